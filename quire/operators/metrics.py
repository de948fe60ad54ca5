"""Per-file size, length, line-count and hash metrics (column expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lines as split_lines
from quire.functions.text import utf16_length, utf8_bytes


def file_metrics(df: DataFrame, content_col: str = "content", keep=("path",)) -> DataFrame:
    c = F.col(content_col)
    return df.select(
        *keep,
        utf8_bytes(c).alias("size_bytes"),
        utf16_length(c).alias("utf16_length"),
        F.size(split_lines(c)).alias("line_count"),
        F.md5(c).alias("md5"),
    )
