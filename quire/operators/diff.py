"""Positional (line-by-line, not LCS) comparison of file pairs.

Pairs are an equi-join of a pair table with the file table (twice); the comparison itself
is ``zip_with`` over the two line arrays inside the joined row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lines as split_lines
from quire.functions.text import utf16_length


def _differences(c1, c2):
    z = F.zip_with(split_lines(c1), split_lines(c2), lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))
    numbered = F.transform(z, lambda x, i: F.struct((i + 1).alias("line_number"), x["a"].alias("line_1"), x["b"].alias("line_2")))
    return F.filter(numbered, lambda x: x["line_1"] != x["line_2"])


def line_diff(pairs: DataFrame, c1: str = "content_1", c2: str = "content_2", keep=("path_1", "path_2"), limit: int | None = None) -> DataFrame:
    """One row per differing line (the first ``limit`` per pair, if given): kind = modified /
    deleted / added, where an empty left line counts as absent (so it reports 'added')."""
    listed = _differences(F.col(c1), F.col(c2))
    listed = listed if limit is None else F.slice(listed, 1, limit)
    rows = pairs.select(*keep, F.inline_outer(listed)).where(F.col("line_number").isNotNull())
    kind = (
        F.when(F.col("line_1") == "", F.lit("added"))
        .when(F.col("line_2") == "", F.lit("deleted"))
        .otherwise(F.lit("modified"))
    )
    return rows.select(*keep, "line_number", kind.alias("kind"), "line_1", "line_2")


def diff_summary(pairs: DataFrame, c1: str = "content_1", c2: str = "content_2", keep=("path_1", "path_2")) -> DataFrame:
    staged = pairs.select(*keep, c1, c2, F.size(_differences(F.col(c1), F.col(c2))).alias("_total"))
    total = F.col("_total")
    return staged.select(
        *keep,
        total.alias("total_differences"),
        (total == 0).alias("identical"),
        utf16_length(F.col(c1)).alias("size_1"),
        utf16_length(F.col(c2)).alias("size_2"),
        F.size(split_lines(F.col(c1))).alias("lines_1"),
        F.size(split_lines(F.col(c2))).alias("lines_2"),
    )
