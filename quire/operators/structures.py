"""Regex structure extraction per line (functions, classes, methods, arrow functions).

The per-file line array is scanned with ``transform`` inside the row, so only matches are
exploded into rows; no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import JS_WS, js_trim
from quire.functions.text import lines as split_lines

_W = "[A-Za-z0-9_]"
# The four line patterns, in the order they are tried on each line
# (JavaScript's \s and ASCII \w spelled out).
STRUCTURE_PATTERNS: list[tuple[str, str, str]] = [
    ("function", "function", "^" + JS_WS + "*function" + JS_WS + "+(" + _W + "+)" + JS_WS + r"*\("),
    ("class", "class", "^" + JS_WS + "*class" + JS_WS + "+(" + _W + "+)"),
    ("method", "method", "^" + JS_WS + "*(" + _W + "+)" + JS_WS + r"*\([^)]*\)" + JS_WS + r"*\{"),
    ("arrow", "arrow_function", "^" + JS_WS + "*const" + JS_WS + "+(" + _W + "+)" + JS_WS + "*=" + JS_WS + r"*\([^)]*\)" + JS_WS + "*=>"),
]
STRUCTURE_FILTERS = ("all", "function", "class", "method", "arrow")


def code_structures(df: DataFrame, structure_type: str = "all", content_col: str = "content", keep=("path",)) -> DataFrame:
    """(keep..., line, type, name, content) for every match; a line can match several types."""
    if structure_type not in STRUCTURE_FILTERS:
        raise ValueError(f"unknown structure type {structure_type!r}")
    pats = [p for p in STRUCTURE_PATTERNS if structure_type in ("all", p[0])]

    def per_line(line, i):
        return F.array(
            *[
                F.when(
                    line.rlike(rx),
                    F.struct(
                        (i + 1).alias("line"),
                        F.lit(kind).alias("type"),
                        F.regexp_extract(line, rx, 1).alias("name"),
                        js_trim(line).alias("content"),
                    ),
                )
                for _, kind, rx in pats
            ]
        )

    found = F.filter(F.flatten(F.transform(split_lines(F.col(content_col)), per_line)), lambda s: s.isNotNull())
    return df.select(*keep, F.inline_outer(found)).where(F.col("line").isNotNull())


def structure_summary(structures: DataFrame, keys=("path",)) -> DataFrame:
    """Per file: total and per-type structure counts."""
    return structures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_structures"),
        F.count_if(F.col("type") == "function").alias("functions"),
        F.count_if(F.col("type") == "class").alias("classes"),
        F.count_if(F.col("type") == "method").alias("methods"),
        F.count_if(F.col("type") == "arrow_function").alias("arrow_functions"),
    )
