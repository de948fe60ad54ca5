"""Find/replace and comment stripping as column expressions (JVM regex, whole-stage codegen).

Patterns are written so that Java regex and RE2 agree: JavaScript's ``\\s`` and ``.`` are
spelled out as explicit classes (``JS_WS``, ``JS_DOT``) because each engine defines them
differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import JS_DOT, JS_WS, utf16_length

# The three compression levels, as ordered (pattern, replacement) steps.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = "//" + JS_DOT + "*"
BLANK_LINES = "(?m)^" + JS_WS + r"*\n"
STRIP_STEPS: dict[str, list[tuple[str, str]]] = {
    "light": [(r"[ \t]+", " "), (r"\n" + JS_WS + r"*\n", "\n")],
    "medium": [(BLOCK_COMMENT, ""), (LINE_COMMENT, ""), (BLANK_LINES, ""), (r"[ \t]+", " ")],
    "aggressive": [
        (BLOCK_COMMENT, ""),
        (LINE_COMMENT, ""),
        (BLANK_LINES, ""),
        (JS_WS + "+", " "),
        (";" + JS_WS + r"*\}", ";}"),
        (r"\{" + JS_WS + "*", "{"),
        (JS_WS + r"*\}", "}"),
    ],
}


def _java_literal_replacement(s: str) -> str:
    """Escape a replacement so Java's Matcher treats ``$`` and ``\\`` literally."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def strip_content(content: Column, level: str) -> Column:
    out = content
    for pattern, repl in STRIP_STEPS[level]:
        out = F.regexp_replace(out, pattern, _java_literal_replacement(repl))
    return out


def strip_ratio(original: Column, stripped: Column) -> Column:
    """round((1 - new/old) * 100, 2) on UTF-16 lengths; NULL for empty input."""
    old = utf16_length(original)
    return F.round((F.lit(1.0) - utf16_length(stripped) / F.nullif(old, F.lit(0))) * 100, 2)


def strip(df: DataFrame, level: str = "medium", content_col: str = "content", keep=("path",)) -> DataFrame:
    if level not in STRIP_STEPS:
        raise ValueError(f"unknown level {level!r}")
    # two projections: the stripped text is computed once and referenced three times (the
    # optimizer does not inline a non-trivial expression that has several consumers)
    staged = df.select(*keep, F.col(content_col).alias("_c"), strip_content(F.col(content_col), level).alias("_s"))
    return staged.select(
        *keep,
        utf16_length(F.col("_c")).alias("original_size"),
        utf16_length(F.col("_s")).alias("compressed_size"),
        strip_ratio(F.col("_c"), F.col("_s")).alias("compression_ratio"),
        F.col("_s").alias("compressed_content"),
    )


def replace_literal(df: DataFrame, pattern: str, replacement: str, content_col: str = "content", keep=("path",)) -> DataFrame:
    """Replace every non-overlapping occurrence; count = removed length / pattern length.
    An empty pattern is rejected per row (``success`` false)."""
    c = F.col(content_col)
    if pattern == "":
        return df.select(*keep, F.lit(False).alias("success"), F.lit("empty search pattern").alias("error"),
                         F.lit(None).cast("int").alias("replacements"), F.lit(None).cast("string").alias("new_content"))
    count = ((F.length(c) - F.length(F.replace(c, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")
    return df.select(
        *keep,
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
        count.alias("replacements"),
        F.replace(c, F.lit(pattern), F.lit(replacement)).alias("new_content"),
    )


def replace_regex(df: DataFrame, pattern: str, replacement: str, content_col: str = "content", keep=("path",)) -> DataFrame:
    """Global regex replace; the replacement is literal (``$1`` and ``\\1`` are not expanded)."""
    c = F.col(content_col)
    if pattern == "":
        return df.select(*keep, F.lit(False).alias("success"), F.lit("empty search pattern").alias("error"),
                         F.lit(None).cast("int").alias("replacements"), F.lit(None).cast("string").alias("new_content"))
    return df.select(
        *keep,
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
        F.regexp_count(c, F.lit(pattern)).cast("int").alias("replacements"),
        F.regexp_replace(c, pattern, _java_literal_replacement(replacement)).alias("new_content"),
    )
