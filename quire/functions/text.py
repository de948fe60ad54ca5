"""Column expressions over text: character classes, lines, lengths, tokens.

One module owns the regex character classes so every operator (and every oracle query)
uses the same definitions. All patterns here are valid in both Java regex (Spark) and RE2
(DuckDB, used by the oracle), and behave the same on the inputs we feed them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the semantics being reproduced).
#
# Python's Unicode whitespace set (str.isspace / re \s): tab, LF, VT, FF, CR, the four
# information separators 0x1C-0x1F, NEL 0x85 and every Unicode separator (Zs, Zl, Zp).
PY_WS = r"\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}"
# Characters kept by the BM25 cleaner: word characters (letters, numbers, underscore),
# whitespace and  . ( ) [ ] { } = + - * / < > ! & | ^ %
BM25_DROP = r"[^\p{L}\p{N}_" + PY_WS + r".()\[\]{}=+\-*/<>!&|^%]"
# JavaScript's \s: ASCII whitespace, NBSP, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000 and the byte-order mark U+FEFF.
JS_WS = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# JavaScript's '.': anything but a line terminator.
JS_DOT = r"[^\n\r\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------------------

PY_WS_RUN = "[" + PY_WS + "]+"


def lines(content: Column) -> Column:
    """``content.split('\\n')``: a trailing newline yields a final empty line; '' is one line."""
    return F.split(content, "\n", -1)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units (what a JavaScript string reports)."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def utf8_bytes(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def clean_for_bm25(s: Column) -> Column:
    """Replace characters outside word/space/code punctuation by a space, squeeze, trim."""
    cleaned = F.regexp_replace(s, BM25_DROP, " ")
    squeezed = F.regexp_replace(cleaned, PY_WS_RUN, " ")
    return F.regexp_replace(squeezed, "^ | $", "")


def bm25_tokens(s: Column) -> Column:
    """clean -> lower -> split on whitespace; duplicates kept, empty tokens dropped."""
    parts = F.split(F.lower(F.regexp_replace(s, BM25_DROP, " ")), PY_WS_RUN, -1)
    return F.filter(parts, lambda t: t != F.lit(""))


def ws_tokens(s: Column) -> Column:
    """Python ``str.split()``: runs of non-whitespace."""
    return F.filter(F.split(s, PY_WS_RUN, -1), lambda t: t != F.lit(""))


def js_trim(s: Column) -> Column:
    """JavaScript ``String.prototype.trim``."""
    return F.regexp_replace(s, "^" + JS_WS + "+|" + JS_WS + "+$", "")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


# Note on exploding computed arrays: operators use explode_outer / posexplode_outer /
# inline_outer followed by a NOT NULL filter. The inner variants make the optimizer infer a
# ``size(array) > 0`` filter and push it below the exchange, so the whole array expression
# (tokenising, embedding) would be computed twice, the first time before any repartition.


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (a one-argument lambda over columns).

    Spark re-evaluates an expression each time a higher-order-function lambda refers to it;
    routing it through a one-element ``transform`` binds it to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
