"""DuckDB SQL fragments mirroring the column expressions in ``quire.functions.text``.

The oracle queries are written with these so the Spark side and the SQL side share one
definition of every regex class.
"""

from __future__ import annotations

from quire.functions.text import BM25_DROP, JS_DOT, JS_WS, PY_WS_RUN  # noqa: F401  (re-exported for the query modules)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bm25_tokens(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower(regexp_replace({expr}, {lit(BM25_DROP)}, ' ', 'g')), "
        f"{lit(PY_WS_RUN)}), lambda t: t <> '')"
    )


def ws_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(PY_WS_RUN)}), lambda t: t <> '')"


def js_trim(expr: str) -> str:
    return f"regexp_replace({expr}, {lit('^' + JS_WS + '+|' + JS_WS + '+$')}, '', 'g')"


def utf16_length(expr: str) -> str:
    # code points plus one extra unit per supplementary-plane character
    return f"(length({expr}) + length(regexp_replace({expr}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def lines(expr: str) -> str:
    return f"string_split({expr}, chr(10))"


FILES_CTE = """files AS (
  SELECT doc_id, '/corpus/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         text AS content
  FROM documents)"""
