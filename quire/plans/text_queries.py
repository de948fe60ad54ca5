"""Registered queries: whole-file line and text operators over the corpus.

Request parameters (line ranges, new content, path spellings) are derived per file from its
``doc_id`` so every file in the table gets its own request and the boundary cases (range past
the end, end before start, insert at 0, ...) occur across the corpus. Nothing is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunking, diff, lines, metrics, paths, rewrite, structures
from quire.plans import inputs
from quire.plans.registry import register, table
from quire.plans.sqltext import FILES_CTE, js_trim, lit, utf16_length, ws_tokens

CODE_FILES_CTE = """code_files AS (
  SELECT '/code/p' || CAST(p_partkey AS VARCHAR) || '.js' AS path,
         concat_ws(chr(10), 'function f_' || CAST(p_partkey AS VARCHAR) || '(a) {', 'class C' || CAST(p_size AS VARCHAR) || ' {',
                   '  m' || CAST(p_size AS VARCHAR) || '(x) { // note', '  if (x) {', 'const g = (y) => y;',
                   '/* ' || p_name, '*/', '', '}') AS content
  FROM part)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, sz = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("function f_"), k, F.lit("(a) {")),
        F.concat(F.lit("class C"), sz, F.lit(" {")),
        F.concat(F.lit("  m"), sz, F.lit("(x) { // note")),
        F.lit("  if (x) {"),
        F.lit("const g = (y) => y;"),
        F.concat(F.lit("/* "), F.col("p_name")),
        F.lit("*/"),
        F.lit(""),
        F.lit("}"),
    )
    return p.select(F.concat(F.lit("/code/p"), k, F.lit(".js")).alias("path"), content.alias("content"))


# ---------------------------------------------------------------------------- metrics

@register(
    "file_metrics",
    f"""WITH {FILES_CTE}
SELECT path, CAST(strlen(content) AS BIGINT) AS size_bytes, CAST({utf16_length('content')} AS BIGINT) AS utf16_length,
       CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count, md5(content) AS md5
FROM files""",
)
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_metrics(inputs.files(spark, sf_dir))


@register(
    "truncate_for_embedding",
    f"WITH {FILES_CTE} SELECT path, substring(content, 1, 1000) AS text FROM files",
)
def truncate_for_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    return f.select("path", chunking.truncate_for_embedding(F.col("content"), 1000).alias("text"))


@register(
    "token_chunks",
    f"""WITH {FILES_CTE},
t AS (SELECT path, {ws_tokens('content')} AS toks FROM files),
c AS (SELECT path, toks, unnest(generate_series(0, CAST(ceil(len(toks) / {chunking.TOKENS_PER_CHUNK}) AS BIGINT) - 1)) AS chunk_id FROM t)
SELECT path, CAST(chunk_id AS INTEGER) AS chunk_id,
       array_to_string(list_slice(toks, chunk_id * {chunking.TOKENS_PER_CHUNK} + 1, (chunk_id + 1) * {chunking.TOKENS_PER_CHUNK}), ' ') AS text
FROM c""",
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_chunks(inputs.files(spark, sf_dir))


# ---------------------------------------------------------------------------- line ranges

def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    d = F.col("doc_id")
    start = 1 + d % 4
    end = F.when(d % 6 == 0, F.lit(None)).when(d % 6 == 1, start - 1).when(d % 6 == 2, start + 3).otherwise(40 + d % 9)
    return f.select("path", "content", (2 + d % 5).alias("chunk_size"), start.alias("start_line"), end.alias("end_line"))


@register(
    "line_chunks",
    f"""WITH {FILES_CTE},
req AS (
  SELECT path, string_split(content, chr(10)) AS lines, 2 + doc_id % 5 AS cs, 1 + doc_id % 4 AS req_start,
         CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN doc_id % 4 WHEN 2 THEN 4 + doc_id % 4 ELSE 40 + doc_id % 9 END AS req_end
  FROM files),
b AS (
  SELECT path, lines, cs, len(lines) AS total, greatest(1, req_start) AS s,
         CASE WHEN req_end IS NULL OR req_end = 0 THEN len(lines) ELSE least(req_end, len(lines)) END AS e
  FROM req),
c AS (
  SELECT *, greatest(e - s + 1, 0) AS n_req,
         CASE WHEN cs < 1 THEN 'chunk size must be at least 1'
              WHEN s > total THEN printf('start line %d is past the last line %d', s, total) END AS error
  FROM b),
o AS (SELECT *, unnest(CASE WHEN error IS NULL AND n_req > 0 THEN generate_series(0, n_req - 1, cs) ELSE [NULL] END) AS i FROM c)
SELECT path, error IS NULL AS success, error, CAST(total AS INTEGER) AS total_lines,
       CAST(i // cs AS INTEGER) AS chunk_index, CAST(s + i AS INTEGER) AS start_line,
       CASE WHEN i IS NOT NULL THEN CAST(least(s + i + least(cs, n_req - i) - 1, e) AS INTEGER) END AS end_line,
       CASE WHEN i IS NOT NULL THEN array_to_string(list_slice(lines, s + i, s + i + least(cs, n_req - i) - 1), chr(10)) END AS content,
       CASE WHEN i IS NOT NULL THEN CAST(least(cs, n_req - i) AS INTEGER) END AS line_count
FROM o""",
)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chunk_requests(spark, sf_dir)
    return lines.line_chunks(r, "content", F.col("chunk_size"), F.col("start_line"), F.col("end_line"))


def _edit_sql(body: str) -> str:
    return f"""WITH {FILES_CTE},
{body}
SELECT path, error IS NULL AS success, error, {{extra}}
       CAST(len(res) AS INTEGER) AS total_lines, array_to_string(res, chr(10)) AS new_content,
       md5(array_to_string(res, chr(10))) AS file_hash
FROM y"""


_RANGE_ERR = """CASE WHEN s < 1 OR s > len(lines) THEN printf('invalid start line: %d (total lines: %d)', s, len(lines))
            WHEN e < s OR e > len(lines) THEN printf('invalid end line: %d', e) END"""

REPLACE_LINES_SQL = _edit_sql(
    f"""r AS (
  SELECT path, string_split(content, chr(10)) AS lines, 1 + doc_id % 5 AS s, 1 + doc_id % 5 + doc_id % 3 AS e,
         string_split(CASE WHEN doc_id % 2 = 0 THEN 'edited ' || CAST(doc_id AS VARCHAR) || chr(10) || 'second line' ELSE '' END, chr(10)) AS new
  FROM files),
x AS (SELECT *, {_RANGE_ERR} AS error FROM r),
y AS (SELECT *, CASE WHEN error IS NULL THEN list_concat(list_slice(lines, 1, s - 1), new, list_slice(lines, e + 1, len(lines))) END AS res FROM x)"""
).replace(
    "{extra}",
    "CASE WHEN error IS NULL THEN CAST(e - s + 1 AS INTEGER) END AS replaced_lines, "
    "CASE WHEN error IS NULL THEN CAST(len(new) AS INTEGER) END AS new_lines,",
)


@register("replace_lines", REPLACE_LINES_SQL)
def replace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    d = F.col("doc_id")
    new = F.when(d % 2 == 0, F.concat(F.lit("edited "), d.cast("string"), F.lit("\nsecond line"))).otherwise(F.lit(""))
    return lines.replace_lines(f, 1 + d % 5, 1 + d % 5 + d % 3, new)


DELETE_LINES_SQL = _edit_sql(
    f"""r AS (
  SELECT path, string_split(content, chr(10)) AS lines, 1 + doc_id % 4 AS s, doc_id % 4 + doc_id % 6 AS e
  FROM files),
x AS (SELECT *, {_RANGE_ERR} AS error FROM r),
y AS (SELECT *, CASE WHEN error IS NULL THEN list_concat(list_slice(lines, 1, s - 1), list_slice(lines, e + 1, len(lines))) END AS res FROM x)"""
).replace("{extra}", "CASE WHEN error IS NULL THEN CAST(e - s + 1 AS INTEGER) END AS deleted_lines,")


@register("delete_lines", DELETE_LINES_SQL)
def delete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    d = F.col("doc_id")
    return lines.delete_lines(f, 1 + d % 4, d % 4 + d % 6)


INSERT_LINES_SQL = _edit_sql(
    """r AS (
  SELECT path, string_split(content, chr(10)) AS lines, doc_id % 7 - 1 AS k,
         string_split('inserted ' || CAST(doc_id AS VARCHAR), chr(10)) AS new
  FROM files),
x AS (SELECT *, CASE WHEN k < 0 OR k > len(lines) THEN printf('invalid insert position: %d', k) END AS error FROM r),
y AS (SELECT *, CASE WHEN error IS NULL THEN list_concat(list_slice(lines, 1, k), new, list_slice(lines, k + 1, len(lines))) END AS res FROM x)"""
).replace("{extra}", "CASE WHEN error IS NULL THEN CAST(len(new) AS INTEGER) END AS inserted_lines,")


@register("insert_lines", INSERT_LINES_SQL)
def insert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    d = F.col("doc_id")
    return lines.insert_lines(f, d % 7 - 1, F.concat(F.lit("inserted "), d.cast("string")))


# ---------------------------------------------------------------------------- find / replace

# The find/replace requests run over every page.
LITERAL_FIND, LITERAL_REPLACE = "</li>", "</li>\n"
REGEX_FIND, REGEX_REPLACE = '<a href="/([A-Za-z]+)">', "$1"


@register(
    "replace_literal",
    f"""SELECT page_id, true AS success, CAST(NULL AS VARCHAR) AS error,
       CAST((length(html) - length(replace(html, {lit(LITERAL_FIND)}, ''))) / {len(LITERAL_FIND)} AS INTEGER) AS replacements,
       replace(html, {lit(LITERAL_FIND)}, {lit(LITERAL_REPLACE)}) AS new_content
FROM pages""",
)
def replace_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return rewrite.replace_literal(p, LITERAL_FIND, LITERAL_REPLACE, "html", keep=("page_id",))


@register(
    "replace_regex",
    f"""SELECT page_id, true AS success, CAST(NULL AS VARCHAR) AS error,
       CAST(len(regexp_extract_all(html, {lit(REGEX_FIND)})) AS INTEGER) AS replacements,
       regexp_replace(html, {lit(REGEX_FIND)}, {lit(REGEX_REPLACE)}, 'g') AS new_content
FROM pages""",
)
def replace_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return rewrite.replace_regex(p, REGEX_FIND, REGEX_REPLACE, "html", keep=("page_id",))


# ---------------------------------------------------------------------------- stripping

def _strip_chain_sql(expr: str, level: str) -> str:
    out = expr
    for pattern, repl in rewrite.STRIP_STEPS[level]:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(repl)}, 'g')"
    return out


def _strip_sql(level: str) -> str:
    s = _strip_chain_sql("content", level)
    return f"""WITH {CODE_FILES_CTE},
s AS (SELECT path, content, {s} AS stripped FROM code_files)
SELECT path, CAST({utf16_length('content')} AS BIGINT) AS original_size,
       CAST({utf16_length('stripped')} AS BIGINT) AS compressed_size,
       round((1 - {utf16_length('stripped')} / nullif({utf16_length('content')}, 0)) * 100, 2) AS compression_ratio,
       stripped AS compressed_content
FROM s"""


def _register_strip(level: str) -> None:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rewrite.strip(code_files(spark, sf_dir), level)

    register(f"strip_{level}", _strip_sql(level))(q)


for _level in ("light", "medium", "aggressive"):
    _register_strip(_level)


@register(
    "strip_ratio",
    f"""WITH {CODE_FILES_CTE}
SELECT path,
  {' ,'.join(f"round((1 - {utf16_length(_strip_chain_sql('content', lv))} / nullif({utf16_length('content')}, 0)) * 100, 2) AS ratio_{lv}" for lv in ("light", "medium", "aggressive"))}
FROM code_files""",
)
def strip_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return code_files(spark, sf_dir).select(
        "path", *[rewrite.strip_ratio(c, rewrite.strip_content(c, lv)).alias(f"ratio_{lv}") for lv in ("light", "medium", "aggressive")]
    )


# ---------------------------------------------------------------------------- structures

def _structures_sql() -> str:
    parts = []
    for _, kind, rx in structures.STRUCTURE_PATTERNS:
        parts.append(
            f"SELECT path, line_no, {lit(kind)} AS type, regexp_extract(line, {lit(rx)}, 1) AS name, line FROM l "
            f"WHERE regexp_matches(line, {lit(rx)})"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"""{CODE_FILES_CTE},
l AS (SELECT path, unnest(string_split(content, chr(10))) AS line,
             unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no FROM code_files),
s AS ({union})"""


@register(
    "code_structures",
    f"WITH {_structures_sql()}\nSELECT path, CAST(line_no AS INTEGER) AS line, type, name, {js_trim('line')} AS content FROM s",
)
def code_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.code_structures(code_files(spark, sf_dir))


@register(
    "structure_summary",
    f"""WITH {_structures_sql()}
SELECT path, count(*) AS total_structures, CAST(count_if(type = 'function') AS BIGINT) AS functions,
       CAST(count_if(type = 'class') AS BIGINT) AS classes, CAST(count_if(type = 'method') AS BIGINT) AS methods,
       CAST(count_if(type = 'arrow_function') AS BIGINT) AS arrow_functions
FROM s GROUP BY path""",
)
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.structure_summary(structures.code_structures(code_files(spark, sf_dir)))


# ---------------------------------------------------------------------------- diff

def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_1, content_1, path_2, content_2) for neighbouring documents doc_id, doc_id + 1."""
    f = inputs.files(spark, sf_dir)
    a = f.select(F.col("doc_id").alias("d1"), F.col("path").alias("path_1"), F.col("content").alias("content_1"))
    b = f.select(F.col("doc_id").alias("d2"), F.col("path").alias("path_2"), F.col("content").alias("content_2"))
    return a.join(b, F.col("d2") == F.col("d1") + 1).select("path_1", "content_1", "path_2", "content_2")


PAIRS_CTE = f"""{FILES_CTE},
p AS (SELECT f1.path AS path_1, f2.path AS path_2, f1.content AS c1, f2.content AS c2,
             string_split(f1.content, chr(10)) AS l1, string_split(f2.content, chr(10)) AS l2
      FROM files f1 JOIN files f2 ON f2.doc_id = f1.doc_id + 1),
d AS (SELECT path_1, path_2, i AS line_number, coalesce(l1[i], '') AS line_1, coalesce(l2[i], '') AS line_2
      FROM (SELECT *, unnest(generate_series(1, greatest(len(l1), len(l2)))) AS i FROM p))"""


@register(
    "line_diff",
    f"""WITH {PAIRS_CTE},
f AS (SELECT * FROM d WHERE line_1 <> line_2)
SELECT path_1, path_2, CAST(line_number AS INTEGER) AS line_number,
       CASE WHEN line_1 = '' THEN 'added' WHEN line_2 = '' THEN 'deleted' ELSE 'modified' END AS kind, line_1, line_2
FROM f""",
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.line_diff(file_pairs(spark, sf_dir))


@register(
    "diff_summary",
    f"""WITH {PAIRS_CTE},
n AS (SELECT path_1, path_2, count_if(line_1 <> line_2) AS total FROM d GROUP BY path_1, path_2)
SELECT p.path_1, p.path_2, CAST(n.total AS INTEGER) AS total_differences, n.total = 0 AS identical,
       CAST({utf16_length('c1')} AS BIGINT) AS size_1, CAST({utf16_length('c2')} AS BIGINT) AS size_2,
       CAST(len(l1) AS INTEGER) AS lines_1, CAST(len(l2) AS INTEGER) AS lines_2
FROM p JOIN n ON p.path_1 = n.path_1 AND p.path_2 = n.path_2""",
)
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_summary(file_pairs(spark, sf_dir))


# ---------------------------------------------------------------------------- paths

# Fixed value: the project root paths are resolved against.
PROJECT_ROOT = "/corpus"


def path_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i, s, lg = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    k = F.col("doc_id") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit(PROJECT_ROOT + "/"), s, F.lit("/"), i, F.lit(".txt")))
        .when(k == 1, F.concat(s, F.lit("/"), lg, F.lit("/"), i, F.lit(".txt")))
        .when(k == 2, F.concat(F.lit("./"), s, F.lit("/"), i, F.lit(".txt")))
        .when(k == 3, F.concat(F.lit("../"), i, F.lit(".txt")))
        .when(k == 4, F.concat(s, F.lit("/../../"), lg, F.lit("/"), i, F.lit(".txt")))
        .when(k == 5, F.concat(s, F.lit("/./"), lg, F.lit("//"), i, F.lit(".txt")))
        .otherwise(F.concat(F.lit("../corpus-"), s, F.lit("/"), i, F.lit(".txt")))
    )
    return d.select("doc_id", raw.alias("raw_path"))


_FOLD = "lambda acc, s: CASE WHEN s IN ('', '.') THEN acc WHEN s = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, s) END"


@register(
    "normalize_path",
    f"""WITH r AS (
  SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN '{PROJECT_ROOT}/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt'
    WHEN 1 THEN source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'
    WHEN 2 THEN './' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt'
    WHEN 3 THEN '../' || CAST(doc_id AS VARCHAR) || '.txt'
    WHEN 4 THEN source || '/../../' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'
    WHEN 5 THEN source || '/./' || lang || '//' || CAST(doc_id AS VARCHAR) || '.txt'
    ELSE '../corpus-' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS raw_path
  FROM documents),
g AS (SELECT doc_id, raw_path, CASE WHEN starts_with(raw_path, './') THEN substr(raw_path, 3) ELSE raw_path END AS rel FROM r),
h AS (SELECT doc_id, raw_path,
        '/' || array_to_string(list_reduce(string_split(rel, '/'), {_FOLD}, ['{PROJECT_ROOT.strip('/')}']), '/') AS resolved,
        coalesce(list_filter(string_split(rel, '/'), lambda s: s <> '')[-1], '') AS base
      FROM g)
SELECT doc_id, raw_path,
  CASE WHEN starts_with(raw_path, '/') THEN raw_path
       WHEN starts_with(resolved, '{PROJECT_ROOT}') THEN resolved
       ELSE '/' || array_to_string(list_reduce([base], {_FOLD}, ['{PROJECT_ROOT.strip('/')}']), '/') END AS normalized
FROM h""",
)
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = path_requests(spark, sf_dir)
    return r.select("doc_id", "raw_path", paths.normalize_path(F.col("raw_path"), PROJECT_ROOT).alias("normalized"))

