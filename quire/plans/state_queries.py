"""Registered queries: cache, history and change-set tables derived from the driver tables.

Mapping: the ``events`` log is the cache write log and the operation history (event_type ->
cache type / operation type, user_id -> key / file, props -> payload, ts -> time); ``now``
is the latest event time (a scalar subquery), so results do not depend on the wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.embed import embed
from quire.functions.text import rounded, utf16_length
from quire.functions.vectors import array_size
from quire.operators import cache, changes, history
from quire.plans import inputs
from quire.plans.registry import register, table
from quire.session import stored
from quire.plans.sqltext import FILES_CTE, utf16_length as utf16_sql
from quire.plans.vector_queries import embed_ctes, with_index_dim

# Event type -> cache type, and event type -> operation type.
CACHE_TYPE_OF_EVENT = {"view": "embeddings", "click": "reranking", "purchase": "llm_responses"}
OPERATION_OF_EVENT = {"view": "replace_lines", "click": "insert_lines", "purchase": "delete_lines", "signup": "find_and_replace", "error": "batch_edit"}

ISO_SPARK = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_SQL = "%Y-%m-%dT%H:%M:%S.%gZ"


def _case_sql(col: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


def _case(col: str, mapping: dict[str, str], default):
    out = None
    for k, v in mapping.items():
        out = (F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v)))
    return out.otherwise(default)


def now_of(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "events").select(F.max("ts")).scalar()


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ctype = _case("event_type", CACHE_TYPE_OF_EVENT, F.col("event_type"))
    return e.select(
        ctype.alias("cache_type"),
        F.md5(F.concat(ctype, F.lit(":"), F.col("user_id").cast("string"))).alias("key"),
        F.col("props").alias("payload"),
        F.octet_length("props").cast("long").alias("size_bytes"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def live_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.live_entries(cache_log(spark, sf_dir))


NOW_SQL = "(SELECT max(ts) FROM events)"
CACHE_CTES = f"""cache_log AS (
  SELECT cache_type, md5(cache_type || ':' || CAST(user_id AS VARCHAR)) AS key, props AS payload,
         CAST(strlen(props) AS BIGINT) AS size_bytes, ts AS created_at, event_id AS seq
  FROM (SELECT *, {_case_sql('event_type', CACHE_TYPE_OF_EVENT, 'event_type')} AS cache_type FROM events)),
live AS (
  SELECT cache_type, key, payload, size_bytes, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY cache_type, key ORDER BY created_at DESC, seq DESC) AS rn FROM cache_log)
  WHERE rn = 1),
config AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {d})" for t, d in cache.CACHE_TTL_DAYS)}) t(cache_type, ttl_days))"""


# ---------------------------------------------------------------------------- cache

@register(
    "content_key",
    """SELECT doc_id, md5(text) AS content_key, sha256(to_json({'cache_type': 'embeddings', 'text': text})) AS request_key FROM documents""",
)
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        cache.content_key(F.col("text")).alias("content_key"),
        cache.request_key(F.lit("embeddings").alias("cache_type"), F.col("text").alias("text")).alias("request_key"),
    )


@register(
    "cache_lookup",
    f"""WITH {CACHE_CTES},
req AS (SELECT cache_type, key FROM cache_log UNION SELECT 'llm_responses', md5('llm_responses:' || CAST(doc_id AS VARCHAR)) FROM documents),
j AS (SELECT r.cache_type, r.key, l.created_at, c.ttl_days * 86400 AS ttl_s,
             (epoch_us({NOW_SQL}) - epoch_us(l.created_at)) / 1e6 AS age
      FROM req r LEFT JOIN live l ON l.cache_type = r.cache_type AND l.key = r.key LEFT JOIN config c ON c.cache_type = r.cache_type)
SELECT cache_type, key, round(age, 6) AS age_seconds,
       CASE WHEN created_at IS NULL THEN 'miss' WHEN key < '2' THEN 'bypassed' WHEN ttl_s IS NULL OR age < ttl_s THEN 'hit' ELSE 'expired' END AS status
FROM j""",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cache_log(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.lit("llm_responses").alias("cache_type"), F.md5(F.concat(F.lit("llm_responses:"), F.col("doc_id").cast("string"))).alias("key"))
    req = log.select("cache_type", "key").unionByName(docs).distinct().withColumn("force", F.col("key") < "2")
    out = cache.lookup(req, cache.live_entries(log), cache.cache_config(spark), now_of(spark, sf_dir), force="force")
    return out.select("cache_type", "key", rounded(F.col("age_seconds")).alias("age_seconds"), "status")


@register(
    "cache_stats",
    f"""WITH {CACHE_CTES},
j AS (SELECT c.cache_type, c.ttl_days, l.key, l.size_bytes, l.created_at FROM config c LEFT JOIN live l ON l.cache_type = c.cache_type),
g AS (
  SELECT cache_type, count(key) AS files_count, round(coalesce(sum(size_bytes), 0) / 1024 / 1024, 2) AS total_size_mb,
         min(created_at) AS oldest, max(created_at) AS newest, max(ttl_days) AS ttl_days
  FROM j GROUP BY cache_type
  UNION ALL
  SELECT NULL, count(key), round(coalesce(sum(size_bytes), 0) / 1024 / 1024, 2), min(created_at), max(created_at), NULL FROM j)
SELECT coalesce(cache_type, 'all') AS cache_type, files_count, total_size_mb,
       strftime(oldest, '{ISO_SQL}') AS oldest, strftime(newest, '{ISO_SQL}') AS newest, ttl_days
FROM g""",
)
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cache.stats(live_cache(spark, sf_dir), cache.cache_config(spark))
    return s.select(
        "cache_type", "files_count", "total_size_mb",
        F.date_format("oldest", ISO_SPARK).alias("oldest"), F.date_format("newest", ISO_SPARK).alias("newest"), "ttl_days",
    )


@register(
    "cache_clear",
    f"""WITH {CACHE_CTES}
SELECT c.cache_type, count(l.key) AS files_deleted, round(coalesce(sum(l.size_bytes), 0) / 1024 / 1024, 2) AS space_freed_mb
FROM config c LEFT JOIN live l ON l.cache_type = c.cache_type GROUP BY c.cache_type""",
)
def cache_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _survivors = cache.clear(live_cache(spark, sf_dir), cache.cache_config(spark), "all")
    return report


@register(
    "cache_clear_type",
    f"""WITH {CACHE_CTES}
SELECT cache_type, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM live WHERE cache_type <> 'reranking' GROUP BY cache_type""",
)
def cache_clear_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one type's clearing leaves, per type."""
    _report, survivors = cache.clear(live_cache(spark, sf_dir), cache.cache_config(spark), "reranking")
    return survivors.groupBy("cache_type").agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("size_bytes"))


def _aside_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    return f.select("doc_id", F.md5("content").alias("key"), F.col("content").alias("text"))


@register(
    "cache_aside",
    f"""WITH {FILES_CTE},
req AS (SELECT doc_id, md5(content) AS key, content AS text FROM files),
cached AS (SELECT key, arg_min(embedding, vec_id)::DOUBLE[] AS value FROM req r JOIN embeddings e ON e.vec_id = r.doc_id GROUP BY key),
{embed_ctes("gen", "SELECT key, any_value(text) AS text FROM req WHERE key NOT IN (SELECT key FROM cached) GROUP BY key")},
filled AS (
  SELECT r.doc_id, r.key, 'cache' AS source, c.value FROM req r JOIN cached c ON c.key = r.key
  UNION ALL
  SELECT r.doc_id, r.key, 'generated', g.embedding FROM req r JOIN gen g ON g.key = r.key)
SELECT doc_id, key, source, CAST(len(value) AS INTEGER) AS dimension, round(list_sum(value), 6) AS checksum FROM filled""",
)
def cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = _aside_requests(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    cached = req.join(emb, emb["vec_id"] == req["doc_id"]).groupBy("key").agg(
        F.min_by("embedding", "vec_id").cast("array<double>").alias("value")
    )

    def compute(misses: DataFrame) -> DataFrame:
        m = with_index_dim(misses, spark, sf_dir)
        return m.select("key", embed(F.col("text"), F.col("_dim")).alias("value"))

    out = cache.cache_aside(req, cached, compute)
    checksum = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "key", "source", array_size("value").alias("dimension"), rounded(checksum).alias("checksum"))


# ---------------------------------------------------------------------------- history

def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history rows, one per event: the file is document ``user_id`` (absent -> /corpus/missing),
    error events carry no backup and no snapshot."""
    e = table(spark, sf_dir, "events")
    # hash and size are computed once per file, before the join; the content itself only
    # flows through the join for consumers that read snapshot.content (nested-column pruning)
    f = inputs.files(spark, sf_dir).select(
        F.col("doc_id").alias("user_id"), "path", "content", F.md5("content").alias("_hash"), utf16_length(F.col("content")).alias("_size")
    )
    j = e.join(f, "user_id", "left")
    path = F.coalesce(F.col("path"), F.concat(F.lit("/corpus/missing/"), F.col("user_id").cast("string"), F.lit(".txt")))
    backup = F.col("event_type") != "error"
    snap = F.when(backup & F.col("path").isNotNull(), F.struct(
        F.col("content").alias("content"), F.col("_hash").alias("hash"), F.col("_size").alias("size")))
    return j.select(
        F.concat(F.lit("op-"), F.col("event_id").cast("string")).alias("operation_id"),
        _case("event_type", OPERATION_OF_EVENT, F.lit("unknown")).alias("type"),
        path.alias("original_path"),
        F.when(backup, F.concat(path, F.lit(".backup."), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))).alias("backup_path"),
        snap.alias("snapshot"),
        "ts",
        F.col("event_id").alias("seq"),
    )


HISTORY_CTE = f"""{FILES_CTE},
history AS (
  SELECT 'op-' || CAST(e.event_id AS VARCHAR) AS operation_id,
         {_case_sql('e.event_type', OPERATION_OF_EVENT, "'unknown'")} AS type,
         coalesce(f.path, '/corpus/missing/' || CAST(e.user_id AS VARCHAR) || '.txt') AS original_path,
         e.event_type <> 'error' AS has_backup,
         CASE WHEN e.event_type <> 'error' AND f.content IS NOT NULL THEN f.content END AS snap_content,
         e.ts, e.event_id AS seq
  FROM events e LEFT JOIN files f ON f.doc_id = e.user_id)"""


@register(
    "history_stats",
    f"""WITH {HISTORY_CTE},
recent AS (SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) AS recent_rank FROM history)
SELECT operation_id, type, strftime(ts, '{ISO_SQL}') AS ts, has_backup, CAST(recent_rank AS INTEGER) AS recent_rank,
       (SELECT count(*) FROM history) AS total_operations,
       strftime((SELECT min(ts) FROM history), '{ISO_SQL}') AS oldest_operation,
       strftime((SELECT max(ts) FROM history), '{ISO_SQL}') AS newest_operation
FROM recent WHERE recent_rank <= 10""",
)
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = history.stats(history_table(spark, sf_dir))
    return s.select(
        "operation_id", "type", F.date_format("ts", ISO_SPARK).alias("ts"), "has_backup", "recent_rank", "total_operations",
        F.date_format("oldest_operation", ISO_SPARK).alias("oldest_operation"),
        F.date_format("newest_operation", ISO_SPARK).alias("newest_operation"),
    )


@register(
    "snapshot_files",
    f"""WITH {HISTORY_CTE}
SELECT h.operation_id, h.original_path AS path, f.content IS NOT NULL AS success,
       CASE WHEN f.content IS NULL THEN 'file does not exist: ' || h.original_path END AS error,
       md5(f.content) AS hash, CAST({utf16_sql('f.content')} AS BIGINT) AS size
FROM history h LEFT JOIN files f ON f.path = h.original_path""",
)
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = history_table(spark, sf_dir).select("operation_id", F.col("original_path").alias("path"))
    snaps = history.snapshot(req, inputs.files(spark, sf_dir), now_of(spark, sf_dir))
    return snaps.select("operation_id", "path", "success", "error", F.col("snapshot.hash").alias("hash"), F.col("snapshot.size").alias("size"))


@register(
    "rollback",
    f"""WITH {HISTORY_CTE},
req AS (SELECT operation_id FROM history UNION ALL SELECT 'op-none-' || CAST(item_id AS VARCHAR) FROM benchmark)
SELECT r.operation_id, h.snap_content IS NOT NULL AS success,
       CASE WHEN h.operation_id IS NULL THEN 'operation not found: ' || r.operation_id
            WHEN h.snap_content IS NULL THEN 'no snapshot for operation ' || r.operation_id END AS error,
       CASE WHEN h.snap_content IS NOT NULL THEN h.original_path END AS restored_file,
       CASE WHEN h.snap_content IS NOT NULL THEN h.type END AS original_operation,
       md5(h.snap_content) AS restored_hash
FROM req r LEFT JOIN history h ON h.operation_id = r.operation_id""",
)
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation of every type asked back, and ids that no operation has."""
    h = history_table(spark, sf_dir)
    unknown = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("op-none-"), F.col("item_id").cast("string")).alias("operation_id"))
    result, _remaining = history.rollback(h.select("operation_id").unionByName(unknown), h)
    return result.select("operation_id", "success", "error", "restored_file", "original_operation",
                         F.md5("restored_content").alias("restored_hash"))


@register(
    "history_chain",
    f"""WITH {FILES_CTE},
e1 AS (SELECT doc_id, path, content AS c0, 'first ' || CAST(doc_id AS VARCHAR) || chr(10) || content AS c1 FROM files),
e2 AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN c1 || chr(10) || 'second' ELSE c1 END AS c2 FROM e1)
SELECT path, md5(CASE WHEN doc_id % 6 = 0 THEN c1 WHEN doc_id % 5 = 0 THEN c0 ELSE c2 END) AS md5,
       CAST(1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS operations_left
FROM e2""",
)
def history_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits write their before-images to the history, rollbacks restore files and drop theirs:
    every file gets a first line (op-<id>), every third then a last line (op-<id + 10^9>); the first
    edit of every fifth and the second of every sixth file are rolled back."""
    f = inputs.files(spark, sf_dir).select("doc_id", "path", "content")
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000 + n))

    def edit(kind: str, rows: DataFrame, seq, ts):
        return rows.select(F.concat(F.lit("op-"), seq.cast("string")).alias("operation_id"), F.lit(kind).alias("type"), "path", ts.alias("ts"), seq.alias("seq"))

    d = F.col("doc_id")
    h = stored(history.record(None, edit("insert_lines", f, d, at(0)), f.select("path", "content")), "history")
    f = f.withColumn("content", F.concat(F.lit("first "), d.cast("string"), F.lit("\n"), F.col("content")))
    h = history.record(h, edit("insert_lines", f.where(d % 3 == 0), d + 1_000_000_000, at(1)), f.select("path", "content"))
    f = f.withColumn("content", F.when(d % 3 == 0, F.concat("content", F.lit("\nsecond"))).otherwise(F.col("content")))
    asked = f.where(d % 5 == 0).select(F.concat(F.lit("op-"), d.cast("string")).alias("operation_id")).unionByName(
        f.where(d % 6 == 0).select(F.concat(F.lit("op-"), (d + 1_000_000_000).cast("string")).alias("operation_id")))
    h = stored(h, "history")
    result, left = history.rollback(asked, h)
    restored = history.restore(f.select("path", "content"), result)
    counts = left.groupBy(F.col("original_path").alias("path")).agg(F.count(F.lit(1)).alias("operations_left"))
    return restored.join(counts, "path", "left").select("path", F.md5("content").alias("md5"), F.coalesce("operations_left", F.lit(0)).alias("operations_left"))


@register(
    "history_retention",
    f"""SELECT CAST(count_if(ts < {NOW_SQL} - INTERVAL 24 HOURS) AS BIGINT) AS cleaned_count,
       CAST(count_if(NOT (ts < {NOW_SQL} - INTERVAL 24 HOURS)) AS BIGINT) AS remaining_count,
       strftime({NOW_SQL} - INTERVAL 24 HOURS, '{ISO_SQL}') AS cutoff
FROM events""",
)
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select("ts")
    report, _kept = history.retention(h, now_of(spark, sf_dir))
    return report.select("cleaned_count", "remaining_count", F.date_format("cutoff", ISO_SPARK).alias("cutoff"))


# ---------------------------------------------------------------------------- change sets

INSERT_CTE = f"""{FILES_CTE},
batch AS (
  SELECT coalesce(f.path, '/corpus/new/' || CAST(b.item_id AS VARCHAR) || '.txt') AS path, b.text || CASE WHEN t = 0 THEN '' ELSE ' again' END AS content,
         (b.item_id + t) % 2 = 0 AS overwrite, b.item_id + 1000000 * t AS seq
  FROM (SELECT item_id, text, unnest([0, 1, 2]) AS t FROM benchmark) b LEFT JOIN files f ON f.doc_id = b.item_id + 150
  WHERE t = 0 OR b.item_id % 3 = t),
j AS (
  SELECT *, overwrite OR (NOT EXISTS (SELECT 1 FROM files f WHERE f.path = b.path) AND NOT EXISTS (SELECT 1 FROM batch e WHERE e.path = b.path AND e.seq < b.seq)) AS ok
  FROM batch b)"""


def insert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts for existing and new paths, some paths asked for twice."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t"))
    b = b.where((F.col("t") == 0) | (F.col("item_id") % 3 == F.col("t")))
    f = inputs.files(spark, sf_dir).select((F.col("doc_id") - 150).alias("item_id"), "path")
    return b.join(f, "item_id", "left").select(
        F.coalesce("path", F.concat(F.lit("/corpus/new/"), F.col("item_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.when(F.col("t") == 0, F.col("text")).otherwise(F.concat("text", F.lit(" again"))).alias("content"),
        ((F.col("item_id") + F.col("t")) % 2 == 0).alias("overwrite"), (F.col("item_id") + 1_000_000 * F.col("t")).alias("seq"),
    )


@register(
    "corpus_insert",
    f"""WITH {INSERT_CTE}
SELECT path, seq, ok AS success, CASE WHEN NOT ok THEN 'file already exists: ' || path END AS error,
       CASE WHEN ok THEN CAST(strlen(content) AS BIGINT) END AS size_bytes,
       CASE WHEN ok THEN CAST(len(string_split(content, chr(10))) AS INTEGER) END AS line_count,
       CASE WHEN ok THEN md5(content) END AS md5
FROM j""",
)
def corpus_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.corpus_insert(inputs.files(spark, sf_dir), insert_requests(spark, sf_dir))[0]


@register(
    "corpus_insert_files",
    f"""WITH {INSERT_CTE}
SELECT path, md5(content) AS md5 FROM files WHERE path NOT IN (SELECT path FROM j WHERE ok)
UNION ALL SELECT path, md5(arg_max(content, seq)) FROM j WHERE ok GROUP BY path""",
)
def corpus_insert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = changes.corpus_insert(inputs.files(spark, sf_dir), insert_requests(spark, sf_dir))[1]
    return files.select("path", F.md5("content").alias("md5"))


def change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five changes for each file, by doc_id modulo 4: copy, move the copy, delete the moved one, copy and
    delete what is gone; move onto the next file's path (by doc_id; a path of its own where there is none),
    copy from there, and from the path left; copy what the file before moved here, delete twice, an
    unknown type; copies of a missing file, onto itself, and an unknown type."""
    f = inputs.files(spark, sf_dir)
    following = f.groupBy((F.col("doc_id") - 1).alias("doc_id")).agg(F.min("path").alias("next"))
    f = f.select("doc_id", "path").join(following, "doc_id", "left")
    d, p = F.col("doc_id"), F.col("path")
    k = d % 4
    g, h = F.concat(p, F.lit(".g")), F.concat(p, F.lit(".h"))
    q = F.coalesce("next", g)
    none = F.lit(None).cast("string")

    def five(*rows):
        return F.array(*(F.struct((d * 10 + n).alias("change_id"), F.lit(kind).alias("type"), source.alias("source"), destination.alias("destination"), target.alias("target"))
                         for n, (kind, source, destination, target) in enumerate(rows, 1)))

    zero = five(("copy", p, g, none), ("move", g, h, none), ("delete", none, none, h), ("copy", h, g, none), ("delete", none, none, g))
    one = five(("move", p, q, none), ("copy", q, g, none), ("copy", p, h, none), ("copy", q, h, none), ("delete", none, none, p))
    two = five(("copy", p, g, none), ("delete", none, none, p), ("delete", none, none, p), ("archive", p, none, none), ("delete", none, none, g))
    three = five(("copy", g, p, none), ("copy", p, p, none), ("move", p, h, none), ("copy", p, g, none), ("archive", p, none, none))
    return f.select(F.inline(F.when(k == 0, zero).when(k == 1, one).when(k == 2, two).otherwise(three)))


# The SQL replays the changes too: those of a file and of the one before it that moves onto its path are a
# set, folded in order over the paths that exist and the size of the file that each holds.
_CHANGE_STEP = """CASE
      WHEN x.type IN ('copy', 'move') AND len(list_filter(acc.held, lambda f: f.path = x.source)) > 0 THEN {
        'held': list_append(list_filter(acc.held, lambda f: f.path <> x.destination AND NOT (x.type = 'move' AND f.path = x.source)),
                            {'path': x.destination, 'units': list_filter(acc.held, lambda f: f.path = x.source)[1].units}),
        'told': list_append(acc.told, {'change_id': x.change_id, 'error': NULL::VARCHAR,
                            'size': CASE WHEN x.type = 'copy' THEN list_filter(acc.held, lambda f: f.path = x.source)[1].units END})}
      WHEN x.type = 'delete' AND len(list_filter(acc.held, lambda f: f.path = x.target)) > 0 THEN {
        'held': list_filter(acc.held, lambda f: f.path <> x.target),
        'told': list_append(acc.told, {'change_id': x.change_id, 'error': NULL::VARCHAR, 'size': NULL::BIGINT})}
      ELSE {'held': acc.held, 'told': list_append(acc.told, {'change_id': x.change_id, 'size': NULL::BIGINT,
        'error': CASE WHEN x.type IN ('copy', 'move', 'delete') THEN 'no such file: ' || coalesce(x.source, x.target) ELSE 'Unknown operation type: ' || x.type END})}
    END"""
CHANGE_CTE = f"""{FILES_CTE},
f AS (
  SELECT doc_id, path, coalesce(next, path || '.g') AS q, doc_id - CASE doc_id % 4 WHEN 2 THEN 1 ELSE 0 END AS linked, CAST({utf16_sql('content')} AS BIGINT) AS units
  FROM files LEFT JOIN (SELECT doc_id - 1 AS doc_id, min(path) AS next FROM files GROUP BY 1) USING (doc_id)),
n AS (SELECT *, doc_id % 4 + 1 AS k, unnest([1, 2, 3, 4, 5]) AS n FROM f),
c AS (
  SELECT linked, doc_id * 10 + n AS change_id,
    [['copy', 'move', 'delete', 'copy', 'delete'], ['move', 'copy', 'copy', 'copy', 'delete'], ['copy', 'delete', 'delete', 'archive', 'delete'], ['copy', 'copy', 'move', 'copy', 'archive']][k][n] AS type,
    [[path, path || '.g', NULL, path || '.h', NULL], [path, q, path, q, NULL], [path, NULL, NULL, path, NULL], [path || '.g', path, path, path, path]][k][n] AS source,
    [[path || '.g', path || '.h', NULL, path || '.g', NULL], [q, path || '.g', path || '.h', path || '.h', NULL], [path || '.g', NULL, NULL, NULL, NULL], [path, path, path || '.h', path || '.g', NULL]][k][n] AS destination,
    [[NULL, NULL, path || '.h', NULL, path || '.g'], [NULL, NULL, NULL, NULL, path], [NULL, path, path, NULL, path || '.g'], [NULL, NULL, NULL, NULL, NULL]][k][n] AS target
  FROM n),
s AS (SELECT linked, list({{'path': path, 'units': units}}) AS held FROM f GROUP BY linked),
b AS (SELECT linked, list({{'change_id': change_id, 'type': type, 'source': source, 'destination': destination, 'target': target}} ORDER BY change_id) AS batch FROM c GROUP BY linked),
r AS (
  SELECT unnest(list_reduce(batch, lambda acc, x: {_CHANGE_STEP},
    {{'held': held, 'told': []::STRUCT(change_id BIGINT, error VARCHAR, size BIGINT)[]}}).told, recursive := true)
  FROM b JOIN s USING (linked))"""


@register(
    "apply_path_changes",
    f"""WITH {CHANGE_CTE}
SELECT change_id, type, source, destination, target, error IS NULL AS success, error, size
FROM c JOIN r USING (change_id)""",
)
def apply_path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_path_changes(inputs.files(spark, sf_dir), change_requests(spark, sf_dir))[0]


@register(
    "apply_path_changes_files",
    f"""WITH {FILES_CTE}
SELECT path || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN unnest(['.g', '.h']) ELSE '.h' END AS path, md5(content) AS md5 FROM files WHERE doc_id % 4 = 1
UNION ALL SELECT CASE doc_id % 4 WHEN 3 THEN path || '.h' ELSE path END, md5(content) FROM files WHERE doc_id % 4 IN (0, 3)""",
)
def apply_path_changes_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = changes.apply_path_changes(inputs.files(spark, sf_dir), change_requests(spark, sf_dir))[1]
    return files.select("path", F.md5("content").alias("md5"))


@register(
    "batch_summary",
    """SELECT CAST(ts AS DATE) AS batch_date, count(*) AS total_operations, CAST(count_if(event_type <> 'error') AS BIGINT) AS successful_operations,
       CAST(count_if(event_type = 'error') AS BIGINT) AS failed_operations, round(avg(value), 6) AS average_time_ms
FROM events GROUP BY CAST(ts AS DATE)""",
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("batch_date")).agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.count_if(F.col("event_type") != "error").alias("successful_operations"),
        F.count_if(F.col("event_type") == "error").alias("failed_operations"),
        rounded(F.avg("value")).alias("average_time_ms"),
    )


def edit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per file: insert a header, replace line 2, delete a range that may run past the end."""
    f = inputs.files(spark, sf_dir)
    d = F.col("doc_id")
    def edit(seq, op, start, end, new):
        return F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), start.cast("int").alias("start_line"),
                        end.cast("int").alias("end_line"), new.cast("string").alias("new_content"))

    e = F.array(
        edit(1, "insert", F.lit(0), F.lit(None), F.concat(F.lit("header "), d.cast("string"))),
        edit(2, "replace", F.lit(2), F.lit(2), F.lit("second")),
        edit(3, "delete", 1 + d % 4, 1 + d % 4 + d % 2 * 30, F.lit(None)),
    )
    return f.select("path", F.inline(e))


_EDIT_STEP = """CASE
      WHEN CASE WHEN x.op IN ('replace', 'delete')
                THEN x.s IS NULL OR x.s < 1 OR x.s > len(acc.lines) OR x.e IS NULL OR x.e < x.s OR x.e > len(acc.lines)
                WHEN x.op = 'insert' THEN x.s IS NULL OR x.s < 0 OR x.s > len(acc.lines)
                ELSE true END
        THEN {'lines': acc.lines, 'error': coalesce(acc.error, printf('edit %d is invalid', x.seq)), 'applied': acc.applied}
      WHEN x.op = 'delete'
        THEN {'lines': list_concat(list_slice(acc.lines, 1, x.s - 1), list_slice(acc.lines, x.e + 1, len(acc.lines))), 'error': acc.error, 'applied': acc.applied + 1}
      WHEN x.op = 'insert'
        THEN {'lines': list_concat(list_slice(acc.lines, 1, x.s), string_split(coalesce(x.new, ''), chr(10)), list_slice(acc.lines, x.s + 1, len(acc.lines))), 'error': acc.error, 'applied': acc.applied + 1}
      ELSE {'lines': list_concat(list_slice(acc.lines, 1, x.s - 1), string_split(coalesce(x.new, ''), chr(10)), list_slice(acc.lines, x.e + 1, len(acc.lines))), 'error': acc.error, 'applied': acc.applied + 1}
    END"""


@register(
    "apply_edit_batch",
    f"""WITH {FILES_CTE},
e AS (
  SELECT path, content, [
    {{'seq': 1, 'op': 'insert', 's': 0, 'e': NULL::INTEGER, 'new': 'header ' || CAST(doc_id AS VARCHAR)}},
    {{'seq': 2, 'op': 'replace', 's': 2, 'e': 2, 'new': 'second'}},
    {{'seq': 3, 'op': 'delete', 's': CAST(1 + doc_id % 4 AS INTEGER), 'e': CAST(1 + doc_id % 4 + doc_id % 2 * 30 AS INTEGER), 'new': NULL::VARCHAR}}
  ] AS edits FROM files),
r AS (
  SELECT path, content,
         list_reduce(edits, lambda acc, x: {_EDIT_STEP}, {{'lines': string_split(content, chr(10)), 'error': NULL::VARCHAR, 'applied': 0}}) AS res
  FROM e)
SELECT path, res.error IS NULL AS success, res.error AS error, res.applied AS edits_applied, md5(array_to_string(res.lines, chr(10))) AS md5
FROM r""",
)
def apply_edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes.apply_edit_batch(inputs.files(spark, sf_dir), edit_requests(spark, sf_dir))
    return out.select("path", "success", "error", "edits_applied", F.md5("content").alias("md5"))
