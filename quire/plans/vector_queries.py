"""Registered queries: embedding tables, exact top-k search, index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.embed import embed, overlap_score
from quire.functions.text import rounded
from quire.functions.vectors import array_size, l2_normalize
from quire.operators import knn, vectors
from quire.plans import inputs
from quire.plans.registry import register, table
from quire.plans.sqltext import FILES_CTE, bm25_tokens

# Result sizes of the reproduced searches.
SEARCH_K = 10
SIMILAR_K = 3


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def with_index_dim(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``_dim``: the dimension of the whole index (a scalar subquery); vectors of mixed
    sizes fail."""
    return df.withColumn("_dim", vectors.dimension(embeddings(spark, sf_dir)).scalar())


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, vec_id, embedding): each vector keyed by the path of document ``vec_id``; vectors
    whose document is absent keep a path under /corpus/missing/."""
    f = inputs.files(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "path")
    e = embeddings(spark, sf_dir)
    j = e.join(f, "vec_id", "left")
    path = F.coalesce(F.col("path"), F.concat(F.lit("/corpus/missing/"), F.col("vec_id").cast("string"), F.lit(".txt")))
    return j.select(path.alias("path"), "vec_id", "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts embedded with the default embedder at the index dimension."""
    b = with_index_dim(table(spark, sf_dir, "benchmark"), spark, sf_dir)
    return b.select(F.col("item_id").alias("query_id"), "text", embed(F.col("text"), F.col("_dim")).alias("embedding"))


def embed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text, force): every file (whole text), forced when labelled low quality."""
    f = inputs.files(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("low_quality"))
    j = f.join(lab, "doc_id", "left")
    return j.select("doc_id", "path", F.col("content").alias("text"),
                    F.coalesce("low_quality", F.lit(False)).alias("force"))


# ---------------------------------------------------------------------------- SQL fragments

def embed_ctes(name: str, source_sql: str) -> str:
    """CTE chain ``name`` = source rows (must expose ``text``) + ``embedding``, the default
    hashed embedding at the index dimension."""
    return f"""{name}_src AS ({source_sql}),
{name}_b AS (
  SELECT s.*, d.dim, list_transform({bm25_tokens('s.text')}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % d.dim) AS buckets
  FROM {name}_src s, (SELECT max(len(embedding)) AS dim FROM embeddings) d),
{name}_c AS (
  SELECT *, list_transform(generate_series(0, dim - 1), lambda i: CAST(len(list_filter(buckets, lambda x: x = i)) AS DOUBLE)) AS cnt
  FROM {name}_b),
{name}_n AS (SELECT *, sqrt(list_sum(list_transform(cnt, lambda y: y * y))) AS nrm FROM {name}_c),
{name} AS (
  SELECT * EXCLUDE (buckets, cnt, dim, nrm), CASE WHEN nrm > 0 THEN list_transform(cnt, lambda y: y / nrm) END AS embedding
  FROM {name}_n)"""


QV_CTE = embed_ctes("qv", "SELECT item_id AS query_id, text FROM benchmark")
VINDEX_CTE = f"""{FILES_CTE},
vindex AS (SELECT coalesce(f.path, '/corpus/missing/' || CAST(e.vec_id AS VARCHAR) || '.txt') AS path, e.vec_id, e.embedding
           FROM embeddings e LEFT JOIN files f ON f.doc_id = e.vec_id)"""


def _ranked_cte(pairs_sql: str, better: str) -> str:
    """``ranked(qid, key, score, rnk)`` over candidate pairs; ties at 1e-9 go to the smaller key."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) {better}, key) AS rnk
  FROM ({pairs_sql}) WHERE score IS NOT NULL AND NOT isnan(score))"""


def _topk_sql(pairs_sql: str, better: str, k: int, cols: str) -> str:
    return f"""{_ranked_cte(pairs_sql, better)}
SELECT {cols} FROM ranked WHERE rnk <= {k}"""


COSINE_PAIRS = "SELECT q.query_id AS qid, e.vec_id AS key, list_cosine_similarity(q.embedding, e.embedding::DOUBLE[]) AS score FROM qv q, embeddings e WHERE q.embedding IS NOT NULL"
L2_PAIRS = "SELECT q.query_id AS qid, e.vec_id AS key, list_distance(q.embedding, e.embedding::DOUBLE[]) ** 2 AS score FROM qv q, embeddings e WHERE q.embedding IS NOT NULL"


# ---------------------------------------------------------------------------- queries

@register(
    "l2_normalize",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / nrm, 6) AS value
FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM n) WHERE nrm > 0""",
)
def l2_normalize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.posexplode_outer("v").alias("dim", "value")).where(F.col("dim").isNotNull()).select("vec_id", "dim", rounded(F.col("value")).alias("value"))


@register(
    "embed_text",
    f"""WITH {FILES_CTE},
{embed_ctes("v", "SELECT doc_id, content AS text FROM files")}
SELECT doc_id, CAST(i - 1 AS INTEGER) AS dim, round(embedding[i], 6) AS value
FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM v)""",
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_index_dim(inputs.files(spark, sf_dir), spark, sf_dir)
    v = f.select("doc_id", embed(F.col("content"), F.col("_dim")).alias("e"))
    return v.select("doc_id", F.posexplode_outer("e").alias("dim", "value")).where(F.col("dim").isNotNull()).select("doc_id", "dim", rounded(F.col("value")).alias("value"))


def _bench_rows(spark: SparkSession, sf_dir: str) -> int:
    """Row count of the query table (a parquet count), an upper bound for its vectors."""
    return table(spark, sf_dir, "benchmark").count()


def cosine_hits(spark: SparkSession, sf_dir: str, k: int = SEARCH_K) -> DataFrame:
    return knn.topk(embeddings(spark, sf_dir), query_vectors(spark, sf_dir), k, "cosine", n_queries=_bench_rows(spark, sf_dir))


def l2_hits(spark: SparkSession, sf_dir: str, k: int = SEARCH_K) -> DataFrame:
    return knn.topk(embeddings(spark, sf_dir), query_vectors(spark, sf_dir), k, "l2", n_queries=_bench_rows(spark, sf_dir))


@register(
    "cosine_topk",
    f"WITH {QV_CTE},\n"
    + _topk_sql(COSINE_PAIRS, "DESC", SEARCH_K, "qid AS query_id, key AS vec_id, round(score, 6) AS score, CAST(rnk AS INTEGER) AS rank"),
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cosine_hits(spark, sf_dir)
    return h.select("query_id", F.col("key").alias("vec_id"), rounded(F.col("score")).alias("score"), "rank")


@register(
    "l2_topk",
    f"WITH {QV_CTE},\n"
    + _topk_sql(L2_PAIRS, "ASC", SEARCH_K, "qid AS query_id, key AS vec_id, round(score, 6) AS vector_score, CAST(rnk AS INTEGER) AS vector_rank"),
)
def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = l2_hits(spark, sf_dir)
    return h.select("query_id", F.col("key").alias("vec_id"), rounded(F.col("score")).alias("vector_score"), F.col("rank").alias("vector_rank"))


@register(
    "similar_all",
    "WITH x AS (SELECT 1),\n"
    + _topk_sql(
        "SELECT a.vec_id AS qid, b.vec_id AS key, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b",
        "DESC",
        SIMILAR_K,
        "qid AS vec_id, key AS similar_vec_id, round(score, 6) AS score, CAST(rnk AS INTEGER) AS rank",
    ),
)
def similar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    h, _ = knn.pruned_topk(e, e.withColumnRenamed("vec_id", "query_id"), SIMILAR_K, "cosine")
    return h.select(F.col("query_id").alias("vec_id"), F.col("key").alias("similar_vec_id"), rounded(F.col("score")).alias("score"), "rank")


@register(
    "hit_metadata_join",
    f"""WITH {QV_CTE},
{_ranked_cte(COSINE_PAIRS, "DESC")},
hits AS (SELECT qid, key, score, rnk FROM ranked WHERE rnk <= {SEARCH_K})
SELECT h.qid AS query_id, h.key AS vec_id, round(h.score, 6) AS score, CAST(h.rnk AS INTEGER) AS rank, d.lang, d.source, d.n_chars
FROM hits h JOIN documents d ON d.doc_id = h.key""",
)
def hit_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hits are at most #queries x k rows; adaptive execution picks the join from their real size
    hits = cosine_hits(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "source", "n_chars")
    j = docs.join(hits, "key")
    return j.select("query_id", F.col("key").alias("vec_id"), rounded(F.col("score")).alias("score"), "rank", "lang", "source", "n_chars")


@register(
    "rerank_fallback",
    f"WITH {QV_CTE},\n"
    + _topk_sql(
        L2_PAIRS,
        "ASC",
        SEARCH_K,
        "qid AS query_id, key AS vec_id, round(CAST(1.0 AS DOUBLE) - CAST(0.1 AS DOUBLE) * (rnk - 1), 6) AS rerank_score, CAST(rnk AS INTEGER) AS final_rank, CAST(rnk - 1 AS INTEGER) AS corpus_id",
    ),
)
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import rerank

    return rerank.fallback(l2_hits(spark, sf_dir))


# ---------------------------------------------------------------------------- index maintenance

@register(
    "has_embedding",
    f"""WITH {VINDEX_CTE}
SELECT f.path, EXISTS (SELECT 1 FROM vindex v WHERE v.path = f.path) AS has_embedding FROM files f""",
)
def has_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir).select("path")
    return vectors.has_embedding(f, vector_index(spark, sf_dir))


LABELS_FORCE = "coalesce((SELECT l.quality = 0 FROM labels l WHERE l.doc_id = f.doc_id), false)"


@register(
    "missing_embeddings",
    f"""WITH {VINDEX_CTE}
SELECT f.path FROM files f
WHERE NOT EXISTS (SELECT 1 FROM vindex v WHERE v.path = f.path) OR {LABELS_FORCE}""",
)
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = embed_requests(spark, sf_dir).select("path", "force")
    return vectors.missing_embeddings(r, vector_index(spark, sf_dir), force="force").select("path")


@register(
    "vector_upsert",
    f"""WITH {VINDEX_CTE},
{embed_ctes("req", f"SELECT f.path, {LABELS_FORCE} AS force, f.content AS text FROM files f")},
j AS (SELECT coalesce(v.path, r.path) AS path, v.embedding::DOUBLE[] AS old_embedding, r.embedding AS new_embedding, r.force,
             r.path IS NOT NULL AS in_new, v.path IS NOT NULL AS in_old
      FROM vindex v FULL OUTER JOIN req r ON v.path = r.path),
a AS (SELECT *, CASE WHEN NOT in_new THEN 'unchanged' WHEN NOT in_old THEN 'created' WHEN force THEN 'recreated' ELSE 'skipped' END AS action FROM j)
SELECT path, action, CAST(len(CASE WHEN action IN ('created', 'recreated') THEN new_embedding ELSE old_embedding END) AS INTEGER) AS dimension,
       round(list_sum(CASE WHEN action IN ('created', 'recreated') THEN new_embedding ELSE old_embedding END), 6) AS checksum
FROM a""",
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only files without a vector and forced ones are embedded."""
    r = embed_requests(spark, sf_dir)
    idx = vector_index(spark, sf_dir).select("path", F.col("embedding").cast("array<double>").alias("embedding"))
    todo = with_index_dim(vectors.missing_embeddings(r, idx, force="force"), spark, sf_dir)
    fresh = todo.select("path", embed(F.col("text"), F.col("_dim")).alias("embedding"))
    batch = r.select("path", "force").join(fresh, "path", "left")
    out = vectors.vector_upsert(idx, batch)
    checksum = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("path", "action", array_size("embedding").alias("dimension"), rounded(checksum).alias("checksum"))


REMOVE_REQ_CTE = """req AS (SELECT f.path FROM files f JOIN labels l ON l.doc_id = f.doc_id WHERE l.toxic = 1)"""


@register(
    "vector_remove",
    f"""WITH {VINDEX_CTE},
{REMOVE_REQ_CTE},
remaining AS (SELECT count(*) AS n FROM vindex v WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.path = v.path))
SELECT r.path, CASE WHEN EXISTS (SELECT 1 FROM vindex v WHERE v.path = r.path) THEN 'removed' ELSE 'skipped' END AS action,
       (SELECT n FROM remaining) AS remaining_vectors
FROM req r""",
)
def vector_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inputs.files(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    req = f.join(toxic, "doc_id", "left_semi").select("path")
    result, remaining = vectors.vector_remove(vector_index(spark, sf_dir), req)
    return result.withColumn("remaining_vectors", remaining.select(F.count(F.lit(1))).scalar())


VSTATS_SQL = f"""WITH {VINDEX_CTE},
s AS (SELECT count(*) AS total_vectors,
             CAST(count_if(EXISTS (SELECT 1 FROM files f WHERE f.path = v.path)) AS BIGINT) AS existing_files,
             CAST(count_if(NOT EXISTS (SELECT 1 FROM files f WHERE f.path = v.path)) AS BIGINT) AS missing_files,
             CAST(max(len(embedding)) AS INTEGER) AS dimension
      FROM vindex v)"""


@register("vector_stats", VSTATS_SQL + "\nSELECT * FROM s")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_stats(vector_index(spark, sf_dir), inputs.files(spark, sf_dir).select("path"))


@register(
    "vector_cache_status",
    VSTATS_SQL
    + """
SELECT total_vectors AS cached_files, existing_files, missing_files,
       CASE WHEN total_vectors = 0 THEN 'empty' WHEN existing_files > 0 THEN 'active' ELSE 'stale' END AS status
FROM s""",
)
def vector_cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cache_status(vectors.vector_stats(vector_index(spark, sf_dir), inputs.files(spark, sf_dir).select("path")))


# ---------------------------------------------------------------------------- pair scoring

PAIRS_CTE = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS query, a.text AS doc
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, doc): each user turn with the assistant turn that answers it."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("doc"))
    return u.join(a, ["conv_id", "turn"])


@register(
    "score_pairs",
    f"""WITH {PAIRS_CTE},
t AS (SELECT conv_id, turn, list_distinct({bm25_tokens('query')}) AS q, list_distinct({bm25_tokens('doc')}) AS d FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0.0 END, 6) AS score FROM t""",
)
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turn_pairs(spark, sf_dir)
    return p.select("conv_id", "turn", rounded(overlap_score(F.col("query"), F.col("doc"))).alias("score"))
