"""Registered queries: composed retrieval — rerank, approximate search, hybrid lists,
answer selection and token accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.embed import embed, overlap_score
from quire.functions.text import rounded, ws_tokens
from quire.operators import ann, bm25, graph_ann, knn, lines, rerank, vectors
from quire.plans import inputs
from quire.plans.registry import register, table
from quire.plans.search_queries import FIXED_QUERIES_CTE, _documents, fixed_query, search_ctes
from quire.plans.sqltext import bm25_tokens, lit
from quire.plans.sqltext import ws_tokens as ws_tokens_sql
from quire.plans.vector_queries import (
    QV_CTE,
    VINDEX_CTE,
    SEARCH_K,
    SIMILAR_K,
    embed_ctes,
    embeddings,
    query_vectors,
    vector_index,
    with_index_dim,
)
from quire.session import stored

# ---------------------------------------------------------------------------- token usage


@register(
    "token_usage",
    f"""SELECT conv_id, count(*) AS turns,
       CAST(sum(CASE WHEN role <> 'assistant' THEN len({ws_tokens_sql('text')}) ELSE 0 END) AS BIGINT) AS prompt_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN len({ws_tokens_sql('text')}) ELSE 0 END) AS BIGINT) AS completion_tokens,
       CAST(sum(len({ws_tokens_sql('text')})) AS BIGINT) AS total_tokens
FROM conversations GROUP BY conv_id""",
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.size(ws_tokens(F.col("text"))).cast("long").alias("n"))
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(F.when(F.col("role") != "assistant", F.col("n")).otherwise(F.lit(0))).alias("prompt_tokens"),
        F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(F.lit(0))).alias("completion_tokens"),
        F.sum("n").alias("total_tokens"),
    )


# ---------------------------------------------------------------------------- best candidate


#: Turns of a conversation that one window looks at.
TURNS_A_SPAN = 1000


@register(
    "best_candidate",
    f"""WITH t AS (
  SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt_turn FROM conversations),
p AS (SELECT conv_id, turn AS prompt_turn, min(text) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
a AS (SELECT conv_id, prompt_turn, t.turn, t.text, p.prompt FROM t JOIN p USING (conv_id, prompt_turn) WHERE t.role = 'assistant'),
s AS (SELECT *, list_distinct({bm25_tokens('prompt')}) AS q, list_distinct({bm25_tokens('text')}) AS d FROM a),
r AS (SELECT conv_id, prompt_turn, turn, text, prompt, CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0.0 END AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, prompt_turn ORDER BY round(score, 9) DESC, turn) AS rk FROM r)
SELECT conv_id, prompt_turn, turn AS best_turn, round(score, 6) AS score, CAST(len({ws_tokens_sql('prompt')}) AS INTEGER) AS prompt_tokens,
       CAST(len({ws_tokens_sql('text')}) AS INTEGER) AS completion_tokens,
       CAST(len({ws_tokens_sql('prompt')}) + len({ws_tokens_sql('text')}) AS INTEGER) AS total_tokens
FROM b WHERE rk = 1""",
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a prompt, the assistant turns up to the next one its candidate answers; keep
    the best by the default scorer (the first when there is only one), with whitespace token
    counts. A turn finds its prompt within a span of turns or, failing that, the last one of the spans
    before, so no window holds a whole conversation; the best is a partial+final max_by."""
    c = table(spark, sf_dir, "conversations").withColumn("span", F.floor(F.col("turn") / TURNS_A_SPAN))
    asked = F.max(F.when(F.col("role") == "user", F.col("turn")))
    spans = c.groupBy("conv_id", "span").agg(asked.alias("asked"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.max("asked").over(earlier).alias("before"))
    within = Window.partitionBy("conv_id", "span").orderBy("turn")
    turns = c.join(spans, ["conv_id", "span"]).withColumn("prompt_turn", F.coalesce(asked.over(within), F.col("before")))
    prompts = c.where(F.col("role") == "user").groupBy("conv_id", F.col("turn").alias("prompt_turn")).agg(F.min("text").alias("prompt"))
    cand = turns.where(F.col("role") == "assistant").join(prompts, ["conv_id", "prompt_turn"])
    scored = cand.withColumn("score", overlap_score(F.col("prompt"), F.col("text")))
    # best = highest score, then the earliest turn; a lone candidate wins unscored either way
    rank_key = F.struct(F.round("score", 9).alias("s"), (-F.col("turn")).alias("t"))
    best = scored.groupBy("conv_id", "prompt_turn").agg(F.max_by(F.struct("turn", "text", "prompt", "score"), rank_key).alias("b"))
    pt, ct = F.size(ws_tokens(F.col("b.prompt"))), F.size(ws_tokens(F.col("b.text")))
    return best.select(
        "conv_id", "prompt_turn", F.col("b.turn").alias("best_turn"), rounded(F.col("b.score")).alias("score"),
        pt.alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).alias("total_tokens"),
    )


# ---------------------------------------------------------------------------- rerank


RERANK_SQL = f"""WITH {QV_CTE},
pairs AS (SELECT q.query_id AS qid, q.text AS qtext, e.vec_id AS key, list_distance(q.embedding, e.embedding::DOUBLE[]) ** 2 AS score
          FROM qv q, embeddings e WHERE q.embedding IS NOT NULL),
cand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), key) AS vector_rank FROM pairs),
c2 AS (SELECT c.*, coalesce(d.text, '') AS dtext, count(*) OVER (PARTITION BY qid) AS n
       FROM cand c LEFT JOIN documents d ON d.doc_id = c.key WHERE vector_rank <= {2 * SEARCH_K}),
s AS (SELECT *, CASE WHEN n > 1 THEN (SELECT CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0.0 END
                                     FROM (SELECT list_distinct({bm25_tokens('qtext')}) AS q, list_distinct({bm25_tokens('dtext')}) AS d)) END AS rs FROM c2),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rs DESC NULLS LAST, vector_rank) AS final_rank FROM s)
SELECT qid AS query_id, key AS vec_id, CAST(vector_rank AS INTEGER) AS vector_rank, round(rs, 6) AS rerank_score,
       CAST(final_rank AS INTEGER) AS final_rank
FROM f WHERE final_rank <= {SEARCH_K}"""


@register("rerank_topk", RERANK_SQL)
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch 2k by squared L2, score (query text, document text) with the default scorer,
    keep k. Candidate texts come from a join on the hit keys (bounded: queries x 2k)."""
    qv = query_vectors(spark, sf_dir)
    hits = knn.topk(embeddings(spark, sf_dir), qv, 2 * SEARCH_K, "l2", n_queries=table(spark, sf_dir, "benchmark").count())
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("dtext"))
    # The candidates (queries x 2k) are written once, so the search runs once and the planner
    # knows their size: documents stream past them. Candidates without a document get empty text.
    hits = stored(hits.join(qv.select("query_id", F.col("text").alias("qtext")), "query_id"), "rerank-hits")
    matched = docs.join(hits, "key")
    missing = hits.join(matched.select("query_id", "key"), ["query_id", "key"], "left_anti").withColumn("dtext", F.lit(""))
    cand = matched.unionByName(missing)
    cand = cand.withColumn("dtext", F.coalesce("dtext", F.lit("")))
    out = rerank.rerank(cand, overlap_score(F.col("qtext"), F.col("dtext")), SEARCH_K)
    return out.select("query_id", F.col("key").alias("vec_id"), F.col("rank").alias("vector_rank"),
                      rounded(F.col("rerank_score")).alias("rerank_score"), "final_rank")


# ---------------------------------------------------------------------------- approximate search


@register("ann_topk")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph search of the benchmark queries, with per-query recall@k against the exact search and
    the numbers of adjacency lists and of vectors that its search read."""
    e = embeddings(spark, sf_dir)
    qv = stored(query_vectors(spark, sf_dir), "ann-queries")
    codes = graph_ann.encode(e, "vec_id", "embedding")
    approx = stored(graph_ann.search(graph_ann.build(codes), codes, e, qv, SEARCH_K), "ann-hits")
    exact = knn.topk(e, qv, SEARCH_K, "cosine")
    rec = ann.recall_at_k(approx, exact)
    return approx.join(rec, "query_id", "left").select(
        "query_id", F.col("key").alias("vec_id"), rounded(F.col("score")).alias("score"), "rank", rounded(F.col("recall")).alias("recall"), "visited", "opened"
    )


# ---------------------------------------------------------------------------- hybrid


@register(
    "hybrid_union",
    f"""{search_ctes(FIXED_QUERIES_CTE)},
{embed_ctes("fq", f"SELECT CAST(-1 AS BIGINT) AS query_id, {lit(inputs.FIXED_QUERY)} AS text")},
vec AS (SELECT e.vec_id, list_distance(fq.embedding, e.embedding::DOUBLE[]) ** 2 AS score FROM fq, embeddings e WHERE fq.embedding IS NOT NULL),
vr AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), vec_id) AS rk FROM vec),
u AS (SELECT 'bm25' AS source, doc_id AS id, bm25_score AS score, rank AS rk FROM ranked WHERE rank <= {bm25.DEFAULT_LIMIT}
      UNION ALL SELECT 'vector', vec_id, score, rk FROM vr WHERE rk <= {SEARCH_K})
SELECT source, id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank, (SELECT count(*) FROM u) AS total_found FROM u""",
)
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vector candidates of the fixed query in one list tagged by ``source``."""
    docs = _documents(spark, sf_dir)
    text_hits = bm25.search_documents(docs, fixed_query(spark)).select(
        F.lit("bm25").alias("source"), F.col("doc_id").alias("id"), F.col("bm25_score").alias("score"), "rank"
    )
    q = with_index_dim(fixed_query(spark), spark, sf_dir).select("query_id", embed(F.col("text"), F.col("_dim")).alias("embedding"))
    vec_hits = knn.topk(embeddings(spark, sf_dir), q, SEARCH_K, "l2", n_queries=1).select(
        F.lit("vector").alias("source"), F.col("key").alias("id"), "score", "rank"
    )
    u = stored(text_hits.unionByName(vec_hits), "hybrid-hits")  # read twice below
    return u.select("source", "id", rounded(F.col("score")).alias("score"), "rank", u.select(F.count(F.lit(1))).scalar().alias("total_found"))


# ---------------------------------------------------------------------------- per-file pipeline


PROCESS_SQL = f"""WITH {VINDEX_CTE},
{embed_ctes("nv", "SELECT doc_id, path, content AS text FROM files")},
up AS (
  SELECT vec_id AS key, path, embedding::DOUBLE[] AS embedding FROM vindex
  UNION ALL SELECT doc_id, path, embedding FROM nv WHERE path NOT IN (SELECT path FROM vindex)),
pairs AS (
  SELECT q.doc_id AS qid, u.key, u.path AS similar_path, list_cosine_similarity(q.embedding, u.embedding) AS score
  FROM nv q, up u WHERE q.embedding IS NOT NULL AND u.embedding IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rnk
  FROM pairs WHERE score IS NOT NULL AND NOT isnan(score)),
sim AS (
  SELECT qid, max(CASE WHEN rnk = 1 THEN similar_path END) AS similar_1, max(CASE WHEN rnk = 2 THEN similar_path END) AS similar_2,
         max(CASE WHEN rnk = 3 THEN similar_path END) AS similar_3, count(*) AS similar_files_found
  FROM ranked WHERE rnk <= {SIMILAR_K} GROUP BY qid)
SELECT f.path, CAST(ceil(len(string_split(f.content, chr(10))) / 50) AS BIGINT) AS chunk_count,
       CASE WHEN f.path IN (SELECT path FROM vindex) THEN 'skipped' ELSE 'created' END AS embedding_action,
       s.similar_1, s.similar_2, s.similar_3, coalesce(s.similar_files_found, 0) AS similar_files_found
FROM files f LEFT JOIN sim s ON s.qid = f.doc_id"""


@register("process_corpus", PROCESS_SQL)
def process_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file one row, as a corpus-wide job: the number of 50-line chunks, the embedding
    action (upsert of the default embedding without forcing: existing vectors are kept) and
    the 3 most similar files of the updated index for the file's own embedding (the file
    itself included, as a similarity search over an index that holds it)."""
    files = inputs.files(spark, sf_dir)
    chunks = lines.line_chunks(files, "content", 50).groupBy("path").agg(F.count("chunk_index").alias("chunk_count"))
    q = with_index_dim(files, spark, sf_dir).select("doc_id", "path", embed(F.col("content"), F.col("_dim")).alias("embedding"))
    q = stored(q, "file-embeddings")  # every text is embedded once
    idx = vector_index(spark, sf_dir).select("vec_id", "path", F.col("embedding").cast("array<double>").alias("embedding"))
    batch = q.select("path", "embedding", F.lit(False).alias("force"))
    upsert = vectors.vector_upsert(idx.select("path", "embedding"), batch)
    # every vector keeps a numeric key: the document id (index rows of existing files carry it
    # as vec_id), or the vec_id of an index row whose file is gone
    keys = idx.select("path", F.col("vec_id").alias("key")).unionByName(
        q.join(idx.select("path"), "path", "left_anti").select("path", F.col("doc_id").alias("key"))
    )
    updated = stored(upsert.join(keys, "path").select("key", "path", "embedding"), "updated-index")
    sim, _ = knn.pruned_topk(updated, q.withColumnRenamed("doc_id", "query_id"), SIMILAR_K, "cosine", corpus_key="key")
    sim = sim.join(updated.select("key", F.col("path").alias("similar_path")), "key")
    similar = sim.groupBy("query_id").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("similar_path"))).alias(f"similar_{i}") for i in range(1, SIMILAR_K + 1)],
        F.count(F.lit(1)).alias("similar_files_found"),
    )
    actions = upsert.join(files.select("path"), "path", "left_semi").select("path", F.col("action").alias("embedding_action"))
    out = files.select("doc_id", "path").join(chunks, "path", "left").join(actions, "path", "left")
    out = out.join(similar, out["doc_id"] == similar["query_id"], "left")
    return out.select(
        "path", "chunk_count", "embedding_action", *[f"similar_{i}" for i in range(1, SIMILAR_K + 1)],
        F.coalesce("similar_files_found", F.lit(0)).alias("similar_files_found"),
    )
