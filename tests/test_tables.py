"""Golden cases for the state tables and extension points."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quire.functions.embed import model_embedder, model_scorer, overlap_score
from quire.operators import cache, changes, rerank, vectors

NOW = dt.datetime(2024, 1, 10, 12, 0, 0)


def test_ttl_boundary_is_a_miss(spark):
    ttl = dt.timedelta(days=1)
    entries = spark.createDataFrame(
        [("reranking", "k1", "p", 1, NOW - ttl), ("reranking", "k2", "p", 1, NOW - ttl + dt.timedelta(seconds=1)),
         ("other", "k3", "p", 1, NOW - dt.timedelta(days=400))],
        "cache_type string, key string, payload string, size_bytes long, created_at timestamp",
    )
    req = spark.createDataFrame([("reranking", "k1"), ("reranking", "k2"), ("reranking", "k9"), ("other", "k3")], "cache_type string, key string")
    out = cache.lookup(req, entries, cache.cache_config(spark), F.lit(NOW))
    got = {r.key: r.status for r in out.collect()}
    assert got == {"k1": "expired", "k2": "hit", "k9": "miss", "k3": "hit"}  # no TTL configured -> never expires


def test_force_refresh_bypasses(spark):
    entries = spark.createDataFrame([("embeddings", "k", "p", 1, NOW)], "cache_type string, key string, payload string, size_bytes long, created_at timestamp")
    req = spark.createDataFrame([("embeddings", "k", True)], "cache_type string, key string, force boolean")
    assert cache.lookup(req, entries, cache.cache_config(spark), F.lit(NOW), force="force").first().status == "bypassed"


def test_cache_aside_computes_identical_texts_once(spark):
    req = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "id int, key string, text string")
    cached = spark.createDataFrame([("b", 7.0)], "key string, value double")
    calls = spark.sparkContext.accumulator(0)

    def compute(misses):
        calls.add(misses.count())
        return misses.select("key", F.lit(1.0).alias("value"))

    out = {r.id: (r.source, r.value) for r in cache.cache_aside(req, cached, compute, id_col="id").collect()}
    assert out == {1: ("generated", 1.0), 2: ("generated", 1.0), 3: ("cache", 7.0)}
    assert calls.value == 1


def test_cache_stats_lists_empty_types(spark):
    entries = spark.createDataFrame([("embeddings", "k", "p", 2 * 1024 * 1024, NOW)], "cache_type string, key string, payload string, size_bytes long, created_at timestamp")
    got = {r.cache_type: (r.files_count, r.total_size_mb) for r in cache.stats(entries, cache.cache_config(spark)).collect()}
    assert got == {"embeddings": (1, 2.0), "reranking": (0, 0.0), "llm_responses": (0, 0.0), "all": (1, 2.0)}


def test_live_entries_latest_write_wins(spark):
    log = spark.createDataFrame(
        [("t", "k", "old", 1, NOW, 1), ("t", "k", "new", 1, NOW + dt.timedelta(seconds=1), 2), ("t", "k", "tie", 1, NOW + dt.timedelta(seconds=1), 3)],
        "cache_type string, key string, payload string, size_bytes long, created_at timestamp, seq long",
    )
    assert [r.payload for r in cache.live_entries(log).collect()] == ["tie"]


def test_fallback_rerank_scores(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, key long, rank int")
    got = [(r.rerank_score, r.final_rank, r.corpus_id) for r in rerank.fallback(hits).orderBy("final_rank").collect()]
    assert got == [(1.0, 1, 0), (0.9, 2, 1), (0.8, 3, 2)]


def test_rerank_single_candidate_is_not_rescored(spark):
    c = spark.createDataFrame([(1, 5, 1, "q a", "a"), (2, 6, 1, "q", "z"), (2, 7, 2, "q", "q")], "query_id long, key long, rank int, qtext string, dtext string")
    out = rerank.rerank(c, overlap_score(F.col("qtext"), F.col("dtext")), 5)
    got = {(r.query_id, r.key): (r.rerank_score, r.final_rank) for r in out.collect()}
    assert got == {(1, 5): (None, 1), (2, 7): (1.0, 1), (2, 6): (0.0, 2)}


def test_model_hooks_run_on_arrow_batches(spark):
    def load_embedder():
        return lambda texts: [np.array([len(t), 1.0], dtype=np.float32) for t in texts]

    def load_scorer():
        return lambda qs, ds: [float(len(set(q) & set(d))) for q, d in zip(qs, ds)]

    df = spark.createDataFrame([("ab", "b"), ("xyz", "q")], "t string, d string")
    embed, score = model_embedder(load_embedder), model_scorer(load_scorer)
    rows = df.select(embed("t").alias("v"), score("t", "d").alias("s")).collect()
    assert [list(r.v) for r in rows] == [[2.0, 1.0], [3.0, 1.0]] and [r.s for r in rows] == [1.0, 0.0]


def test_vector_upsert_actions(spark):
    idx = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "path string, embedding array<double>")
    batch = spark.createDataFrame([("a", [9.0], False), ("b", [8.0], True), ("d", [7.0], False)], "path string, embedding array<double>, force boolean")
    got = {r.path: (r.action, r.embedding[0]) for r in vectors.vector_upsert(idx, batch).collect()}
    assert got == {"a": ("skipped", 1.0), "b": ("recreated", 8.0), "c": ("unchanged", 3.0), "d": ("created", 7.0)}


def test_vector_remove(spark):
    idx = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "path string, embedding array<double>")
    req = spark.createDataFrame([("a",), ("z",)], "path string")
    res, remaining = vectors.vector_remove(idx, req)
    assert {r.path: r.action for r in res.collect()} == {"a": "removed", "z": "skipped"}
    assert [r.path for r in remaining.collect()] == ["b"]


def test_corpus_insert_and_changes(spark):
    files = spark.createDataFrame([("/r/a", "x"), ("/r/b", "y")], "path string, content string")
    batch = spark.createDataFrame([("/r/a", "new", False, 1), ("/r/b", "new\nb", True, 2), ("/r/c", "c", False, 3)], "path string, content string, overwrite boolean, seq int")
    res, new_files = changes.corpus_insert(files, batch)
    assert {r.path: (r.success, r.line_count) for r in res.collect()} == {"/r/a": (False, None), "/r/b": (True, 2), "/r/c": (True, 1)}
    assert {r.path: r.content for r in new_files.collect()} == {"/r/a": "x", "/r/b": "new\nb", "/r/c": "c"}
    ch = spark.createDataFrame(
        [(1, "copy", "/r/a", "/r/a2", None), (2, "move", "/r/b", "/r/b2", None), (3, "delete", None, None, "/r/zz"), (4, "mkdir", None, None, None)],
        "change_id int, type string, source string, destination string, target string",
    )
    res, after = changes.apply_path_changes(files, ch)
    assert {r.change_id: r.success for r in res.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {r.path: r.content for r in after.collect()} == {"/r/a": "x", "/r/a2": "x", "/r/b2": "y"}


def test_cache_clear_by_type_and_all(spark):
    entries = spark.createDataFrame(
        [("embeddings", "a", "p", 1024 * 1024, NOW), ("reranking", "b", "p", 3 * 1024 * 1024, NOW), ("reranking", "c", "p", 0, NOW)],
        "cache_type string, key string, payload string, size_bytes long, created_at timestamp",
    )
    cfg = cache.cache_config(spark)
    report, survivors = cache.clear(entries, cfg, "reranking")
    assert {(r.cache_type, r.files_deleted, r.space_freed_mb) for r in report.collect()} == {("reranking", 2, 3.0)}
    assert [r.key for r in survivors.collect()] == ["a"]
    report, survivors = cache.clear(entries, cfg, "all")
    assert {r.cache_type: r.files_deleted for r in report.collect()} == {"embeddings": 1, "reranking": 2, "llm_responses": 0}
    assert survivors.count() == 0


def test_history_retention_boundary(spark):
    from quire.operators import history

    h = spark.createDataFrame(
        [("op-1", NOW - dt.timedelta(hours=24)), ("op-2", NOW - dt.timedelta(hours=24, seconds=1)), ("op-3", NOW)],
        "operation_id string, ts timestamp",
    )
    report, kept = history.retention(h, F.lit(NOW))
    r = report.first()
    assert (r.cleaned_count, r.remaining_count) == (1, 2)
    assert sorted(x.operation_id for x in kept.collect()) == ["op-1", "op-3"]


def test_missing_embeddings_with_force(spark):
    files = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "path string, force boolean")
    idx = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "path string, embedding array<double>")
    got = sorted(r.path for r in vectors.missing_embeddings(files, idx, force="force").collect())
    assert got == ["b", "c"]
    flags = {r.path: r.has_embedding for r in vectors.has_embedding(files, idx.unionByName(idx)).collect()}
    assert flags == {"a": True, "b": True, "c": False}  # duplicate index rows do not duplicate files


def test_cache_stats_ignore_unconfigured_types(spark):
    entries = spark.createDataFrame(
        [("embeddings", "a", "p", 1024 * 1024, NOW), ("sessions", "b", "p", 5 * 1024 * 1024, NOW - dt.timedelta(days=9))],
        "cache_type string, key string, payload string, size_bytes long, created_at timestamp",
    )
    got = {r.cache_type: (r.files_count, r.total_size_mb, r.oldest, r.ttl_days) for r in cache.stats(entries, cache.cache_config(spark)).collect()}
    assert got["all"] == (1, 1.0, NOW, None) and "sessions" not in got
    assert got["embeddings"] == (1, 1.0, NOW, 7) and got["reranking"] == (0, 0.0, None, 1)


def test_change_requests_link_neighbouring_files(spark, registry, tmp_path):
    import duckdb

    from quire.plans.state_queries import change_requests

    # 5 moves onto 6, 9 has no next file, 13's next one has no path
    docs = [(i, f"text of {i}" + "x" * i, "en", "s") for i in (4, 5, 6, 7, 8, 9, 13)] + [(14, "no path", None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = change_requests(spark, str(tmp_path))
    per_file = {}
    for r in asked.collect():
        per_file.setdefault(r.change_id // 10, []).append(r)
    assert {i: len(rows) for i, rows in per_file.items()} == dict.fromkeys((4, 5, 6, 7, 8, 9, 13, 14), 5)
    got = {r.change_id: r for r in registry.QUERIES["apply_path_changes"](spark, str(tmp_path)).collect()}
    assert (got[51].type, got[51].destination, got[51].success) == ("move", "/corpus/s/en/6.txt", True)
    # what 6 holds by then is the text of 5
    assert got[52].size == got[54].size == got[61].size == len("text of 5" + "x" * 5)
    assert [got[60 + n].success for n in (2, 3, 4, 5)] == [True, False, False, True]
    assert got[91].destination == "/corpus/s/en/9.txt.g" and got[131].destination == "/corpus/s/en/13.txt.g"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet') WHERE doc_id <> 14")
    for name in ("apply_path_changes", "apply_path_changes_files"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        cols = df.columns
        rows = [tuple(r) for r in df.where("path is not null" if "path" in cols else "change_id not between 140 and 149").collect()]
        assert sorted(rows, key=repr) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE[name]})").fetchall(), key=repr)
