"""Plan shape: narrow text operators stay in the JVM; joins are the intended kinds; top-k is
limited per group; a persisted BM25 index is pruned by term bucket."""

from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ["file_metrics", "line_chunks", "replace_lines", "strip_aggressive", "code_structures", "normalize_path", "token_chunks", "clean_text", "line_diff"]


def test_narrow_ops_have_no_python(spark, registry):
    for name in NARROW:
        p = plan(registry.QUERIES[name](spark, SMALL))
        assert "Python" not in p and "ArrowEval" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_membership_uses_anti_and_semi_joins(spark, registry):
    assert "LeftAnti" in plan(registry.QUERIES["missing_embeddings"](spark, SMALL))
    assert "LeftSemi" in plan(registry.QUERIES["vector_remove"](spark, SMALL))


def test_no_cartesian_anywhere(spark, registry):
    for name in ["cosine_topk", "similar_all", "bm25_batch", "rerank_topk", "cache_aside", "best_candidate", "hybrid_union"]:
        p = plan(registry.QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_topk_window_is_group_limited(spark, registry):
    df = registry.QUERIES["bm25_batch"](spark, SMALL)
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_search_broadcasts_query_terms(spark, registry):
    assert "BroadcastHashJoin" in plan(registry.QUERIES["bm25_search"](spark, SMALL))


def test_indexed_search_prunes_buckets(spark, registry):
    """The persisted-index search lists and reads only the buckets of its query terms."""
    import re

    df = registry.QUERIES["bm25_search_indexed"](spark, SMALL)
    p = plan(df)
    scans = [line for line in p.split("\n") if "FileScan parquet" in line and "/postings" in line]
    assert scans
    for line in scans:
        n_paths = int(re.search(r"InMemoryFileIndex\((\d+) paths\)", line).group(1))
        assert 1 <= n_paths <= 4  # four distinct query terms
        assert "PushedFilters: [" in p and "In(term" in p
