"""The neighbour graph and the pruned exact join, on clustered, repeated, null and zero vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graph_ann, knn

SCHEMA = "vec_id long, embedding array<float>"


def clustered(spark, n=1500, centres=12, dim=16, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((centres, dim)) * 4
    x = at[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * spread * 4
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA).repartition(4)


def odd(spark):
    """Copies of one vector for a third of the rows, nulls, zeros and a lone vector."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(80)] + [(80 + i, [float(v) for v in rng.standard_normal(4)]) for i in range(160)]
    return spark.createDataFrame([*rows, (300, None), (301, [0.0] * 4), (302, [-9.0, 1.0, 1.0, 1.0])], SCHEMA)


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.key, round(r.score, 9)))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("data", ["clustered", "odd"])
def test_pruned_equals_exact(spark, metric, data):
    e = clustered(spark) if data == "clustered" else odd(spark)
    q = e.where(F.col("vec_id") % 3 == 0).withColumnRenamed("vec_id", "query_id")
    got, _ = knn.pruned_topk(e, q, 5, metric, pivots=20, block_rows=40)
    want = knn.topk(e, q, 5, metric)
    assert answers(got) == answers(want)


def test_pruned_sends_fewer_tiles_on_clusters(spark):
    e = clustered(spark)
    q = e.withColumnRenamed("vec_id", "query_id")
    _, tiles = knn.pruned_topk(e, q, 3, "l2", pivots=30, block_rows=50)
    sent = tiles.distinct().count()
    assert sent == tiles.count()
    n_q, n_c = tiles.select("qb").distinct().count(), tiles.select("cb").distinct().count()
    assert sent < 0.35 * n_q * n_c, (sent, n_q, n_c)


def test_pruned_with_few_rows(spark):
    e = odd(spark)
    q = e.where("vec_id < 90").withColumnRenamed("vec_id", "query_id")
    for corpus in (e.where("vec_id = 302"), e.where("vec_id = 301"), e.limit(0)):
        assert answers(knn.pruned_topk(corpus, q, 4, "cosine")[0]) == answers(knn.topk(corpus, q, 4, "cosine"))
    assert answers(knn.pruned_topk(e, q.limit(0), 4, "cosine")[0]) == {}


def test_graph_recall_on_clusters(spark):
    e = clustered(spark)
    q = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    codes = graph_ann.encode(e, "vec_id", "embedding")
    graph = graph_ann.build(codes, block=64)
    sizes = [len(r["keys"]) for r in graph.collect()]
    assert len(sizes) == 1500 and max(sizes) <= 3 * graph_ann.DEGREE + graph_ann.LONG
    got, want = answers(graph_ann.search(graph, codes, e, q, 10)), answers(knn.topk(e, q, 10, "cosine"))
    recall = np.mean([len({k for k, _ in got[i]} & {k for k, _ in w}) / len(w) for i, w in want.items()])
    assert recall >= 0.9
    assert all(k in dict(want[i]) and abs(dict(want[i])[k] - s) < 1e-9 for i, x in got.items() for k, s in x if k in dict(want[i]))


def test_graph_cases(spark):
    e = odd(spark)
    q = e.where("vec_id in (0, 85, 302, 301, 300)").withColumnRenamed("vec_id", "query_id")
    codes = graph_ann.encode(e, "vec_id", "embedding")
    got = answers(graph_ann.search(graph_ann.build(codes), codes, e, q, 3))
    assert set(got) == {0, 85, 302}  # null and zero vectors ask for nothing
    assert got[302][0][0] == 302 and got[85][0][0] == 85
    assert not {300, 301} & {k for x in got.values() for k, _ in x}
    none = graph_ann.encode(e.limit(0), "vec_id", "embedding")
    assert graph_ann.search(graph_ann.build(none), none, e.limit(0), q, 3).collect() == []
    one = graph_ann.encode(e.where("vec_id = 302"), "vec_id", "embedding")
    assert [k for k, _ in answers(graph_ann.search(graph_ann.build(one), one, e, q, 3))[85]] == [302]


def test_tile_of_string_keys_holds_no_matrix_of_strings():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    vecs = lambda n: list(rng.normal(size=(n, 8)))
    corpus = pd.DataFrame({"key": [f"/corpus/some/long/folder/name/{i:06d}.txt#0" for i in range(8192)], "vec": vecs(8192)})
    queries = pd.DataFrame({"query_id": range(256), "vec": vecs(256)})
    tracemalloc.start()
    out = knn._tile_topk(5, "l2")(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = ((np.stack(queries["vec"])[:, None, :] - np.stack(corpus["vec"])[None, :, :]) ** 2).sum(2)
    want = {(q, corpus["key"][c]) for q in range(256) for c in d[q].argsort()[:5]}
    assert set(zip(out["query_id"], out["key"])) == want
    assert peak < 200e6, peak  # strings in the score matrix: 440 MB more


def test_graph_holds_names_and_lists_merge_in_arrays(spark):
    """A graph's row is names only; lists of several nodes merge to the best entries of each."""
    import pyarrow as pa

    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1, 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert graph_ann.build(graph_ann.encode(e, "vec_id", "embedding")).columns == ["u", "keys"]
    entry = lambda keys, sims, own: {"keys": keys, "sims": sims, "own": own}
    kind = pa.list_(pa.struct([("keys", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("own", pa.bool_())]))
    lists = pa.array([[entry([1, 2], [0.5, 0.25], True), entry([2, 3, 4], [0.25, 0.75, 0.125], False)], [entry([], [], False)], [entry([9], [1.0], False)]], kind)
    got = [b.to_pylist() for b in graph_ann._merged(2)([pa.RecordBatch.from_pydict({"u": pa.array([5, 6, 7]), "lists": lists}).slice(0)])][0]
    assert got == [{"u": 5, "keys": [3, 1], "sims": [0.75, 0.5], "fresh": 1}, {"u": 6, "keys": [], "sims": [], "fresh": 0}, {"u": 7, "keys": [9], "sims": [1.0], "fresh": 1}]


def test_only_scores_that_reach_the_kth_are_ranked(monkeypatch):
    """Of a tile of many vectors the first are ranked whole, the others only where a score reaches the k-th; ties go by key."""
    import pandas as pd

    rng = np.random.default_rng(3)
    c = np.round(rng.normal(size=(6000, 8)), 1)
    c[3000:5000] = c[:2000]  # copies, and one vector many times
    c[5000:5900], c[7], c[5990] = c[11], 0.0, np.nan
    q = np.concatenate([c[[1, 11, 2000]], np.zeros((1, 8)), rng.normal(size=(40, 8))])
    keys = rng.permutation(6000)
    seen, select = [], knn._select_k
    monkeypatch.setattr(knn, "_select_k", lambda o, k_, k: seen.append(o.shape[1]) or select(o, k_, k))
    monkeypatch.setattr(knn, "FEW", 500)  # both ways, with few and with many that may pass
    for metric in ("cosine", "l2"):
        got = knn._tile_topk(5, metric)(pd.DataFrame({"query_id": range(len(q)), "vec": list(q)}), pd.DataFrame({"key": keys, "vec": list(c)}))
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T if metric == "cosine" else -((q[:, None] - c[None]) ** 2).sum(2)
        want = []
        for i in range(len(q)):
            real = np.flatnonzero(np.isfinite(s[i]))
            want += [(i, keys[j]) for j in real[np.lexsort((keys[real], -np.round(s[i, real], 9)))][:5]]
        assert list(zip(got["query_id"], got["key"])) == want
    assert max(seen) <= knn.FIRST_ROWS + 5
