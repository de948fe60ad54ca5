"""Exact k-nearest-neighbour search between a query table and a vector table.

Plan (no cross join, no all-pairs rows):
  * queries are hashed into Q blocks and corpus vectors into C blocks; each query row is
    replicated to the C corpus blocks and each corpus row to the Q query blocks, so the
    (query block, corpus block) groups tile the product exactly once;
  * ``cogroup().applyInPandas`` scores one tile with a NumPy matrix product, walking the
    corpus side in sub-blocks and keeping a running top-k per query, and emits only k rows
    per query per tile;
  * a window rank per query (planned as a WindowGroupLimit) merges the C partial lists.
Block sizes cap the memory of one task whatever the table sizes; the number of tiles, not
the size of one, grows with the data.

``pruned_topk`` sends only the tiles that can hold a result: corpus and queries fall into cells around
pivots, a block of a cell is bounded by its distances from the pivot, and by the triangle inequality
a tile whose least possible distance exceeds the query block's k-th distance is never sent. Tiles of
neighbouring blocks are sent together: a row crosses once for all of them.

Metrics: ``cosine`` (inner product of L2-normalised vectors, larger is better; zero
vectors never match) and ``l2`` (squared Euclidean distance on raw vectors, smaller is
better). Scores are compared at 1e-9 so float noise cannot reorder exact ties; ties go to
the smaller key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tile shape: a tile holds up to QUERY_BLOCK_ROWS queries and CORPUS_BLOCK_ROWS vectors; it
# is scored QUERY_CHUNK_ROWS x SUB_BLOCK_ROWS at a time (a 64 MB score matrix at most).
# Larger tiles mean less replication (each side is copied once per block of the other).
QUERY_BLOCK_ROWS = 16384
CORPUS_BLOCK_ROWS = 65536
QUERY_CHUNK_ROWS = 1024
SUB_BLOCK_ROWS = 8192
# Vectors that are ranked whole for the first k-th score; of the others only those that reach it are.
FIRST_ROWS = 512
# Cosines of the others are first worked out in single precision, FEW_ROWS vectors at a time; up to FEW scores
# of a step that may pass, by the error of such a product, are worked out again.
FEW_ROWS, FEW = 2048, 1 << 16
TIE_DECIMALS = 9
# Rows of a block in the pruned join, most pivots (one a block up to then; beyond, larger cells are split
# and prune less) and vectors that each is chosen from; slack of a bound, far above the noise of double arithmetic.
PIVOTS, SAMPLES, PRUNE_ROWS, SLACK = 1024, 4, 4096, 1e-6
# Most blocks of either side of the pruned join that are sent together (fewer while that makes too few tasks).
TOGETHER = 8


def _matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _score_tile(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        s = q @ c.T
    else:
        s = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)
        s = np.maximum(s, 0.0) + 0.0
    return s


def _normalized(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = m / n
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _select_k(o: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k best per row by (o ascending, key ascending).

    ``argpartition`` finds each row's k-th value in O(m); only rows whose k-th value is tied
    with an unselected entry fall back to an exact sort of their tied candidates."""
    n, m = o.shape
    if m <= k:
        return np.lexsort((keys, o), axis=1)
    part = np.argpartition(o, k - 1, axis=1)[:, :k]
    po = np.take_along_axis(o, part, axis=1)
    kth = po.max(axis=1)
    sel = np.take_along_axis(part, np.lexsort((np.take_along_axis(keys, part, axis=1), po), axis=1), axis=1)
    tied = np.nonzero((o <= kth[:, None]).sum(axis=1) > k)[0]
    for r in tied:
        cand = np.nonzero(o[r] <= kth[r])[0]
        sel[r] = cand[np.lexsort((keys[r, cand], o[r, cand]))][:k]
    return sel


def _better(q: np.ndarray, c: np.ndarray, near: np.ndarray | None, keys: np.ndarray, metric: str, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Brings into ``best`` (ordering value, score, key; each row's k in order) what of ``c`` comes before a row's
    last: one comparison a score, and only those that pass it are rounded and sorted. ``near``: cosines
    of single precision, which leave out what cannot pass."""
    sign = -1.0 if metric == "cosine" else 1.0
    best_o, best_s, best_k = best
    k = best_o.shape[1]
    last = (best_o[:, -1] + 10.0**-TIE_DECIMALS)[:, None]
    error = (q.shape[1] + 8) * 2.0**-23  # of a single-precision product of vectors of length 1, at most
    if near is not None and np.count_nonzero(mask := near >= (-last - error).astype(np.float32)) <= FEW:
        rows, cols = np.nonzero(mask)
        s = np.einsum("ij,ij->i", q[rows], c[cols])
    else:
        raw = _score_tile(q, c, metric)
        rows, cols = np.nonzero(sign * raw <= last)
        s = raw[rows, cols]
    key, o = keys[cols], sign * np.round(s, TIE_DECIMALS)
    sooner = (o < best_o[rows, -1]) | ((o == best_o[rows, -1]) & (key < best_k[rows, -1]))
    if not sooner.any():
        return
    hit = np.unique(rows[sooner])
    rows = np.concatenate([np.repeat(hit, k), rows[sooner]])
    o, s, key = (np.concatenate([b[hit].ravel(), x[sooner]]) for b, x in ((best_o, o), (best_s, s), (best_k, key)))
    order = np.lexsort((key, o, rows))
    starts = np.searchsorted(rows[order], hit)
    take = order[(starts[:, None] + np.arange(k)).ravel()].reshape(len(hit), k)
    for b, x in ((best_o, o), (best_s, s), (best_k, key)):
        b[hit] = x[take]


def _key(df: DataFrame, name: str):
    """The key as long if it is a whole number, else as string."""
    return F.col(name).cast("long" if df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string")


def _keys(col: pd.Series) -> np.ndarray:
    return col.to_numpy(dtype=np.int64) if col.dtype != object else col.to_numpy(dtype=str)


def _tile_topk(k: int, metric: str):
    def run(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"query_id": qpdf["query_id"][:0], "key": cpdf["key"][:0], "score": pd.Series([], dtype="float64")})
        # a key's place in key order stands for it: a score matrix of string keys would be gigabytes
        keys, ck_all = np.unique(_keys(cpdf["key"]), return_inverse=True)
        c_all = _matrix(cpdf["vec"])
        qk_all = _keys(qpdf["query_id"])
        q_all = _matrix(qpdf["vec"])
        if metric == "cosine":
            q_all, c_all = _normalized(q_all), _normalized(c_all)
        c_few = c_all.astype(np.float32) if metric == "cosine" else None
        sign = -1.0 if metric == "cosine" else 1.0  # select ascending on sign * score
        out = []
        for qlo in range(0, len(qk_all), QUERY_CHUNK_ROWS):
            qk, q = qk_all[qlo : qlo + QUERY_CHUNK_ROWS], q_all[qlo : qlo + QUERY_CHUNK_ROWS]
            best_o = np.full((len(qk), 0), np.inf)  # ordering value: sign * score rounded at 1e-9
            best_s = np.full((len(qk), 0), np.nan)  # raw score, reported
            best_k = np.zeros((len(qk), 0), dtype=ck_all.dtype)
            first, step = max(FIRST_ROWS, k), SUB_BLOCK_ROWS if c_few is None else FEW_ROWS
            q_few = None if c_few is None else q.astype(np.float32)
            for lo, hi in [(0, first), *((x, x + step) for x in range(first, len(ck_all), step))]:
                ck, c = ck_all[lo:hi], c_all[lo:hi]
                if lo:  # every row has k by now
                    _better(q, c, None if c_few is None else q_few @ c_few[lo:hi].T, ck, metric, (best_o, best_s, best_k))
                    continue
                raw = _score_tile(q, c, metric)
                o = sign * np.round(raw, TIE_DECIMALS)
                o = np.where(np.isnan(o), np.inf, o)
                all_o = np.concatenate([best_o, o], axis=1)
                all_s = np.concatenate([best_s, raw], axis=1)
                all_k = np.concatenate([best_k, np.broadcast_to(ck, o.shape)], axis=1)
                order = _select_k(all_o, all_k, k)
                best_o = np.take_along_axis(all_o, order, axis=1)
                best_s = np.take_along_axis(all_s, order, axis=1)
                best_k = np.take_along_axis(all_k, order, axis=1)
            keep = np.isfinite(best_o)
            rows_q = np.broadcast_to(qk[:, None], best_o.shape)[keep]
            out.append(pd.DataFrame({"query_id": rows_q, "key": keys[best_k[keep]], "score": best_s[keep]}))
        return pd.concat(out, ignore_index=True)

    return run


def _wanted_topk(k: int, metric: str):
    """The tiles of some query blocks and some corpus blocks that come together: each query block (``qb``) is
    scored against the corpus blocks (``cb``) that its rows list as ``wanted``, and no others."""
    tile = _tile_topk(k, metric)

    def run(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        out = [tile(qpdf[:0], cpdf[:0])]
        cb = cpdf["cb"].to_numpy()
        for _, block in qpdf.groupby("qb"):
            out.append(tile(block, cpdf[np.isin(cb, np.asarray(block["wanted"].iloc[0]))]))
        out = [x for x in out if len(x)] or out[:1]
        return pd.concat(out, ignore_index=True)

    return run


def _blocks(n: int, rows_per_block: int, min_blocks: int = 1) -> int:
    return max(min(max(math.ceil(n / rows_per_block), min_blocks), max(n, 1)), 1)


def _result(q: DataFrame, c: DataFrame) -> str:
    return f"query_id {dict(q.dtypes)['query_id']}, key {dict(c.dtypes)['key']}, score double"


def topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    corpus_key: str = "vec_id",
    corpus_vec: str = "embedding",
    query_key: str = "query_id",
    query_vec: str = "embedding",
    query_block_rows: int = QUERY_BLOCK_ROWS,
    corpus_block_rows: int = CORPUS_BLOCK_ROWS,
    n_queries: int | None = None,
    n_corpus: int | None = None,
) -> DataFrame:
    """(query_id, key, score, rank) — the k best corpus rows per query (k = min(k, n)).

    Block counts come from the row counts of both sides. Pass ``n_queries`` / ``n_corpus``
    (an upper bound is enough, e.g. the row count of the source table) when a side is
    expensive to compute, so it is not evaluated once just to be counted."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = corpus.sparkSession
    c = corpus.select(_key(corpus, corpus_key).alias("key"), F.col(corpus_vec).cast("array<double>").alias("vec"))
    q = queries.select(_key(queries, query_key).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec"))
    c = c.where(F.col("vec").isNotNull())
    q = q.where(F.col("vec").isNotNull())
    n_q = n_queries if n_queries is not None else q.count()
    n_c = n_corpus if n_corpus is not None else c.count()
    from quire.session import parallelism as cores

    parallelism = cores(spark)
    n_qb = _blocks(n_q, query_block_rows)
    n_cb = _blocks(n_c, corpus_block_rows, min_blocks=max(parallelism // n_qb, 1))
    # Block ids are ints on both sides: cogroup co-locates groups by hashing the key values,
    # so the two sides' key types must be identical.
    q_rep = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_qb)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(n_cb - 1)))
    )
    c_rep = c.withColumn("cb", F.pmod(F.xxhash64("key"), F.lit(n_cb)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))
    )
    partial = (
        q_rep.groupBy("qb", "cb")
        .cogroup(c_rep.groupBy("qb", "cb"))
        .applyInPandas(_tile_topk(k, metric), _result(q, c))
    )
    order = F.round("score", TIE_DECIMALS)
    order = order.desc() if metric == "cosine" else order.asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("key").asc())
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grouped_topk(
    corpus: DataFrame,
    queries: DataFrame,
    group: str,
    k: int,
    metric: str = "cosine",
    corpus_block_rows: int = CORPUS_BLOCK_ROWS,
    query_block_rows: int = QUERY_BLOCK_ROWS,
) -> DataFrame:
    """Top-k per query restricted to the corpus rows of the same ``group`` value.

    corpus(key, embedding, group) and queries(query_id, embedding, group). Groups are split
    into blocks on both sides (hash of the row key), so a hot group becomes many tiles.
    Returns partial (query_id, key, score) rows, at most k per query per tile."""
    c = corpus.select(_key(corpus, "key").alias("key"), F.col("embedding").cast("array<double>").alias("vec"), F.col(group).cast("long").alias("g"))
    q = queries.select(_key(queries, "query_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col(group).cast("long").alias("g"))
    c, q = c.where(F.col("vec").isNotNull()), q.where(F.col("vec").isNotNull())
    # blocks per group come from the group's own row counts (an aggregate, joined back)
    c_sizes = c.groupBy("g").agg(F.count(F.lit(1)).alias("nc"))
    q_sizes = q.groupBy("g").agg(F.count(F.lit(1)).alias("nq"))
    sizes = c_sizes.join(q_sizes, "g").select(
        "g",
        F.greatest(F.ceil(F.col("nc") / corpus_block_rows), F.lit(1)).cast("int").alias("ncb"),
        F.greatest(F.ceil(F.col("nq") / query_block_rows), F.lit(1)).cast("int").alias("nqb"),
    )
    c_rep = c.join(sizes, "g").select(
        "key", "vec", "g", F.pmod(F.xxhash64("key"), F.col("ncb")).cast("int").alias("cb"),
        F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)).alias("qb"),
    )
    q_rep = q.join(sizes, "g").select(
        "query_id", "vec", "g", F.pmod(F.xxhash64("query_id"), F.col("nqb")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("ncb") - 1)).alias("cb"),
    )
    return (
        q_rep.groupBy("g", "qb", "cb")
        .cogroup(c_rep.groupBy("g", "qb", "cb"))
        .applyInPandas(_tile_topk(k, metric), _result(q, c))
    )


def _space(m: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean distance orders like the metric."""
    return _normalized(m) if metric == "cosine" else m


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the farthest from those before it."""
    at = [0]
    far = np.linalg.norm(points - points[0], axis=1)
    while len(at) < min(n, len(points)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[at[-1]], axis=1))
    return points[at]


def _to_pivots(pivots: np.ndarray, metric: str, name: str):
    """Adds each vector's nearest pivot and its distance from it; vectors that match nothing go."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = _space(_matrix(pdf["vec"]), metric)
            real = np.isfinite(m).all(axis=1)
            pdf, m = pdf[real], m[real]
            if len(pdf):
                d = _score_tile(m, pivots, "l2")
                cell = d.argmin(axis=1)
                # from the difference itself: the expanded square loses digits near 0
                yield pdf.assign(cell=cell.astype("int64"), dist=np.linalg.norm(m - pivots[cell], axis=1))[[name, "vec", "cell", "dist"]]

    return run


def _bounds(k: int, pivots: np.ndarray, blocks: pd.DataFrame, second: bool):
    """Corpus blocks to send to each query block. First those that hold k rows within the least upper
    bound; then, once the k-th distances are known, all others whose lower bound does not exceed them."""
    cells, lo, hi, rows = (blocks[c].to_numpy() for c in ("cell", "lo", "hi", "rows"))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                apart = np.linalg.norm(pivots[cells] - pivots[row.cell], axis=1)
                upper = apart + hi + row.hi
                order = np.argsort(upper, kind="stable")
                enough = int(np.searchsorted(np.cumsum(rows[order]), k)) + 1
                first = order[:enough]
                if not second:
                    out += [(row.qb, int(b)) for b in first]
                    continue
                least = np.maximum(0.0, np.maximum(apart - row.hi - hi, lo - row.hi - apart))
                send = np.flatnonzero(least <= row.kth + SLACK * (1 + abs(row.kth))) if np.isfinite(row.kth) else np.arange(len(rows))
                out += [(row.qb, int(b)) for b in np.setdiff1d(send, first)]
            yield pd.DataFrame(out, columns=["qb", "cb"]).astype("int64")

    return run


def _celled(df: DataFrame, name: str, pivots: np.ndarray, metric: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(``df`` with its block, blocks with cell, rows and least and largest distance from the pivot)."""
    from quire.session import stored

    kind = dict(df.dtypes)[name]
    df = stored(df.mapInPandas(_to_pivots(pivots, metric, name), f"{name} {kind}, vec array<double>, cell long, dist double"), "knn-cells")
    parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    df = df.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(name), F.col("parts")))
    blocks = df.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    return df, stored(blocks, "knn-blocks")


def _no_tiles(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("qb"), F.lit(0).cast("long").alias("cb"))


def pruned_topk(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", corpus_key: str = "vec_id", corpus_vec: str = "embedding",
    query_key: str = "query_id", query_vec: str = "embedding", pivots: int = PIVOTS, block_rows: int = PRUNE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(what ``topk`` returns, exactly; the tiles (qb, cb) that were sent). The driver holds the pivots
    and four numbers a block."""
    from quire.session import parallelism, stored

    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    c = corpus.select(_key(corpus, corpus_key).alias("key"), F.col(corpus_vec).cast("array<double>").alias("vec")).where("vec is not null")
    q = queries.select(_key(queries, query_key).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).where("vec is not null")
    wanted = min(pivots, math.ceil(c.count() / block_rows))
    if wanted <= 1:  # one block: nothing to leave out
        return topk(corpus, queries, k, metric, corpus_key, corpus_vec, query_key, query_vec), _no_tiles(corpus)
    chosen = c.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("key"), "key").limit(SAMPLES * wanted).select("vec").collect()
    if not chosen:  # no vector that anything is near to
        none = q.select("query_id").limit(0)
        return none.select("query_id", F.lit(None).cast(dict(c.dtypes)["key"]).alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")), _no_tiles(corpus)
    points = _spread(_space(np.array([r["vec"] for r in chosen], dtype=np.float64), metric), wanted)
    c, c_blocks = _celled(c, "key", points, metric, block_rows)
    q, q_blocks = _celled(q, "query_id", points, metric, block_rows)
    number = F.row_number().over(Window.orderBy("cell", "part")) - 1
    c_blocks = stored(c_blocks.withColumn("cb", number.cast("long")), "knn-blocks")
    q_blocks = stored(q_blocks.withColumn("qb", number.cast("long")), "knn-blocks")
    c = c.join(c_blocks.select("cell", "part", "cb"), ["cell", "part"]).select("key", "vec", "cb")
    q = q.join(q_blocks.select("cell", "part", "qb"), ["cell", "part"]).select("query_id", "vec", "qb")
    blocks = c_blocks.orderBy("cb").toPandas()
    n_qb, n_cb = q_blocks.count(), len(blocks)
    together = TOGETHER
    while together > 1 and math.ceil(n_qb / together) * math.ceil(n_cb / together) < 4 * parallelism(corpus.sparkSession):
        together //= 2
    group = lambda b: F.floor(F.col(b) / together)

    def scored(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
        tiles = stored(tiles, "knn-tiles")
        # neighbouring blocks travel together, so a row is sent once to all their tiles and gives one partial list
        tiles_of = tiles.groupBy("qb", group("cb").alias("cg")).agg(F.collect_list("cb").alias("wanted"))
        left = q.join(tiles_of, "qb").withColumn("qg", group("qb"))
        right = c.join(tiles.select(group("qb").alias("qg"), "cb").distinct(), "cb").withColumn("cg", group("cb"))
        partial = left.groupBy("qg", "cg").cogroup(right.groupBy("qg", "cg")).applyInPandas(_wanted_topk(k, metric), _result(q, c))
        return stored(partial, "knn-partial"), tiles

    first, sent = scored(q_blocks.mapInPandas(_bounds(k, points, blocks, False), "qb long, cb long"))
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) if metric == "cosine" else F.sqrt("score")
    # the k-th distance of each query so far (infinite with fewer), the largest of a block
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(far))).where(F.col("n") == k)
    kth = q.select("query_id", "qb").join(best.select("query_id", far.alias("far")), "query_id", "left")
    kth = kth.groupBy("qb").agg(F.max(F.coalesce("far", F.lit(float("inf")))).alias("kth"))
    second, more = scored(q_blocks.join(kth, "qb").mapInPandas(_bounds(k, points, blocks, True), "qb long, cb long"))
    order = F.round("score", TIE_DECIMALS)
    order = order.desc() if metric == "cosine" else order.asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("key").asc())
    return first.unionByName(second).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), sent.unionByName(more)
