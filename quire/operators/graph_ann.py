"""Approximate nearest neighbours over a neighbour graph, built and searched by Spark joins.

Vectors are normalised and quantised to two bytes a number (``codes``); the graph is built and walked on
codes, exact vectors are opened only to rank the last candidates.

Build (``build``):
  * starting lists: in each of ``TABLES`` random-hyperplane hashings, vectors of one cell (split by
    salt beyond ``BLOCK`` rows) are compared exactly, the best ``degree`` kept;
  * rounds of neighbour-of-neighbour joins: a node meets the nodes that list it with all it lists and
    is listed by, and tells each of them which are nearer than its last neighbour; lists merge and the
    best ``degree`` stay, until a round changes fewer than ``SETTLED`` of the entries;
  * the graph links both ways. A node that many list (a hub) keeps its ``2 * degree`` nearest such
    links, and every node has ``LONG`` links to random nodes, which join far regions.
Search (``search``): a beam of ``breadth`` candidates for each query starts at hash-chosen entry nodes; a
round opens the adjacency of the best ``FRONT`` candidates not opened so far, by one join, and ends for
a query once all of its beam is opened. The best ``reopen`` are scored on their exact vectors.

Every step is a join or an aggregation over written tables with lists of bounded length; the driver
holds the entry codes (``ENTRIES``) and counts. Null and zero vectors match nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.knn import TIE_DECIMALS, _key, _normalized
from quire.session import stored

DEGREE, BREADTH = 32, 64
TABLES, BLOCK, SETTLED = 4, 512, 0.01
LONG, ENTRIES, FRONT = 2, 64, 16
#: Candidates that a node tells another one in a round.
TOLD = 8


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _encode(batches):
    """(key, code) of the vectors that are not null or zero."""
    for batch in batches:
        vec = batch["vec"]
        if len(vec) == 0:
            continue
        m = _normalized(np.stack([np.asarray(v, dtype=np.float64) for v in vec.to_pylist()]))
        real = np.isfinite(m).all(axis=1)
        codes = np.round(m[real] * 32767).astype(np.int16)
        yield pa.RecordBatch.from_pydict({"key": batch["key"].filter(pa.array(real)), "code": pa.array([c.tobytes() for c in codes], pa.binary())})


def _cells(bits: int, tables: int):
    """(table, cell, key, code) by the signs of random projections; the last table is random."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _flat(batch["code"], np.int16).reshape(batch.num_rows, -1).astype(np.float32)
            planes = np.random.default_rng(11).standard_normal((codes.shape[1], tables * bits), dtype=np.float32)
            signs = (codes @ planes > 0).reshape(len(codes), tables, bits)
            cell = (signs.astype(np.int64) << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(codes), tables), np.int64)
            for t in range(tables):
                yield pa.RecordBatch.from_pydict({"table": pa.array(np.full(len(codes), t), pa.int32()), "cell": pa.array(cell[:, t]), "key": batch["key"], "code": batch["code"]})
            yield pa.RecordBatch.from_pydict({"table": pa.array(np.full(len(codes), tables), pa.int32()), "cell": pa.array(np.zeros(len(codes), np.int64)), "key": batch["key"], "code": batch["code"]})

    return run


def _lists(keys: np.ndarray, sims: np.ndarray, at: np.ndarray) -> dict:
    """Arrow columns of the entries ``at`` (a row of places for each list, best first)."""
    n, k = at.shape
    offsets = pa.array(np.arange(0, n * k + 1, k), pa.int32()) if k else pa.array(np.zeros(n + 1), pa.int32())
    return {"keys": pa.ListArray.from_arrays(offsets, pa.array(keys[at].ravel(), pa.int64())), "sims": pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(sims, at, axis=1).ravel(), pa.float32()))}


def _block(degree: int, tables: int):
    def run(table: pa.Table) -> pa.Table:
        keys, codes = table["key"].to_numpy(), _flat(table["code"], np.int16).reshape(table.num_rows, -1).astype(np.float32)
        by = np.argsort(keys)
        keys, codes = keys[by], codes[by]
        random = table["table"][0].as_py() == tables
        if random:  # the next rows of the block, which is a random one
            k = min(LONG, len(keys) - 1)
            at = (np.arange(len(keys))[:, None] + np.random.default_rng(len(keys)).permutation(len(keys) - 1)[None, :k] + 1) % len(keys) if k else np.zeros((len(keys), 0), np.int64)
            sims = np.zeros((len(keys), len(keys)), np.float32)
        else:
            sims = codes @ codes.T
            np.fill_diagonal(sims, -np.inf)
            k = min(degree, len(keys) - 1)
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if 0 < k < len(keys) else np.zeros((len(keys), 0), np.int64)
        return pa.table({"u": pa.array(keys), **_lists(keys, sims, at), "random": pa.array([random] * len(keys), pa.bool_())})

    return run


def _ragged(array: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(the flat values of a list column, the row of each)."""
    lengths = np.diff(array.offsets.to_numpy())
    return array.flatten(), np.repeat(np.arange(len(array)), lengths)


def _listed(row: np.ndarray, rows: int, **columns: pa.Array) -> dict:
    """List columns of ``rows`` rows from flat values in ascending order of their row."""
    offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    return {name: pa.ListArray.from_arrays(offsets, x) for name, x in columns.items()}


def _merged(degree: int):
    """A node's lists merged, the best ``degree`` kept; entries that its own list did not have."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists, row = _ragged(batch["lists"])
            entry, at = _ragged(lists.field("keys"))
            key, sim = entry.to_numpy(), lists.field("sims").flatten().to_numpy()
            own, row = lists.field("own").to_numpy(zero_copy_only=False)[at].astype(bool), row[at]
            by = np.lexsort((-sim, key, row))
            key, sim, own, row = key[by], sim[by], own[by], row[by]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, np.int64)
            own = np.logical_or.reduceat(own, first) if len(first) else own
            key, sim, row = key[first], sim[first], row[first]
            by = np.lexsort((key, -sim, row))
            by = by[np.arange(len(by)) - np.searchsorted(row, row) < degree]  # rows stay in place under this order
            fresh = np.bincount(row[by], weights=~own[by], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"u": batch["u"], **_listed(row[by], n, keys=pa.array(key[by], pa.int64()), sims=pa.array(sim[by], pa.float32())), "fresh": pa.array(fresh)})

    return run


def _told(batches):
    """At a node: for each node that lists it, the members nearer than that node's last neighbour."""
    for batch in batches:
        members, _ = _ragged(batch["members"])
        if not len(members):
            continue
        edges = batch["members"].offsets.to_numpy() - batch["members"].offsets[0].as_py()
        keys, codes = members.field("key").to_numpy(), _flat(members.field("code"), np.int16).reshape(len(members), -1).astype(np.float32)
        last = members.field("last").to_numpy(zero_copy_only=False)  # null: NaN
        out_u, out_k, out_s, sizes = [], [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            back = a + np.flatnonzero(~np.isnan(last[a:b]))
            one, place = np.unique(keys[a:b], return_index=True)
            near = codes[back] @ codes[a + place].T
            near[one == keys[back, None]] = -np.inf
            at = np.argsort(-near, axis=1, kind="stable")[:, :TOLD]
            near = np.take_along_axis(near, at, axis=1)
            good = near > last[back, None]
            size = good.sum(axis=1)
            some = size > 0
            out_u.append(keys[back][some])
            sizes.append(size[some])
            out_k.append(one[at[good]])
            out_s.append(near[good])
        sizes = np.concatenate(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(out_u), pa.int64()), **_listed(row, len(sizes), keys=pa.array(np.concatenate(out_k), pa.int64()), sims=pa.array(np.concatenate(out_s), pa.float32()))})


_LISTS = "u long, keys array<long>, sims array<float>"


def _links(lists: DataFrame, degree: int) -> DataFrame:
    """(u, key, last): what each node lists, and its ``2 * degree`` nearest of the nodes that list it,
    those with the similarity of their own last neighbour."""
    each = lists.select("u", F.element_at("sims", -1).alias("last"), F.explode(F.arrays_zip("keys", "sims")).alias("e"))
    nearest = Window.partitionBy("u").orderBy(F.desc("sim"), "key")
    back = each.select(F.col("e.keys").alias("u"), F.col("u").alias("key"), "last", F.col("e.sims").alias("sim"))
    back = back.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= 2 * degree)
    return each.select("u", F.col("e.keys").alias("key"), F.lit(None).cast("float").alias("last")).unionByName(back.select("u", "key", "last"))


def encode(corpus: DataFrame, key: str, vec: str) -> DataFrame:
    c = corpus.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).filter("key is not null and vec is not null")
    return stored(c.mapInArrow(_encode, "key long, code binary").dropDuplicates(["key"]), "graph-codes")


def build(codes: DataFrame, degree: int = DEGREE, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(u, keys): the neighbours of every node, from ``codes(key, code)``."""
    n = codes.count()
    bits = max(0, (-(-n // block) - 1).bit_length())
    rows = stored(codes.mapInArrow(_cells(bits, tables), "table int, cell long, key long, code binary"), "graph-cells")
    parts = rows.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    rows = rows.join(parts, ["table", "cell"]).withColumn("salt", F.pmod(F.xxhash64("key", "table"), F.col("parts")))
    start = stored(rows.groupBy("table", "cell", "salt").applyInArrow(_block(degree, tables), f"{_LISTS}, random boolean"), "graph-blocks")
    far = start.filter("random").select("u", F.explode("keys").alias("key"), F.lit(None).cast("float").alias("last"))

    def merge(df: DataFrame) -> DataFrame:
        lists = df.groupBy("u").agg(F.collect_list(F.struct("keys", "sims", "own")).alias("lists"))
        return stored(lists.mapInArrow(_merged(degree), f"{_LISTS}, fresh long"), "graph-lists")

    lists = merge(start.filter("not random").withColumn("own", F.lit(False)).drop("random"))
    while True:
        members = _links(lists, degree).join(codes, "key").groupBy("u").agg(F.collect_list(F.struct("key", "last", "code")).alias("members"))
        told = members.mapInArrow(_told, _LISTS).withColumn("own", F.lit(False))
        lists = merge(lists.select("u", "keys", "sims").withColumn("own", F.lit(True)).unionByName(told))
        if (lists.agg(F.sum("fresh")).first()[0] or 0) <= SETTLED * degree * n:
            break
    links = _links(lists, degree).unionByName(far).select("u", "key").distinct()
    return stored(links.groupBy("u").agg(F.collect_list("key").alias("keys")), "graph")


def _entered(entries: list[tuple[int, bytes]], breadth: int):
    """The beam of each query at the entry nodes: keys, similarities and whether opened."""

    def run(batches):
        keys = np.array([k for k, _ in entries], dtype=np.int64)
        codes = np.frombuffer(b"".join(c for _, c in entries), dtype=np.int16).reshape(len(keys), -1).astype(np.float32)
        for batch in batches:
            out = []
            for q in batch["query"].to_pylist():
                sims = codes @ np.frombuffer(q, dtype=np.float32)
                at = np.lexsort((keys, -sims))[:breadth]
                out.append((keys[at].tolist(), sims[at].tolist()))
            yield pa.RecordBatch.from_pydict({
                "query_id": batch["query_id"], "query": batch["query"], "keys": pa.array([k for k, _ in out], pa.list_(pa.int64())), "sims": pa.array([s for _, s in out], pa.list_(pa.float32())),
                "opened": pa.array([[False] * len(k) for k, _ in out], pa.list_(pa.bool_())), "visited": pa.array([0] * len(out), pa.int64()),
            })

    return run


def _stepped(breadth: int):
    """The beam after the adjacency of its best unopened candidates has been read."""

    def run(batches):
        for batch in batches:
            cols = {c: batch[c].to_pylist() for c in ("query", "keys", "sims", "opened", "visited", "found")}
            out = []
            for q, keys, sims, opened, visited, found in zip(*cols.values()):
                beam = {k: (s, o) for k, s, o in zip(keys, sims, opened)}
                front = [i for i, o in enumerate(opened) if not o][:FRONT]  # a beam is in order
                beam.update((keys[i], (sims[i], True)) for i in front)
                if found:
                    fresh = {k: c for k, c in zip(found["keys"], found["codes"]) if k not in beam}
                    if fresh:
                        near = np.frombuffer(b"".join(fresh.values()), dtype=np.int16).reshape(len(fresh), -1).astype(np.float32) @ np.frombuffer(q, dtype=np.float32)
                        beam.update((k, (float(s), False)) for k, s in zip(fresh, near))
                best = sorted(beam.items(), key=lambda kv: (-kv[1][0], kv[0]))[:breadth]
                out.append(([k for k, _ in best], [s for _, (s, _) in best], [o for _, (_, o) in best], visited + len(front)))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.int64())
            yield pa.RecordBatch.from_pydict({"query_id": batch["query_id"], "query": batch["query"], **{c: pa.array([o[i] for o in out], kinds[i]) for i, c in enumerate(("keys", "sims", "opened", "visited"))}})

    return run


def search(graph: DataFrame, codes: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH, reopen: int | None = None,
           key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank, visited, opened): cosine neighbours from the graph; ``visited`` nodes had
    their adjacency read for the query and ``opened`` vectors were read."""
    reopen = reopen or 4 * k
    entries = [(r["key"], bytes(r["code"])) for r in codes.orderBy(F.xxhash64("key"), "key").limit(ENTRIES).collect()]
    q = queries.select(_key(queries, query_key).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).filter("vec is not null")
    kind = dict(q.dtypes)["query_id"]

    def unit(batches):
        for batch in batches:
            if batch.num_rows:
                m = _normalized(np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"].to_pylist()]))
                real = np.isfinite(m).all(axis=1)
                yield pa.RecordBatch.from_pydict({"query_id": batch["query_id"].filter(pa.array(real)), "query": pa.array([x.astype(np.float32).tobytes() for x in m[real]], pa.binary())})

    state = f"query_id {kind}, query binary, keys array<long>, sims array<float>, opened array<boolean>, visited long"
    q = stored(q.mapInArrow(unit, f"query_id {kind}, query binary"), "graph-queries")
    if not entries:
        return q.select("query_id", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("visited"), F.lit(0).alias("opened")).limit(0)
    beams = stored(q.mapInArrow(_entered(entries, breadth), state), "graph-beams")
    ended = None
    while True:
        going = beams.filter(F.exists("opened", lambda x: ~x))
        done = beams.filter(~F.exists("opened", lambda x: ~x))
        ended = done if ended is None else ended.unionByName(done)
        if going.isEmpty():
            break
        unopened = F.slice(F.filter(F.arrays_zip("keys", "opened"), lambda e: ~e["opened"]), 1, FRONT)
        front = going.select("query_id", F.explode(unopened).alias("e")).select("query_id", F.col("e.keys").alias("u"))
        # names first, then the codes of those that the queries meet: a round reads each table once, and what moves follows the queries
        met = graph.join(stored(front, "graph-front"), "u").select("query_id", F.explode("keys").alias("key")).distinct()
        found = codes.join(stored(met, "graph-met"), "key").groupBy("query_id").agg(F.struct(F.collect_list("key").alias("keys"), F.collect_list("code").alias("codes")).alias("found"))
        beams = stored(going.join(found, "query_id", "left").mapInArrow(_stepped(breadth), state), "graph-beams")
    best = ended.select("query_id", "visited", F.slice("keys", 1, reopen).alias("keys"))
    best = stored(best.select("query_id", "visited", F.size("keys").alias("opened"), F.explode("keys").alias("key")), "graph-candidates")
    exact = corpus.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).join(best, "key")
    own = queries.select(_key(queries, query_key).alias("query_id"), F.col(query_vec).cast("array<double>").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = exact.join(own, "query_id").withColumn("score", dot(F.col("vec"), F.col("q")) / F.sqrt(dot(F.col("vec"), F.col("vec")) * dot(F.col("q"), F.col("q"))))
    order = Window.partitionBy("query_id").orderBy(F.round("score", TIE_DECIMALS).desc(), "key")
    return scored.select("query_id", "key", "score", "visited", "opened", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)
