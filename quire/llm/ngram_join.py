"""N-gram Jaccard join by PartEnum signatures, exact.

A document's set holds its distinct word n-grams; two sets link when ``100 * |A & B| >= percent *
|A | B|``. Sizes fall into bands so wide that linked sets lie in one band or in neighbours, so each
set takes part in the join of its own band and of the next. Within a band, linked sets differ in at
most k elements. The feature domain is partitioned by hash into ceil((k + 1) / 2) parts of three
subparts; some part holds at most one difference, so two of its three subparts agree: the hashes of
every pair of subparts are the set's signatures, and linked sets share one.

Steps, each a Spark job over written tables:

1. Nodes: equal sets collapse to one node (64-bit set hash), so copies cost nothing further. A node
   carries a parity sketch of at least four bits an element; sketches of two sets, folded to one
   length, differ in at most as many bits as the sets have differing elements and in hardly fewer,
   which refutes nearly all false candidates without loss. Most fall to sketches folded to a quarter
   already, so whole ones travel with the few pairs and members that are left.
2. Groups: signatures, packed, are dealt by hash range; those of one set only fall away, and groups
   with the same members collapse.
3. Rounds: first every node is paired with the most connected member of each of its groups; then
   groups that still span several components compare sketches within the group and name only edges
   that would join components. Named edges are verified on the real sets; components follow from
   large-star/small-star rounds. A group whose edge was refuted is compared again without it, until
   none is left. So each link is covered by a path of verified links, and no group emits its pairs.

Sketches and texts that a round does not ask for stay out of its exchanges: a map of bits of fixed
size, made of the hashes that are asked for, is sent to them first. Hot centres of verification are
split by salt. Nothing is capped, and nothing but counts of rows and that map reaches the driver.

Defined cases: null or empty text has an empty set, n_shingles 0, and is its own component; with
fewer words than n the whole sequence is one element; repeated rows share a component; rows with a
null id take part, a component takes the smallest id that is not null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.llm import common as C

WIDTH, PERCENT = 4, 85
#: Sketch bits an element, rounded up to a power of two.
SKETCH_BITS = 4
#: A sketch is folded so often for the first look at a pair, at which nearly all false candidates fall away.
BRIEF = 4
#: Signatures a task holds before it sends them on (bounds worker memory).
FLUSH = 1 << 19
#: Elements of all sets to a hash range of signatures (bounds the task that groups a range). A set's name goes
#: to each range that holds a signature of it, so more ranges mean more bytes a signature.
RANGE_ELEMENTS = 1 << 21
#: Bits of the map that keeps out of an exchange what its join does not ask for: 2 MB however many rows ask.
SLOTS = 1 << 24
#: Members that one verification group takes before its centre is salted.
MEMBERS = 500
#: Bits of a signature that are dropped after ranging; a clash only makes a false candidate.
_TRIM = np.uint64(16)
_SEED, _PART = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Bands:
    """Size bands [lo, hi] with hi = lo * 100 // percent, and each band's largest difference."""

    def __init__(self, percent: int) -> None:
        self.percent, self.high = percent, [0]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.high.append((self.high[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.high, size, side="left"))

    def differences(self, band: int) -> int:
        while len(self.high) <= band:
            self.high.append((self.high[-1] + 1) * 100 // self.percent)
        return 2 * self.high[band] * (100 - self.percent) // (100 + self.percent)


def sets_of(column, width: int) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    data, offsets = C.flat_bytes(column)
    out: list[np.ndarray] = []
    for a, b in C.slices(offsets, C.HASH_BYTES):
        part = C.lowered(data[offsets[a] : offsets[b]])
        starts, ends, counts = C.word_spans(part, offsets[a : b + 1] - offsets[a])
        words = C.span_hashes(part, starts, ends)
        rolled = {w: C.rolling(words, w) + C.mix_int(w) for w in {width, *(int(x) for x in np.unique(counts) if 0 < x < width)}}
        at = 0
        for n in counts.tolist():
            w = min(n, width)
            out.append(np.unique(rolled[w][at : at + n - w + 1]) if n else np.zeros(0, np.uint64))
            at += n
    return out


def set_hash(s: np.ndarray) -> int:
    return int(C.mix(np.array([np.sum(C.mix(s ^ _SEED), dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell, a power of two of cells."""
    cells = 1 << max(6, (SKETCH_BITS * len(s) - 1).bit_length())
    cell = (s >> np.uint64(20)) & np.uint64(cells - 1)
    return np.packbits(np.bincount(cell.astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches as rows of ``size`` bytes, longer ones folded onto themselves."""
    out = np.empty((len(sketches), size // 8), dtype=np.uint64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, size // 8), axis=0)
    return out


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    own = bands.of(len(s))
    g = C.mix(s + _SEED)
    low, high = (g & np.uint64(0xFFFFFFFF)).astype(np.float64), (g >> np.uint64(32)).astype(np.float64)
    out = []
    for band in (own, own + 1):
        k = bands.differences(band)
        if not k:
            continue  # only equal sets link here, and they are one node
        parts = (k + 2) // 2
        cell = (s % np.uint64(3 * parts)).astype(np.int64)
        sums = np.bincount(cell, weights=low, minlength=3 * parts).astype(np.uint64) + (np.bincount(cell, weights=high, minlength=3 * parts).astype(np.uint64) << np.uint64(32))
        sums = sums.reshape(parts, 3)
        pair = np.stack([sums[:, 0] + sums[:, 1], sums[:, 0] + sums[:, 2], sums[:, 1] + sums[:, 2]], axis=1).ravel()
        out.append(C.mix(pair + np.arange(1, 3 * parts + 1, dtype=np.uint64) * _PART + C.mix_int(band + 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _nodes(width: int):
    @C.worker("ngram_join")
    def run(batches):
        for batch in batches:
            sets = sets_of(batch["text"], width)
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"], "text_hash": batch["text_hash"], "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                "sketch": pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            })

    return run


def _signature_side(width: int, percent: int, ranges: int):
    @C.worker("ngram_join")
    def run(batches):
        bands = Bands(percent)
        found: list[np.ndarray] = []
        nodes: list[int] = []
        seen: set[int] = set()
        held = 0

        def flush():
            key = np.concatenate(found)
            owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
            by = np.argsort(key)
            key, owner = key[by], owner[by]
            name = np.array(nodes, dtype=np.int64)
            rows = []
            for r, a, b in C.key_ranges(key, ranges):
                local, place = np.unique(owner[a:b], return_inverse=True)
                rows.append((r, C.pack_sorted(key[a:b] >> _TRIM), C.pack_small(place.astype(np.uint32)), name[local].tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_pydict({"hash_range": pa.array(cols[0], pa.int32()), "keys": pa.array(cols[1], pa.binary()), "places": pa.array(cols[2], pa.binary()), "nodes": pa.array(cols[3], pa.binary())})

        for batch in batches:
            for s in sets_of(batch["text"], width):
                if not len(s) or (node := set_hash(s)) in seen:
                    continue
                seen.add(node)
                got = signatures(s, bands)
                if len(got):
                    found.append(got)
                    nodes.append(node)
                    held += len(got)
                if held >= FLUSH:
                    yield flush()
                    found, nodes, seen, held = [], [], set(), 0
        if found:
            yield flush()

    return run


def _group_side(table: pa.Table) -> pa.Table:
    """(group, node) of every signature that at least two nodes share; same members, same group."""
    keys, nodes = [], []
    for key, place, node in zip(table["keys"].to_pylist(), table["places"].to_pylist(), table["nodes"].to_pylist()):
        keys.append(C.unpack_sorted(key))
        nodes.append(np.frombuffer(node, dtype=np.int64)[C.unpack_small(place, np.uint32)])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    by = np.argsort(key, kind="stable")
    key, node = key[by], node[by]
    same = key[1:] == key[:-1]
    many = np.r_[False, same] | np.r_[same, False]
    key, node = key[many], node[many]
    by = np.lexsort((node, key))
    key, node = key[by], node[by]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
    key, node = key[fresh], node[fresh]
    empty = pa.table({"grp": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
    if not len(key):
        return empty
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    name = C.mix(np.add.reduceat(C.mix(node.view(np.uint64) ^ _SEED), first) + size.astype(np.uint64))
    _, one = np.unique(name, return_index=True)
    one = one[size[one] > 1]
    if not len(one):
        return empty
    return pa.table({"grp": np.repeat(name[one].view(np.int64), size[one]), "node": C.ragged_take(node, first[one], size[one])})


def _most(percent: int, a, b):
    """The largest difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def _brief(batches):
    """Nodes with their sketches folded to a share, 8 bytes at least."""
    for batch in batches:
        short = [folded([x], max(8, len(x) // BRIEF)).tobytes() for x in batch["sketch"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"node": batch["node"], "n": batch["n"], "sketch": pa.array(short, pa.binary())})


def _passing(percent: int):
    """Keeps pairs whose sizes and sketches allow a link."""

    @C.worker("ngram_join")
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist()
            size = np.array([min(len(i), len(j)) for i, j in zip(x, y)])
            apart = np.empty(len(x), dtype=np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n).tolist()
                apart[at] = np.bitwise_count(folded([x[i] for i in at], n) ^ folded([y[i] for i in at], n)).sum(axis=1, dtype=np.int64)
            a, b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            near = np.maximum(apart, np.abs(a - b)) <= _most(percent, a, b)
            yield batch.select(["a", "b", "weight"]).filter(pa.array(near))

    return run


def _group_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, sketches of one length, components by number) of a group's members."""
    sketches = table["sketch"].to_pylist()
    return table["n"].to_numpy(), folded(sketches, min(map(len, sketches))), np.unique(table["component"].to_numpy(), return_inverse=True)[1]


def _others(i: int, percent: int, n: np.ndarray, bits: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members of other components that sizes and sketches allow a link with member i, how far each is)."""
    at = np.flatnonzero(part != part[i])
    at = at[np.abs(n[at] - n[i]) <= _most(percent, n[at], n[i])]
    far = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
    near = far <= _most(percent, n[at], n[i])
    return at[near], far[near]


def _open(percent: int):
    """Within one group: the members that may link with one of another component. Folded sketches
    differ in no more bits than whole ones, so no link is lost."""

    @C.worker("ngram_join")
    def run(table: pa.Table) -> pa.Table:
        n, bits, part = _group_rows(table)
        main, kept = int(np.argmax(np.bincount(part))), np.zeros(len(n), dtype=bool)
        for i in np.flatnonzero(part != main).tolist():
            at, _ = _others(i, percent, n, bits, part)
            kept[at] = True
            kept[i] |= len(at) > 0
        return table.select(["grp", "node", "component"]).filter(pa.array(kept))

    return run


def _compare(percent: int):
    """Within one group: edges between components that sketches allow and nothing refuted. Of a
    member's edges the nearest to each new component counts as a join; further ones go to components
    it has named already, so a refuted edge has the others beside it in the same round, while
    members that all link name a spanning tree and not their pairs."""

    @C.worker("ngram_join")
    def run(table: pa.Table) -> pa.Table:
        node, (n, bits, part) = table["node"].to_numpy(), _group_rows(table)
        refuted = [set(x or ()) for x in table["refuted"].to_pylist()]
        main, joined = int(np.argmax(np.bincount(part))), part.copy()
        out = []
        # Every edge between components has an end outside the largest one.
        for i in np.flatnonzero(part != main).tolist():
            at, far = _others(i, percent, n, bits, part)
            named: set[int] = set()
            for j in at[np.argsort(far, kind="stable")].tolist():
                fresh = joined[j] != joined[i]
                if (fresh or part[j] in named) and int(node[j]) not in refuted[i] and int(node[i]) not in refuted[j]:
                    out.append((max(node[i], node[j]), min(node[i], node[j])))
                    named.add(part[j])
                    if fresh:
                        joined[joined == joined[j]] = joined[i]
        grp = table["grp"][0].as_py()
        return pa.table({"grp": pa.array([grp] * len(out), pa.int64()), "a": pa.array([int(a) for a, _ in out], pa.int64()), "b": pa.array([int(b) for _, b in out], pa.int64())})

    return run


def _sets(width: int):
    @C.worker("ngram_join")
    def run(batches):
        for batch in batches:
            wanted = batch["node"].to_pylist()
            sets = sets_of(batch["text"], width)
            mine = [i for i, s in enumerate(sets) if len(s) and set_hash(s) == wanted[i]]
            kept = batch.select(["centre", "salt", "member", "node"]).take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_pydict({c: kept[c] for c in kept.schema.names} | {"elements": pa.array([sets[i].tobytes() for i in mine], pa.binary())})

    return run


def _verify(percent: int):
    @C.worker("ngram_join")
    def run(table: pa.Table) -> pa.Table:
        centre, out = None, {}
        rows = list(zip(table["member"].to_pylist(), table["node"].to_pylist(), table["elements"]))
        for member, _, elements in rows:
            if not member:
                centre = np.frombuffer(elements.as_buffer(), dtype=np.uint64)
        for member, node, elements in rows:
            if member:
                s = np.frombuffer(elements.as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                both = int((centre[at] == s).sum())
                out[node] = 100 * both >= percent * (len(s) + len(centre) - both)
        name = table["centre"][0].as_py()
        return pa.table({"a": pa.array(list(out), pa.int64()), "b": pa.array([name] * len(out), pa.int64()), "ok": pa.array(list(out.values()), pa.bool_())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node of its component,
    by alternating large-star and small-star until nothing changes."""

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        """The written edges with their number and checksum, observed while writing."""
        seen = Observation()
        marked = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return C.stored(marked, "edges"), seen.get

    def least_of(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    now, last = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = least_of(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        least = least_of(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now, mark = kept(small)
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _asked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key``, a hash, may be among those of ``wanted`` (one column), for an exact join to
    follow. A map of bits goes to the rows, so only these enter the join's exchange; a crowded map lets
    more of them through and loses none."""
    slot = F.pmod(F.col(wanted.columns[0]), F.lit(SLOTS))
    bits = wanted.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_at")).repartition("_bucket")
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    slot = F.pmod(F.col(key), F.lit(SLOTS))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("_bucket"))
    return found.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, ok) of candidate pairs, on the real sets of one document of each node. Only texts that a pair
    asks for cross an exchange; repeated rows of that document come along."""
    salts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("members")).select("b", F.ceil(F.col("members") / MEMBERS).alias("salts"))
    member = pairs.join(salts, "b").select(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(True).alias("member"), F.col("a").alias("node"))
    centre = salts.select(F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("b").alias("node"))
    wanted = C.stored(member.unionByName(centre), "wanted")
    names = _asked(nodes.select("node", "rep_id", "rep_hash"), "node", wanted.select("node"))
    wanted = C.stored(wanted.join(names, "node"), "wanted")
    # a shuffle at every size: the wanted texts grow with the corpus
    texts = _asked(docs, "text_hash", wanted.select("rep_hash")).join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    sets = texts.select("centre", "salt", "member", "node", "text").mapInArrow(_sets(width), "centre long, salt long, member boolean, node long, elements binary")
    return sets.groupBy("centre", "salt").applyInArrow(_verify(percent), "a long, b long, ok boolean")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), class_id (the component,
    null for an empty set) and text_hash (xxhash64 of the text) of every row of ``docs``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    every = rows.mapInArrow(_nodes(width), "id long, text_hash long, n long, node long, sketch binary")
    every = C.stored(every, "sets")
    rep = F.min(F.struct(F.col("id").isNull(), "id", "text_hash"))
    nodes = C.stored(
        every.filter("node is not null").groupBy("node").agg(rep.alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select("node", F.col("r.id").alias("rep_id"), F.col("r.text_hash").alias("rep_hash"), "n", "sketch"), "nodes")

    elements = every.agg(F.sum("n")).first()[0] or 0
    ranges = max(C.shuffle_partitions(docs.sparkSession), -(-elements // RANGE_ELEMENTS))
    sent = rows.select("text").mapInArrow(_signature_side(width, percent, ranges), "hash_range int, keys binary, places binary, nodes binary")
    groups = C.stored(sent.groupBy("hash_range").applyInArrow(_group_side, "grp long, node long").distinct(), "groups")

    # Round 0: each node and the most connected member of each of its groups.
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    weight = groups.join(sizes, "grp").groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = groups.join(weight, "node").groupBy("grp").agg(F.max(F.struct("weight", "node")).alias("hub"))
    pairs = groups.join(hubs, "grp").filter(F.col("node") != F.col("hub.node")).groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.max("hub.weight").alias("weight"))

    def sketches(asked: DataFrame) -> DataFrame:
        return _asked(nodes.select("node", "n", "sketch"), "node", asked)

    def brief(asked: DataFrame) -> DataFrame:
        return sketches(asked).mapInArrow(_brief, "node long, n long, sketch binary")

    def passing(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        side = lambda s: rows.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_passing(percent), "a long, b long, weight long")

    near = C.stored(passing(pairs, brief(groups.select("node"))), "brief")
    near = passing(near, sketches(near.select(F.explode(F.array("a", "b")))))
    named = C.stored(near.groupBy("a").agg(F.max(F.struct("weight", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "named")
    checked = found = None
    while True:
        if named.head(1):
            now = _verified(named.select("a", "b").distinct(), nodes, rows, width, percent)
            checked = C.stored(now if checked is None else now.unionByName(checked), "checked")
            bad = checked.filter("not ok").select("a", "b")
            found = C.stored(components(checked.filter("ok").select("a", "b")), "components")
            if "grp" in named.columns:  # only groups with a refuted edge can still hold one
                groups = C.stored(groups.join(named.join(bad, ["a", "b"], "left_semi").select("grp").distinct(), "grp", "left_semi"), "groups")
        elif "grp" in named.columns:
            break
        active = groups.withColumn("component", F.col("node")) if found is None else groups.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spans = active.groupBy("grp").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("grp")
        active = active.join(spans, "grp", "left_semi").select("grp", "node", "component").join(brief(groups.select("node")), "node")
        active = C.stored(active.groupBy("grp").applyInArrow(_open(percent), "grp long, node long, component long"), "open")
        active = active.join(sketches(active.select("node")), "node")
        if checked is None:
            active = active.withColumn("refuted", F.array().cast("array<bigint>"))
        else:
            active = active.join(bad.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refuted")), "node", "left")
        named = C.stored(active.select("grp", "node", "n", "sketch", "component", "refuted").groupBy("grp").applyInArrow(_compare(percent), "grp long, a long, b long"), "named")
    return _labelled(every, nodes, found)


def _labelled(every: DataFrame, nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    ids = nodes.select("node", "rep_id").withColumn("component", F.col("node"))
    if found is not None:
        ids = nodes.select("node", "rep_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    ids = ids.join(least, "component").select("node", "component", "component_id")
    out = every.select("id", "n", "node", "text_hash").join(ids, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("component").alias("class_id"), "text_hash")
