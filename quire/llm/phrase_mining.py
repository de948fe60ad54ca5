"""Phrase collocations by Toivonen mining: a sample proposes, a full pass counts, failures expand.

Texts (A-Z lower-cased) fall into pieces and words; everything is per language. A phrase of words
is frequent if it occurs ``least`` times. Its parts are then frequent too, so:

1. Sample: in a share of the documents, chosen by hash, phrases of 1 to ``longest - 1`` words that occur
   often enough for the share (with a margin) are proposed.
2. Full pass: all single words are counted, and every longer phrase both of whose one-word-shorter
   parts are proposed: the proposed phrases and their negative border.
3. A frequent phrase that was not proposed is a border failure: longer phrases around it were not
   counted. Another pass counts exactly those, and so on until a pass finds no new failure. The counts
   of frequent phrases are then exact and complete, whatever the sample held.

Proposals go to the tasks as one bitmap a length, of bounded size: a false positive only counts a phrase
more, and a bitmap that fills up prunes less but loses nothing. Tasks count by 64-bit hashes, some slices
of text at a time, and send the phrases themselves, packed by hash range; a range's task sums them by
their words. Ranges follow from the bytes of text, so a range is of bounded size at any size of corpus.

4. A candidate's cuts are joined with the counts of their parts; the lowest score counts, in exact
   integers (decimals). Candidates inside a longer one that is at least half as frequent drop.

Defined cases: null text is empty, null language is ``und``; repeated rows count each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C

LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
#: Share of the documents in the sample, and of the expected count that proposes a phrase there.
SHARE, MARGIN = 0.125, 0.8
#: Most bits of a bitmap of proposals (16 MB), bits for each proposal below that, and bits of the
#: segments that a bitmap is put together from.
BITS, BITS_EACH, SEGMENT = 1 << 27, 16, 1 << 16
#: Bytes of text whose phrases are counted at once, distinct phrases that a task holds before it sends
#: them, and bytes of text to a hash range.
SLICE_BYTES, FLUSH, RANGE_BYTES = 1 << 20, 1 << 18, 1 << 24

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _BREAK.copy()
_BLANK[[0x20, 0x09]] = True


class Grams:
    """All phrases of the texts of some rows, as 64-bit hashes by number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], longest: int) -> None:
        self.data = C.lowered(data)
        self.starts, self.ends, counts = C.word_spans(self.data, offsets, _BLANK)
        self.row = np.repeat(np.arange(len(counts)), counts)
        breaks = np.cumsum(_BREAK[self.data])[self.starts] if len(self.starts) else self.row
        joined = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        names = C.mix(np.array([hash_text(x) for x in langs], dtype=np.uint64) * C.ROLL)  # not the hashes of words
        word = C.mix(C.span_hashes(self.data, self.starts, self.ends) ^ names[self.row]) if len(self.starts) else np.zeros(0, np.uint64)
        #: Hashes of the phrases of k words that begin at each word, and whether there is one.
        self.key, self.real = {1: word}, {1: np.ones(len(word), dtype=bool)}
        for k in range(2, longest + 1):
            n = max(0, len(word) - k + 1)
            self.key[k] = C.mix(self.key[k - 1][:n] * C.ROLL + word[k - 1 : k - 1 + n] + np.uint64(k))
            self.real[k] = self.real[k - 1][:n] & joined[k - 2 : k - 2 + n]

    def phrases(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words beginning at words ``at``, joined by single spaces."""
        a, b = self.starts[at], self.ends[at + words - 1]
        offsets = np.r_[0, np.cumsum(b - a)].astype(np.int32)
        flat = C.ragged_take(self.data, a, b - a)
        blanks = _BLANK[flat]
        out = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
        if int(blanks.sum()) != len(at) * (words - 1) or bool((flat[blanks] != 0x20).any()):
            out = pa.array([b" ".join(x.split()) for x in out.to_pylist()], pa.binary())
        return out


def hash_text(text: str) -> np.uint64:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return C.span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0] if len(raw) else np.uint64(0)


def _slices(batches, longest: int):
    for batch in batches:
        data, offsets = C.flat_bytes(batch["text"])
        langs = batch["lang"].to_pylist()
        for a, b in C.slices(offsets, SLICE_BYTES):
            yield Grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs[a:b], longest), langs[a:b]


def _sampled(longest: int):
    @C.worker("phrase_mining")
    def run(batches):
        for grams, _ in _slices(batches, longest - 1):
            for k in range(1, longest):
                key, n = np.unique(grams.key[k][grams.real[k]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"words": pa.array(np.full(len(key), k), pa.int32()), "key": pa.array(key.view(np.int64)), "n": pa.array(n, pa.int64())})

    return run


Proposals = dict[int, np.ndarray]


def has(proposals: list[Proposals], words: int, key: np.ndarray) -> np.ndarray:
    """Whether one of the bitmaps for so many words has the key."""
    out = np.zeros(len(key), dtype=bool)
    for bitmap in (p[words] for p in proposals):
        at = key & np.uint64(64 * len(bitmap) - 1)
        out |= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _due(grams: Grams, k: int, old: list[Proposals], new: Proposals) -> np.ndarray:
    """Beginnings of the phrases of k words that this pass counts: both parts are proposed and, in a
    pass of expansion, one of them newly."""
    if k == 1:
        return np.flatnonzero(grams.real[1]) if not old else np.zeros(0, np.int64)
    at = np.flatnonzero(grams.real[k])
    left, right = grams.key[k - 1][at], grams.key[k - 1][at + 1]
    now = has([*old, new], k - 1, left) & has([*old, new], k - 1, right)
    at, left, right = at[now], left[now], right[now]
    return at[~(has(old, k - 1, left) & has(old, k - 1, right))]


def _counted(longest: int, old: list[Proposals], new: Proposals, ranges: int):
    """Packed counts by hash range: language, line feed, phrase; the phrase of no words is all words."""

    def pack(keys: list[np.ndarray], names: list[pa.Array], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        name = pa.concat_arrays(names).take(pa.array(first))
        rows = []
        for r, a, b in C.key_ranges(key, ranges):
            flat, offsets = C.flat_bytes(name.slice(a, b - a))
            rows.append((r, C.pack_small(np.diff(offsets).astype(np.uint32)), C.pack_small(flat), C.pack_small(n[a:b])))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_pydict({"hash_range": pa.array(cols[0], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("lengths", "phrases", "n"), cols[1:])}})

    @C.worker("phrase_mining")
    def run(batches):
        keys, names, counts, held = [], [], [], 0

        def add(key, name, n):
            nonlocal held
            keys.append(key)
            names.append(name)
            counts.append(n)
            held += len(key)

        for grams, langs in _slices(batches, longest):
            heads = pa.array([x.encode() + b"\n" for x in langs], pa.binary())
            if not old and len(grams.row):
                own, where = np.unique(np.array(langs, dtype=str), return_inverse=True)
                add(C.mix(np.array([hash_text(x) for x in own.tolist()], dtype=np.uint64)), pa.array([x.encode() + b"\n" for x in own.tolist()], pa.binary()), np.bincount(where[grams.row], minlength=len(own)))
            for k in range(1, longest + 1):
                due = _due(grams, k, old, new)
                key, first, n = np.unique(grams.key[k][due], return_index=True, return_counts=True)
                if len(first):
                    at = due[first]
                    add(key, pc.binary_join_element_wise(heads.take(pa.array(grams.row[at])), grams.phrases(at, k), b""), n)
            if held >= FLUSH:
                yield pack(keys, names, counts)
                keys, names, counts, held = [], [], [], 0
        if held:
            yield pack(keys, names, counts)

    return run


def _summed(least: int):
    """The counts of one hash range that reach ``least``, and those of all words."""

    @C.worker("phrase_mining")
    def run(table: pa.Table) -> pa.Table:
        names, counts = [], []
        for lengths, phrases, n in zip(table["lengths"].to_pylist(), table["phrases"].to_pylist(), table["n"].to_pylist()):
            ends = np.r_[0, np.cumsum(C.unpack_small(lengths, np.uint32))].astype(np.int32)
            names.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(C.unpack_small(phrases, np.uint8))]))
            counts.append(C.unpack_small(n, np.int64))
        sums = pa.table({"name": pa.chunked_array(names), "n": np.concatenate(counts)}).group_by("name").aggregate([("n", "sum")])
        kept = sums.filter(pc.or_(pc.greater_equal(sums["n_sum"], least), pc.ends_with(sums["name"], b"\n")))
        pairs = [x.rpartition(b"\n") for x in kept["name"].to_pylist()]
        return pa.table({
            "lang": pa.array([x for x, _, _ in pairs], pa.binary()).cast(pa.string()), "words": pa.array([y.count(b" ") + 1 if y else 0 for _, _, y in pairs], pa.int32()),
            "phrase": pa.array([y for _, _, y in pairs], pa.binary()), "n": kept["n_sum"],
        })

    return run


def _failed(longest: int, proposed: list[Proposals]):
    """Keys of the counted phrases that could be part of longer ones and were not proposed."""

    @C.worker("phrase_mining")
    def run(batches):
        for batch in batches:
            data, offsets = C.flat_bytes(batch["phrase"])
            words, langs = batch["words"].to_numpy(), batch["lang"].to_pylist()
            grams = Grams(data, offsets, langs, longest - 1)
            first = np.searchsorted(grams.row, np.arange(len(langs)))
            for k in range(1, longest):
                key = grams.key[k][first[words == k]]
                key = key[~has(proposed, k, key)]
                yield pa.RecordBatch.from_pydict({"words": pa.array(np.full(len(key), k), pa.int32()), "key": pa.array(key.view(np.int64))})

    return run


def _segment(table: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT >> 6, dtype=np.int64)
    bits[table["at"].to_numpy() & ((SEGMENT >> 6) - 1)] = table["bits"].to_numpy()
    return pa.table({"words": table["words"][:1], "segment": table["segment"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def _bitmaps(keys: DataFrame, longest: int) -> tuple[Proposals, bool]:
    """A bitmap for each number of words from the written rows (words, key); whether any bit is set."""
    most = max([r["n"] for r in keys.groupBy("words").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
    size = min(BITS, max(SEGMENT, 1 << (BITS_EACH * most).bit_length()))
    at = F.shiftright(F.col("key").bitwiseAND(size - 1), 6)
    words = keys.groupBy("words", at.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
    parts = words.withColumn("segment", F.shiftright("at", (SEGMENT >> 6).bit_length() - 1)).groupBy("words", "segment").applyInArrow(_segment, "words int, segment long, bits binary")
    out = {k: np.zeros(size >> 6, dtype=np.uint64) for k in range(1, longest)}
    for r in parts.collect() if most else []:  # at most BITS for each number of words
        a = r["segment"] * (SEGMENT >> 6)
        out[r["words"]][a : a + (SEGMENT >> 6)] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out, bool(most)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: float = SHARE, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of every phrase of up to ``longest`` words that occurs at least ``least``
    times in its language, and (lang, n) of all words."""
    lang, text = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"))
    draw = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(C.shuffle_partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    low = max(2, int(margin * share * least))
    seen = rows.filter(draw).mapInArrow(_sampled(longest), "words int, key long, n long").groupBy("words", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= low)
    new, _ = _bitmaps(C.stored(seen.select("words", "key"), "proposals"), longest)
    old: list[Proposals] = []
    found = total = None
    while True:
        counted = rows.mapInArrow(_counted(longest, old, new, ranges), "hash_range int, lengths binary, phrases binary, n binary")
        sums = counted.groupBy("hash_range").applyInArrow(_summed(least), "lang string, words int, phrase binary, n long")
        fresh = C.stored(sums.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n"), "frequent")
        if found is None:
            total = fresh.filter("words = 0").select("lang", "n")
            fresh = fresh.filter("words > 0")
        found = fresh if found is None else found.unionByName(fresh)
        old = [*old, new]
        failed = fresh.filter(F.col("words") < longest).mapInArrow(_failed(longest, old), "words int, key long")
        new, more = _bitmaps(C.stored(failed, "border-failures"), longest)
        if not more:
            return found, total


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)); a million squares of 15 digits fit into a decimal."""
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right)).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, share: float = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` candidates of 2 to ``longest`` words."""
    found, total = frequent_phrases(docs, text_col, lang_col, least, longest, share)
    several = found.filter("words > 1")
    # the longer candidates of each shorter one: contiguous parts of at least two words
    part = F.array_join(F.slice(F.col("w"), F.col("i"), F.col("k")), " ")
    cut = several.filter("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", "n")
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)))
    longer = cut.select("lang", part.alias("phrase"), F.col("n").alias("m")).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    kept = several.join(longer, ["lang", "phrase"], "left").filter(F.col("m").isNull() | (F.lit(100) * F.col("m") < F.lit(inside) * F.col("n")))

    sides = kept.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), "words").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = sides.withColumn("left", F.array_join(F.slice(F.col("w"), F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(F.col("w"), F.col("k") + 1, F.col("words")), " ")).drop("w", "words")
    sides = sides.join(found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    worst = sides.withColumn("score", score_of("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = worst.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
