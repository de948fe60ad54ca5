"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word goes when a window of ``width`` consecutive words covers it whose word sequence also
starts in a document with a smaller id. Method:

1. Documents are dealt into *blocks* of ascending id ranges (bounds are quantiles of the ids).
2. Each block rolls a 64-bit hash over every window and sends its distinct hashes, delta-coded,
   to ranges of the hash space. A window that a third of all rows repeat is one entry per block.
3. A hash-range task finds the first block of each hash and answers every later block with the
   hashes it must remove. Inside a block the document order decides.
4. Each block re-rolls its windows, merges the repeated ones into maximal intervals and cuts them.

Both passes over the text read one exchange (the block repartition is reused), hashes never
travel with text, and no task holds more than one block or one hash range.

Defined cases: null text has no words; texts shorter than ``width`` words lose nothing; rows with
a null id come after every id and repeat nothing among themselves; rows sharing an id are one
document's texts, so they do not remove each other's windows; an empty table gives no rows; other
columns, whatever their names, travel in one struct and come back unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common as C

WIDTH = 13
_LAST = np.iinfo(np.int64).max


def _field(table: pa.Table, name: str) -> pa.Array:
    return pa.chunked_array([c.field(name) for c in table["row"].chunks], table["row"].type.field(name).type)


def _windows(table: pa.Table, id_col: str, text_col: str, width: int):
    """(words of each document, hashes of all windows, document of each window, documents' ids)."""
    data, offsets = C.flat_bytes(_field(table, text_col))
    starts, ends, counts = C.word_spans(data, offsets)
    rolled = C.rolling(C.span_hashes(data, starts, ends), width)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = owner[: len(rolled)] == owner[len(owner) - len(rolled) :]  # not across documents
    order = _field(table, id_col).cast(pa.int64()).fill_null(_LAST).to_numpy()
    return counts, rolled[whole], owner[: len(rolled)][whole], order


def _hash_side(id_col: str, text_col: str, width: int, ranges: int):
    @C.worker("substring_dedup")
    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(_windows(table, id_col, text_col, width)[1])
        cut = list(C.key_ranges(keys, ranges))
        return pa.table({
            "hash_range": pa.array([r for r, _, _ in cut], pa.int32()),
            "block": pa.array([table["block"][0].as_py()] * len(cut), pa.int64()),
            "hashes": pa.array([C.pack_sorted(keys[a:b]) for _, a, b in cut], pa.binary()),
        })

    return run


def _first_blocks(table: pa.Table) -> pa.Table:
    """For each block of the range: its hashes that an earlier block has too."""
    blocks = table["block"].to_numpy()
    order = np.argsort(blocks, kind="stable")
    parts = [C.unpack_sorted(table["hashes"][int(i)].as_py()) for i in order]
    keys = np.concatenate(parts)
    owner = np.repeat(blocks[order].astype(np.int32), [len(p) for p in parts])
    del parts
    by = np.argsort(keys, kind="stable")  # equal hashes stay in ascending order of blocks
    keys, owner = keys[by], owner[by]
    later = np.zeros(len(keys), dtype=bool)
    later[1:] = keys[1:] == keys[:-1]
    keys, owner = keys[later], owner[later]
    by = np.argsort(owner, kind="stable")
    keys, owner = keys[by], owner[by]
    found, starts = np.unique(owner, return_index=True)
    ends = [*starts[1:], len(owner)]
    return pa.table({
        "block": pa.array(found, pa.int64()),
        "hashes": pa.array([C.pack_sorted(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
    })


def _spans(repeated: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal word intervals [start, end) covered by the repeated windows."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > width)
    return list(zip(at[np.r_[0, new + 1]].tolist(), (at[np.r_[new, len(at) - 1]] + width).tolist()))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_side(id_col: str, text_col: str, width: int):
    @C.worker("substring_dedup")
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        counts, hashes, owner, order = _windows(docs, id_col, text_col, width)
        removed = [C.unpack_sorted(x) for x in flags["hashes"].to_pylist()]
        gone = np.unique(np.concatenate(removed)) if removed else np.zeros(0, np.uint64)
        repeated = np.zeros(len(hashes), dtype=bool)
        if len(hashes):
            if len(gone):
                at = np.minimum(np.searchsorted(gone, hashes), len(gone) - 1)
                repeated = gone[at] == hashes
            mine = order[owner]
            by = np.lexsort((mine, hashes))  # the smallest id of each hash leads its run
            first = np.r_[True, hashes[by][1:] != hashes[by][:-1]]
            least = mine[by][np.flatnonzero(first)[np.cumsum(first) - 1]]
            repeated[by] |= mine[by] > least
        del hashes, owner
        ends = np.cumsum(np.maximum(counts - width + 1, 0))
        spans, kept, lost = [], [], []
        for i, text in enumerate(_field(docs, text_col).cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            s = _spans(repeated[(ends[i - 1] if i else 0) : ends[i]], width)
            spans.append([{"start": a, "end": b} for a, b in s])
            lost.append(sum(b - a for a, b in s))
            left, at = [], 0
            for a, b in s:
                left += words[at:a]
                at = b
            kept.append(b" ".join(left + words[at:] if s else words).decode())
        return pa.table({
            "row": docs["row"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
            "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` as a struct ``row`` beside n_words, n_removed, spans (word intervals cut out) and
    kept (the remaining words joined by one space)."""
    spark = docs.sparkSession
    parts = C.shuffle_partitions(spark)
    bounds = C.id_bounds(docs, id_col, 2 * parts)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    dealt = rows.select(C.block_of(bounds)(F.col("row")[id_col].cast("long")).alias("block"), "row").repartition(parts, "block")
    sent = dealt.groupBy("block").applyInArrow(_hash_side(id_col, text_col, width, parts), "hash_range int, block long, hashes binary")
    flags = sent.groupBy("hash_range").applyInArrow(_first_blocks, "block long, hashes binary")
    out = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType()),
    ])
    return dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_cut_side(id_col, text_col, width), out)
