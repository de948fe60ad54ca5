"""Helpers shared by the corpus operators: words, hashes, packed exchanges and scratch tables.

A *packed exchange* moves sorted 64-bit keys between tasks as delta-coded binary blocks, one row
for each (map flush, key range). Spark still partitions, shuffles and retries the work; the rows
are just a few kilobytes each instead of one key each, which divides shuffle volume by about four.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_dir

#: Fixed value: the words of the contracts (anything but space and \\t \\n \\v \\f \\r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Odd multipliers of the rolling hash and of the finalizer (public splitmix64 constants).
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed and bytes of texts handled at once; they bound the working arrays, not the texts.
HASH_BYTES, SLICE_BYTES = 1 << 20, 1 << 22
#: Rows of a batch between Spark and its Python workers, for operators that carry whole documents.
BATCH_ROWS = 1000
#: A group of more bytes gives its freed memory back when it ends.
TRIM_BYTES = 1 << 20
_BYTE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_INVERSE = np.uint64(pow(int(_BYTE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_held = []


@lru_cache(maxsize=1)
def _process() -> dict:
    """What lasts as long as this process. The package's functions are shipped by value, so a task has globals
    of its own; a cache alone goes by name and is the process's one."""
    return {"owner": ""}


def held_by_worker(clear):
    """Registers a function that frees what a module keeps in a worker process between tasks."""
    _held.append(clear)
    return clear


def enter(owner: str) -> None:
    """A worker that another operator used before gives that operator's caches and free memory back, so
    a session that runs several operators holds the caches of one."""
    process = _process()
    if process["owner"] != owner:
        process["owner"] = owner
        for clear in _held:
            clear()
        trim()


def trim() -> None:
    """Unused memory of this process goes back to the system."""
    gc.collect()
    freed()


def freed() -> None:
    """What the allocators hold unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a GNU libc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker(owner: str):
    """For a function that runs in Python workers, on batches, on one group's table or on two."""

    def wrap(run):
        if inspect.isgeneratorfunction(run):

            def batches_run(batches):
                enter(owner)
                yield from run(batches)
                trim()

            return batches_run

        def group_run(*tables: pa.Table) -> pa.Table:
            enter(owner)
            out = run(*tables)
            if sum(t.nbytes for t in tables) > TRIM_BYTES:
                freed()
            return out

        if len(inspect.signature(run).parameters) == 1:
            return lambda table: group_run(table)
        return lambda left, right: group_run(left, right)

    return wrap


def small_batches(spark: SparkSession) -> None:
    """From now on at most BATCH_ROWS rows travel at once between Spark and the session's Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return shared_dir(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, so a lost
    executor costs a read and not a recomputation, and gives the planner real file sizes."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def word_count(text: Column) -> Column:
    """Words of ``text`` as long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> np.uint64:
    return mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes (mod 2^64, finalized) of every window of ``width`` word hashes."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:m].copy()
    for k in range(1, width):
        out *= ROLL
        out += hashes[k : k + m]
    return mix(out)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as zstd-compressed byte planes of their differences."""
    if not len(keys):
        return b""
    d = np.empty_like(keys)
    d[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=d[1:])
    width = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    planes = np.ascontiguousarray(d[1:]).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + int(d[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:]), dtype=np.uint8).reshape(width, -1)
    d = np.zeros((raw.shape[1] + 1, 8), dtype=np.uint8)
    d[1:, :width] = raw.T
    d = d.reshape(-1).view(np.uint64)
    d[0] = first
    return np.cumsum(d, dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack_small(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def key_ranges(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range number, from, to) of the slices of ascending ``keys`` in equal ranges of 2^64."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, edges, side="left").tolist(), len(keys)]
    for i in range(ranges):
        if cuts[i + 1] > cuts[i]:
            yield i, cuts[i], cuts[i + 1]


def flat_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string or binary column, n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes unchanged."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of every word, number of words of each row); no word crosses a row. ``blanks``
    marks the byte values between words."""
    blank = blanks[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = ~blank
    before = np.r_[False, inside[:-1]] & ~edge[:n] if n else inside
    after = np.r_[inside[1:], False] & ~edge[1:] if n else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BYTE, _BYTE_INVERSE)):
            steps = np.full(max(n, HASH_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


@held_by_worker
def _forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: polynomials mod 2^64 from prefix sums, finalized.
    Spans are ascending and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _power_tables(high - low)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * down[a] ^ ((b - a).astype(np.uint64) * ROLL)
        at = to
    return mix(out)


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each (a longer row is a range of its own)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1))
        yield at, to
        at = to


def id_bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending ids that deal the non-null ids into about equal ranges."""
    if parts <= 1:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(F.percentile_approx(F.col(id_col), shares, F.lit(max(10_000, 20 * parts))).alias("b")).first()
    return sorted({int(x) for x in row["b"] or []})


def block_of(bounds: list[int]):
    """Column function: the number of the id range a (long) id falls in; null ids come last."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def block(ids: pd.Series) -> pd.Series:
        null = ids.isna()
        return pd.Series(np.where(null, len(edges) + 1, np.searchsorted(edges, ids.where(~null, 0).astype("int64"), side="right")))

    return block


def ragged_at(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """s, s + 1, ..., s + n - 1 for each (s, n), one after another."""
    shift = starts - np.r_[0, np.cumsum(lengths)[:-1]]
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] for each (s, n)."""
    return flat[ragged_at(starts, lengths)] if len(lengths) else flat[:0]
