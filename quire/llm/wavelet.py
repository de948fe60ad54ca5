"""Token-ID output: one wavelet matrix file per shard of ascending document ids.

A shard holds its documents' token ids as ``levels`` bit-planes. At each level, from the highest
bit down, zeros move stably before ones; the plane with a rank directory and its number of zeros
is all that token access, counting and occurrence lookup need, so one compressed file serves as
data and as index (:class:`WaveletMatrix`).

Writing: documents are dealt into id ranges (bounds are quantiles of the ids), one task encodes
and writes one range at a time through ``pyarrow.fs`` under a temporary name and renames it, so a
repeated or speculative task leaves the same file. Reading: Spark reads the files back as binary
rows; a shard's global start is a running sum over the manifest, one row per shard.

Defined cases: a null or empty text is just the end id; rows sharing an id follow one another in
order of their texts; rows with a null id come last; an empty table writes no shard.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.tokens import encoder

#: Fixed values of the file format: magic bytes and the bits one rank entry stands for.
MAGIC = b"QWM1"
RANK_BITS = 512
END_ID = 2


class Plane:
    """A bit vector with constant-time rank and logarithmic select."""

    def __init__(self, packed: np.ndarray, n: int) -> None:
        self.n = n
        whole = np.zeros(-(-max(n, 1) // RANK_BITS) * RANK_BITS // 8, dtype=np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view(np.uint64)
        ones = np.bitwise_count(self.words).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
        self.before = np.r_[0, np.cumsum(ones)]
        self.bytes = whole

    def get(self, i: int) -> int:
        return int(self.bytes[i >> 3] >> (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        block, rest = divmod(i, RANK_BITS)
        count = int(self.before[block])
        if rest:
            at = block * RANK_BITS // 8
            count += int(np.bitwise_count(self.bytes[at : at + rest // 8]).sum())
            if rest & 7:
                count += int(self.bytes[at + rest // 8] & ((1 << (rest & 7)) - 1)).bit_count()
        return count

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            if self.rank(bit, mid) <= j:
                low = mid
            else:
                high = mid
        return low

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.bytes, bitorder="little", count=self.n).view(bool)


class WaveletMatrix:
    """Access, rank, count and select over the token ids of one shard file."""

    def __init__(self, planes: list[Plane], zeros: list[int], n: int, docs: list[int | None], lengths: np.ndarray) -> None:
        self.planes, self.zeros, self.n, self.docs, self.lengths = planes, zeros, n, docs, lengths
        self.levels = len(planes)

    @staticmethod
    def pack(tokens: np.ndarray, docs: list[int | None], lengths: np.ndarray) -> bytes:
        levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        seq, zeros, planes = tokens.astype(np.uint32), [], []
        press = zstandard.ZstdCompressor(level=1)
        for level in range(levels - 1, -1, -1):
            bits = (seq >> np.uint32(level)) & np.uint32(1) != 0
            low = seq[~bits]
            zeros.append(len(low))
            planes.append(press.compress(np.packbits(bits, bitorder="little").tobytes()))
            seq = np.concatenate([low, seq[bits]])
        table = press.compress(json.dumps({"docs": docs}).encode())
        sizes = press.compress(lengths.astype("<i8").tobytes())
        head = json.dumps({"n": len(tokens), "zeros": zeros, "planes": [len(p) for p in planes], "docs": len(table), "lengths": len(sizes)}).encode()
        return MAGIC + len(head).to_bytes(4, "little") + head + table + sizes + b"".join(planes)

    @classmethod
    def load(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        at = 8 + int.from_bytes(blob[4:8], "little")
        head = json.loads(blob[8:at])
        open_ = zstandard.ZstdDecompressor().decompress

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return open_(blob[at - size : at])

        docs = json.loads(take(head["docs"]))["docs"]
        lengths = np.frombuffer(take(head["lengths"]), dtype="<i8")
        planes = [Plane(np.frombuffer(take(size), dtype=np.uint8), head["n"]) for size in head["planes"]]
        return cls(planes, head["zeros"], head["n"], docs, lengths)

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane.get(i)
            value = value << 1 | bit
            i = zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first i positions end up, below all levels."""
        low, high = 0, i
        if token >> self.levels:
            return 0, 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            bit = token >> (self.levels - 1 - level) & 1
            low, high = (zeros * bit + plane.rank(bit, low), zeros * bit + plane.rank(bit, high))
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first i positions."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= j < high - low:
            raise IndexError(f"token {token} occurs {high - low} times")
        at = low + j
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self.planes[level].select(bit, at - self.zeros[level] * bit)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, undone level by level from the lowest bit up."""
        seq = np.zeros(self.n, dtype=np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits, zeros, up = self.planes[level].bits(), self.zeros[level], np.empty_like(seq)
            up[~bits] = seq[:zeros]
            up[bits] = seq[zeros:] | np.uint32(1 << (self.levels - 1 - level))
            seq = up
        return seq


def _write(folder: str, path: str, end_id: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_pylist()
        raw = table["text"].cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i] or b""))
        flat, lengths = encoder(path).encode(table["text"].take(pa.array(order, pa.int64())))
        tokens = np.insert(flat, np.cumsum(lengths), end_id)
        blob = WaveletMatrix.pack(tokens, [ids[i] for i in order], lengths + 1)
        shard = table["block"][0].as_py()
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("/") else pafs.FileSystem.from_uri(folder.replace(":", "://", 1))
        fs.create_dir(root, recursive=True)
        temporary, final = f"{root}/_{uuid.uuid4().hex}", f"{root}/shard-{shard:08d}.qwm"
        with fs.open_output_stream(temporary) as out:
            out.write(blob)
        fs.move(temporary, final)
        return pa.table({"shard": pa.array([shard], pa.int64()), "file": [f"shard-{shard:08d}.qwm"], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "n_bytes": pa.array([len(blob)], pa.int64())})

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as shards into ``folder``; the manifest (shard, file, n_docs, n_tokens,
    n_bytes, start), ascending ids by ascending shards."""
    spark = docs.sparkSession
    parts = C.shuffle_partitions(spark)
    bounds = C.id_bounds(docs, id_col, 2 * parts)
    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = dealt.withColumn("block", C.block_of(bounds)("id")).repartition(parts, "block")
    written = dealt.groupBy("block").applyInArrow(_write(folder, tokenizer_path, end_id), "shard long, file string, n_docs long, n_tokens long, n_bytes long")
    shards = sorted(C.stored(written, "manifest").collect())  # one short row per shard
    starts = np.cumsum([0, *(r["n_tokens"] for r in shards)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(shards, starts)], "shard long, file string, n_docs long, n_tokens long, n_bytes long, start long")


def _read(batches):
    for batch in batches:
        for start, content in zip(batch["start"].to_pylist(), batch["content"]):
            shard = WaveletMatrix.load(content.as_buffer().to_pybytes())
            raw = shard.tokens().astype("<u4")
            ends = np.cumsum(shard.lengths)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(shard.docs, pa.int64()), "start": pa.array(start + ends - shard.lengths, pa.int64()), "n_tokens": pa.array(shard.lengths, pa.int64()),
                "ids": pa.array([raw[b - n : b].tobytes() for b, n in zip(ends.tolist(), shard.lengths.tolist())], pa.binary()),
            })


_READ = "doc_id long, start long, n_tokens long, ids binary"


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    if not manifest.head(1):
        return spark.createDataFrame([], _READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.qwm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(manifest.select("file", "start"), "file").select("start", "content").mapInArrow(_read, _READ)
