"""Lexical retrieval packing: BM25 indexes whose neighbours fill each document's window.

1. Every document is encoded once. Document frequencies are counted with it (one row a task, then
   one a term and task, then one a term); so are the number of documents and their mean length.
2. Documents are placed by lexical neighbourhood: a document's BM25 weights, projected to ``DIM``
   numbers, fall into the nearest of several cells for each shard. Centres are fitted on a bounded
   sample in hash order; neighbouring cells are chained into shards of ``SHARD_TOKENS`` tokens, and
   a cell beyond that is split by the hash of id and tokens. So documents with terms in common
   meet in a shard, whose number depends on the corpus and not on the session. Documents without a
   term that another one has are dealt by hash.
3. A shard's task builds an inverted BM25 index over token ids, weighted by the statistics of the
   whole corpus, and packs: the first unused document seeds a window; the index returns all unused
   documents that share any of its terms, best first; they fill the window greedily and the one
   that reaches the end is cut there, its rest seeding the next window. Without neighbours left,
   the next unused document follows. The index drops used documents now and then, as no search
   returns them. A shard's last window is cut into sequences of powers of two,
   so that no sequence holds padding.

Neighbours are sought within a shard: placement is approximate, scores are those of the whole
corpus. A corpus of at most ``SHARD_TOKENS`` tokens is one shard, searched whole.

Defined cases: a null or empty text is one piece holding just the end id; rows sharing an id are
separate documents; a document longer than the window fills windows of its own first; an empty
table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.tokens import encoder

WINDOW = 4096
END_ID = 2
#: The usual BM25 constants.
K1, B = 1.2, 0.75
#: Tokens (with end ids) of a shard, which bound a task's arrays, and cells for each shard.
SHARD_TOKENS, CELLS = 1 << 20, 4
#: Numbers of a projected document; documents for each cell that its centre is fitted on; rounds.
DIM, FIT_DOCS, FIT_ROUNDS = 64, 16, 10
#: Searches after which a shard's index drops the documents used meanwhile.
FORGET = 16
#: Terms projected at once, few enough for a core's cache.
PROJECT_TERMS = 1 << 13
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Statistics:
    """Document frequencies by term, number of documents and mean length of the whole corpus."""

    def __init__(self, df: np.ndarray, n: int, mean: float) -> None:
        self.df, self.n, self.mean = df, n, max(1.0, mean)

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weights of terms in documents of these lengths."""
        idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def postings(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) in ascending order."""
    key, tf = np.unique(np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) << 32 | flat, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf


class Index:
    """BM25 over the token ids of one shard, as compressed rows of documents and of terms, weighted
    by the statistics of the corpus (without them, the shard's own)."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, whole: Statistics | None = None) -> None:
        n = len(lengths)
        doc, term, tf = postings(flat, lengths)
        df = np.bincount(term)
        whole = whole or Statistics(df, n, float(lengths.mean()))
        weight = whole.weight(term, tf, lengths[doc])
        useful = df[term] > 1  # a term of one document retrieves nothing
        doc, term, weight = doc[useful], term[useful], weight[useful]
        self.n = n
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        by = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by], weight[by]
        self.term_at = np.r_[0, np.cumsum(np.bincount(term, minlength=len(df)))]

    def forget(self, used: np.ndarray) -> None:
        """Drops what the index holds of used documents, which no search returns; they can seed on."""
        stay = ~used[self.docs]
        self.docs, self.weights = self.docs[stay], self.weights[stay]
        self.term_at = np.r_[0, np.cumsum(stay)][self.term_at]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties in order."""
        terms = self.terms[self.doc_at[seed] : self.doc_at[seed + 1]]
        if not len(terms):
            return terms
        starts = self.term_at[terms]
        counts = self.term_at[terms + 1] - starts
        at = C.ragged_at(starts, counts)
        score = np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def pack(index: Index, lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every token once."""
    pieces = []
    used = np.zeros(index.n, dtype=bool)
    sequence, offset, order, searches = 0, 0, iter(range(index.n)), 0
    rest: tuple[int, int] | None = None

    def place(doc: int, start: int) -> tuple[int, int] | None:
        """Fill the window from the document; what is left of it where the window ends."""
        nonlocal sequence, offset
        used[doc] = True
        length = min(lengths[doc] - start, window - offset)
        pieces.append((doc, start, length, sequence, offset))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0
        return (doc, start + length) if start + length < lengths[doc] else None

    while True:
        if rest is None:
            seed = next((d for d in order if not used[d]), None)
            if seed is None:
                break
            rest = (seed, 0)
        seed = rest[0]
        rest = place(*rest)
        if rest is None and offset:
            searches += 1
            if searches % FORGET == 0:
                index.forget(used)
            for doc in index.neighbours(seed, used):
                rest = place(int(doc), 0)
                if not offset:
                    break
    if offset:
        tail = [p for p in pieces if p[3] == sequence]
        pieces = [p for p in pieces if p[3] != sequence]
        pieces += _powers(tail, sequence, offset)
    return pieces


def _powers(tail: list[tuple], sequence: int, total: int) -> list[tuple]:
    """The pieces of the last window cut into sequences of descending powers of two."""
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, offset = [], 0
    for doc, start, length, _, _ in tail:
        while length:
            take = min(length, sizes[0] - offset)
            out.append((doc, start, take, sequence, offset))
            start, length, offset = start + take, length - take, offset + take
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0
    return out


def _shard(whole: Statistics, window: int, end_id: int, kind: str):
    @C.worker("lexical_pack")
    def run(table: pa.Table) -> pa.Table:
        ids, raw = table["id"].to_pylist(), table["tokens"].to_pylist()
        by = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
        lengths = table["n"].to_numpy()[by]
        flat = np.frombuffer(b"".join(raw[i] for i in by), dtype=kind).astype(np.int64)
        index = Index(flat, lengths, whole)
        tokens = np.insert(flat, np.cumsum(lengths), end_id).astype("<u4")
        lengths = lengths + 1
        begin = np.cumsum(lengths) - lengths
        found = pack(index, lengths.tolist(), window)
        doc, start, length, sequence, offset = (np.fromiter(x, dtype=np.int64, count=len(found)) for x in zip(*found))
        at = (begin[doc] + start).tolist()
        shard = table["shard"][0].as_py()
        return pa.table({
            "doc_id": pa.array([ids[by[d]] for d in doc], pa.int64()), "start": start, "length": length, "doc_tokens": lengths[doc],
            "sequence_id": (shard << 32) + sequence, "offset": offset,
            "ids": pa.array([tokens[a : a + n].tobytes() for a, n in zip(at, length.tolist())], pa.binary()),
        })

    return run


def _encoded(path: str, kind: str):
    """Each document's token ids; last, a task's document frequencies by term."""

    @C.worker("lexical_pack")
    def run(batches):
        df = np.zeros(0, np.int64)
        for batch in batches:
            _, offsets = C.flat_bytes(batch["text"])
            for a, b in C.slices(offsets):
                flat, lengths = encoder(path).encode(batch["text"].slice(a, b - a))
                ends, flat = np.cumsum(lengths), flat.astype(kind)
                df = _added(df, flat, lengths, ends)
                ends = ends.tolist()
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"].slice(a, b - a), "n": pa.array(lengths, pa.int64()),
                    "tokens": pa.array([flat[e - n : e].tobytes() for e, n in zip(ends, lengths.tolist())], pa.binary()),
                    "df": pa.nulls(b - a, pa.binary()),
                })
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_pydict({"id": none, "n": none, "tokens": pa.nulls(1, pa.binary()), "df": pa.array([df.tobytes()], pa.binary())})

    return run


def _added(df: np.ndarray, flat: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Document frequencies with those of more documents, few at a time."""
    for a, b in C.slices(np.r_[0, ends], C.HASH_BYTES // 2):
        _, term, _ = postings(flat[ends[a] - lengths[a] : ends[b - 1]].astype(np.int64), lengths[a:b])
        found = np.bincount(term, minlength=len(df))
        found[: len(df)] += df
        df = found
    return df


def _frequencies(batches):
    """The tasks' document frequencies, a row a term."""
    for batch in batches:
        for x in batch["df"].to_pylist():
            df = np.frombuffer(x, dtype=np.int64)
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int64()), "df": pa.array(df[term], pa.int64())})


def _parts(batch: pa.RecordBatch, kind: str):
    """(from, to, token ids, lengths) of row ranges of a batch, each of bounded size."""
    data, offsets = C.flat_bytes(batch["tokens"])
    lengths = batch["n"].to_numpy()
    for a, b in C.slices(offsets, C.HASH_BYTES):
        yield a, b, np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), dtype=kind).astype(np.int64), lengths[a:b]


@lru_cache(maxsize=1)
def _directions(terms: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((terms, DIM), dtype=np.float32)


C.held_by_worker(_directions.cache_clear)


def projected(flat: np.ndarray, lengths: np.ndarray, whole: Statistics) -> np.ndarray:
    """The documents' BM25 weights as unit vectors of DIM numbers, 0 without a shared term."""
    doc, term, tf = postings(flat, lengths)
    weight = whole.weight(term, tf, lengths[doc])
    shared = whole.df[term] > 1
    doc, term, weight = doc[shared], term[shared], weight[shared].astype(np.float32)
    out = np.zeros((len(lengths), DIM), dtype=np.float32)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        edges, directions = np.r_[first, len(doc)], _directions(len(whole.df))
        for a, b in C.slices(edges, PROJECT_TERMS):
            part = directions[term[edges[a] : edges[b]]]
            part *= weight[edges[a] : edges[b], None]
            out[doc[first[a:b]]] = np.add.reduceat(part, first[a:b] - edges[a], axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-12))


def _vectors(whole: Statistics, kind: str):
    @C.worker("lexical_pack")
    def run(batches):
        for batch in batches:
            for _, _, flat, lengths in _parts(batch, kind):
                yield pa.RecordBatch.from_pydict({"v": pa.array([x.tobytes() for x in projected(flat, lengths, whole)], pa.binary())})

    return run


def _cells(whole: Statistics, centres: np.ndarray, kind: str):
    """Adds each document's cell, -1 without a shared term."""

    @C.worker("lexical_pack")
    def run(batches):
        for batch in batches:
            for a, b, flat, lengths in _parts(batch, kind):
                v = projected(flat, lengths, whole)
                cell = np.where(v.any(axis=1), np.argmax(v @ centres.T, axis=1), -1)
                yield pa.RecordBatch.from_pydict({c: batch[c].slice(a, b - a) for c in ("id", "n", "tokens")} | {"cell": pa.array(cell, pa.int64())})

    return run


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of the sample by spherical k-means, in an order in which each follows the most
    similar one before it that is still free."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(np.int64)].copy()
    for _ in range(FIT_ROUNDS):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres).astype(np.float32)
    free, order = np.ones(len(centres), dtype=bool), [0]
    free[0] = False
    while free.any():
        order.append(int(np.argmax(np.where(free, centres @ centres[order[-1]], -2))))
        free[order[-1]] = False
    return centres[order]


def _shards_of(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """cell: (its first shard, shards it is split into), from tokens by cell in chain order."""
    out, shard, held = {}, 0, 0
    for cell, size in sorted(sizes.items()):
        if held and (held + size > SHARD_TOKENS or cell == 0):
            shard, held = shard + 1, 0
        out[cell] = (shard, max(1, -(-size // SHARD_TOKENS)))
        if out[cell][1] > 1:
            shard += out[cell][1]
        else:
            held += size
    return out


def placed(docs: DataFrame, whole: Statistics, tokens: int, kind: str) -> DataFrame:
    """Encoded documents with their shard."""
    size = F.sum(F.col("n") + 1)
    shards = -(-tokens // SHARD_TOKENS)
    if shards <= 1:
        return docs.withColumn("shard", F.lit(0).cast("long"))
    wanted = FIT_DOCS * CELLS * shards
    draw = F.pmod(F.xxhash64("tokens"), F.lit(1 << 30)) < int(min(1.0, wanted / whole.n) * (1 << 30))
    found = docs.filter(draw).mapInArrow(_vectors(whole, kind), "v binary").collect()
    sample = np.frombuffer(b"".join(bytes(r["v"]) for r in found), dtype=np.float32).reshape(-1, DIM)
    sample = sample[sample.any(axis=1)]
    centres = _fitted(sample, CELLS * shards) if len(sample) else np.zeros((1, DIM), np.float32)
    docs = C.stored(docs.mapInArrow(_cells(whole, centres, kind), "id long, n long, tokens binary, cell long"), "packing-cells")
    at = _shards_of({r["cell"]: r["size"] for r in docs.groupBy("cell").agg(size.alias("size")).collect()})
    first, parts = (np.array([at.get(c, (0, 1))[i] for c in range(-1, len(centres))], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("long")
    def shard(cell: pd.Series, key: pd.Series) -> pd.Series:
        c = cell.to_numpy() + 1
        return pd.Series(first[c] + key.to_numpy() % parts[c])

    return docs.withColumn("shard", shard(F.col("cell"), F.xxhash64("id", "tokens"))).drop("cell")


@lru_cache(maxsize=2)
def _id_kind(tokenizer_path: str) -> str:
    """Type that holds the vocabulary's ids; the driver keeps no vocabulary for it."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    C.freed()
    return kind


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``docs``: doc_id, start, length, doc_tokens, sequence_id, offset and the
    piece's ids (little-endian unsigned 32-bit)."""
    C.small_batches(docs.sparkSession)
    kind = _id_kind(tokenizer_path)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    told = C.stored(rows.mapInArrow(_encoded(tokenizer_path, kind), "id long, n long, tokens binary, df binary"), "packing-tokens")
    rows = told.filter("df is null").select("id", "n", "tokens")
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    df = told.filter("df is not null").select("df").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # one row a term
    term = df["term"].to_numpy()
    counts = np.zeros(1 + term.max(initial=0), dtype=np.int64)
    counts[term] = df["df"].to_numpy()
    whole = Statistics(counts, total["docs"], total["tokens"] / max(1, total["docs"]))
    dealt = placed(rows, whole, total["tokens"] + total["docs"], kind)
    return dealt.groupBy("shard").applyInArrow(_shard(whole, window, end_id, kind), SCHEMA)
