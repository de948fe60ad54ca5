"""Embedding and pair-scoring extension points.

Default embedder: feature hashing of the BM25 tokens, bucket = first 8 hex digits of
md5(token) mod dim, counts L2-normalised (empty text -> NULL). It exists twice with identical
results: ``hashed_embedding`` as a JVM column expression (what the SQL oracle repeats) and
``hashed_embedding_model``, the same function as an Arrow-batched iterator pandas UDF — the
embedding extension point, and about twice as fast on whole documents because counting is
one ``numpy.bincount`` per text instead of an interpreted lambda per token and slot.
Default scorer: ``overlap_score``, the share of distinct query tokens found in the document.

A real model plugs in through ``model_embedder`` / ``model_scorer``: iterator pandas UDFs that
load the model once per Python worker and run it on Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import bm25_tokens
from quire.functions.vectors import l2_normalize


def _col(v: Column | int) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def token_bucket(tok: Column, dim: Column | int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), _col(dim).cast("long"))


def hashed_embedding(text: Column, dim: Column | int) -> Column:
    """``dim`` may be a column (e.g. a scalar subquery reading the index dimension)."""
    buckets = F.transform(bm25_tokens(text), lambda t: token_bucket(t, dim))
    zeros = F.array_repeat(F.lit(0.0), _col(dim).cast("int"))
    # one pass over the tokens; each step bumps one slot
    counts = F.aggregate(buckets, zeros, lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)))
    return l2_normalize(counts)


# Fixed value: the BM25 cleaner's character class in Python's own regex dialect (the JVM
# twin is ``quire.functions.text.BM25_DROP``; tests check both give the same tokens).
_PY_DROP = re.compile(r"[^\w\s\.\(\)\[\]{}=+\-*/<>!&|^%]")


def _hash_vectors(texts: pd.Series, dims: pd.Series) -> list:
    out = []
    md5 = hashlib.md5
    for text, dim in zip(texts, dims):
        toks = _PY_DROP.sub(" ", text).lower().split() if isinstance(text, str) else []
        if not toks:
            out.append(None)
            continue
        d = int(dim)
        b = np.fromiter((int(md5(t.encode("utf-8")).hexdigest()[:8], 16) % d for t in toks), dtype=np.int64, count=len(toks))
        c = np.bincount(b, minlength=d).astype(np.float64)
        out.append(c / np.sqrt((c * c).sum()))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding_model(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(text, dim) -> array<double>; the default embedding model on Arrow batches."""
    for texts, dims in batches:
        yield pd.Series(_hash_vectors(texts, dims))


def embed(text: Column, dim: Column | int) -> Column:
    """The default embedding of ``text`` at dimension ``dim``."""
    return hashed_embedding_model(text, _col(dim).cast("int"))


def overlap_score(query: Column, doc: Column) -> Column:
    q = F.array_distinct(bm25_tokens(query))
    d = F.array_distinct(bm25_tokens(doc))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Wrap a model loader as an iterator pandas UDF: text -> array<float>.
    ``load()`` runs once per worker; the returned callable embeds a list of texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vecs = model(texts.fillna("").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vecs])

    return embed


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]):
    """Wrap a (query, document) relevance model as an iterator pandas UDF -> double."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, d in batches:
            yield pd.Series(np.asarray(model(q.fillna("").tolist(), d.fillna("").tolist()), dtype=np.float64))

    return score
