"""Text chunking for retrieval: whitespace-token windows, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let, ws_tokens

# Fixed value: tokens per chunk.
TOKENS_PER_CHUNK = 400


def truncate_for_embedding(content: Column, n: int) -> Column:
    """First ``n`` code points: the caller's own limit of an embedding request."""
    return F.substring(content, 1, n)


def token_windows(content: Column, size: int = TOKENS_PER_CHUNK) -> Column:
    """Array of chunks: runs of non-whitespace, ``size`` per chunk, joined by one space."""
    def windows(toks: Column) -> Column:
        n_chunks = F.ceil(F.size(toks) / F.lit(size)).cast("int")
        starts = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i * size + 1, size), " "))

    return let(ws_tokens(content), windows)


def token_chunks(df: DataFrame, content_col: str = "content", size: int = TOKENS_PER_CHUNK, keep=("path",)) -> DataFrame:
    """(keep..., chunk_id, text); empty text yields no chunk."""
    rows = df.select(*keep, F.posexplode_outer(token_windows(F.col(content_col), size)).alias("chunk_id", "text"))
    return rows.where(F.col("chunk_id").isNotNull())
