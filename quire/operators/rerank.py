"""Second-stage ranking of retrieved candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import rounded


def fallback(hits: DataFrame, rank_col: str = "rank", key: str = "key") -> DataFrame:
    """No scorer: keep the retrieval order; score = 1.0 - 0.1 * i, rank i + 1, corpus_id i."""
    i = F.col(rank_col) - 1
    return hits.select(
        "query_id",
        F.col(key).alias("vec_id"),
        rounded(F.lit(1.0) - F.lit(0.1) * i).alias("rerank_score"),
        F.col(rank_col).alias("final_rank"),
        i.cast("int").alias("corpus_id"),
    )


def rerank(candidates: DataFrame, score: Column, k: int, rank_col: str = "rank") -> DataFrame:
    """Score (query, text) candidates and keep the k best per query.

    ``candidates`` carries query_id and the first-stage ``rank``; ``score`` is a column over
    its columns (a built-in expression or a pandas UDF from ``quire.functions.embed``). A
    query with a single candidate keeps it un-rescored (score NULL), as the reference does.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    scored = candidates.withColumn("_n", n).withColumn("rerank_score", F.when(F.col("_n") > 1, score))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col(rank_col).asc())
    return scored.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k).drop("_n")
