"""Approximate nearest neighbours with an inverted-file (IVF) index, built from Spark joins.

  * ``n_lists`` centroids are trained with Spark ML's distributed k-means (seeded, so the
    index is reproducible); every corpus vector belongs to its nearest centroid;
  * every query probes its ``n_probe`` nearest centroids — an exact k-NN problem against the
    small centroid table, solved with the blocked plan of ``quire.operators.knn``;
  * the search itself runs the same tile scorer over (cell, block) groups: a query meets
    only the vectors of the cells it probes, so work per query is ~n_probe / n_lists of
    the corpus; a hot cell is split into blocks like any other large group.
Recall is measured against the exact search (``recall_at_k``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.vectors import l2_normalize
from quire.operators import knn


def default_lists(n: int) -> int:
    return max(1, int(math.sqrt(max(n, 1))))


# Centroids are fitted on about this many vectors; every vector is indexed.
FIT_ROWS = 1_000_000


def build_ivf(
    corpus: DataFrame, n_lists: int, key: str = "vec_id", vec: str = "embedding", seed: int = 7, max_iter: int = 20,
    metric: str = "cosine", fit_rows: int = FIT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(centroids(cell, embedding), assignment(key, cell, embedding)).

    Centroids are fitted on a seeded sample of about ``fit_rows`` vectors; every vector that is
    not NULL is assigned. Cells follow the metric: for cosine, vectors are normalised first
    (zero vectors match nothing and are left out). The
    model holds ``n_lists`` x dim numbers — bounded by the parameter, not by the corpus — and
    comes back as a small DataFrame."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    c = corpus.select(F.col(key).alias("key"), F.col(vec).alias("embedding")).where(F.col("embedding").isNotNull())
    point = F.col("embedding").cast("array<double>")
    if metric == "cosine":
        c = c.where(F.exists("embedding", lambda x: x != 0))
        point = l2_normalize(point)
    feats = c.withColumn("features", array_to_vector(point))
    n = c.count()
    fraction = min(1.0, fit_rows / max(n, 1))
    train = feats if fraction >= 1.0 else feats.sample(fraction=fraction, seed=seed)
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cell").fit(train)
    spark = corpus.sparkSession
    centers = [(i, [float(x) for x in v]) for i, v in enumerate(model.clusterCenters())]
    centroids = spark.createDataFrame(centers, "cell long, embedding array<double>")
    assignment = model.transform(feats).select("key", F.col("cell").cast("long").alias("cell"), "embedding")
    return centroids, assignment


def search(
    assignment: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int,
    n_probe: int,
    metric: str = "cosine",
    query_key: str = "query_id",
    query_vec: str = "embedding",
) -> DataFrame:
    """(query_id, key, score, rank) from the probed cells only."""
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vec).alias("embedding")).where(F.col("embedding").isNotNull())
    near = q.withColumn("embedding", l2_normalize(F.col("embedding").cast("array<double>"))) if metric == "cosine" else q
    probes = knn.topk(centroids, near, n_probe, "l2", corpus_key="cell", n_corpus=centroids.count())
    probes = probes.select("query_id", F.col("key").alias("cell"))
    # Per cell: the probing queries against that cell's vectors, one tile scorer per (cell, block).
    q_in_cell = probes.join(q, "query_id")
    partial = knn.grouped_topk(assignment, q_in_cell, "cell", k, metric)
    order = F.round("score", knn.TIE_DECIMALS)
    order = order.desc() if metric == "cosine" else order.asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("key").asc())
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: share of the exact top-k keys that the approximate search returned."""
    hit = exact.select("query_id", "key").join(approx.select("query_id", "key").withColumn("_found", F.lit(1)), ["query_id", "key"], "left")
    return hit.groupBy("query_id").agg((F.count("_found") / F.count(F.lit(1))).alias("recall"))
