"""Vector column expressions (array<double>): norms, normalisation, dot products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """v / ||v||; a zero (or NULL) vector gives NULL."""
    return let(as_double(v), lambda w: let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def array_size(c) -> Column:
    """Length of an array column, NULL for a NULL array whatever ``spark.sql.legacy.sizeOfNull``
    / ANSI settings say (the legacy setting returns -1)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.size(c))
