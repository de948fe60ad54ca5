"""Path normalisation against a project root, as a column expression (stack fold)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(p: Column) -> Column:
    return F.split(p, "/", -1)


def _fold(initial: Column, segments: Column) -> Column:
    def step(acc, s):
        return (
            F.when((s == "") | (s == "."), acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s)))
        )

    stack = F.aggregate(segments, initial, step)
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def normalize_path(p: Column, root: str) -> Column:
    """Absolute paths are kept as given; a leading './' is dropped; the rest is resolved on
    ``root``. A result that does not start with ``root`` (a plain prefix test, so a sibling
    ``root-x`` passes) becomes ``root/<basename>``."""
    root_stack = F.filter(_segments(F.lit(root)), lambda s: (s != "") & (s != "."))
    rel = F.when(p.startswith("./"), F.substring(p, 3, 1 << 30)).otherwise(p)
    resolved = _fold(root_stack, _segments(rel))
    named = F.filter(_segments(rel), lambda s: s != "")
    base = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    fallback = _fold(root_stack, F.array(base))
    return F.when(p.startswith("/"), p).when(resolved.startswith(root), resolved).otherwise(fallback)
