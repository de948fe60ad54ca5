"""Source divergence audit: how far the sources of a language differ in their words, by count cells.

Null texts, languages and sources are ''. Terms are runs of letters (ASCII letters and everything
beyond ASCII), A-Z lower-cased; a language keeps the terms that at least ``LEAST_DOCS`` of its
documents have (V of them). In a group (language, source), as in the language as a whole, a kept term
with ``count`` occurrences has the share ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, N being all
occurrences of kept terms there. All of it is integer arithmetic.

1. One scan counts terms and documents by (language, source, term) inside the tasks; one exchange by
   (language, term) sums them, and a kept term is one row with its counts by source.
2. ``pair``: each task adds up ``|p - q|`` of its terms for all source pairs of a language in one
   integer matrix; only the matrices are summed, no pair of rows leaves a term.
3. ``term``: a group's terms with equal (group count, language count) are one cell. ``f`` is computed
   per cell, cells of equal value merge, the highest values are ranked by cumulative multiplicity, and
   only cells that begin within the first ``TOP`` ranks are expanded into their terms, in UTF-8 order.

The driver holds the list of groups, whose square the ``pair`` part returns.

Defined cases: a group without kept terms has its pairs (0 where the language keeps none) and no
terms; a language with one source has no pairs; repeated rows count each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C

LEAST_DOCS, TOP = 30, 50
#: Fixed values of the shares.
SCALE, PRIOR = 1_000_000_000, 5
#: Distinct (group, term) pairs that a task holds before it sends them on; numbers of a matrix slice.
FLUSH, SLICE = 300_000, 1 << 20
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _counted(batches):
    """(lang, source, term, times, docs), summed over as many rows as fit."""
    times: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def rows():
        groups = [(g, c) for g, c in times.items() if c]
        sizes = [len(c) for _, c in groups]
        part = np.repeat(np.arange(len(groups)), sizes)
        names = [pa.array([g[i] for g, _ in groups], pa.string()).take(pa.array(part)) for i in (0, 1)]
        return pa.RecordBatch.from_pydict({
            "lang": names[0], "source": names[1], "term": pa.array([t for _, c in groups for t in c], pa.binary()),
            "times": pa.array([n for _, c in groups for n in c.values()], pa.int64()),
            "docs": pa.array([docs[g][t] for g, c in groups for t in c], pa.int64()),
        })

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.large_binary())):
            group = (lang, source)
            if group not in times:
                times[group], docs[group] = Counter(), Counter()
            found, before = _TERM.findall(text.as_py().lower()), len(times[group])
            times[group].update(found)
            docs[group].update(set(found))
            held += len(times[group]) - before
            if held >= FLUSH:
                yield rows()
                times, docs, held = {}, {}, 0
    if held:
        yield rows()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exactly."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", up, (total + PRIOR * kept).cast("decimal(20,0)")).cast("long")


def shares(count: np.ndarray, under: np.ndarray) -> np.ndarray:
    """The same for arrays, by long division of three digits a step; ``under`` = N + PRIOR * V."""
    rest = count + PRIOR
    out = rest // under
    rest = rest - out * under
    for _ in range(3):
        rest = rest * 1000
        step = rest // under
        out, rest = out * 1000 + step, rest - step * under
    return out + 1


def _pairs(under: dict[str, np.ndarray]):
    """Sums of |p - q| over this task's terms, by language and pair of source numbers."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, counts = np.array(batch["lang"].to_pylist(), dtype=object), batch["counts"]
            places, offsets = counts.values.field("place").to_numpy(), counts.offsets.to_numpy()
            values = counts.values.field("times").to_numpy()
            for lang in dict.fromkeys(langs.tolist()):
                n = len(under[lang])
                sums = total.setdefault(lang, np.zeros((n, n), dtype=np.int64))
                rows = np.flatnonzero(langs == lang)
                for some in np.array_split(rows, -(-len(rows) * n // SLICE)):
                    lengths = offsets[some + 1] - offsets[some]
                    dense = np.zeros((len(some), n), dtype=np.int64)
                    np.add.at(dense, (np.repeat(np.arange(len(some)), lengths), C.ragged_take(places, offsets[some], lengths)), C.ragged_take(values, offsets[some], lengths))
                    p = shares(dense, under[lang])
                    for i in range(n):
                        sums[i] += np.abs(p - p[:, i : i + 1]).sum(axis=0)
        for lang, sums in total.items():
            a, b = np.divmod(np.arange(sums.size), len(sums))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * sums.size, pa.string()), "a": a, "b": b, "value": sums.ravel()})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank of every group."""
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_counted, "lang string, source string, term binary, times long, docs long")
    # one exchange: grouped by term and source, then by term, within the same partitions
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"), F.collect_list(F.struct("source", "times")).alias("counts"))
    terms = C.stored(terms.filter(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "times", "counts"), "kept-terms")

    each = terms.select("lang", "term", F.col("times").alias("all_times"), F.explode("counts").alias("c")).select("lang", "term", "all_times", "c.source", "c.times")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("times").alias("all_total"))
    totals = each.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "all_total"])
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    groups = C.stored(groups.select("lang", "source", "total", "kept", "all_total", place), "groups")

    listed = groups.select("lang", "place", (F.col("total") + PRIOR * F.col("kept")).alias("under")).orderBy("lang", "place").collect()
    under = {g: np.array([r["under"] for r in listed if r["lang"] == g], dtype=np.int64) for g in {r["lang"] for r in listed}}
    if any(len(x) and int(x.max()) > (1 << 63) // 1001 for x in under.values()):
        raise OverflowError("more than 9 * 10^15 occurrences in a group")
    numbered = terms.join(groups.select("lang", "source", "place").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "place"))).alias("places")), "lang")
    numbered = numbered.select("lang", F.transform("counts", lambda c: F.struct(F.element_at("places", c["source"]).cast("int").alias("place"), c["times"].alias("times"))).alias("counts"))
    sums = numbered.mapInArrow(_pairs(under), "lang string, a long, b long, value long").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("place").cast("long").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").cast("long").alias("b"))
    pairs = one.join(other, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    cells = each.groupBy("lang", "source", "times", "all_times").agg(F.count(F.lit(1)).alias("terms")).join(groups.drop("place"), ["lang", "source"])
    p, q = share(F.col("times"), F.col("total"), F.col("kept")), share(F.col("all_times"), F.col("all_total"), F.col("kept"))
    cells = C.stored(cells.withColumn("p", p).withColumn("q", q).filter("p > q").select("lang", "source", "times", "all_times", "terms", (F.col("p") - F.col("q")).alias("value")), "cells")
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    best = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("place", F.row_number().over(of_group)).filter(F.col("place") <= top)
    best = best.withColumn("before", F.sum("terms").over(of_group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("terms")).filter(F.col("before") < top)
    wanted = C.stored(cells.drop("terms").join(best.select("lang", "source", "value", "before"), ["lang", "source", "value"]), "wanted-cells")
    tied = Window.partitionBy("lang", "source", "value").orderBy("term")
    found = each.join(wanted, ["lang", "source", "times", "all_times"]).withColumn("place", F.row_number().over(tied)).filter(F.col("place") <= top)
    found = found.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).filter(F.col("rank") <= top)
    return pairs.unionByName(found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
