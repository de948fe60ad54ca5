"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: the rates stay as close as they can (in relative entropy) to one copy
of everything, under one token constraint for each source and a ceiling on the rate. The solution
tilts exponentially, rate = min(ceiling, exp(lambda_source * size / mean size of the source)), and
lambda solves the convex dual by Newton steps. Every step is one distributed aggregation over the
histogram (source, size, salt) -> documents; the driver holds one number for each source. Steps
that leave the known bracket fall back to bisection.

Rates become whole copies by systematic rounding down the sizes of a source, so the rounding error
of a source never exceeds about half of its largest document; a few last aggregations then flip
single copies where that brings the source's words nearer to its target. Hash order within a
histogram cell picks the documents, so reruns agree. Hot sources and hot sizes are salted; only
cells, never documents, are ordered within a source.

Defined cases: a null or empty text has size 0, copies 1 and takes no words; a null source is a
source of its own, after all others; repeated rows are documents each; a source at its ceiling takes
every document ``ceiling`` times; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common as C

#: Fixed value: the weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
CEILING = 3
SALTS = 8
MAX_STEPS = 60
MAX_FLIPS = 16
TOLERANCE = 1e-9


def order_of(source: str | None) -> tuple:
    """Sources by code point, null last."""
    return (source is None, source or "")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, ceiling: float = CEILING) -> dict[str | None, float]:
    """Share the words of all sources by weight; what exceeds a source's ceiling is shared anew."""
    names = sorted(sizes, key=order_of)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > ceiling * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(ceiling * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _by_source(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, f"s_null boolean, s_name string, {schema}")


_KEYS = ["s_null", "s_name"]


def _key(source: str | None) -> tuple:
    return (source is None, source or "")


def solve(cells: DataFrame, sums: dict, goal: dict, ceiling: float) -> dict:
    """lambda of each source by safeguarded Newton steps; None where every rate is the ceiling."""
    spark = cells.sparkSession
    lam = {s: 0.0 for s in goal}
    low, high = {s: -math.inf for s in goal}, {s: math.inf for s in goal}
    solved = {s for s in goal if not sums[s][0]}
    for s in goal:
        if sums[s][0] and goal[s] >= ceiling * sums[s][0] * (1 - TOLERANCE):
            lam[s] = None
            solved.add(s)
    for _ in range(MAX_STEPS):
        todo = [s for s in goal if s not in solved]
        if not todo:
            break
        state = _by_source(spark, [(*_key(s), lam[s], sums[s][0] / sums[s][1]) for s in todo], "lam double, mean double")
        rate = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
        free = rate < ceiling
        words = F.col("docs") * F.col("size")
        got = cells.join(state, _KEYS).groupBy(*_KEYS).agg(
            F.sum(words * F.least(rate, F.lit(float(ceiling)))).alias("value"),
            F.sum(F.when(free, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        for r in got.collect():  # one row for each source
            s = None if r["s_null"] else r["s_name"]
            miss = r["value"] - goal[s]
            if abs(miss) <= TOLERANCE * goal[s]:
                solved.add(s)
                continue
            if miss > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - miss / r["slope"] if r["slope"] > 0 else math.inf
            if not low[s] < step < high[s]:
                if math.isinf(low[s]):
                    step = 2 * high[s] - 1
                elif math.isinf(high[s]):
                    step = 2 * low[s] + 1
                else:
                    step = (low[s] + high[s]) / 2
            lam[s] = step
    return lam


def _rounded(cells: DataFrame, lam: dict, sums: dict, ceiling: int) -> DataFrame:
    """Copies of each cell by systematic rounding of the running rate, largest sizes first."""
    spark = cells.sparkSession
    state = _by_source(spark, [(*_key(s), v, max(1.0, sums[s][0] / max(1, sums[s][1]))) for s, v in lam.items()], "lam double, mean double")
    rate = F.when(F.col("lam").isNull(), F.lit(float(ceiling))).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(ceiling))))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    down = Window.partitionBy(*_KEYS).orderBy(F.desc("size"), "salt")
    running = F.sum(F.col("docs") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    out = cells.join(state, _KEYS).withColumn("rate", rate).withColumn("running", running)
    to = F.floor(F.col("running") + 0.5)
    before = F.floor(F.col("running") - F.col("docs") * F.col("rate") + 0.5 + 1e-9)
    copies = F.greatest(F.lit(0), F.least(to - before, F.col("docs") * ceiling)).cast("long")
    return out.select(*_KEYS, "size", "salt", "docs", copies.alias("copies"))


def _flips(cells: DataFrame, goal: dict, ceiling: int) -> list[tuple]:
    """Single copies (source, size, salt, +1 or -1) that bring each source nearer to its target."""
    spark = cells.sparkSession
    taken = {(r["s_null"], r["s_name"]): r["taken"] for r in cells.groupBy(*_KEYS).agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()}
    miss = {s: goal[s] - taken.get(_key(s), 0) for s in goal}
    open_, out = {s for s in goal if abs(miss[s]) >= 1}, []
    for _ in range(MAX_FLIPS):
        if not open_:
            break
        state = _by_source(spark, [(*_key(s), float(miss[s])) for s in open_], "miss double")
        now = cells.join(state, _KEYS).withColumn("flip", F.lit(0).cast("long"))
        if out:
            done = _by_source(spark, out, "size long, salt long, f long").groupBy(*_KEYS, "size", "salt").agg(F.sum("f").alias("f"))
            now = now.join(done, [*_KEYS, "size", "salt"], "left").withColumn("flip", F.coalesce("f", F.lit(0)))
        copies = F.col("copies") + F.col("flip")
        able = F.when(F.col("miss") > 0, copies < F.col("docs") * ceiling).otherwise(copies > 0) & (F.col("size") > 0)
        left = F.abs(F.abs("miss") - F.col("size"))
        best = now.filter(able & (left < F.abs("miss"))).groupBy(*_KEYS).agg(F.min(F.struct(left.alias("left"), "size", "salt")).alias("b"))
        found = best.collect()  # one row for each source
        open_ = set()
        for r in found:
            s = None if r["s_null"] else r["s_name"]
            sign = 1 if miss[s] > 0 else -1
            out.append((*_key(s), r["b"]["size"], r["b"]["salt"], sign))
            miss[s] -= sign * r["b"]["size"]
            if abs(miss[s]) >= 1:
                open_.add(s)
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, ceiling: int = CEILING, size_col: str | None = None) -> DataFrame:
    """``docs`` as a struct ``row`` beside size (words; or ``size_col``), source_size, target (the source's words),
    copies and taken (copies * size)."""
    spark = docs.sparkSession
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), col(source_col).isNull().alias("s_null"), F.coalesce(col(source_col).cast("string"), F.lit("")).alias("s_name"),
        (col(size_col).cast("long") if size_col else C.word_count(col(text_col))).alias("size"), F.xxhash64(col(id_col)).alias("draw"),
    ).withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    cells = C.stored(rows.groupBy(*_KEYS, "size", "salt").agg(F.count(F.lit(1)).alias("docs")), "mix-cells")
    sums = {
        (None if r["s_null"] else r["s_name"]): (r["words"], r["n"])
        for r in cells.groupBy(*_KEYS).agg(F.sum(F.col("docs") * F.col("size")).alias("words"), F.sum("docs").alias("n")).collect()
    }  # one row for each source
    goal = targets({s: v[0] for s, v in sums.items()}, weights, ceiling)
    lam = solve(cells, sums, goal, ceiling)
    cells = C.stored(_rounded(cells, lam, sums, ceiling), "mix-copies")
    flips = _flips(cells, goal, ceiling)
    if flips:
        change = _by_source(spark, flips, "size long, salt long, f long").groupBy(*_KEYS, "size", "salt").agg(F.sum("f").alias("f"))
        cells = cells.join(change, [*_KEYS, "size", "salt"], "left").withColumn("copies", F.col("copies") + F.coalesce("f", F.lit(0))).drop("f")
    per_source = _by_source(spark, [(*_key(s), sums[s][0], goal[s]) for s in goal], "source_size long, target double")
    plan = cells.join(per_source, _KEYS)
    in_cell = Window.partitionBy(*_KEYS, "size", "salt").orderBy("draw")
    out = rows.withColumn("place", F.row_number().over(in_cell)).join(plan, [*_KEYS, "size", "salt"])
    base = F.floor(F.col("copies") / F.col("docs"))
    copies = (base + F.when(F.col("place") <= F.col("copies") - base * F.col("docs"), 1).otherwise(0)).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
