"""Language identification by Bayesian evidence fusion.

Evidence of a row: its text (likelihoods of hashed byte trigrams under one model per language), the
language its markup declares, its address suffix, and its host. Text likelihoods come from a model
fitted on a bounded sample of labelled rows (of each language about ``FIT_ROWS`` by hash of id and
text, all where it has no more). Everything else is learnt from all rows by grouped aggregation of the text's verdicts: P(declared | language),
P(suffix | language), and language priors of hosts, smoothed hierarchically from host to registered
domain to top label to all rows. The posterior multiplies them. Only the aggregate by (host,
declared, suffix) moves; its combined evidence is written and joined back, so a host with a third
of all rows is a few rows.

A row is rejected if no language reaches ``MIN_POSTERIOR``, if it has no text, or if its text is
much less likely under the best language than text of that language is that the model has not seen
(``FOREIGN`` standard deviations below the mean log-likelihood of held-out folds of the sample,
widened for short texts). A language with fewer than ``EVIDENCE`` held-out texts has no such bound:
a row whose best or declared language it is is never rejected as foreign.

Defined cases: null or empty text is no evidence and rejected; a null declaration, suffix or host
is a value of its own; repeated rows count each; an empty table gives no rows; without labelled rows
every row is rejected with language null; the added columns are language, posterior, rejected, and
replace columns of these names; helper columns cannot clash, all input travels in one struct.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm import common as C

#: Rows of each language in the sample; folds that are held out in turn; held-out texts that make a bound.
FIT_ROWS, FOLDS, EVIDENCE = 1_000, 10, 20
BUCKETS = 1 << 16
#: Trigrams beyond which more text adds little: neighbouring trigrams depend on each other.
SATURATION = 200.0
#: Pseudo-counts of a parent's distribution in its child.
STRENGTH = 5.0
MIN_POSTERIOR, FOREIGN = 0.5, 6.0


def trigrams(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte trigrams of all texts, n + 1 offsets), A-Z lower-cased, none across texts."""
    data, offsets = C.flat_bytes(column)
    low = C.lowered(data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gram = ((low[:-2] * np.uint32(0x01000193) ^ low[1:-1]) * np.uint32(0x01000193) ^ low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    size = np.diff(offsets)
    count = np.maximum(size - 2, 0)
    starts = np.minimum(offsets[:-1], max(0, len(gram) - 1))
    return C.ragged_take(gram.astype(np.int64), starts, count), np.r_[0, np.cumsum(count)]


def _held_out(counts: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean log-likelihoods of a fold's texts of 50 trigrams or more under the other folds."""
    other = counts - np.bincount(gram, minlength=BUCKETS)
    row = np.log(other / other.sum())
    sums = np.diff(np.r_[0.0, np.cumsum(row[gram])][np.r_[0, np.cumsum(n)]])
    return sums[n >= 50] / n[n >= 50]


def _learnt(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods of trigrams in one language's texts, what those texts score held out)."""
    folds = [trigrams(pa.array(texts[f::FOLDS], pa.large_string())) for f in range(FOLDS)]
    folds = [(gram.astype(np.uint16), np.diff(offsets)) for gram, offsets in folds]  # there are 2^16 buckets
    counts = np.ones(BUCKETS)
    for gram, _ in folds:
        counts += np.bincount(gram, minlength=BUCKETS)
    return np.log(counts / counts.sum()).astype(np.float32), np.concatenate([_held_out(counts, gram, n) for gram, n in folds])


class TextModel:
    """Log-likelihoods of trigrams for each language and what texts of it score that it has not seen;
    ``unsure`` are the languages with too few of them."""

    def __init__(self, learnt: dict[str, tuple[np.ndarray, np.ndarray]], labels: list[str]) -> None:
        """What ``_learnt`` gives for each language; the label of each row of the sample."""
        self.languages = sorted(set(labels))
        self.mean, self.sd = np.zeros(max(1, len(self.languages))), np.full(max(1, len(self.languages)), np.inf)
        self.unsure = set()
        for i, l in enumerate(self.languages):
            usual = learnt[l][1]
            if len(usual) >= EVIDENCE:
                self.mean[i], self.sd[i] = usual.mean(), max(0.05, float(usual.std()))
            else:
                self.unsure.add(l)
        self.table = np.stack([learnt[l][0] for l in self.languages] or [np.full(BUCKETS, -np.log(BUCKETS), np.float32)])

    def score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-likelihood of each text under each language, number of trigrams)."""
        gram, offsets = trigrams(column)
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.table)))
        for i, row in enumerate(self.table):
            out[:, i] = np.diff(np.r_[0.0, np.cumsum(row[gram], dtype=np.float64)][offsets])
        return out / np.maximum(n, 1)[:, None], n

    def evidence(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log-likelihoods, whether the text is like the best language at all)."""
        parts = []
        data, offsets = C.flat_bytes(column)
        column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
        for a, b in C.slices(offsets, C.HASH_BYTES):
            mean, n = self.score(column.slice(a, b - a))
            best = np.argmax(mean, axis=1)
            rows = np.arange(len(n))
            slack = FOREIGN * self.sd[best] * np.sqrt(1 + SATURATION / np.maximum(n, 1))
            parts.append((mean * (n / (1 + n / SATURATION))[:, None], (n > 0) & (mean[rows, best] >= self.mean[best] - slack)))
        if not parts:
            return np.zeros((0, len(self.table))), np.zeros(0, bool)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@C.worker("language_id")
def _language(sample: pa.Table) -> pa.Table:
    """What one language's rows of the sample teach, in the order of their texts."""
    logs, usual = _learnt(sorted(sample["t"].to_pylist()))
    return pa.table({
        "l": sample["l"].slice(0, 1), "n": pa.array([sample.num_rows], pa.int64()),
        "table": pa.array([logs.tobytes()], pa.binary()), "usual": pa.array([usual], pa.list_(pa.float64())),
    })


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> TextModel:
    """A model from about FIT_ROWS labelled rows of each language, whole texts, by hash of id and
    text; equal rows count once. The texts stay in Spark's tasks, a language's in one: the sample is bounded."""
    label = F.col(f"`{label_col}`").alias("l")
    sizes = {r["l"]: r["n"] for r in rows.select(label).filter("l is not null").groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return TextModel([], [])
    rows = rows.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"), label).filter("t is not null and l is not null")
    every = [l for l, n in sizes.items() if n <= FIT_ROWS]
    chosen = F.col("l").isin(every)
    for l, n in sizes.items():
        if n > FIT_ROWS:
            chosen = chosen | ((F.col("l") == l) & (F.col("h") < int(FIT_ROWS / n * (1 << 64)) - (1 << 63)))
    # a language's sample is learnt from where its rows are; the driver gets what was learnt
    sample = rows.filter(chosen).dropDuplicates(["h", "l"]).select("l", "t")
    kind = StructType([sample.schema["l"], *StructType.fromDDL("n long, table binary, usual array<double>")])
    found = sample.groupBy("l").applyInArrow(_language, kind).toArrow().to_pylist()  # one row a language
    learnt = {r["l"]: (np.frombuffer(r["table"], np.float32), np.array(r["usual"])) for r in found}
    return TextModel(learnt, [r["l"] for r in found for _ in range(r["n"])])


def _text_evidence(model: TextModel):
    kind = pa.struct([("ll", pa.list_(pa.float64())), ("alike", pa.bool_())])

    @F.arrow_udf("struct<ll: array<double>, alike: boolean>")
    def evidence(column: pa.Array) -> pa.Array:
        C.enter("language_id")
        ll, alike = model.evidence(column)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
        return pa.StructArray.from_arrays([values, pa.array(alike)], fields=list(kind))

    return evidence


def _argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _norm(c: Column) -> Column:
    """Primary subtag of a declared language or address part, '' for none."""
    return F.coalesce(F.lower(F.regexp_extract(c.cast("string"), r"^\s*([A-Za-z]{2,8})(?:[-_.].*)?\s*$", 1)), F.lit(""))


def _primary(label: str) -> str:
    """What _norm makes of a label."""
    found = re.fullmatch(r"\s*([A-Za-z]{2,8})(?:[-_.].*)?\s*", label)
    return found.group(1).lower() if found else ""


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def address_language(url: Column) -> Column:
    """The first path segment of two letters, else the top label of the host."""
    segment = F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    return F.when(segment != "", segment).otherwise(F.regexp_extract(url, r"://[^/?#:]*\.([A-Za-z]+)(?:[:/?#]|$)", 1))


def _evidence_table(counts: DataFrame, k: int) -> DataFrame:
    """(host, declared, suffix, prior): log of everything but the text, up to a constant."""
    n = lambda i: F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
    each = [n(i) for i in range(k)]
    named = counts.withColumn("domain", F.when(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1) == "", F.col("host")).otherwise(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    named = named.withColumn("top", F.regexp_extract("host", r"([^.]*)$", 1))
    hosts = named.groupBy("host", "domain", "top").agg(*each)
    total = counts.agg(*each).first()  # one row
    whole = sum(total)
    level = F.array(*[F.lit((total[i] + 1.0) / (whole + k)) for i in range(k)])

    def shrunk(parent: Column) -> Column:
        size = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
        return F.array(*[(F.col(f"n{i}") + STRENGTH * F.get(parent, F.lit(i))) / (size + STRENGTH) for i in range(k)])

    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    tops = hosts.groupBy("top").agg(*sums).select("top", shrunk(level).alias("p_top"))
    domains = hosts.groupBy("domain", "top").agg(*sums).join(tops, "top").select("domain", "top", shrunk(F.col("p_top")).alias("p_domain"))
    hosts = hosts.join(domains, ["domain", "top"]).select("host", shrunk(F.col("p_domain")).alias("p_host"))

    def given_language(column: str) -> DataFrame:
        values = counts.groupBy(column).agg(*each)
        kinds = values.count()
        p = [F.log((F.col(f"n{i}") + 1.0) / F.lit(total[i] + float(kinds))) for i in range(k)]
        return values.select(column, F.array(*p).alias(f"p_{column}"))

    keys = counts.select("host", "declared", "suffix").distinct()
    out = keys.join(hosts, "host").join(given_language("declared"), "declared").join(given_language("suffix"), "suffix")
    fused = F.array(*[F.log(F.get("p_host", F.lit(i))) + F.get("p_declared", F.lit(i)) + F.get("p_suffix", F.lit(i)) for i in range(k)])
    return out.select("host", "declared", "suffix", fused.alias("prior"))


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """``rows`` with language, posterior (of the best language) and rejected added."""
    k = len(model.languages)
    names = [c for c in rows.columns if c not in ("language", "posterior", "rejected")]
    back = [F.col("row")[c].alias(c) for c in names]
    if not k:
        return rows.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(True).alias("rejected"))
    seen = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), _norm(declared).alias("declared"), _norm(suffix).alias("suffix"),
        F.lower(F.coalesce(host.cast("string"), F.lit(""))).alias("host"),
        (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) > 2).alias("has_text"), _text_evidence(model)(F.coalesce(text.cast("string"), F.lit(""))).alias("text"),
    )
    counts = C.stored(seen.groupBy("host", "declared", "suffix", _argmax(F.col("text.ll")).alias("best")).agg(F.count(F.lit(1)).alias("n")), "language-counts")
    if not counts.head(1):
        return seen.select(*back, F.lit("").alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))
    prior = C.stored(_evidence_table(counts, k), "language-evidence")
    out = seen.join(prior, ["host", "declared", "suffix"])
    out = out.withColumn("fused", F.zip_with(F.col("text.ll"), F.col("prior"), lambda a, b: a + b))
    top = F.array_max("fused")
    posterior = 1.0 / F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    unsure = F.col("declared").isin(sorted(model.unsure | {_primary(l) for l in model.unsure})) & (F.col("declared") != "") & F.col("has_text")
    language = F.get(F.array(*[F.lit(x) for x in model.languages]), _argmax(F.col("fused")))
    return out.select(*back, language.alias("language"), posterior.alias("posterior"), (~(F.col("text.alike") | unsure) | (posterior < MIN_POSTERIOR)).alias("rejected"))
