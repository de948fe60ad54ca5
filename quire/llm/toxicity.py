"""Toxicity by a weighted finite-state pattern grammar.

Clauses (text between ``. ; ! ?`` and line ends) are read as class symbols: insult, threat, target,
negation, reported speech, other. The lexical transducer gives a word its class and weight: fixed seed
lists, and words and stems learnt from labelled rows. Five small transducers read the symbols, one
for each pattern, and are composed into one deterministic machine whose arcs emit what kind of match
a word is there: an insult or a threat, aimed at a target or not, within a negation's reach or not,
reported or not. A clause counts each kind once, with its largest lexical weight; a document's score is
a logistic function of its matched clauses.

Fitting reads a bounded sample: of each label about ``FIT_ROWS / 2`` rows in hash order, without rows
whose crc32(id) mod 4 is 2, which stay held out. Remainders 0 and 1 give the lexicon (counts of
documents by word and stem, near copies once, kept where the log-likelihood ratio withstands the number
of entries tried), remainder 3 gives the weights of the kinds (ridge logistic regression towards the prior
weights below). Scoring reads all rows and nothing but the text.

Defined cases: null or empty text has the score of a text without a match; a null id is not held out
and not learnt from; labels that are null are no labels, of several for an id the largest counts;
without labels the seeds and prior weights score; repeated rows score alike; an empty table gives no
rows; the result has doc_id, held_out, score, predicted and ``clauses`` (matched clauses).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

FIT_ROWS = 20_000
HELD_OUT, LEXICON_FOLDS, WEIGHT_FOLDS = 2, (0, 1), (3,)
THRESHOLD = 0.3
#: Code points of a learnt stem; words that a context reaches ahead; words remembered by a worker.
STEMS, REACH, REMEMBERED = range(3, 9), 5, 200_000
#: Documents that a learnt entry must come from, the chance of one false entry, a weight's bounds.
LEAST_DOCS, FALSE_ENTRY, WEIGHTS = 3, 0.05, (0.5, 8.0)

#: A stem goes if one longer entry has this share of its documents.
SAME_STEM = 0.95

# Seed words by class, in English, German, French and Spanish.
INSULTS = """idiot moron stupid worthless scum loser pathetic trash clown disgusting dumb fool jerk dumm trottel abschaum widerlich
connard crétin débile pourriture estúpido imbécil basura asqueroso""".split()
THREATS = """kill hurt destroy burn shoot stab strangle punish töten umbringen verbrennen erschießen tuer frapper brûler détruire matar
golpear quemar destruir""".split()
TARGETS = """you your yours yourself he him she her they them du dich dir dein ihr euch sie tu toi vous ton ta tes votre vos
tú ti usted ustedes vosotros vuestro""".split()
NEGATIONS = "not no never none neither nor don't isn't aren't nicht nie kein keine keinen niemals ne pas jamais aucun nunca jamás ningún ni".split()
REPORTS = """said says say saying wrote writes quote quoted quotes called reported according sagte sagt schrieb laut zitiert dit
disait écrit selon cité dijo dice escribió según citó""".split()
#: Weight of a seed that no label speaks about.
SEED_WEIGHT = 2.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.;!?\n\r]")
_BREAKS = frozenset(".;!?\n\r")


# ---------------------------------------------------------------- transducers
# A transducer is (start state, step); step(state, symbol) gives the next state and what it emits.


def insult_transducer():
    return 0, lambda s, x: (0, ("insult",) if x == INSULT else ())


def threat_transducer():
    return 0, lambda s, x: (0, ("threat",) if x == THREAT else ())


def reach_transducer(opens: int, name: str):
    """Emits ``name`` with insults and threats up to REACH words after ``opens``."""
    return 0, lambda s, x: (REACH if x == opens else max(0, s - 1), (name,) if s and x in (INSULT, THREAT) else ())


def report_transducer():
    """Reported speech lasts to the clause's end."""
    return 0, lambda s, x: (1 if x == REPORT else s, ("reported",) if s and x in (INSULT, THREAT) else ())


def compose(*machines):
    """The product machine over reachable states: (next state, emitted kind) by state and symbol, and the
    kinds, sets of names, 0 being nothing."""
    starts, steps = zip(*machines)
    states, kinds, todo = {starts: 0}, {frozenset(): 0}, [starts]
    arcs: list[list[tuple[int, int]]] = []
    for at in count():
        if at == len(todo):
            break
        row = []
        for x in range(BREAK):
            moved = [step(s, x) for step, s in zip(steps, todo[at])]
            to, kind = tuple(m[0] for m in moved), frozenset(n for m in moved for n in m[1])
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append((states[to], kinds.setdefault(kind, len(kinds))))
        arcs.append(row)
    return arcs, list(kinds)


def grammar():
    return compose(insult_transducer(), threat_transducer(), reach_transducer(TARGET, "targeted"), reach_transducer(NEGATION, "negated"), report_transducer())


ARCS, KINDS = grammar()


def _after_others() -> list[list[int]]:
    """[words skipped][state]: the state after that many other words; beyond REACH nothing changes."""
    out = [list(range(len(ARCS)))]
    for _ in range(REACH):
        out.append([ARCS[s][OTHER][0] for s in out[-1]])
    return out


SKIP = _after_others()


def prior_weights() -> np.ndarray:
    """Weight of one clause by kind before any label: an aimed match counts more, a negated or reported
    one less; then those of the best clause, of matches a clause, and the constant."""
    of = {"targeted": 1.3, "negated": 0.4, "reported": 0.5}
    kinds = [0.3 * math.prod(of.get(n, 1.0) for n in k) for k in KINDS]
    return np.array([0.0, *kinds[1:], 0.5, 0.0, -3.0])


class Lexicon:
    """Class and weight of words; learnt words and stems count as insults."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        fixed = ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT))
        self.fixed = {w: (c, SEED_WEIGHT) for ws, c in fixed for w in ws}
        self.words = {w: SEED_WEIGHT for w in INSULTS} | words
        self.stems, self.lengths = stems, sorted({len(s) for s in stems})
        self.memory: dict[str, tuple[int, float]] = {}

    def read(self, token: str) -> tuple[int, float]:
        got = self.memory.get(token)
        if got is None:
            got = (BREAK, 0.0) if token in _BREAKS else self.fixed.get(token)
            if got is None:
                best = max([self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in self.lengths if n <= len(token))])
                got = (INSULT, best) if best > 0 else (OTHER, 0.0)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[token] = got
        return got


def match(text: str, lexicon: Lexicon) -> tuple[np.ndarray, int]:
    """(features of a document as in ``prior_weights``, matched clauses)."""
    tokens = _TOKEN.findall(text.lower())
    memory, read = lexicon.memory, lexicon.read
    seen = [(i, *got) for i, t in enumerate(tokens) if (got := memory.get(t) or read(t))[0]]
    out = np.zeros(len(KINDS) + 3)
    out[-1] = 1.0
    if not any(c in (INSULT, THREAT) for _, c, _ in seen):
        return out, 0
    matched, clauses, best, state, last = 0, 1, 0.0, 0, -1
    clause: dict[int, float] = {}
    for i, c, weight in [*seen, (len(tokens), BREAK, 0.0)]:
        if c == BREAK:
            if clause:
                matched += 1
                for kind, w in clause.items():
                    out[kind] += w
                best = max(best, sum(clause.values()))
                clause = {}
            clauses += 1
            state = 0
        else:
            state, kind = ARCS[SKIP[min(REACH, i - last - 1)][state]][c]
            if kind:
                clause[kind] = max(weight, clause.get(kind, 0.0))
        last = i
    out[-3], out[-2] = best, matched / clauses
    return out, matched


# ---------------------------------------------------------------- fitting


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray) -> None:
        self.words, self.stems, self.weights = words, stems, weights

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems)


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4))


def _signature(tokens: list[str]) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    text = "\0".join(tokens).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    cuts = np.flatnonzero(data == 0)
    word = C.span_hashes(data, np.r_[0, cuts + 1], np.r_[cuts, len(data)])
    return int((C.rolling(word, 3).min() if len(word) > 2 else C.mix(word.sum(keepdims=True))[0]).view(np.int64))


def _entries(batches):
    """(signature, toxic, entries) of each row: its distinct words, and stems with a star."""
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            tokens = _TOKEN.findall(text.lower())
            words = {t for t in tokens if t not in _BREAKS}
            stems = {w[:n] + "*" for n in STEMS for w in words if len(w) > n}
            out.append((_signature(tokens) if tokens else 0, [*words, *stems]))
        yield pa.RecordBatch.from_pydict({"signature": pa.array([s for s, _ in out], pa.int64()), "toxic": batch["toxic"], "entries": pa.array([e for _, e in out], pa.list_(pa.string()))})


def _tallied(batches):
    """Documents by entry and label, as many as fit summed in the task."""
    tally = Counter(), Counter()
    for batch in batches:
        for toxic, entries in zip(batch["toxic"].to_pylist(), batch["entries"].to_pylist()):
            tally[toxic].update(entries)
        if len(tally[0]) + len(tally[1]) > 300_000:
            yield from _rows(tally)
            tally = Counter(), Counter()
    yield from _rows(tally)


def _rows(tally):
    for toxic, found in enumerate(tally):
        n = pa.array(found.values(), pa.int64())
        none = pa.array(np.zeros(len(found)), pa.int64())
        yield pa.RecordBatch.from_pydict({"entry": pa.array(found.keys(), pa.string()), "toxic": n if toxic else none, "clean": none if toxic else n})


def weight_of(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log odds ratio of an entry, smoothed."""
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled rows for fitting (text, toxic, fold), and all such rows by label."""
    one = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("fold", fold(F.col("id"))).filter(F.col("fold") != HELD_OUT)
    rows = {int(r["toxic"] > 0): r["n"] for r in one.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {y: min(1.0, fit_rows / 2 / max(1, rows.get(y, 0))) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    bound = F.when(F.col("toxic") > 0, int(part[1] * (1 << 30))).otherwise(int(part[0] * (1 << 30)))
    drawn = C.stored(one.filter(draw < bound).select(F.col("id").alias("key"), (F.col("toxic") > 0).cast("int").alias("toxic"), "fold"), "toxic-labels")
    return docs.join(drawn, F.col("id") == F.col("key")).select("text", "toxic", "fold"), rows


def _lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    rows = sample.filter(F.col("fold").isin(*LEXICON_FOLDS)).select("text", "toxic").mapInArrow(_entries, "signature long, toxic int, entries array<string>")
    rows = C.stored(rows.groupBy("signature", "toxic").agg(F.first("entries").alias("entries")), "toxic-entries")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        return {}, {}
    tally = rows.select("toxic", "entries").mapInArrow(_tallied, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    tally = C.stored(tally.filter(F.col("toxic") >= LEAST_DOCS), "toxic-tally")
    # log-likelihood ratio of the entry's documents against the share of toxic rows
    share = t / (t + c)
    n = F.col("toxic") + F.col("clean")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    ratio = 2 * (term(F.col("toxic"), share) + term(F.col("clean"), 1 - share))
    least = 2 * math.log(max(1, tally.count()) / FALSE_ENTRY)
    kept = tally.filter((F.col("toxic") > n * share) & (ratio > least)).collect()  # of a bounded sample
    # a stem says more than its longest form only if several words share it
    longer: dict[str, int] = {}
    for r in kept:
        base = r["entry"].removesuffix("*")
        for k in range(min(STEMS), len(base)):
            longer[base[:k]] = max(longer.get(base[:k], 0), r["toxic"])
    words, stems = {}, {}
    for r in kept:
        if r["entry"].endswith("*") and longer.get(r["entry"][:-1], 0) >= SAME_STEM * r["toxic"]:
            continue
        weight = min(WEIGHTS[1], weight_of(r["toxic"], r["clean"], t, c))
        if weight >= WEIGHTS[0]:
            (stems if r["entry"].endswith("*") else words)[r["entry"].removesuffix("*")] = weight
    return words, stems


def _features(model: Model):
    def run(batches):
        lexicon = model.lexicon()
        for batch in batches:
            found = [match(t, lexicon)[0] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch["toxic"], "x": pa.array([x.tolist() for x in found], pa.list_(pa.float64()))})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a logistic regression drawn towards ``start`` (its constant is free)."""
    pull = np.full(len(start), ridge)
    pull[-1] = 1e-3
    w = start.copy()

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - z[y == 1].sum() + 0.5 * (pull * (w - start) ** 2).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The lexicon and the weights, from a bounded sample of the labelled rows that are not held out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    sample, size = _sample(rows, labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label_col}`").alias("toxic")), fit_rows)
    sample = C.stored(sample, "toxic-sample")
    words, stems = _lexicon(sample)
    model = Model(words, stems, prior_weights())
    found = sample.filter(F.col("fold").isin(*WEIGHT_FOLDS)).select("text", "toxic").mapInArrow(_features(model), "toxic int, x array<double>").collect()  # a bounded sample
    y = np.array([r["toxic"] for r in found])
    if len(y) and 0 < y.sum() < len(y):
        w = _logistic(np.array([r["x"] for r in found]), y, model.weights)
        # the sample holds another share of toxic rows than the labels
        w[-1] += math.log(size[1] / size[0]) - math.log(y.sum() / (len(y) - y.sum()))
        model.weights = w
    return model


def _scored(model: Model):
    def run(batches):
        lexicon = model.lexicon()
        for batch in batches:
            found = [match(t or "", lexicon) for t in batch["text"].to_pylist()]
            z = np.array([x for x, _ in found]).reshape(len(found), len(model.weights)) @ model.weights
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "clauses": pa.array([n for _, n in found], pa.int64())})

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and matched clauses of every row."""
    id_type = docs.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), f"id {id_type}, score double, clauses long")
    held = F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")
