"""Toxicity grammar, source divergence audit and phrase mining against brute force and held-out rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import phrase_mining, source_divergence, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = "term string, times string, docs string, counts string, place string, value string, words string, phrase string, n string, w string, k string, key string, id string, fold string, x string, score string, rank string"


def rows():
    rng = random.Random(3)
    vocab = ["the", "of", "Ab", "ab", "cD", "é", "ÉÉ", "x1y", "don't", "日本", "new", "york", "city"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " new york city "]) for _ in range(n))
    out = [(i, text(rng.randint(0, 40)), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "Ä", None, ""])) for i in range(60)]
    out += [(60, None, "en", "s1"), (61, "", "en", "lonely"), (62, " \t\n", "it", "s1"), (63, text(9000), "en", "s2"), (63, "same id", "de", "s1"), (None, text(20), None, None), out[0], out[0]]
    out += [(100 + i, "copied passage of words that all these rows have", "fr", "s1" if i % 3 else "s2") for i in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def clashing(df):
    return df.selectExpr("*", *[f"'{i}' AS `{c.split()[0]}`" for i, c in enumerate(CLASH.split(", "))])


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# 12 ------------------------------------------------------------------------------------------


def brute_audit(rows, least, top):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add((lang or "", source or ""))
        tf[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: tf[lang, s] for g, s in groups if g == lang}
        whole = sum(own.values(), Counter())

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept))

        pairs = [(-sum(abs(p(own[source], t) - p(own[s], t)) for t in kept), s.encode(), s) for s in own if s != source]
        out += [(lang, source, "pair", s, -v, i) for i, (v, _, s) in enumerate(sorted(pairs), 1)]
        terms = [(p(whole, t) - p(own[source], t), t.encode(), t) for t in kept if own[source][t] and p(own[source], t) > p(whole, t)]
        out += [(lang, source, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 50), (5, 3), (30, 50)])
def test_audit_equals_brute_force(docs, least, top):
    got = source_divergence.audit(docs, least_docs=least, top=top)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows(), least, top)


def test_audit_of_clashing_names_and_no_rows(spark, docs):
    assert sorted(source_divergence.audit(clashing(docs), least_docs=5).collect()) == sorted(source_divergence.audit(docs, least_docs=5).collect())
    assert source_divergence.audit(docs.limit(0)).collect() == []


def test_audit_shares_of_large_counts():
    count = np.array([0, 7, 10**13, 10**15], dtype=np.int64)
    under = 9 * 10**15
    assert source_divergence.shares(count, np.full(4, under)).tolist() == [1 + 10**9 * (int(c) + 5) // under for c in count]


def test_audit_flushes(docs, monkeypatch):
    monkeypatch.setattr(source_divergence, "FLUSH", 3)
    batches = [b for b in docs.select("lang", "source", "text").na.fill("").toArrow().to_batches(max_chunksize=4)]
    n = sum(sum(b["times"].to_pylist()) for b in source_divergence._counted(iter(batches)))
    assert n == sum(len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for _, t, _, _ in rows())


# 13 ------------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    f = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        best = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * v >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, v in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("share,longest,least", [(0.125, 3, 10), (1.0, 3, 2), (0.0, 4, 3)])
def test_phrases_equal_brute_force(docs, share, longest, least):
    """Also without any sample, where every length fails its border in turn."""
    got = phrase_mining.collocations(docs, least=least, longest=longest, top=40, share=share)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows(), least, longest, 40)


def test_phrases_whatever_the_bitmaps_hold(docs, monkeypatch):
    """Full bitmaps prune nothing and lose nothing."""
    monkeypatch.setattr(phrase_mining, "SEGMENT", 64)
    monkeypatch.setattr(phrase_mining, "BITS", 64)
    got = phrase_mining.collocations(docs, least=3, share=0.5, top=40)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows(), 3, 3, 40)


def test_phrases_keep_languages_apart(spark):
    """A word that is another language's name does not meet that language's words."""
    got = phrase_mining.collocations(spark.createDataFrame([("es", "en en en"), ("en", "es es es")] * 5, "lang string, text string"))
    assert sorted((r.lang, r.phrase, r.a) for r in got.collect()) == [("en", "es es", 10), ("es", "en en", 10)]


def test_phrases_of_clashing_names_and_no_rows(docs):
    assert sorted(phrase_mining.collocations(clashing(docs)).collect()) == sorted(phrase_mining.collocations(docs).collect())
    assert phrase_mining.collocations(docs.limit(0)).collect() == []


def test_phrases_exact_beyond_64_bits(spark):
    """Products of counts are decimals."""
    df = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_007)], "a long, l long, r long")
    a, l, r = 3_000_000_000, 3_000_000_001, 3_000_000_007
    assert df.select(phrase_mining.score_of("a", "l", "r").alias("s")).first().s == 10**6 * a * a // (l * r)


# 11 ------------------------------------------------------------------------------------------


def labelled(spark, n=1200, seed=5, insult="zorbag"):
    """Documents whose toxic ones hold words of one stem; labels of half of the clean ones are missing."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 120))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = insult + rng.choice(["", "en", "ung", "lich", "er"])
        docs.append((i, ". ".join(" ".join(w[a : a + 9]) for a in range(0, len(w), 9))))
        if toxic or rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_stems_and_holds_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert any(s.startswith("zorba") for s in model.stems)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    out = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in out]) > 0.97
    # labels of held-out rows make no difference
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.fit(docs, other)
    assert (same.words, same.stems) == (model.words, model.stems) and np.allclose(same.weights, model.weights)


def test_toxicity_of_the_given_labels(spark):
    """Accuracy on held-out rows, whose labels are noisy."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def test_toxicity_cases(spark, docs):
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (2, 1), (999, 1)], "doc_id long, toxic int")
    for labels in (odd, odd.limit(0)):
        model = toxicity.fit(docs, labels)
        got = toxicity.score(clashing(docs), model).collect()
        assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
        none = {r.score for r in got if r.doc_id in (60, 61, 62)}
        assert len(none) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize(
    "text,kind",
    [
        ("what an idiot.", {"insult"}),
        ("you are an idiot.", {"insult", "targeted"}),
        ("she is not an idiot.", {"insult", "targeted", "negated"}),
        ("the paper said that idiot was used", {"insult", "reported"}),
        ("i will kill them", {"threat"}),
        ("they will kill him", {"threat", "targeted"}),
        ("not now. idiot", {"insult"}),  # contexts end with the clause
        ("you and a b c d e f idiot", {"insult"}),  # and after their reach
        ("a clear path to nothing", set()),
    ],
)
def test_toxicity_grammar(text, kind):
    x, n = toxicity.match(text, toxicity.Lexicon({}, {}))
    at = np.flatnonzero(x[:-3])
    assert [set(toxicity.KINDS[i]) for i in at] == ([kind] if kind else []) and n == len(at)


def test_toxicity_machine_is_the_product():
    """The composed machine says what its transducers say one by one."""
    rng = random.Random(1)
    parts = [toxicity.insult_transducer(), toxicity.threat_transducer(), toxicity.reach_transducer(toxicity.TARGET, "targeted"), toxicity.reach_transducer(toxicity.NEGATION, "negated"), toxicity.report_transducer()]
    for _ in range(200):
        state, own = 0, [s for s, _ in parts]
        for x in rng.choices(range(toxicity.BREAK), k=12):
            state, kind = toxicity.ARCS[state][x]
            moved = [step(s, x) for s, (_, step) in zip(own, parts)]
            own = [m[0] for m in moved]
            assert toxicity.KINDS[kind] == {n for m in moved for n in m[1]}


def test_audit_queries_run_over_the_small_tables(spark):
    from quire.llm import queries

    for name in ("op11_toxicity", "op12_source_divergence", "op13_phrase_mining"):
        assert queries.QUERIES[name](spark, SMALL).count() >= 0
