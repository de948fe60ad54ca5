"""Each corpus operator against a brute-force version, a round trip or held-out rows, over rows with
nulls, empty and very long texts, ties, repeats, empty tables and clashing extra columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
BPE, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use for themselves.
CLASH = "row string, id string, block string, size string, salt string, copies string, n_words string, spans string, kept string, language string, host string, draw string, _host string, _labelled string, _bad string, _bound string, _id string, _hash string, _text_hash string"


def words(text):
    return (text or "").encode().split()


def nasty():
    """Rows with every defined case."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = sentence(120)
    swap = lambda t, k: " ".join(rng.choice(vocab) if i % 120 < k else w for i, w in enumerate(t.split()))
    texts = [base, base, base.upper(), swap(base, 1), swap(base, 2), swap(base, 3), swap(base, 9), None, "", " \t\n", "a", "a", "A b", "a  b c", "a b c d", "a b c d e"]
    texts += [sentence(rng.randint(1, 80)) for _ in range(20)]
    texts += [sentence(25) + " " + " ".join(base.split()[10:70]) + "\n" + sentence(9) for _ in range(5)]
    texts += [sentence(30_000), "x" * 50_000, "Ünï. Cödé! <|endoftext|> 日本 don't\r\n\x0b😀 a\u0301 \x00 ▁▁ end.", "same same " * 40]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "Ä", None, ""]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (3, "other text for an id that is there already", "en", "s1", 42)]
    rows += [(None, base, None, None, None), (None, sentence(40), "en", "s2", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.selectExpr("*", *[f"'{i}' AS `{c.split()[0]}`" for i, c in enumerate(CLASH.split(", "))])


# 1 -------------------------------------------------------------------------------------------


def brute_join(rows, width, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    known = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return [(d, len(sets[i]), known[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (1, 60)])
def test_join_equals_brute_force(spark, docs, width, percent):
    from quire.llm.ngram_join import jaccard_join

    got = jaccard_join(clashing(docs), width=width, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_join([(r[0], r[1]) for r in nasty()], width, percent)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_join_chain_of_near_copies(spark):
    """A chain in which only neighbours link, among many copies, is one component."""
    from quire.llm.ngram_join import jaccard_join

    rng = random.Random(3)
    now = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        rows += [(i * 3, " ".join(now)), (i * 3 + 1, " ".join(now))]
        now = now[2:] + [f"w{rng.randint(0, 10**6)}", f"w{rng.randint(0, 10**6)}"]
    got = {tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == set(brute_join(rows, 4, 85)) and {c for _, _, c in got} == {0}


def test_join_signatures_are_shared_by_every_linked_pair():
    from quire.llm.ngram_join import Bands, signatures

    rng = np.random.default_rng(1)
    for percent in (60, 80, 85, 95):
        bands = Bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            drop, add = rng.integers(0, max(1, n // 5) + 1, 2)
            b = np.unique(np.r_[rng.permutation(a)[int(drop) :], rng.integers(0, 1 << 62, int(add)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(signatures(a, bands), signatures(b, bands)))


def test_join_empty(empty):
    from quire.llm.ngram_join import jaccard_join

    assert jaccard_join(empty).collect() == []


# 2 -------------------------------------------------------------------------------------------


def test_neighbours_recall_and_scores(spark):
    from quire.llm.inverted_multi_index import InvertedMultiIndex

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in InvertedMultiIndex(vectors).search(F.col("id") % 100 == 0, 10, share=0.8, least=0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(np.square(x - x[ids == q][0]).sum(axis=1))
        best = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        hits += len({ids[i] for i in best} & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(far[ids == v][0] - s) < 1e-12 for _, v, s in found)
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(got)


def test_neighbours_walk_is_ascending_and_complete():
    from quire.llm.inverted_multi_index import walk

    rng = np.random.default_rng(0)
    a, b, counts = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
    cells = walk(a, b, counts, 10**9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(7) for j in range(5) if counts[i, j]}


def test_neighbours_cases(spark):
    from quire.llm.inverted_multi_index import InvertedMultiIndex

    nan = float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [1.0, None, 0.0])]
    rows += [(8, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (9, [1.0, 2.0]), (200, None), (100, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, first string")
    got = [tuple(r) for r in InvertedMultiIndex(df).search(F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    two = math.sqrt(2.0)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, two), (100, 1, 0, two), (100, 2, 1, two), (100, 3, 2, two)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert InvertedMultiIndex(none).search(F.col("id") % 100 == 0).collect() == []


# 3 -------------------------------------------------------------------------------------------


def text_hash(t):
    h = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def piece_counts(text):
    """The pieces of a text as (text of the piece): count, by a plain loop."""
    blank = " \t\n\x0b\x0c\r"
    script = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
    out, paragraph = Counter(), ""
    paragraphs = []
    for c in text:
        paragraph += c
        if c == "\n" or (c == " " and paragraph[-2:-1] in tuple(".!?;|")):
            paragraphs.append(paragraph)
            paragraph = ""
    for p in paragraphs + [paragraph]:
        units, unit = [], ""
        for c in p:
            unit += c
            if c in blank or script(c) or len(unit) == 64:
                units.append(unit)
                unit = ""
        run = []
        for u in units + [unit]:
            run.append(u)
            if len(p) <= 64:
                continue
            if text_hash(u) % 4 == 0 or len(run) == 63:
                out["".join(run)] += 1
                run = []
        out["".join(run)] += 1
    del out[""]
    return out


def dice(a, b):
    if a == b:
        return 1.0
    x, y = piece_counts(a), piece_counts(b)
    length = lambda c: sum(len(k) * n for k, n in c.items())
    return 2 * length(x & y) / (length(x) + length(y))


def test_fingerprints(spark, docs):
    from quire.llm.merkle import fingerprints, string_likeness

    rows = sorted(((r[0], r[1] or "") for r in nasty()), key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]), r[1]))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        want[d, len(t), edited, round(dice(t, edited), 9), round(dice(t, after), 9)] += 1
    out = fingerprints(clashing(docs))
    got = out.withColumn("again", string_likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert all(r["again"] == r["near_edited"] for r in got)
    by_text = defaultdict(set)
    text_of = defaultdict(set)
    for d, t in rows:
        text_of[d].add(t)
    for r in got:
        if len(text_of[r["doc_id"]]) == 1:
            by_text[next(iter(text_of[r["doc_id"]]))].add(r["fingerprint"])
        by_text[r["edited"]].add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert all((r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0) == (not r["changed"]) for r in got)


def test_fingerprints_of_hot_ids(spark):
    """A third of the rows without an id, a third under one: still one successor each, in order."""
    from quire.llm.merkle import _ranges, fingerprints

    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"Text number {i}. Of the {i % 50} others.") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]), r[1]))
    want = Counter((r[0], r[1][: len(r[1]) - len(r[1]) // 4] + order[(i + 1) % len(order)][1][: len(r[1]) // 4]) for i, r in enumerate(order))
    assert Counter((r["doc_id"], r["edited"]) for r in fingerprints(df).select("doc_id", "edited").collect()) == want
    keyed = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    sizes = [r["count"] for r in keyed.groupBy(_ranges(keyed, 32)).count().collect()]
    assert max(sizes) < 3000 / 32 * 2 and len(sizes) > 24


def test_fingerprints_locate_edits(spark):
    from quire.llm import merkle

    lines = [f"Paragraph {i} of the text.\n" for i in range(40)]
    new = "Another one.\n"
    edits = [
        (lines, lines[:21] + [new] + lines[22:], [21]),
        (lines, [new] + lines, [0]),
        (lines, lines[:30] + [new, new] + lines[30:], [30, 31]),
        (lines, lines[:5] + [new] + lines[6:33] + [new] + lines[33:], [5, 33]),
        (lines, lines[:12] + lines[15:], [12]),
        (lines, lines[:-1] + [new], [39]),
        (lines, lines, []),
        (lines[:1], [], [0]),
    ]
    df = spark.createDataFrame([(i, "".join(a), "".join(b)) for i, (a, b, _) in enumerate(edits)], "i int, a string, b string")
    for c in "ab":
        df = merkle.with_tree(df, c, c)
        df = df.withColumn(f"{c}s", merkle.section_starts(F.col(f"{c}leaves"))).withColumn(f"{c}n", merkle.sections(F.col(f"{c}leaves"), F.col(f"{c}s")))
        df = df.withColumn(f"{c}t", F.struct(F.col(f"{c}leaves").alias("leaves"), F.col(f"{c}s").alias("starts"), F.col(f"{c}n").alias("nodes")))
    got = df.select("i", merkle.changed_paragraphs(F.col("at"), F.col("bt")).alias("changed"), "an", "bn").orderBy("i").collect()
    assert [r["changed"] for r in got] == [w for _, _, w in edits]
    assert len(got[1]["an"]) > 2 and len(set(got[1]["bn"]) - set(got[1]["an"])) == 1  # an insertion changes its own section


def test_fingerprints_of_text_without_marks(spark):
    from quire.llm.merkle import fingerprints

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    han = lambda: "".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(2_000))
    texts = [" ".join(word() for _ in range(800)), " ".join(word() for _ in range(20_000)), han(), "".join(word() for _ in range(500)), " ".join(word() for _ in range(50))]
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(0.5 < r["near_edited"] < 0.87 for r in got), [r["near_edited"] for r in got]
    assert all(r["near_next"] < 0.1 for r in got)


def test_fingerprints_small_tables(spark, empty):
    from quire.llm.merkle import fingerprints

    assert fingerprints(empty).collect() == []
    one = fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert (one["edited"], one["near_next"]) == ("abcdefab", 1.0)


# 4 -------------------------------------------------------------------------------------------


def test_targets_share_and_stop_at_the_ceiling():
    from quire.llm.entropy_mix import targets

    t = targets({"a": 1, "b": 1000, "c": 1000, None: 500})
    assert t["a"] == 3 and abs(sum(t.values()) - 2501) < 1e-6
    assert abs(t["b"] / t["c"] - 2) < 1e-9 and abs(t[None] / t["c"] - 5 / 1) < 1e-9 or t[None] == 1500
    assert targets({"a": 0, None: 0}) == {"a": 0.0, None: 0.0} and targets({}) == {}


def check_mix(got, tolerance):
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = r["row"]["source"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert all(size[r["row"]["source"]] == r["source_size"] for r in got)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(5, tolerance * target[s]), (s, taken[s], target[s])


def test_mix(spark, docs, empty):
    from quire.llm.entropy_mix import mix_sources

    out = mix_sources(clashing(docs)).collect()
    assert sorted(r["size"] for r in out) == sorted(len(words(r[1])) for r in nasty())
    check_mix(out, 0.2)
    again = mix_sources(clashing(docs).repartition(3)).collect()
    pick = lambda rows: sorted(repr((r["row"]["doc_id"], r["size"], r["taken"], r["target"])) for r in rows)
    assert pick(out) == pick(again)
    assert mix_sources(empty).collect() == []
    check_mix(mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect(), 0.02)


def test_mix_tilts_exponentially(spark):
    """Rates of one source fall or rise with size by exp(lambda * size): its expected words fit."""
    from quire.llm.entropy_mix import mix_sources

    rows = [(i, "w " * (1 + i % 50), "a" if i % 4 else "b") for i in range(4000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(out, 0.001)
    rate = defaultdict(list)
    for r in out:
        rate[r["row"]["source"], r["size"] // 10].append(r["copies"])
    for s in "ab":
        means = [np.mean(rate[s, b]) for b in range(5)]
        assert means == sorted(means) or means == sorted(means, reverse=True)


# 5, 8 ----------------------------------------------------------------------------------------


def token_lists(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]


def blob(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_packing_round_trip(spark, docs, empty):
    from quire.llm.lexical_pack import pack_documents

    got = pack_documents(clashing(docs), BPE).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["doc_tokens"], bytes(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: no padding
    want = Counter((d, blob(ids)) for d, ids in token_lists(nasty()))
    for (d, whole), times in want.items():
        n = len(whole) // 4
        mine = [p for p in pieces[d] if p[1] == n and p[2] == whole[4 * p[0] : 4 * p[0] + len(p[2])]]
        cover = Counter(i for start, _, ids in mine for i in range(start, start + len(ids) // 4))
        assert len(cover) == n and min(cover.values()) >= times
    assert sum(r["length"] for r in got) == sum(len(w) // 4 * k for (_, w), k in want.items())
    assert pack_documents(empty, BPE).collect() == []


def test_packing_prefers_lexical_neighbours():
    from quire.llm.lexical_pack import Index, pack

    # documents 0, 2, 4 share rare terms, as do 1, 3, 5; all share term 1
    flat = np.array([x for i in range(6) for x in ([1, 10 + i % 2, 20 + i % 2, 30 + i % 2] * 4)])
    found = pack(Index(flat, np.full(6, 16)), [16] * 6, 48)
    groups = defaultdict(set)
    for doc, _, _, sequence, _ in found:
        groups[sequence].add(doc)
    assert list(groups.values()) == [{0, 2, 4}, {1, 3, 5}]


def test_packing_neighbours_of_the_whole_corpus(spark, monkeypatch):
    from quire.llm import lexical_pack as L

    # a seed meets documents that share only weak terms of a long text, too
    flat = np.array([*range(100, 140), *range(100, 118), 139, 139, *range(100, 139), 1, 1, 1])
    index = L.Index(flat, np.array([40, 19, 1, 39, 1, 1, 1]))
    assert set(index.neighbours(0, np.arange(7) == 0).tolist()) == {1, 2, 3}
    # a third shard's documents count in the weights of this one
    whole = L.Statistics(np.array([0, 1000, 2]), 1000, 4.0)
    a = L.Index(np.array([1, 2, 1, 2]), np.array([2, 2]), whole)
    assert a.weights[a.term_at[2]] > 100 * a.weights[a.term_at[1]]
    # pairs with words of their own meet in one shard, at any number of partitions
    monkeypatch.setattr(L, "SHARD_TOKENS", 4_000)
    rng = random.Random(3)
    topics = [["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(25)] for _ in range(20)]
    rows = spark.createDataFrame([(i, " ".join(rng.choice(topics[i % 20]) for _ in range(60))) for i in range(400)], "doc_id long, text string")
    got = []
    for partitions in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got.append(sorted((r["doc_id"], r["start"], r["sequence_id"], r["offset"]) for r in L.pack_documents(rows, BPE).collect()))
    assert got[0] == got[1]
    shards = defaultdict(set)
    for doc, _, sequence, _ in got[0]:
        shards[doc % 20].add(sequence >> 32)
    assert len(set().union(*shards.values())) > 5
    assert sum(len(x) for x in shards.values()) < 60


def test_wavelet_round_trip(spark, docs, empty, tmp_path):
    from quire.llm import wavelet

    folder = f"file://{tmp_path}/shards"
    manifest = wavelet.write_shards(clashing(docs), folder, BPE)
    got = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in wavelet.read_shards(spark, folder, manifest).collect()]
    raw = {}
    rows = sorted(nasty(), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    at, want = 0, []
    for d, ids in token_lists(rows):
        want.append((d, at, len(ids), blob(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    none = f"file://{tmp_path}/none"
    assert wavelet.read_shards(spark, none, wavelet.write_shards(empty, none, BPE)).collect() == []
    assert raw == {}


def test_wavelet_matrix_queries():
    from quire.llm.wavelet import WaveletMatrix

    rng = np.random.default_rng(2)
    for size, top in ((0, 1), (1, 1), (700, 3), (2000, 50_000)):
        seq = rng.integers(0, top, size).astype(np.uint32)
        m = WaveletMatrix.load(WaveletMatrix.pack(seq, [1], np.array([size])))
        assert np.array_equal(m.tokens(), seq)
        for i in range(0, size, 37):
            assert m.access(i) == seq[i] and m.rank(int(seq[i]), i) == int((seq[:i] == seq[i]).sum())
        for token in {*seq[:20].tolist(), top, 60_000}:
            places = np.flatnonzero(seq == token)
            assert m.count(token) == len(places) and [m.select(token, j) for j in range(min(5, len(places)))] == places[:5].tolist()
            with pytest.raises(IndexError):
                m.select(token, len(places))


def test_chunk_encoder_equals_whole_texts(spark):
    import pyarrow as pa

    from quire.llm.tokens import ChunkEncoder

    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in nasty()] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    alphabet = "aZ.É'éß,!|<>😀日1 \t\n\u0301\u00a0Σİ$_*\"-)\u2014"
    rows += [(0, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))) for _ in range(1500)]
    rows += [(0, t) for t in ("it's. don't, A<|endoftext|>B <|ENDOFTEXT|> <|endoftext|>.", "ΑΣ ΑΣ. İx", "가 각 ạ́", "a..b.. .a", "it$$$ $$$it $it$s's$ x_y_ a'$ a-'s")]
    ids, lengths = ChunkEncoder(BPE).encode(pa.array([t for _, t in rows], pa.string()))
    ends = np.cumsum(lengths)
    for (_, want), n, end in zip(token_lists(rows), lengths, ends):
        assert ids[end - n : end].tolist() == want[:-1]


# 6 -------------------------------------------------------------------------------------------


def test_language_held_out(spark, docs, empty):
    from quire.llm import language_id as L

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(rows.filter("doc_id % 2 = 0"))
    out = L.identify(rows.filter("doc_id % 2 = 1"), model, F.col("text"), F.lit(None), F.lit(None), F.lit(None)).collect()
    assert np.mean([r["lang"] == r["language"] for r in out]) > 0.97
    assert np.mean([r["rejected"] for r in out]) < 0.02
    mine = L.identify(clashing(docs), model, F.col("text"), F.col("lang"), F.lit("x"), F.col("source")).collect()
    assert len(mine) == len(nasty()) and all(r["rejected"] for r in mine if not words(r["text"]) and len(r["text"] or "") < 3)
    assert L.identify(empty, model, F.col("text"), F.col("lang"), F.lit(None), F.col("source")).collect() == []
    nothing = L.identify(docs, L.fit(empty), F.col("text"), F.col("lang"), F.lit(None), F.col("source")).collect()
    assert len(nothing) == len(nasty()) and all(r["rejected"] and r["language"] is None for r in nothing)


def test_language_keeps_rare_languages(spark, monkeypatch):
    from quire.llm import language_id as L

    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang in ('en', 'de', 'fr', 'es') and length(text) >= 200")
    others = rows.filter("lang <> 'es' and doc_id % 10 = 0")
    rare = rows.filter("lang = 'es'").orderBy("doc_id")
    for n in (1, 2, 10, 40):
        model = L.fit(others.unionByName(rare.limit(n)))
        assert "es" in model.languages and ("es" in model.unsure) == (n < L.EVIDENCE)
        text = pa.array([r["text"] for r in rare.offset(n).limit(150).collect()], pa.string())
        declared = spark.createDataFrame([(i, t) for i, t in enumerate(text.to_pylist())], "doc_id long, text string")
        out = L.identify(declared, model, F.col("text"), F.lit("es"), F.lit(None), F.lit(None)).collect()
        assert sum(r["rejected"] for r in out) <= 3, n
    # each language has rows of its own in the sample
    monkeypatch.setattr(L, "FIT_ROWS", 30)
    seen = []
    monkeypatch.setattr(L, "TextModel", lambda texts, labels: seen.extend(labels))
    L.fit(others.unionByName(rare.limit(12)))
    count = Counter(seen)
    assert count["es"] == 12 and all(10 <= count[l] <= 60 for l in ("en", "de", "fr"))


def test_language_sample_stays_in_tasks(spark, monkeypatch):
    """The sample's whole texts are counted in tasks, not in the driver's memory."""
    from quire.llm import language_id as L

    driver, plain = os.getpid(), L.trigrams

    def away(column):
        assert os.getpid() != driver
        return plain(column)

    monkeypatch.setattr(L, "trigrams", away)
    texts = {"aa": [f"abc {i} abd" * 9 for i in range(30)], "bb": [f"xyz {i}" * 9 for i in range(3)], "cc": ["", "z"]}
    rows = [(i, t, l) for l in texts for i, t in enumerate(texts[l])] + [(9, None, "aa"), (9, "abc", None), (0, texts["aa"][0], "aa")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    monkeypatch.undo()
    assert model.languages == [*texts] and model.unsure == {"bb", "cc"}
    for i, l in enumerate(texts):
        counts = 1.0 + np.bincount(L.trigrams(pa.array(texts[l]))[0], minlength=L.BUCKETS)
        assert np.array_equal(model.table[i], np.log(counts / counts.sum()).astype(np.float32))
    assert model.mean[0] < 0 < model.sd[0] < np.inf and not model.mean[1:].any() and np.isinf(model.sd[1:]).all()


def test_language_evidence_settles_short_texts(spark):
    from quire.llm import language_id as L

    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    rows = [(i, text("abcdef" if i % 2 else "uvwxyz"), "xx" if i % 2 else "yy", f"h{i % 2}.site.org") for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = L.fit(train)
    more = train.unionByName(spark.createDataFrame([(1000, "!!!", "xx-US", "h1.site.org"), (1001, "!!!", "yy", "new.site.org"), (1002, "$%&", None, "h1.site.org")], train.schema))
    got = {r["doc_id"]: r["language"] for r in L.identify(more, model, F.col("text"), F.col("lang"), L.address_language(F.concat(F.lit("http://"), "host", F.lit("/"))), F.col("host")).collect()}
    assert (got[1000], got[1001], got[1002]) == ("xx", "yy", "xx")


# 7 -------------------------------------------------------------------------------------------


def brute_repeats(rows, width=13):
    first = {}
    key = lambda d: math.inf if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, math.inf), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_repeats_equal_brute_force(spark, docs, empty):
    from quire.llm.substring_dedup import remove_repeats

    out = remove_repeats(clashing(docs)).collect()
    assert sorted(repr((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in out) == sorted(map(repr, brute_repeats([(r[0], r[1]) for r in nasty()])))
    for r in out:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert r["row"]["block"] == "2" and r["row"]["kept"] == "8"
    assert remove_repeats(empty).collect() == []


# 9 -------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, docs, empty):
    import sentencepiece

    from quire.llm.bpe_count import count_tokens

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(4)
    texts = [r[1] for r in nasty()] + ["".join(rng.choice("aeinrsth \n▁1.é日") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["\n a", "a\n", " " * 37 + "x", "the" * 300, "aaaa" * 99, "=====-----" * 9, "<s> </s> <unk> <0x41>", "▁a ▁▁ b", "\n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in count_tokens(df, PIECE).collect():
        t = texts[r["doc_id"]] or ""
        want = len(model.encode(t))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(t.encode()), want > 4096), t[:80]
    assert count_tokens(clashing(docs), PIECE).count() == len(nasty())
    assert count_tokens(empty, PIECE).collect() == []


# 10 ------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_rules(spark):
    from quire.llm import host_reputation as H

    urls = ["http://a.example.NET/en/1", "http://example.net/en", "http://x.net/", "http://x.net", "http://badexample.com/de/1", "https://m.example.com/de/1?x#y", "http://q.org/fr/", "q.org/fr/", None, "", "://", "http://ÀB.org?/fr/", "a://b://c.net/x", "http://net/x", "http://x.org\n/fr/"]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    for r in H.judge_urls(df, labels).collect():
        host, path = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        assert (r["rule"], r["verdict"]) == (best, rules[best] if best else "allow")


def test_urls_of_clashing_names(spark):
    from quire.llm import host_reputation as H

    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    marks = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    got = H.judge_urls(clashing(pages), marks).collect()
    assert len(got) == 2 and all(r[c] == str(i) for r in got for i, c in enumerate(x.split()[0] for x in CLASH.split(", ")) if c != "host")


def test_worker_gives_memory_back():
    """Another operator's caches go when an operator enters a worker."""
    from quire.llm import common, lexical_pack, tokens

    common.enter("one")
    tokens.encoder(BPE), lexical_pack._directions(10)
    common.enter("one")
    assert tokens.encoder.cache_info().currsize == 1
    common.enter("two")
    assert tokens.encoder.cache_info().currsize == 0 and lexical_pack._directions.cache_info().currsize == 0


def test_worker_keeps_its_caches_between_tasks(spark):
    """An operator's tasks find what its earlier tasks in the same worker have learnt."""
    from quire.llm import common, tokens

    @common.worker("keeps")
    def run(batches):
        known = tokens.encoder.cache_info().currsize
        tokens.encoder(BPE)
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "known": [known]})

    got = spark.range(0, 40, 1, 40).mapInArrow(run, "pid long, known long").collect()
    assert sum(r["known"] == 0 for r in got) <= len({r["pid"] for r in got}) < len(got)


def test_packing_forgets_used_documents(monkeypatch):
    """An index without its used documents finds the same unused ones, with the same scores."""
    from quire.llm import lexical_pack as L

    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 40, 300)
    flat = rng.zipf(1.4, lengths.sum()) % 500
    monkeypatch.setattr(L, "FORGET", 10**9)
    want = L.pack(L.Index(flat, lengths), lengths.tolist(), 64)
    monkeypatch.setattr(L, "FORGET", 3)
    index = L.Index(flat, lengths)
    size = len(index.docs)
    assert L.pack(index, lengths.tolist(), 64) == want and len(index.docs) < size


def test_packing_counts_terms_as_it_encodes(spark):
    """The corpus' document frequencies come with the encoded documents, whatever the batches."""
    from quire.llm import lexical_pack as L

    texts = [r[1] for r in nasty()]
    ids = [set(ids[:-1]) for _, ids in token_lists(nasty())]
    want = Counter(i for x in ids for i in x)
    for size in (1, 7, 100):
        table = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
        out = [*L._encoded(BPE, "<u2")(iter(table.to_batches(max_chunksize=size)))]
        assert sum(b["df"].null_count for b in out) == len(texts) == sum(len(b) for b in out) - 1
        got = [*L._frequencies(iter(out[-1:]))]
        assert len(got) == 1 and dict(zip(got[0]["term"].to_pylist(), got[0]["df"].to_pylist())) == want


def test_chunk_encoder_tells_latin_words_apart(monkeypatch):
    """Words of Latin letters go past the library's splitting, odd ones do not; full slots lose no chunk."""
    from quire.llm import tokens as T

    rng = random.Random(8)
    letters = [chr(c) for c in range(0xC0, 0x250)] + list("abcXYZ") * 30
    rows = [(0, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40))) for _ in range(60)]
    rows += [(0, "a\u00d7b \u00f7 \u0130x \u00e9\u00d7 x\u0130 \u0132\u01c5\u0223 \u0240 \u00b5m \u00aa \u212bx e\u0301 \u00c9\u00c9.")]
    for bits in (T.SLOT_BITS, 3):
        monkeypatch.setattr(T, "SLOT_BITS", bits)
        encoder, ends = T.ChunkEncoder(BPE), 0
        assert encoder.direct
        for at in (0, 20, 0):
            mine = rows[at : at + 41]
            ids, lengths = encoder.encode(pa.array([t for _, t in mine], pa.string()))
            ends = np.cumsum(lengths)
            for (_, want), n, end in zip(token_lists(mine), lengths, ends):
                assert ids[end - n : end].tolist() == want[:-1]
        assert len(encoder.known) == (encoder.n_chunks - (encoder.slot_at >= 0).sum())


def test_reputation_shrinks_and_blocks(spark):
    from quire.llm import host_reputation as H

    rows, labels = [], []
    for h, host in enumerate([f"h{i}.good.org" for i in range(20)] + ["bad.farm.com", "worse.farm.com", "new.farm.com", "thin.good.org"]):
        for k in range(40):
            p = h * 100 + k
            rows.append((p, f"http://{host}/{k}"))
            if "farm" in host and "new" not in host or "good" in host and k < (1 if "thin" in host else 40):
                labels.append((p, "farm" in host or "thin" in host or k % 10 == 0))
    rows += [(None, None), (5, "http://h0.good.org/again")]
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*labels, (None, True), (10**9, True), (1, None)], "page_id long, bad boolean")
    got = {(r["host"], r["verdict"]) for r in H.judge_urls(pages, marks).collect()}
    assert ("bad.farm.com", "block") in got and ("worse.farm.com", "block") in got and ("new.farm.com", "block") in got
    assert ("thin.good.org", "allow") in got and all(v == "allow" for h, v in got if "good" in h or h == "")
    post = {r["host"]: r for r in H.host_posteriors(pages.select("page_id", H.host_and_path(F.col("url"))[0].alias("host")), marks).collect()}
    assert post["h0.good.org"]["mean"] < post["thin.good.org"]["mean"] < post["bad.farm.com"]["mean"]
    assert H.judge_urls(pages.limit(0), marks).collect() == []


# queries -------------------------------------------------------------------------------------


def test_every_query_runs_over_the_small_tables(spark):
    from quire.llm import queries

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        out = query(spark, SMALL)
        rows = out.collect()
        assert rows and len(set(out.columns)) == len(out.columns), name
        if "doc_id" in out.columns and name != "op5_lexical_packing":
            assert sorted(r["doc_id"] for r in rows) == list(range(n)), name


def test_query_digests(spark):
    from quire.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    at = 0
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op8_wavelet_output"](spark, SMALL).collect()}
    lists = dict(token_lists(rows))
    for d, _ in rows:
        assert got[d] == (d, at, len(lists[d]), zlib.crc32(blob(lists[d])))
        at += len(lists[d])
    for r in queries.QUERIES["op5_lexical_packing"](spark, SMALL).collect():
        assert r["ids_crc32"] == zlib.crc32(blob(lists[r["doc_id"]][r["start"] : r["start"] + r["length"]])) and r["doc_tokens"] == len(lists[r["doc_id"]])
    for i, r in enumerate(queries.QUERIES["op3_document_fingerprints"](spark, SMALL).orderBy("doc_id").collect()):
        t, after = rows[i][1], rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()


def test_ngram_join_sends_brief_sketches_first(spark):
    """Folded sketches refute unrelated pairs and members before whole ones travel, and no linked one."""
    from quire.llm import ngram_join as N

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [base, np.r_[base[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)], *(np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(30))]
    whole = pa.RecordBatch.from_pydict({
        "node": pa.array(range(len(sets)), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([N.sketch(s) for s in sets], pa.binary())})
    brief = next(N._brief([whole]))
    assert 4 * sum(map(len, brief["sketch"].to_pylist())) == sum(map(len, whole["sketch"].to_pylist()))
    group = pa.table({"grp": pa.array([7] * len(sets), pa.int64()), "component": whole["node"], **{c: brief[c] for c in ("node", "n", "sketch")}})
    assert N._open(85)(group)["node"].to_pylist() == [0, 1]
    at, other = [0] * (len(sets) - 1), list(range(1, len(sets)))
    pairs = {"a": pa.array(at, pa.int64()), "b": pa.array(other, pa.int64()), "weight": pa.array(at, pa.int64())}
    for s, side in (("a", at), ("b", other)):
        pairs |= {f"n_{s}": brief["n"].take(pa.array(side)), f"sketch_{s}": brief["sketch"].take(pa.array(side))}
    assert [x["b"].to_pylist() for x in N._passing(85)([pa.RecordBatch.from_pydict(pairs)])] == [[1]]


def test_chunks_ends_and_numbers(spark):
    """Closing marks are stepped over to the byte before them, however many; distinct hashes as ``np.unique`` has them."""
    from quire.llm import common as C
    from quire.llm import tokens as T

    texts = ["ab. c!! d", "x" + "." * 9 + " ...... ?", "", ".", "a.b.c-.,;: éé...... " + "-" * 50]
    data, offsets = C.flat_bytes(pa.array(texts))
    starts, ends, _ = C.word_spans(data, offsets)
    want = [max((i for i in range(a, b) if not T._CLOSING[data[i]]), default=None) for a, b in zip(starts, ends)]
    got = T._before_marks(data, starts, ends)
    assert [int(x) if x >= a else None for x, a in zip(got, starts)] == want
    hashes = np.array([5, 1, 5, 2**63 + 1, 1, 0], dtype=np.uint64)
    known, place, inverse = T._distinct(hashes)
    assert known.tolist() == np.unique(hashes).tolist() and hashes[place].tolist() == known.tolist() and known[inverse].tolist() == hashes.tolist()
    assert [len(x) for x in T._distinct(hashes[:0])] == [0, 0, 0]


def test_ngram_join_exchanges_only_what_is_asked_for(spark, monkeypatch):
    """The rows that enter an exchange are those asked for and hardly another; a crowded map loses none. What
    a round verifies reads no text that no pair asks for."""
    from quire.llm import ngram_join as N

    rng = random.Random(11)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(4000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(k, f"row {i}") for i, k in enumerate(keys)] + [(None, "null")], "node long, what string")
    asked = [*keys[:40], *keys[-4:], keys[0]]
    wanted = spark.createDataFrame([(k,) for k in asked], "key long").repartition(3)
    got = [r["node"] for r in N._asked(rows, "node", wanted).collect()]
    assert set(asked) <= set(got) and len(got) == len(set(got)) < 2 * len(asked)
    assert N._asked(rows, "node", wanted.limit(0)).collect() == []
    with monkeypatch.context() as m:
        m.setattr(N, "SLOTS", 16)
        assert set(asked) <= {r["node"] for r in N._asked(rows, "node", wanted).collect()}

    stored, read = N.C.stored, []

    def spy(df, name):
        out = stored(df, name)
        read.append((name, out.columns))
        return out

    monkeypatch.setattr(N.C, "stored", spy)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(["x", *base[1:]]), *(" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(50))]
    table = list(enumerate(texts))
    out = N.jaccard_join(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect())) == sorted(brute_join(table, 4, 85))
    assert read and not [name for name, columns in read if "text" in columns]


def test_ngram_join_names_a_set_to_few_ranges(spark):
    """A set's name is sent once for each range, so ranges hold many signatures of a set."""
    from quire.llm import ngram_join as N

    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(700)])})
    ranges = -(-100_000_000 // N.RANGE_ELEMENTS)  # the elements of a corpus of half a GB
    sent = list(N._signature_side(4, 85, ranges)([batch]))
    bands = N.Bands(85)
    keys = sum(len(N.signatures(s, bands)) for s in N.sets_of(batch["text"], 4))
    assert sum(len(x) for b in sent for x in b["nodes"].to_pylist()) < 2.5 * keys
