"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import public_tokenizers
import pytest
from test_operators import SCHEMA, brute_join, brute_repeats, check_mix, nasty, token_lists

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(name, input, output) of each stage, over the small table and over rows with every case."""
    import corpus_pipeline as P

    out = {}
    for kind, docs in (("small", spark.read.parquet(f"{SMALL}/documents.parquet")), ("nasty", spark.createDataFrame(nasty(), SCHEMA)), ("empty", spark.createDataFrame([], SCHEMA))):
        for name, stage in P.STAGES:
            path = f"{tmp_path_factory.mktemp(kind)}/{name}"
            stage(spark, docs, SMALL).write.parquet(path)
            done = spark.read.parquet(path)
            out[kind, name] = (docs, done)
            docs = done
    return out


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("kind", ["small", "nasty", "empty"])
def test_columns_stay(tables, kind):
    import corpus_pipeline as P

    for name, _ in P.STAGES[:-1]:
        before, after = tables[kind, name]
        assert after.dtypes == before.dtypes


def test_language_keeps_clean_documents(tables):
    before, after = tables["small", "language_id"]
    assert before.count() - after.count() <= 2
    assert not Counter(rows(after, "doc_id", "text")) - Counter(rows(before, "doc_id", "text"))


@pytest.mark.parametrize("kind", ["small", "nasty"])
def test_one_document_of_each_group_stays(tables, kind):
    before, after = tables[kind, "ngram_jaccard_join"]
    had, left = rows(before, "doc_id", "text"), Counter(rows(after, "doc_id", "text"))
    groups: dict = {}
    for row, (d, n, c) in zip(had, brute_join(had, 5, 80)):
        if n:
            groups.setdefault(c, []).append(row)
        else:
            assert left[row]
    for members in groups.values():
        kept = [m for m in set(members) if left[m]]
        assert len(kept) == 1 and left[kept[0]] == 1
        assert kept[0][0] == min((m[0] for m in members if m[0] is not None), default=None)


@pytest.mark.parametrize("kind", ["small", "nasty"])
def test_passages_go(tables, kind):
    before, after = tables[kind, "substring_dedup"]
    had = rows(before, "doc_id", "text")
    want = Counter((d, kept if lost else t) for (d, t), (_, _, lost, kept) in zip(had, brute_repeats(had)) if not lost or kept)
    assert Counter(rows(after, "doc_id", "text")) == want
    assert all(n == len(t) for t, n in rows(after.filter("text is not null and n_chars is not null"), "text", "n_chars") if kind == "small")


@pytest.mark.parametrize("kind", ["small", "nasty"])
def test_mix_repeats_and_drops(tables, kind):
    from quire.llm.entropy_mix import mix_sources

    before, after = tables[kind, "source_mix"]
    plan = mix_sources(before).collect()
    check_mix(plan, 0.25)
    want = Counter()
    for r in plan:
        want[r["row"]["doc_id"], r["row"]["text"]] += r["copies"]
    assert Counter(rows(after, "doc_id", "text")) == +want


@pytest.mark.parametrize("kind", ["small", "nasty"])
def test_packing_holds_every_token(tables, kind):
    before, after = tables[kind, "lexical_packing"]
    assert sum(r[0] for r in rows(after, "length")) == sum(len(ids) for _, ids in token_lists(rows(before, "doc_id", "text")))


def test_run(spark):
    import corpus_pipeline as P

    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
    assert public_tokenizers.path(P.TOKENIZER).endswith(".json")


def test_near_duplicates_keep_columns_of_any_name(spark):
    import corpus_pipeline as P

    rows = [(1, "a b c d e f g h", "en", "s", 15, "keep", "i", "h"), (2, "a b c d e f g h", "en", "s", 15, "keep", "i", "h"), (3, None, None, None, None, "keep", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text_hash string, _id string, _hash string")
    got = P.one_of_each_group(spark, docs, "").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [rows[0], rows[2]]
