"""Golden boundary cases (FIXTURES.md) on inline inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions.text import bm25_tokens, clean_for_bm25
from quire.operators import bm25, chunking, diff, lines, paths, rewrite, structures


def one(spark, content, path="/r/a.txt"):
    return spark.createDataFrame([(path, content)], "path string, content string")


def test_chunk_trailing_newline(spark):
    r = lines.line_chunks(one(spark, "line1\nline2\nline3\n"), chunk_size=2).orderBy("chunk_index").collect()
    assert [(x.start_line, x.end_line, x.line_count) for x in r] == [(1, 2, 2), (3, 4, 2)]
    assert r[0].content == "line1\nline2" and r[1].content == "line3\n"


def test_chunk_empty_file_is_one_line(spark):
    r = lines.line_chunks(one(spark, ""), chunk_size=5).collect()
    assert len(r) == 1 and r[0].total_lines == 1 and r[0].content == "" and r[0].line_count == 1


def test_chunk_start_after_end_of_file(spark):
    r = lines.line_chunks(one(spark, "a\nb\nc"), start_line=9).collect()
    assert len(r) == 1 and r[0].success is False and r[0].error


def test_chunk_end_before_start(spark):
    r = lines.line_chunks(one(spark, "a\nb\nc"), start_line=3, end_line=2).collect()
    assert len(r) == 1 and r[0].success is True and r[0].chunk_index is None


def test_chunk_end_clamped(spark):
    r = lines.line_chunks(one(spark, "a\nb\nc\nd\ne"), chunk_size=2, start_line=2, end_line=4).orderBy("chunk_index").collect()
    assert [(x.start_line, x.end_line, x.content) for x in r] == [(2, 3, "b\nc"), (4, 4, "d")]


def test_insert_at_zero_and_bounds(spark):
    r = lines.insert_lines(one(spark, "a\nb"), 0, "top").collect()[0]
    assert r.success and r.new_content == "top\na\nb"
    bad = lines.insert_lines(one(spark, "a\nb"), 3, "x").collect()[0]
    assert not bad.success and bad.new_content is None


def test_replace_and_delete_lines(spark):
    r = lines.replace_lines(one(spark, "a\nb\nc"), 2, 3, "X\nY\nZ").collect()[0]
    assert r.success and r.new_content == "a\nX\nY\nZ" and r.replaced_lines == 2 and r.new_lines == 3
    r = lines.replace_lines(one(spark, "a\nb\nc"), 2, 2, "").collect()[0]
    assert r.new_content == "a\n\nc"
    d = lines.delete_lines(one(spark, "a\nb"), 1, 2).collect()[0]
    assert d.success and d.new_content == "" and d.total_lines == 0  # the result line array is empty
    e = lines.delete_lines(one(spark, "a\nb"), 2, 1).collect()[0]
    assert not e.success


def test_regex_replacement_is_literal(spark):
    r = rewrite.replace_regex(one(spark, "a1b"), r"a(\d)b", "$1").collect()[0]
    assert r.new_content == "$1" and r.replacements == 1
    r = rewrite.replace_regex(one(spark, "a1b"), r"a(\d)b", r"\1").collect()[0]
    assert r.new_content == r"\1"


def test_literal_replace_counts_and_empty_pattern(spark):
    r = rewrite.replace_literal(one(spark, "aaaa"), "aa", "b").collect()[0]
    assert r.new_content == "bb" and r.replacements == 2
    e = rewrite.replace_literal(one(spark, "aaaa"), "", "b").collect()[0]
    assert e.success is False


def test_strip_levels(spark):
    code = "a  =\t1; // c\n\n/* x\n y */\nf() {\n  return 1;\n}\n"
    df = one(spark, code, "/r/a.js")
    got = {lv: rewrite.strip(df, lv).collect()[0].compressed_content for lv in ("light", "medium", "aggressive")}
    assert got["light"] == "a = 1; // c\n/* x\n y */\nf() {\n return 1;\n}\n"
    assert got["medium"] == "a = 1; \nf() {\n return 1;\n}\n"
    assert got["aggressive"] == "a = 1; f() {return 1;} "  # the final newline becomes a space


def test_strip_ratio_empty_is_null(spark):
    assert rewrite.strip(one(spark, ""), "light").collect()[0].compression_ratio is None


def test_structures_if_is_a_method(spark):
    code = "function f_1(a) {\nclass C {\n  if (x) {\nconst g = (y) => y;\n  m(x) { // c"
    rows = structures.code_structures(one(spark, code)).collect()
    got = sorted((r.line, r.type, r.name) for r in rows)
    assert got == [(1, "function", "f_1"), (2, "class", "C"), (3, "method", "if"), (4, "arrow_function", "g"), (5, "method", "m")]
    only = structures.code_structures(one(spark, code), "class").collect()
    assert [r.name for r in only] == ["C"]


def test_diff_empty_left_line_is_added(spark):
    pairs = spark.createDataFrame([("a", "", "b", "x")], "path_1 string, content_1 string, path_2 string, content_2 string")
    r = diff.line_diff(pairs).collect()
    assert [(x.line_number, x.kind) for x in r] == [(1, "added")]


def test_diff_limit_and_total(spark):
    left = "\n".join(f"a{i}" for i in range(150))
    right = "\n".join(f"b{i}" for i in range(150))
    pairs = spark.createDataFrame([("a", left, "b", right)], "path_1 string, content_1 string, path_2 string, content_2 string")
    assert diff.line_diff(pairs).count() == 150 and diff.line_diff(pairs, limit=100).count() == 100
    s = diff.diff_summary(pairs).collect()[0]
    assert s.total_differences == 150 and s.identical is False


def test_relative_paths(spark):
    df = spark.createDataFrame([(p,) for p in ["test.txt", "./test.txt", "../test.txt", "folder/test.txt", "/abs/x.txt", "../root-x/y.txt"]], "p string")
    got = [r.n for r in df.select(paths.normalize_path(F.col("p"), "/root").alias("n")).collect()]
    assert got == ["/root/test.txt", "/root/test.txt", "/root/test.txt", "/root/folder/test.txt", "/abs/x.txt", "/root-x/y.txt"]


def test_token_chunks_401(spark):
    text = " ".join(f"t{i}" for i in range(401))
    r = chunking.token_chunks(one(spark, text)).orderBy("chunk_id").collect()
    assert [len(x.text.split()) for x in r] == [400, 1]
    assert chunking.token_chunks(one(spark, "  \n ")).count() == 0


def test_clean_text_unicode(spark):
    s = "½ ٣ é “q” a" + "́"
    r = one(spark, s).select(clean_for_bm25(F.col("content")).alias("c"), bm25_tokens(F.col("content")).alias("t")).collect()[0]
    assert r.c == "½ ٣ é q a"
    assert r.t == ["½", "٣", "é", "q", "a"]


def test_negative_idf_and_positive_scores_only(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "the dog", "the the bird", "fish"])], "doc_id long, text string")
    idx = bm25.build_index(docs)
    idf = {r.term: r.idf for r in idx.terms.collect()}
    assert idf["the"] < 0
    q = spark.createDataFrame([(1, "the")], "query_id long, text string")
    assert bm25.search(idx, q).count() == 0
    q2 = spark.createDataFrame([(1, "cat cat the")], "query_id long, text string")
    hits = bm25.search(idx, q2).collect()
    assert [h.doc_id for h in hits] == [0]


@pytest.mark.parametrize("content,expected", [("", 1), ("a\n", 2), ("a\n\n", 3)])
def test_line_count(spark, content, expected):
    from quire.operators.metrics import file_metrics

    assert file_metrics(one(spark, content)).collect()[0].line_count == expected
