"""Randomised comparison of the line operators with a direct Python model of the documented
semantics (300 seeded cases per operator, evaluated in one DataFrame each)."""

import random

from pyspark.sql import functions as F

from quire.operators import diff, lines, paths

random.seed(20241202)
ALPHABET = ["a", "b", "", " ", "x y", "\t", "é", "😀"]


def _content():
    return "\n".join(random.choice(ALPHABET) for _ in range(random.randint(1, 9))) + random.choice(["", "\n"])


def _chunks_model(content, size, start, end):
    ls = content.split("\n")
    total = len(ls)
    e = min(end, total) if end else total
    s = max(1, start)
    if s > total:
        return None
    req = ls[s - 1 : e]
    out = []
    for i in range(0, len(req), size):
        ch = req[i : i + size]
        out.append((s + i, min(s + i + len(ch) - 1, e), "\n".join(ch), len(ch)))
    return out


def test_line_chunks_random(spark):
    cases = [(i, _content(), random.randint(1, 4), random.randint(-1, 8), random.choice([None, 0] + list(range(1, 10)))) for i in range(300)]
    df = spark.createDataFrame(cases, "path int, content string, cs int, st int, en int")
    got = {}
    for r in lines.line_chunks(df, "content", F.col("cs"), F.col("st"), F.col("en")).collect():
        got.setdefault(r.path, []).append(r)
    for i, content, cs, st, en in cases:
        want = _chunks_model(content, cs, st, en)
        rows = sorted(got[i], key=lambda r: -1 if r.chunk_index is None else r.chunk_index)
        if want is None:
            assert len(rows) == 1 and rows[0].success is False
        elif not want:
            assert len(rows) == 1 and rows[0].success and rows[0].chunk_index is None
        else:
            assert [(r.start_line, r.end_line, r.content, r.line_count) for r in rows] == want, (content, cs, st, en)


def test_negative_end_line_reads_nothing(spark):
    # A negative end line is outside the range model (the reference's slice would count it
    # from the end and report a negative end line); here it reads no chunk.
    df = spark.createDataFrame([(1, "a\nb\nc")], "path int, content string")
    r = lines.line_chunks(df, "content", 2, 1, -1).collect()
    assert len(r) == 1 and r[0].success and r[0].chunk_index is None


def test_replace_delete_insert_random(spark):
    cases = [(i, _content(), random.randint(-1, 9), random.randint(-1, 9), random.choice(["", "N", "N\nM"])) for i in range(300)]
    df = spark.createDataFrame(cases, "path int, content string, s int, e int, new string")
    rep = {r.path: r for r in lines.replace_lines(df, F.col("s"), F.col("e"), F.col("new")).collect()}
    dele = {r.path: r for r in lines.delete_lines(df, F.col("s"), F.col("e")).collect()}
    ins = {r.path: r for r in lines.insert_lines(df, F.col("s"), F.col("new")).collect()}
    for i, content, s, e, new in cases:
        ls = content.split("\n")
        n = len(ls)
        ok = 1 <= s <= n and s <= e <= n
        assert rep[i].success == ok and dele[i].success == ok
        if ok:
            assert rep[i].new_content == "\n".join(ls[: s - 1] + new.split("\n") + ls[e:])
            assert dele[i].new_content == "\n".join(ls[: s - 1] + ls[e:])
        ok_ins = 0 <= s <= n
        assert ins[i].success == ok_ins
        if ok_ins:
            assert ins[i].new_content == "\n".join(ls[:s] + new.split("\n") + ls[s:])


def test_diff_random(spark):
    cases = [(i, _content(), _content()) for i in range(300)]
    df = spark.createDataFrame(cases, "path_1 int, content_1 string, content_2 string").withColumn("path_2", F.col("path_1"))
    got = {}
    for r in diff.line_diff(df).collect():
        got.setdefault(r.path_1, []).append((r.line_number, r.kind, r.line_1, r.line_2))
    for i, a, b in cases:
        la, lb = a.split("\n"), b.split("\n")
        want = []
        for k in range(max(len(la), len(lb))):
            x = la[k] if k < len(la) else ""
            y = lb[k] if k < len(lb) else ""
            if x != y:
                want.append((k + 1, ("modified" if y else "deleted") if x else "added", x, y))
        assert sorted(got.get(i, [])) == want[:100]


def _resolve(root, p):
    if p.startswith("/"):
        return p
    if p.startswith("./"):
        p = p[2:]
    stack = [s for s in root.split("/") if s]

    def fold(st, segs):
        st = list(st)
        for s in segs:
            if s in ("", "."):
                continue
            if s == "..":
                st = st[:-1]
            else:
                st.append(s)
        return "/" + "/".join(st)

    res = fold(stack, p.split("/"))
    if res.startswith(root):
        return res
    base = [s for s in p.split("/") if s]
    return fold(stack, [base[-1] if base else ""])


def test_normalize_path_random(spark):
    segs = ["a", "b", "..", ".", "", "root", "root-x"]
    cases = []
    for i in range(300):
        p = "/".join(random.choice(segs) for _ in range(random.randint(1, 5)))
        cases.append((i, random.choice(["", "./", "/"]) + p))
    df = spark.createDataFrame(cases, "i int, p string")
    got = {r.i: r.n for r in df.select("i", paths.normalize_path(F.col("p"), "/root").alias("n")).collect()}
    for i, p in cases:
        assert got[i] == _resolve("/root", p), p
