"""Sources and sinks: decode policies, JSON documents, empty index fallback, change detection."""

import os

from pyspark.sql import functions as F

from quire.session import shared_dir
from quire.sources import corpus, documents_json, index_store
from quire.streaming import watch


def _write_bytes(root, name, data):
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, name), "wb") as fh:
        fh.write(data)


def test_decode_policies(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _write_bytes(root, "latin.txt", b"caf\xe9\r\nx")
    _write_bytes(os.path.join(root, "sub"), "ok.txt", "héllo".encode())
    rep = {os.path.basename(r.path): r.content for r in corpus.read_corpus(spark, root, "replace").collect()}
    assert rep == {"latin.txt": "caf�\r\nx", "ok.txt": "héllo"}
    lat = {os.path.basename(r.path): r.content for r in corpus.read_corpus(spark, root, "latin1").collect()}
    assert lat == {"latin.txt": "café\nx", "ok.txt": "héllo"}
    drop = {os.path.basename(r.path) for r in corpus.read_corpus(spark, root, "drop").collect()}
    assert drop == {"ok.txt"}


def test_documents_json_array_and_lines(spark, tmp_path):
    p = tmp_path / "docs.json"
    p.write_text('[{"id": "1", "file_path": "a.py", "chunk_type": "function", "text": "def f(): pass", "chunk_size": 13},\n'
                 ' {"id": "2", "file_path": "b.py", "chunk_type": "class", "text": "class A: pass", "chunk_size": 13}]')
    df = documents_json.read_documents_json(spark, str(p), multiline=True)
    assert [r.id for r in df.orderBy("id").collect()] == ["1", "2"]
    out = shared_dir(spark, "t-docs")
    documents_json.write_documents_json(df, out)
    assert documents_json.read_documents_json(spark, out).count() == 2


def test_absent_vector_index_reads_empty(spark, tmp_path):
    df = index_store.read_vector_index(spark, str(tmp_path / "nope"))
    assert df.count() == 0 and df.columns == ["path", "embedding"]


def test_changed_files(spark, tmp_path):
    root = str(tmp_path / "w")
    _write_bytes(root, "a.txt", b"1")
    _write_bytes(root, "b.txt", b"1")
    before = watch.listing(spark, root).collect()
    prev = spark.createDataFrame(before, "path string, modificationTime timestamp, length long")
    _write_bytes(root, "b.txt", b"12")
    _write_bytes(root, "c.txt", b"1")
    ev = {os.path.basename(r.path): r.event for r in watch.changed_files(watch.listing(spark, root), prev).collect()}
    assert ev == {"b.txt": "modified", "c.txt": "created"}


def test_watch_stream_emits_files_not_dirs(spark, tmp_path):
    root = str(tmp_path / "s")
    _write_bytes(os.path.join(root, "d1"), "x.txt", b"hello")
    _write_bytes(root, "y.txt", b"hi")
    q = watch.watch_corpus(spark, root).select(F.col("length")).writeStream.format("memory").queryName("watch_t").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.length for r in spark.sql("SELECT * FROM watch_t").collect()) == [2, 5]


def test_read_corpus_glob_and_sizes(spark, tmp_path):
    root = str(tmp_path / "g")
    _write_bytes(root, "a.py", "x = 'é'\n".encode())
    _write_bytes(root, "b.txt", b"skip me")
    rows = corpus.read_corpus(spark, root, "replace", glob="*.py").collect()
    assert [(os.path.basename(r.path), r.content, r.size_bytes) for r in rows] == [("a.py", "x = 'é'\n", 9)]


def test_json_array_read_by_ranges(spark, tmp_path):
    """Borders of ranges fall everywhere: in strings, escapes, nested values and between elements."""
    import json

    odd = ['a}b', '}{', '"quoted" }', "back\\slash\\", 'end\\"}', "[{]", "line\nbreak\t}", "é日本😀}", "", "}" * 30, '\\"', "\\\\}"]
    docs = [{"id": str(i), "file_path": odd[i % len(odd)], "chunk_type": odd[(i * 7 + 3) % len(odd)], "text": odd[(i * 5 + 1) % len(odd)] * (i % 9), "chunk_size": i} for i in range(400)]
    extra = [d | {"more": {"deep": [{"x": [1, {"y": "}"}]}, "]"]}} for d in docs]
    root = tmp_path / "arrays"
    root.mkdir()
    (root / "one_line.json").write_text(json.dumps(docs, ensure_ascii=False))
    (root / "pretty.json").write_text(json.dumps(extra, indent=3))
    (root / "empty.json").write_text(" [ ]\n")
    (root / "single.json").write_text('[\n{"id": "only"}]')
    key = lambda d: tuple(d.get(c) if c != "chunk_size" else d.get(c, -1) for c in ("id", "file_path", "chunk_type", "text", "chunk_size"))
    want = sorted(map(repr, [key(d) for d in docs] * 2 + [("only", None, None, None, -1)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "5000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = documents_json.read_json_array(spark, str(root)).fillna({"chunk_size": -1}).collect()
            assert sorted(repr(tuple(r)) for r in rows) == want
            if size == "700":
                assert spark.read.option("lineSep", "}").text(str(root / "one_line.json")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_large_files_equal_whole_files(spark, tmp_path):
    """Lines read by ranges are those of the whole-file reader, whatever the border cuts."""
    root = str(tmp_path / "lines")
    bodies = {
        "ends.txt": b"one\ntwo\n", "open.txt": b"one\n\ntwo", "cr.txt": b"a\r\nb\rc\r\n\r", "latin.txt": b"caf\xe9\r\nx\ry\n", "newline.txt": b"\n",
        "one.txt": "é".encode(), "long.txt": ("日本語😀 " * 50 + "\r\n").encode() * 40 + b"end\r", "bad.txt": (b"\xff\xfe line\n" + "ü".encode() * 300 + b"\n") * 20,
    }
    for name, body in bodies.items():
        _write_bytes(root, name, body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("600", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for policy in corpus.DECODE_POLICIES:
                whole = {(os.path.basename(r.path), r.size_bytes, i, t) for r in corpus.read_corpus(spark, root, policy).collect() for i, t in enumerate(r.content.split("\n"), 1)}
                rows = corpus.read_corpus_lines(spark, root, policy).collect()
                assert {(os.path.basename(r.path), r.size_bytes, r.line, r.content) for r in rows} == whole and len(rows) == len(whole), policy
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_digests_read_files_by_ranges(spark, tmp_path):
    import hashlib
    import random

    from quire.sources import corpus

    r = random.Random(3)
    files = {
        "b": b"x", "c": b"x\n", "d": b"\n", "e": b"\xef\xbb\xbfabc\ndef", "f": b"\xef\xbb\xbfabc\n", "g": bytes(r.randrange(256) for _ in range(40000)),
        "h": bytes(r.choice(b"ab\n\r\x00") for _ in range(30000)) + b"\n", "i s%20": b"q\r\nz", "j": b"\xef\xbb\xbf", "k": b"\n\n", "l": b"a" * 30000}
    for name, data in files.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        out = corpus.file_digests(spark, str(tmp_path), glob="*.bin")
        got = {x.path.rsplit("/", 1)[1][:-4]: (x.size_bytes, x.line_count, x.md5) for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(d), d.count(b"\n") + 1, hashlib.md5(d).hexdigest()) for n, d in files.items()}


def test_corpus_under_several_policies_is_one_read(spark, tmp_path):
    from quire.sources import corpus

    for name, data in {"a": b"x\r\ny", "b": b"caf\xe9\r", "c": "é".encode()}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    both = corpus.read_corpus(spark, str(tmp_path), corpus.DECODE_POLICIES, glob="*.txt")
    for policy in corpus.DECODE_POLICIES:
        alone = corpus.read_corpus(spark, str(tmp_path), policy, glob="*.txt")
        assert alone.columns == ["path", "content", "size_bytes", "mtime"]
        assert sorted(both.where(both.policy == policy).drop("policy").collect()) == sorted(alone.collect())
    assert both._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_corpus_text_files_share_folders(spark, registry, tmp_path, monkeypatch):
    import hashlib

    from quire.plans import io_queries

    docs = [(i, "plain" if i % 2 else f"caf\u00e9\r\n{i}", "en", "s") for i in range(40)] + [(50, None, "en", "s"), (-7, "minus", "en", "s"), (61, "twice", "en", "s"), (61, "twice", "en", "s"), (None, "no id", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/in/documents.parquet")
    roots = []

    def found(local):
        def folder(_spark, name):
            roots.append(f"file:{tmp_path}/out put/{name}{len(roots)}")
            return roots[-1] if local else f"{tmp_path}/{name}{len(roots)}"

        monkeypatch.setattr(io_queries, "shared_dir", folder)
        return sorted(map(tuple, registry.QUERIES["read_corpus_text"](spark, f"{tmp_path}/in").collect()), key=repr)

    got = found(True)
    files = [os.path.join(at, x) for at, _, names in os.walk(f"{tmp_path}/out put") for x in names]
    assert len(files) == 44 and len({os.path.dirname(x) for x in files}) <= 8  # a file a document, not a folder a document
    rows = {(p, i): (n, m) for p, i, n, m in got}
    assert rows["replace", 61] == (12, hashlib.md5(b"twice\ntwice\n").hexdigest()) and rows["drop", 50] == (1, hashlib.md5(b"\n").hexdigest())
    assert rows["latin1", 3] == (12, hashlib.md5("plain\ncaf\u00e9\n".encode()).hexdigest()) and ("drop", 3) not in rows and ("drop", -7) in rows and ("replace", None) in rows
    # a store that only Spark writes to
    monkeypatch.setattr(corpus, "_local", lambda root: None)
    assert found(False) == got
    monkeypatch.undo()
    assert [corpus._local(x) for x in ("file:///a%20b", "file:/a", "/a b", "file://host/a", "hdfs://host/a", "viewfs:///a", "a")] == ["/a%20b", "/a", "/a b", None, None, None, None]
