"""Corpus readers with the three decode policies: whole files as rows (Spark's binaryFile source), and
files of any size as numbered lines, read by byte ranges."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import stored
from quire.sources.ranges import ranged, with_sum_before

DECODE_POLICIES = ("replace", "latin1", "drop")


def decode(content: Column, policy: str) -> Column:
    """replace: invalid bytes -> U+FFFD, newlines untouched;
    latin1: strict UTF-8, else ISO-8859-1, and CRLF / CR folded to LF (text-mode read);
    drop: strict UTF-8, else NULL (the caller drops the row)."""
    as_str = content.cast("string")
    if policy == "replace":
        return F.make_valid_utf8(as_str)
    if policy == "latin1":
        text = F.when(F.is_valid_utf8(as_str), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
        return F.regexp_replace(text, "\r\n?", "\n")
    if policy == "drop":
        return F.when(F.is_valid_utf8(as_str), as_str)
    raise ValueError(f"unknown decode policy {policy!r}; expected one of {DECODE_POLICIES}")


def read_corpus(spark: SparkSession, root: str, decode_policy: str | Sequence[str] = "replace", glob: str | None = None) -> DataFrame:
    """files(path, content, size_bytes, mtime) for every file below ``root`` (recursive;
    directories are never rows). Several policies give a row and ``policy`` each from one listing and one
    read. Each file is one row, so files must fit a task's memory
    (Spark caps binaryFile rows at 2 GB)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    policies = [decode_policy] if isinstance(decode_policy, str) else list(decode_policy)
    decoded = [F.struct(F.lit(p).alias("policy"), decode(F.col("content"), p).alias("text")) for p in policies]
    rows = reader.load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.inline(F.array(*decoded)))
    rows = rows.where((F.col("policy") != "drop") | F.col("text").isNotNull())
    names = [] if isinstance(decode_policy, str) else ["policy"]
    return rows.select("path", F.col("text").alias("content"), "size_bytes", "mtime", *names)


#: Files of one folder that ``write_corpus`` fills.
FOLDER_FILES = 1000


def _local(root: str) -> str | None:
    """The folder that every process opens as ``root``, if that is a path of the file system itself."""
    path = root.removeprefix("file:")
    path = "/" + path.lstrip("/") if path != root and (path[:3] == "///" or path[:2] != "//") else path
    return path if path[:1] == "/" and path[:2] != "//" else None


def _write_files(root: str):
    """Writes each run of rows of one name as one file, its values as lines; a file appears whole, a task that
    runs again writes the same names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, folder = TaskContext.get().partitionId(), 0, ""
        name, lines = None, []

        def write():
            nonlocal n, folder
            if n % FOLDER_FILES == 0:
                folder = os.path.join(root, f"{task:05d}-{n // FOLDER_FILES:05d}")
                os.makedirs(folder, exist_ok=True)
            n += 1
            part = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
            with open(part, "wb") as f:
                f.writelines(lines)
            os.replace(part, os.path.join(folder, f"{name}.txt"))

        for batch in batches:
            for now, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != name and name is not None:
                    write()
                    lines = []
                name = now
                lines += [value or b"", b"\n"]
        if name is not None:
            write()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return run


def write_corpus(rows: DataFrame, root: str, name: str, value: str) -> None:
    """Each row's ``value`` (bytes, and a line feed) as a text file of its own below ``root``, whose path has
    ``<name>=<the row's name>``, a number; rows of one name that are in one task share a file, a line each.

    Where ``root`` is a path that the processes share, tasks write the files themselves, FOLDER_FILES to a
    folder: Spark's writer makes a folder a file there, starts a process for the mode of each, and moves
    them all in the driver. Any other store is Spark's to write."""
    local = _local(root)
    if local is None:
        rows.select(name, F.col(value).cast("string").alias("value")).write.partitionBy(name).text(root)
        return
    os.makedirs(local, exist_ok=True)
    named = F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    ordered = rows.sortWithinPartitions(name).select(named.alias("name"), F.col(value).cast("binary").alias("value"))
    ordered.mapInArrow(_write_files(local), "files long").agg(F.sum("files")).collect()


#: Bytes of a chunk of a file between the task that reads it and the one that digests it.
CHUNK_BYTES = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins neighbouring lines of a range to chunks of about CHUNK_BYTES, each line with its line feed."""

    def row(key, parts):
        return pa.RecordBatch.from_pylist([{"file": key[0], "range": key[1], "seq": key[2], "lines": len(parts), "chunk": b"".join(p + b"\n" for p in parts)}], schema=_CHUNK)

    key, parts, size = None, [], 0
    for batch in batches:
        for file, start, seq, value in zip(*(batch.column(c).to_pylist() for c in ("file", "range", "seq", "value"))):
            if key is not None and (key[:2] != (file, start) or size >= CHUNK_BYTES):
                yield row(key, parts)
                key, parts, size = None, [], 0
            key = key or (file, start, seq)
            parts.append(value)
            size += len(value) + 1
    if key is not None:
        yield row(key, parts)


_CHUNK = pa.schema([("file", pa.string()), ("range", pa.int64()), ("seq", pa.int64()), ("lines", pa.int64()), ("chunk", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """md5 and line count of each file from its chunks in order; a chunk at a time is held. The last line feed
    is the file's only where the sizes say so; a byte order mark, which the text source leaves out, likewise."""

    def row():
        return pa.RecordBatch.from_pylist([{"file": file, "lines": lines + (not cut), "md5": md5.hexdigest()}])

    file, md5, lines, left, cut = None, None, 0, 0, False
    for batch in batches:
        for name, size, count, chunk in zip(*(batch.column(c) for c in ("file", "size", "lines", "chunk"))):
            if name.as_py() != file:
                if file is not None:
                    yield row()
                file, md5, lines, cut = name.as_py(), hashlib.md5(usedforsecurity=False), 0, False
                left = size.as_py()[0]
                if size.as_py()[1] in (left - 3, left - 2):
                    md5.update(BOM)
                    left -= len(BOM)
            data = memoryview(chunk.as_buffer())
            cut = len(data) > left  # one line feed more than the file has
            md5.update(data[:left])
            left -= min(len(data), left)
            lines += count.as_py()
    if file is not None:
        yield row()


BOM = b"\xef\xbb\xbf"


def file_digests(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size_bytes, line_count, md5) of every file below ``root``: lines as splitting the decoded file at line
    feeds gives them, md5 of its bytes. Files may be larger than any row: ranges are read apart and joined
    to chunks, and a file's chunks meet in order in one task, which holds one of them at a time (an md5 is
    sequential by nature)."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.format("binaryFile").load(root).select("path", F.col("_metadata.file_path").alias("_file"), F.col("length").alias("size_bytes"))
    rows = reader.option("lineSep", "\n").format("text").load(root).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("value"))
    chunks = stored(rows.mapInArrow(_chunks, "file string, range long, seq long, lines long, chunk binary"), "file-chunks")
    read = stored(chunks.groupBy("file").agg(F.sum(F.octet_length("chunk").cast("long")).alias("read")), "file-sizes")
    sizes = read.join(files, read["file"] == files["_file"]).select("file", F.array("size_bytes", "read").alias("size"))
    ordered = chunks.join(sizes, "file").repartition("file").sortWithinPartitions("file", "range", "seq")
    found = ordered.select("file", "size", "lines", "chunk").mapInArrow(_digests, "file string, lines long, md5 string")
    out = files.join(found, files["_file"] == found["file"], "left")
    # a file of a byte order mark alone has no chunk: it is one line
    return out.select("path", "size_bytes", F.coalesce("lines", F.lit(1)).cast("int").alias("line_count"), F.coalesce("md5", F.md5(F.lit(BOM))).alias("md5"))


def read_corpus_lines(spark: SparkSession, root: str, decode_policy: str = "replace", glob: str | None = None) -> DataFrame:
    """(path, size_bytes, line from 1, content) of the lines of every file below ``root``, as splitting the decoded
    file at line feeds gives them: a file that ends with one has an empty last line. Files may be larger
    than any row: ranges of bytes are read apart, a line that crosses a border by the range it begins in,
    and lines are numbered by running sums. Whether a file is valid UTF-8 as a whole, which ``latin1`` and ``drop``
    ask, is one aggregate. A byte order mark at the start is left out; an empty file has no rows."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = ranged(reader, root)
    read = F.sum(F.octet_length("value").cast("long") + 1)
    last = F.max(F.struct("range", "seq"))
    files = rows.groupBy("file").agg(F.min(F.is_valid_utf8("value")).alias("valid"), (read - F.first("size")).alias("over"), last.alias("last"))
    # every line but an unfinished last one has its line feed in the file; a byte order mark is three bytes
    files = files.select("file", "valid", F.col("over").isin(0, -3).alias("finished"), "last")
    # one row a range: its first line, the lines of the ranges before it
    totals = stored(rows.groupBy("file", "range").agg(F.min("seq").alias("from"), F.count(F.lit(1)).alias("n")), "range-lines")
    files = stored(files, "file-ends")  # small tables by their real size: the lines stay where they are
    if decode_policy == "drop":
        files = files.filter("valid")
    rows = rows.join(files, "file")
    is_last = (F.col("range") == F.col("last.range")) & (F.col("seq") == F.col("last.seq"))
    value = F.col("value")
    if decode_policy == "latin1":
        text = F.when(F.col("valid"), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))
        # the carriage return before a line feed is part of the line end
        text = F.when(is_last & ~F.col("finished"), text).otherwise(F.regexp_replace(text, "\r\\z", ""))
        lines = F.split(text, "\r", -1)
    else:
        lines = F.array(decode(value.cast("binary"), decode_policy))
    lines = F.when(is_last & F.col("finished"), F.concat(lines, F.array(F.lit("")))).otherwise(lines)
    rows = rows.select("file", "size", "range", "seq", lines.alias("lines"))
    if decode_policy == "latin1":
        rows = with_sum_before(rows, F.size("lines").cast("long"), "before")
    else:  # a row of the source is one line, so its place in its range is its number there
        earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select("file", "range", "from", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        rows = rows.join(F.broadcast(base), ["file", "range"]).withColumn("before", F.col("base") + F.col("seq") - F.col("from"))
    out = rows.select("file", "size", "before", F.posexplode("lines").alias("place", "content"))
    return out.select(F.col("file").alias("path"), F.col("size").alias("size_bytes"), (F.col("before") + F.col("place") + 1).alias("line"), "content")
