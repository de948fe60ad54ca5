"""Change sets applied to the corpus table: inserts, copy/move/delete, batched line edits.

Each is set-at-a-time: a request table joined to ``files(path, content)``, a per-request
``success``/``error`` result, and the new file table. Requests see what the requests before them
did: inserts by ``seq``, path changes by ``change_id``, edits of one file by ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import lines as split_lines
from quire.functions.text import utf16_length
from quire.session import stored


def corpus_insert(files: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """batch(path, content, overwrite, seq) -> (per request result, new file table).
    An existing path is rejected unless ``overwrite``; a path that an earlier request of the
    batch wrote exists. Results carry UTF-8 size, line count and md5 of the written content."""
    exists = files.join(batch.select("path").distinct(), "path", "left_semi").select("path").distinct().withColumn("_exists", F.lit(True))
    # A first request on a new path always succeeds, so every later one finds the path there.
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq"))
    j = batch.withColumn("_place", place).join(exists, "path", "left")
    ok = (F.col("_exists").isNull() & (F.col("_place") == 1)) | F.coalesce(F.col("overwrite"), F.lit(False))
    result = j.select(
        "path",
        "seq",
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("file already exists: "), F.col("path"))).alias("error"),
        F.when(ok, F.octet_length("content").cast("long")).alias("size_bytes"),
        F.when(ok, F.size(split_lines(F.col("content")))).alias("line_count"),
        F.when(ok, F.md5("content")).alias("md5"),
        F.when(ok, F.col("content")).alias("_content"),
    )
    written = result.where("success").groupBy("path").agg(F.max_by("_content", "seq").alias("content"))
    new_files = files.select("path", "content").join(written.select("path"), "path", "left_anti").unionByName(written)
    return result.drop("_content"), new_files


# The operation types a change set may contain.
CHANGE_TYPES = ("copy", "move", "delete")


def _linked(pairs: DataFrame) -> DataFrame:
    """(path, label): the smallest path that pairs(a, b) connect to each path, by rounds of
    neighbour minima; the rounds are as many as the longest chain of distinct paths."""
    edges = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "path-links")
    labels = edges.select(F.col("a").alias("path")).distinct().withColumn("label", F.col("path"))
    while True:
        near = edges.join(labels, edges["b"] == labels["path"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["path"] == near["a"]).select("path", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        new = stored(new, "path-labels")
        labels = new.drop("moved")
        if not new.where("moved").head(1):
            return labels


REPLAYED = "change_id long, path string, origin string, success boolean, error string, copied string"
#: Rows of a batch that a replay gives back.
REPLAY_ROWS = 10_000


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs linked sets of changes, one after another, in order over names only: ``origin`` is the file whose
    content a path holds. Rows come by set: those of type 'file', which say that their path exists, and
    then the changes in order; names of one set at a time are held."""
    fields = ("change_id", "path", "origin", "success", "error", "copied")
    types = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(fields))

    label, holds, out = None, {}, []
    for table in batches:
        columns = (table.column(c).to_pylist() for c in ("label", "change_id", "type", "source", "destination", "target"))
        for now, change_id, kind, source, destination, target in zip(*columns):
            if now != label:
                out += [(None, p, o, True, None, None) for p, o in holds.items()]
                label, holds = now, {}
            error = origin = None
            if kind == "file":
                holds[source] = source
                continue
            if kind in ("copy", "move"):
                origin = holds.get(source)
                if origin is None:
                    error = f"no such file: {source}"
                else:
                    if kind == "move":
                        del holds[source]
                    holds[destination] = origin
            elif target in holds:
                del holds[target]
            else:
                error = f"no such file: {target}"
            out.append((change_id, None, None, error is None, error, origin if kind == "copy" else None))
            if len(out) >= REPLAY_ROWS:
                yield batch(out)
                out = []
    out += [(None, p, o, True, None, None) for p, o in holds.items()]
    for at in range(0, len(out), REPLAY_ROWS):
        yield batch(out[at : at + REPLAY_ROWS])


def apply_path_changes(files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes(change_id, type, source, destination, target) -> (per change result, new files).

    In order of ``change_id`` (a number), each change seeing the ones before it. copy: source must
    exist, destination gets its content; move: same, source removed; delete: target must exist; any
    other type fails. Changes that share paths, directly or through others, are replayed together
    and only by name: contents join back at the end. ``size`` counts UTF-16 units of a copy."""
    f = files.select("path", "content")
    known = changes.where(F.col("type").isin(*CHANGE_TYPES))
    ends = known.select("change_id", "type", "source", "destination", "target", F.coalesce("source", "target").alias("a"), F.coalesce("destination", "source", "target").alias("b"))
    labels = _linked(ends.select("a", "b").where("a is not null and b is not null"))
    present = f.select("path").join(labels, "path").select(F.lit(None).cast("long").alias("change_id"), F.lit("file").alias("type"), F.col("path").alias("source"), F.lit(None).cast("string").alias("destination"), F.lit(None).cast("string").alias("target"), "label")
    todo = ends.join(labels, ends["a"] == labels["path"]).select(F.col("change_id").cast("long"), "type", "source", "destination", "target", "label")
    # sets are many and small: each follows the one before it in a task, none is a call of its own
    ordered = present.unionByName(todo).repartition("label").sortWithinPartitions("label", F.col("type") != "file", F.col("change_id").asc_nulls_last())
    done = ordered.mapInArrow(_replay, REPLAYED)
    done = stored(done, "path-changes")
    sizes = f.join(done.where("copied is not null").select(F.col("copied").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("copied"), utf16_length(F.col("content")).alias("size"))
    told = done.where("change_id is not null").join(sizes, "copied", "left").select(F.col("change_id").alias("_id"), F.col("success").alias("_ok"), F.col("error").alias("_error"), "size")
    j = changes.join(told, F.col("change_id").cast("long") == F.col("_id"), "left")
    unknown = F.when(F.col("type").isin(*CHANGE_TYPES), F.lit("no such file: ")).otherwise(F.concat(F.lit("Unknown operation type: "), F.coalesce("type", F.lit(""))))
    result = j.select(
        "change_id", "type", "source", "destination", "target",
        F.coalesce("_ok", F.lit(False)).alias("success"), F.when(F.col("_ok").isNull(), unknown).otherwise(F.col("_error")).alias("error"), "size",
    )
    held = done.where("path is not null").select("path", "origin")
    moved = held.join(f.select(F.col("path").alias("origin"), "content"), "origin").select("path", "content")
    new_files = f.join(labels.select("path"), "path", "left_anti").unionByName(moved)
    return result, new_files


def apply_edit_batch(files: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(path, seq, op, start_line, end_line, new_content) with op in replace/delete/insert
    (insert uses start_line as the 'after' line). Edits of a file apply one after another in
    ``seq`` order, each on the result of those before it; an invalid one changes nothing and the
    next goes on. Per edited file: success (no edit failed), error (the first failed edit),
    edits_applied (those that succeeded) and the content. A file's edits meet in its row, as its
    lines do; nothing else is grouped."""

    def step(acc, e):
        ls, n = acc["lines"], F.size(acc["lines"])
        s, en, op = e["start_line"], e["end_line"], e["op"]
        new = split_lines(F.coalesce(e["new_content"], F.lit("")))
        bad_range = s.isNull() | (s < 1) | (s > n) | en.isNull() | (en < s) | (en > n)
        bad = F.when(op.isin("replace", "delete"), bad_range).when(op == "insert", s.isNull() | (s < 0) | (s > n)).otherwise(F.lit(True))
        head = F.slice(ls, 1, F.greatest(F.when(op == "insert", s).otherwise(s - 1), F.lit(0)))
        tail_from = F.when(op == "insert", s + 1).otherwise(en + 1)
        tail = F.slice(ls, F.greatest(tail_from, F.lit(1)), F.greatest(n - tail_from + 1, F.lit(0)))
        edited = F.when(op == "delete", F.concat(head, tail)).otherwise(F.concat(head, new, tail))
        return F.struct(
            F.when(bad, ls).otherwise(edited).alias("lines"),
            F.coalesce(acc["error"], F.when(bad, F.format_string("edit %d is invalid", e["seq"]))).alias("error"),
            (acc["applied"] + F.when(bad, 0).otherwise(1)).alias("applied"),
        )

    batch = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "start_line", "end_line", "new_content"))).alias("edits"))
    start = F.struct(split_lines(F.col("content")).alias("lines"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("applied"))
    out = files.select("path", "content").join(batch, "path").withColumn("_done", F.aggregate("edits", start, step))
    return out.select(
        "path",
        F.col("_done.error").isNull().alias("success"),
        F.col("_done.error").alias("error"),
        F.col("_done.applied").alias("edits_applied"),
        F.array_join("_done.lines", "\n").alias("content"),
    )
