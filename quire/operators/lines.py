"""Line-range operators over whole files, one result row per file (or per chunk).

Every operator is a narrow projection over ``lines = split(content, '\\n', -1)``: no shuffle,
no Python. Parameters are columns so each file can carry its own request; plain Python values
are accepted too. A bad request never raises: it yields ``success = false`` and an ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.functions.text import lines as split_lines

ColumnOrValue = Column | int | str | None


def _c(v: ColumnOrValue) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _new_lines(new_content: ColumnOrValue) -> Column:
    # a string request is split on '\n' ('' is one empty line)
    return split_lines(_c(new_content))


def line_chunks(
    df: DataFrame,
    content_col: str = "content",
    chunk_size: ColumnOrValue = 50,
    start_line: ColumnOrValue = 1,
    end_line: ColumnOrValue = None,
    keep: tuple[str, ...] = ("path",),
) -> DataFrame:
    """Read a line range in chunks of ``chunk_size`` lines.

    end = min(end or total, total); start = max(1, start); start > total -> error;
    end < start -> success with no chunk (one row, chunk columns NULL). A negative end counts
    as end < start.
    """
    df = df.withColumn("_lines", split_lines(F.col(content_col)))  # split once, used below
    lines = F.col("_lines")
    total = F.size(lines)
    size = _c(chunk_size).cast("int")
    req_end = _c(end_line).cast("int")
    end = F.when(req_end.isNull() | (req_end == 0), total).otherwise(F.least(req_end, total))
    start = F.greatest(F.lit(1), _c(start_line).cast("int"))
    n_req = F.greatest(end - start + 1, F.lit(0))
    error = (
        F.when(size.isNull() | (size < 1), F.lit("chunk size must be at least 1"))
        .when(start > total, F.format_string("start line %d is past the last line %d", start, total))
    )
    offsets = F.when(error.isNull() & (n_req > 0), F.sequence(F.lit(0), n_req - 1, size))

    def chunk_list(ls: Column) -> Column:
        # ``ls`` is the line array bound once per row (see ``let``)
        return F.transform(
            offsets,
            lambda i: F.struct(
                (i / size).cast("int").alias("chunk_index"),
                (start + i).alias("start_line"),
                F.least(start + i + F.least(size, n_req - i) - 1, end).alias("end_line"),
                F.array_join(F.slice(ls, start + i, F.least(size, n_req - i)), "\n").alias("content"),
                F.least(size, n_req - i).alias("line_count"),
            ),
        )

    chunks = let(lines, chunk_list)
    out = df.select(
        *keep,
        error.isNull().alias("success"),
        error.alias("error"),
        total.alias("total_lines"),
        F.explode_outer(chunks).alias("c"),
    )
    return out.select(*keep, "success", "error", "total_lines", "c.*")


def _range_error(start: Column, end: Column, total: Column) -> Column:
    return F.when(
        start.isNull() | (start < 1) | (start > total),
        F.format_string("invalid start line: %d (total lines: %d)", start, total),
    ).when(end.isNull() | (end < start) | (end > total), F.format_string("invalid end line: %d", end))


def _result(df: DataFrame, keep, error: Column, new_lines: Column, lines: Column, extra: list[Column]) -> DataFrame:
    ok = error.isNull()
    staged = df.select(*keep, ok.alias("success"), error.alias("error"), *extra, F.when(ok, new_lines).alias("_res"))
    res = F.col("_res")
    extra_names = [c for c in staged.columns if c not in (*keep, "success", "error", "_res")]
    return staged.select(
        *keep,
        "success",
        "error",
        *extra_names,
        F.when(res.isNotNull(), F.size(res)).alias("total_lines"),
        F.array_join(res, "\n").alias("new_content"),
    ).withColumn("file_hash", F.md5("new_content"))


def replace_lines(
    df: DataFrame,
    start_line: ColumnOrValue,
    end_line: ColumnOrValue,
    new_content: ColumnOrValue,
    content_col: str = "content",
    keep: tuple[str, ...] = ("path",),
) -> DataFrame:
    """Replace the inclusive 1-based range [start, end] by ``new_content`` split on '\\n'."""
    df = df.withColumn("_lines", split_lines(F.col(content_col)))
    lines = F.col("_lines")
    total = F.size(lines)
    s, e = _c(start_line).cast("int"), _c(end_line).cast("int")
    new = _new_lines(new_content)
    error = _range_error(s, e, total)
    result = F.concat(F.slice(lines, 1, F.greatest(s - 1, F.lit(0))), new, F.slice(lines, F.greatest(e + 1, F.lit(1)), F.greatest(total - e, F.lit(0))))
    extra = [F.when(error.isNull(), e - s + 1).alias("replaced_lines"), F.when(error.isNull(), F.size(new)).alias("new_lines")]
    return _result(df, keep, error, result, lines, extra)


def delete_lines(
    df: DataFrame,
    start_line: ColumnOrValue,
    end_line: ColumnOrValue,
    content_col: str = "content",
    keep: tuple[str, ...] = ("path",),
) -> DataFrame:
    """Delete the inclusive range; deleting every line leaves empty content."""
    df = df.withColumn("_lines", split_lines(F.col(content_col)))
    lines = F.col("_lines")
    total = F.size(lines)
    s, e = _c(start_line).cast("int"), _c(end_line).cast("int")
    error = _range_error(s, e, total)
    result = F.concat(F.slice(lines, 1, F.greatest(s - 1, F.lit(0))), F.slice(lines, F.greatest(e + 1, F.lit(1)), F.greatest(total - e, F.lit(0))))
    extra = [F.when(error.isNull(), e - s + 1).alias("deleted_lines")]
    return _result(df, keep, error, result, lines, extra)


def insert_lines(
    df: DataFrame,
    after_line: ColumnOrValue,
    new_content: ColumnOrValue,
    content_col: str = "content",
    keep: tuple[str, ...] = ("path",),
) -> DataFrame:
    """Insert after line k (0 = top, total = bottom)."""
    df = df.withColumn("_lines", split_lines(F.col(content_col)))
    lines = F.col("_lines")
    total = F.size(lines)
    k = _c(after_line).cast("int")
    new = _new_lines(new_content)
    error = F.when(k.isNull() | (k < 0) | (k > total), F.format_string("invalid insert position: %d", k))
    result = F.concat(F.slice(lines, 1, F.greatest(k, F.lit(0))), new, F.slice(lines, F.greatest(k + 1, F.lit(1)), F.greatest(total - k, F.lit(0))))
    extra = [F.when(error.isNull(), F.size(new)).alias("inserted_lines")]
    return _result(df, keep, error, result, lines, extra)
