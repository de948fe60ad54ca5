"""Document fingerprints: a Merkle tree over paragraphs and sections. DataFrame operations only.

The tree has four levels. *Pieces* lie in paragraphs: a paragraph of at most ``LONG`` characters is
one piece, a longer one is cut where its own words say so (after a unit whose hash is 0 modulo
``CUT``; a unit is a word with the blank after it, a character of a script without spaces, or 64
characters of neither; no piece has more than ``UNITS`` units). A piece is a 48-bit code: 36 bits
of its hash and 12 bits of its length, which the bounds keep below 4,096. *Paragraphs* end after a
line feed or the space after a closing mark; their node hashes the paragraph and its pieces.
*Sections* end after a paragraph whose node is 0 modulo ``SECTION``, so an insertion changes its own
section only; their node hashes their paragraphs' nodes in order. The *root* is the SHA-256 of all
section nodes and the text's length.

The fingerprint is the string ``root:sections:pieces`` in hexadecimal. Roots test equality. The
likeness of two fingerprints needs nothing but the two strings (``string_likeness``): the share of
characters in pieces common to both, repeated pieces as often as both have them (Dice), 1 for equal
roots. Edits are located from the top: the sections that differ between the common first and last
ones, in them the paragraphs between the common first and last ones, of those the ones that the
other tree lacks there; where nothing is new (a deletion, a move) the first place that differs.

The next document in ascending id order comes from a window over ranges of (id, hash of the text),
not over the whole table; the first document of a range is also dealt to the range before it, so
the text crosses one exchange once. Ids that fill a range by themselves, and null ids, are cut
into ranges of the hash.

Defined cases: null text is empty; an empty text is one empty paragraph; rows sharing an id follow
one another in order of their texts' hash, then text; null ids come last; the last document is
followed by the first, a single one by itself; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common as C

#: One paragraph in SECTION ends a section, one unit in CUT ends a piece.
SECTION, CUT = 8, 4
#: Characters of a paragraph that stays one piece; units of the longest piece (of 64 characters each).
LONG, UNITS = 64, 63
#: A paragraph: all up to a line feed, the space that follows a closing mark, or the end.
PARAGRAPH = r"(?s).*?(?:\n|[.!?;|] |\z)"
#: White space and the blocks of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
UNIT_ENDS = r"\s\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: A unit: up to 63 characters that end none, and one more.
UNIT = f"(?s)[^{UNIT_ENDS}]{{0,63}}."
#: The parts of a piece's code, and the hexadecimal digits that it takes.
_LENGTH, _HASH, _DIGITS = 0xFFF, 0xFFFFFFFFF000, 12


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code(length: Column, *values: Column) -> Column:
    return F.xxhash64(*values).bitwiseAND(F.lit(_HASH)).bitwiseOR(length)


def _piece(text: Column) -> Column:
    return _code(F.char_length(text).cast("long"), text)


def _up_to(n: Column) -> Column:
    """0 .. n - 1, nothing for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _ends(starts: Column, n: Column) -> Column:
    """Where runs end that start at ``starts`` and fill ``n`` places."""
    return F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))


def paragraphs(text: Column) -> Column:
    """array<string>; concatenated they are the text."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    # the pattern's last match is the empty one at the end of a text that is not empty
    return _bound(found, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))))


def pieces(paragraph: Column) -> Column:
    """array<bigint>: codes of a paragraph's pieces."""

    def joined(units: Column, start: Column, end: Column) -> Column:
        run = lambda i, n: _piece(F.array_join(F.slice(units, i + 1, n), ""))
        cut = lambda: F.transform(F.sequence(start, end - 1, F.lit(UNITS)), lambda i: run(i, F.least(F.lit(UNITS), end - i)))
        return F.when(end - start <= UNITS, F.array(run(start, end - start))).otherwise(cut())

    def cut(units: Column) -> Column:
        ends_before = lambda i: (i == 0) | (F.pmod(F.xxhash64(F.get(units, i - 1)), F.lit(CUT)) == 0)
        starts = F.filter(F.sequence(F.lit(0), F.size(units) - 1), ends_before)
        return _bound(starts, lambda s: F.flatten(F.zip_with(s, _ends(s, F.size(units)), lambda a, b: joined(units, a, b))))

    units = F.regexp_extract_all(paragraph, F.lit(UNIT), F.lit(0))
    return F.when(F.char_length(paragraph) <= LONG, F.array(_piece(paragraph))).otherwise(_bound(units, cut))


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with the leaves (nodes of paragraphs) and pieces of its column ``text``, array<bigint> each."""
    df = df.withColumn("_paragraphs", paragraphs(F.col(text)))
    df = df.withColumn("_nested", F.transform("_paragraphs", pieces))
    leaves = F.zip_with("_paragraphs", "_nested", lambda p, c: F.xxhash64(p, c))
    return df.withColumns({f"{prefix}leaves": leaves, f"{prefix}pieces": F.flatten("_nested")}).drop("_paragraphs", "_nested")


def section_starts(leaf: Column) -> Column:
    """array<int>: positions of the paragraphs that begin a section."""
    return F.filter(F.sequence(F.lit(0), F.size(leaf) - 1), lambda i: (i == 0) | (F.pmod(F.get(leaf, i - 1), F.lit(SECTION)) == 0))


def sections(leaf: Column, starts: Column) -> Column:
    """array<bigint>: nodes of the sections."""
    return F.zip_with(starts, _ends(starts, F.size(leaf)), lambda a, b: F.xxhash64(F.slice(leaf, a + 1, b - a)))


def fingerprint(section: Column, piece: Column, n_chars: Column) -> Column:
    """``root:sections:pieces`` in hexadecimal, 64 digits, 16 a section, 12 a piece."""
    digits = lambda a, n: F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), n, "0")), ""))
    build = lambda nodes: F.concat_ws(":", F.sha2(F.concat_ws(":", n_chars.cast("string"), nodes), 256), nodes, digits(piece, _DIGITS))
    return _bound(digits(section, 16), build)


def counted(piece: Column) -> Column:
    """The pieces as a set: the second and later ones of equal pieces get codes of their own."""

    def numbered(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        again = lambda v, k: F.when(k == 0, v).otherwise(_code(v.bitwiseAND(F.lit(_LENGTH)), v, k))
        run = lambda a, b: F.transform(F.sequence(F.lit(0), b - a - 1), lambda k: again(F.get(s, a), k))
        return _bound(starts, lambda st: F.flatten(F.zip_with(st, _ends(st, F.size(s)), run)))

    return F.when(F.size(F.array_distinct(piece)) == F.size(piece), piece).otherwise(_bound(F.sort_array(piece), numbered))


def _length(piece: Column) -> Column:
    return F.aggregate(piece, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(_LENGTH)))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of two trees' counted pieces; ``same``: their roots are equal."""
    total = _length(a) + _length(b)
    shared = 2.0 * _length(F.array_intersect(a, b))
    return F.when(same, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(shared / total)


def string_likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from the two strings alone."""

    def parsed(fp: Column) -> Column:
        code = lambda h, i: F.conv(F.substring(h, i * _DIGITS + 1, F.lit(_DIGITS)), 16, 10).cast("long")
        whole = _bound(F.split_part(fp, F.lit(":"), F.lit(3)), lambda h: F.transform(_up_to((F.char_length(h) / _DIGITS).cast("int")), lambda i: code(h, i)))
        return counted(whole)

    root = lambda fp: F.split_part(fp, F.lit(":"), F.lit(1))
    return likeness(parsed(a), parsed(b), root(a) == root(b))


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common start of two arrays."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return _bound(at, lambda p: F.when(p == 0, F.size(a)).otherwise(p - 1))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of b's paragraphs that are not in a, or where a's differ otherwise. Of two
    structs of leaves, starts and nodes."""

    def middle(x: Column, y: Column, body) -> Column:
        """``body(start, end of x, end of y)`` of what lies between the common first and last elements."""

        def rest(p: Column) -> Column:
            tail = F.least(_common(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - p)
            return _bound(tail, lambda s: body(p, F.size(x) - s, F.size(y) - s))

        return _bound(_common(x, y), rest)

    def leaves_of(tree: Column, start: Column, end: Column) -> Column:
        at = lambda i: F.coalesce(F.get(tree["starts"], i), F.size(tree["leaves"]))
        return F.slice(tree["leaves"], at(start) + 1, at(end) - at(start))

    def located(x: Column, y: Column, first: Column) -> Column:
        def new(p: Column, end_x: Column, end_y: Column) -> Column:
            old = F.slice(x, p + 1, end_x - p)
            fresh = _bound(old, lambda o: F.filter(F.transform(_up_to(end_y - p), lambda i: i + p), lambda i: ~F.array_contains(o, F.get(y, i))))
            place = F.least(first + p, F.size(b["leaves"]) - 1)
            return _bound(fresh, lambda f: F.when(F.size(f) > 0, F.transform(f, lambda i: first + i)).otherwise(F.array(place)))

        return middle(x, y, new)

    def inside(p: Column, end_a: Column, end_b: Column) -> Column:
        first = F.coalesce(F.get(b["starts"], p), F.size(b["leaves"]))
        return _bound(leaves_of(a, p, end_a), lambda x: _bound(leaves_of(b, p, end_b), lambda y: located(x, y, first)))

    return F.when(a["leaves"] == b["leaves"], F.array().cast("array<int>")).otherwise(middle(a["nodes"], b["nodes"], inside))


def _ranges(rows: DataFrame, parts: int) -> tuple[Column, int]:
    """The range, an ascending long, that a row's (id, hash) falls in: about ``parts`` ranges of equal
    size. An id that several quantiles name, and the null ids, are as many ranges of the hash."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    r = rows.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 20 * parts))).alias("q"), F.count(F.lit(1)).alias("n"), F.count("id").alias("known")).first()
    quantiles = [int(x) for x in r["q"] or []]
    bounds = sorted(set(quantiles))
    hot = {b: quantiles.count(b) for b in bounds if quantiles.count(b) > 1}
    nulls = max(1, -(-(r["n"] - r["known"]) * parts // max(r["n"], 1)))
    step = 64  # the bounds are searched in two steps
    longs = lambda x: F.lit(x).cast("array<bigint>") if x else F.array().cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("id")))
    coarse = F.greatest(below(longs(bounds[::step])) - 1, F.lit(0)) * step
    position = coarse + below(F.slice(longs(bounds), coarse + 1, F.lit(step)))
    split = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv]), F.col("id")) if hot else F.lit(None).cast("long")
    part = lambda n: F.least(F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * n), n - 1)
    width = parts + 2
    known = position * F.lit(width).cast("long") + F.coalesce(part(split), F.lit(width - 1).cast("long"))
    null = F.lit((len(bounds) + 1) * width).cast("long") + part(F.lit(nulls).cast("long"))
    return F.when(F.col("id").isNull(), null).otherwise(known)


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, leaves, pieces, counted and next_text, next_counted in ascending order of ids."""
    spark = docs.sparkSession
    parts = C.shuffle_partitions(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("block", _ranges(rows, 4 * parts))
    # each range's first (id, hash), a row a range; its document is also the sentinel that ends the range before
    firsts = rows.groupBy("block").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash")).alias("k")).select("block", "k.id", "k.hash").orderBy("block").collect()
    if not firsts:
        out = with_tree(rows.select("id", "text"), "text").withColumn("counted", counted(F.col("pieces")))
        return out.withColumns({"next_text": F.col("text"), "next_counted": F.col("counted")})
    number = lambda x: "CAST(NULL AS BIGINT)" if x is None else f"CAST('{x}' AS BIGINT)"
    values = ", ".join(f"({number(f['block'])}, {number(firsts[i - 1]['block'])}, {number(f['id'])}, {number(f['hash'])})" for i, f in enumerate(firsts))
    first = spark.sql(f"SELECT * FROM VALUES {values} AS t(at, before, first_id, first_hash)")
    is_first = (F.col("block") == F.col("at")) & (F.col("hash") == F.col("first_hash")) & F.col("id").eqNullSafe(F.col("first_id"))
    sentinel = rows.join(first, is_first).groupBy("before").agg(F.min("text").alias("text"))
    sentinel = sentinel.select(F.lit(None).cast("long").alias("id"), "text", F.lit(None).cast("long").alias("hash"), F.col("before").alias("block"), F.lit(True).alias("sentinel"))
    dealt = rows.withColumn("sentinel", F.lit(False)).unionByName(sentinel).repartition(parts, "block")
    dealt = with_tree(dealt, "text").withColumn("counted", counted(F.col("pieces")))
    ahead = Window.partitionBy("block").orderBy("sentinel", F.col("id").asc_nulls_last(), "hash", "text")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in ("text", "counted")})
    return out.filter(~F.col("sentinel")).drop("block", "hash", "sentinel")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the text whose last quarter is replaced by the next document's
    first characters), fingerprint, edited_fingerprint, near_edited, near_next, changed."""
    rows = _with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = with_tree(rows, "edited", "edited_").withColumn("edited_counted", counted(F.col("edited_pieces")))
    rows = rows.withColumns({"starts": section_starts(F.col("leaves")), "edited_starts": section_starts(F.col("edited_leaves"))})
    rows = rows.withColumns({"nodes": sections(F.col("leaves"), F.col("starts")), "edited_nodes": sections(F.col("edited_leaves"), F.col("edited_starts"))})
    rows = rows.withColumns({
        "fingerprint": fingerprint(F.col("nodes"), F.col("pieces"), F.col("n_chars")),
        "edited_fingerprint": fingerprint(F.col("edited_nodes"), F.col("edited_pieces"), F.char_length("edited").cast("long")),
    })
    tree = lambda p: F.struct(F.col(f"{p}leaves").alias("leaves"), F.col(f"{p}starts").alias("starts"), F.col(f"{p}nodes").alias("nodes"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("counted"), F.col("edited_counted"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("counted"), F.col("next_counted"), F.col("text") == F.col("next_text")).alias("near_next"),
        _bound(tree(""), lambda a: _bound(tree("edited_"), lambda b: changed_paragraphs(a, b))).alias("changed"),
    )
