"""A corpus pipeline over ``documents``: language ID, near-duplicates, repeated passages, source mix,
packing. Every stage reads what its predecessor wrote; all but the last return its columns.

Defined cases are those of the operators; besides, a near-duplicate group keeps its row with the
smallest id (null ids last, then by text hash) and rows equal in id and text count once, rows
without words are in no group and stay, a document that the passage stage empties goes, and a
document whose rate rounds to no copies goes.

Stages carry whole documents through Python workers, so they lower the session's
``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``BATCH_ROWS`` where it is higher.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, entropy_mix, language_id, lexical_pack, ngram_join, substring_dedup
from quire.plans.registry import table

#: Words in a shingle and the least similarity of near-duplicates, in per cent.
SHINGLE, SIMILAR = 5, 80
TOKENIZER = "word_bpe_49k.json"
BATCH_ROWS = common.BATCH_ROWS
#: Every stage has a brute-force or property test; the mix and the packing have no SQL.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _small_batches(stage):
    """The stage, planned and run with batches of at most BATCH_ROWS documents."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    model = language_id.fit(docs)
    out = language_id.identify(docs, model, F.col("text"), F.col("lang"), F.lit(None), F.col("source"))
    return out.filter(~F.col("rejected")).select(*_columns(docs))


@_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    found = ngram_join.jaccard_join(docs, width=SHINGLE, percent=SIMILAR)
    first = found.filter("class_id is not null").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    stay = first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    alone = found.filter("class_id is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows_of = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg((F.count(F.lit(1)) > 1).alias("again"))
    stay = stay.unionByName(alone).distinct().withColumnsRenamed({"_id": "id", "_hash": "hash"})
    stay = rows_of.join(stay, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left_semi")
    stay = common.stored(stay, "stay")
    # the documents travel in one struct, so no name of theirs can clash
    rows = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    kept = lambda keys: rows.join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    # only rows that are equal in id and text cross an exchange to be counted once
    kept = kept(stay.filter("not again")).unionByName(kept(stay.filter("again")).dropDuplicates(["id", "hash"]))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@_small_batches
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a smaller document's window already has."""
    out = substring_dedup.remove_repeats(docs).filter("n_removed = 0 or kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    own = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@_small_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = entropy_mix.mix_sources(docs).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    out = lexical_pack.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("source_mix", mixed),
    ("lexical_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
