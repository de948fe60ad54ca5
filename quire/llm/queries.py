"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_count, common, entropy_mix, host_reputation, inverted_multi_index, language_id, lexical_pack, merkle, ngram_join, phrase_mining, source_divergence, sql, substring_dedup, toxicity, wavelet
from quire.plans.registry import table

QUERIES = {}
ORACLE = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f

    return add


@_query("op1_ngram_jaccard_join", sql.NGRAM_JOIN)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op2_inverted_multi_index")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = inverted_multi_index.InvertedMultiIndex(table(spark, sf_dir, "embeddings"))
    return index.search(F.col("id") % 100 == 0, k=10)


@_query("op3_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


@_query("op4_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    slim = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    mixed = entropy_mix.mix_sources(slim, size_col="size")
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "copies")


@_query("op5_lexical_packing")
def lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lexical_pack.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op6_language_id")
def documents_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = language_id.identify(docs, language_id.fit(docs), F.col("text"), F.col("lang"), F.lit(None), F.col("source"))
    return out.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "rejected")


@_query("pages_language_id")
def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text, html, url = F.regexp_replace("html", "<[^>]*>", " "), F.col("html"), F.col("url")
    out = language_id.identify(pages, language_id.fit(table(spark, sf_dir, "documents")), text, language_id.markup_language(html), language_id.address_language(url), host_reputation.host_and_path(url)[0])
    return out.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "rejected")


@_query("op7_substring_dedup", sql.SUBSTRING_DEDUP)
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op8_wavelet_output")
def wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "wavelet")
    manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_shards(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query("op10_url_filter", sql.URL_FILTER)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "labelled", "bad")


@_query("op11_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


@_query("op12_source_divergence", sql.SOURCE_DIVERGENCE)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@_query("op13_phrase_mining", sql.PHRASE_MINING)
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
