"""One registered query per operator, with production parameters, over the
whole of its tables. Each derives its contract's columns from the operator's
own output; ``ORACLES`` holds DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, fertility, hard_negatives, language, license_scan, line_align, mixing, personal_data, quality_classifier,
    sharding, simhash, substring_dedup, vector_codes,
)
from .common import documents
from .vectors import embeddings


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and tokeniser-fertility verdicts of every document."""
    return fertility.fertility_rules(documents(spark, sf_dir).select("doc_id", "text"), name="f").select("doc_id", "f.*")


def op2_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data.personal_data(documents(spark, sf_dir).select("doc_id", "text"), name="p")
    base = F.filter("p.spans", lambda s: s["base"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in personal_data.BASE_KINDS],
                        hex_sha256(joined(base)).alias("base_sha256"), joined(F.col("p.spans")).alias("spans"))


def op4_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark, name="h")
    return found.select(
        "doc_id", "h.n_words", decontamination.covered_words("h.spans").alias("n_hit"),
        F.size("h.items").cast("long").alias("n_items"),
        hex_sha256(F.concat_ws(",", "h.items")).alias("items_sha256"),
        decontamination.contaminated("h").alias("contaminated"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.mix(documents(spark, sf_dir))


def op6_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(documents(spark, sf_dir))


def op7_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line blocks that an earlier one has."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    done = line_align.deduplicate_lines(docs, name="a")
    return done.select("doc_id", "a.n_lines", "a.n_removed", hex_sha256(F.col("a.text")).alias("kept_sha256"))


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    done = substring_dedup.drop_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places, labels and confidence of every document."""
    return license_scan.scan(documents(spark, sf_dir))


def op11_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document after a uniform shuffle."""
    placed = sharding.shard_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"], name="p")
    utf8 = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    return placed.select("doc_id", (F.octet_length(utf8) + F.lit(1).cast("long")).alias("size"), F.crc32(utf8).alias("text_crc32"),
                         F.lit("rows").alias("law"), "p.shard", "p.slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector under the trained codebooks."""
    return vector_codes.vector_codes(embeddings(spark, sf_dir))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives."""
    return hard_negatives.mine(embeddings(spark, sf_dir)).drop("negative_label")


QUERIES = {
    "op1_fertility_rules": op1_fertility_rules,
    "op2_simhash_multi_index": op2_simhash_multi_index,
    "op3_skip_chain_crf": op3_skip_chain_crf,
    "op4_prefix_set_join": op4_prefix_set_join,
    "op5_systematic_mix": op5_systematic_mix,
    "op6_language_hierarchy": op6_language_hierarchy,
    "op7_patience_lines": op7_patience_lines,
    "op8_random_indexing_quality": op8_random_indexing_quality,
    "op9_fm_index_dedup": op9_fm_index_dedup,
    "op10_license_rules": op10_license_rules,
    "op11_hypergeometric_shards": op11_hypergeometric_shards,
    "op12_dictionary_codes": op12_dictionary_codes,
    "op13_bond_negatives": op13_bond_negatives,
}

ORACLES = {
    "op4_prefix_set_join": decontamination.ORACLE,
    "op5_systematic_mix": mixing.ORACLE.format(docs="documents"),
    "op12_dictionary_codes": vector_codes.ORACLE,
    "op13_bond_negatives": hard_negatives.ORACLE,
}
