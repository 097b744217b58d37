"""A training corpus from raw documents in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next stage's
documents. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, fertility, line_align, mixing, simhash
from lodestar.llm.common import documents, written

_MARK = "__stage"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and fertility rules. Null and empty texts fail; repeated rows are judged
    alike; rows are judged one by one, so there are no ties; no documents, no rows."""
    return fertility.fertility_rules(docs, name=_MARK).filter(F.col(f"{_MARK}.kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; a document of
    which no word is left goes, ``n_chars`` follows the text. Null texts stay as they are; rows with the same id and text
    are one document and stay repeated; equal ids are ordered by text hash, null ids come last; no documents, no rows."""
    done = line_align.deduplicate_lines(docs, name=_MARK)
    changed = F.col(f"{_MARK}.n_removed") > 0
    text = F.when(changed, F.col(f"{_MARK}.text")).otherwise(F.col("text"))
    done = done.filter(~changed | F.col(f"{_MARK}.text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(f"{_MARK}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(columns).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group. Null and empty texts are one group
    (fingerprint zero); of repeated rows, and of ties, one stays; no documents, no rows."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of. Null texts have no words and stay; repeated rows are
    judged alike; rows are judged one by one, so there are no ties; no documents or no benchmark, nothing goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, benchmark, name=_MARK)
    return found.filter(~decontamination.contaminated(_MARK)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it: its share (as ``mixing.mix``), how often the mix holds it, and
    its text. A null text has size 0 and is taken as nothing; repeated rows have shares of their own; ties are
    broken by a hash of the id; no documents, no rows. ``mixing.emit`` writes the copies out."""
    share = F.col(_MARK)
    return mixing.with_shares(docs, name=_MARK).select(
        "doc_id", share["size"].alias("size"), share["source_size"].alias("source_size"), share["target"].alias("target"),
        (share["copies"] * share["size"]).cast("long").alias("taken"), share["copies"].alias("copies"), "source", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

# The stages tokenise, hash with XXH64 and align: SQL cannot express them.
# tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
