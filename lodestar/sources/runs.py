"""Result and metric files of runs.

A run's results are one document ``{"questions": [...]}`` named
``{TYPE}_results_{ranker}_{mode}_{ts}.json``, its metrics one document
``{"questions": [...], keywords_stract, Ranked, Query_ranked, metrics}`` named
``{TYPE}_metrics_{ranker}_{mode}_{ts}.json``. No task holds a run: tasks write ranges of a run's
questions, one per line, and a commit step joins the parts of each run, streaming them
through the file system, and renames the whole file into its place. Until then a reader finds nothing.

The same as tables, for further queries: JSON Lines, one question per line, partitioned by run
(``write_results``, ``scan_results``; ``write_metrics``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators.evaluation import METRIC_LABELS, METRICS
from ..session import materialize, scratch_path
from .files import empty, join_files, path_exists

METRIC_STRUCT = "struct<" + ", ".join(f"`{METRIC_LABELS[m]}`: double" for m in METRICS) + ">"
METRIC_FILE_SCHEMA = f"keywords_stract string, Ranked string, Query_ranked string, metrics {METRIC_STRUCT}"
METRIC_NAME_RE = r"(?:^|/)(?:file_name=)?((?:TRAIN|TEST)_metrics[^/]*\.json)(?:/|$)"
RESULT_SCHEMA = ("id string, type string, body string, documents array<string>, snippets array<struct<"
                 "document: string, text: string, beginSection: string, endSection: string, "
                 "offsetInBeginSection: int, offsetInEndSection: int, rerank_score: double, rerank_position: int>>")


def mode_key(mode: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", mode).strip("_")


def metric_struct(prefix: str = "") -> F.Column:
    return F.struct(*[F.col(prefix + m).cast("double").alias(METRIC_LABELS[m]) for m in METRICS])


def write_results(results: DataFrame, path: str, eval_type: str, run_ts: str) -> None:
    """``results(ranker, mode, id, ..., documents, snippets)`` as JSON Lines."""
    (results.withColumn("id", F.col("id").cast("string"))
     .withColumn("eval_type", F.lit(eval_type)).withColumn("run_ts", F.lit(run_ts))
     .withColumnRenamed("ranker", "reranker")
     .write.mode("overwrite").partitionBy("eval_type", "reranker", "mode", "run_ts").json(path))


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return empty(spark, RESULT_SCHEMA + ", seq bigint, eval_type string, reranker string, mode string, run_ts string")
    return spark.read.schema(RESULT_SCHEMA + ", seq bigint").json(path)


def scan_result_files(spark: SparkSession, path: str) -> DataFrame:
    """Result documents ``{"questions": [...]}`` (one per file, over any number
    of lines): ``(file_name, id, type, body, documents, snippets, seq)``."""
    if not path_exists(spark, path):
        return empty(spark, "file_name string, " + RESULT_SCHEMA + ", seq bigint")
    question = "struct<" + RESULT_SCHEMA.replace("id string, type string, body string, documents array<string>, snippets ",
                                                 "id: string, type: string, body: string, documents: array<string>, snippets: ") + ", seq: bigint>"
    raw = (spark.read.schema(f"questions array<{question}>").option("multiLine", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").json(path))
    return raw.select(F.col("_metadata.file_path").alias("file_name"), F.explode("questions").alias("q")).select("file_name", "q.*")


def file_name_of(kind: str, eval_type: str, run_ts: str) -> F.Column:
    """The name of a run's file, from its columns ``ranker`` and ``mode``."""
    return F.concat(F.lit(f"{eval_type}_{kind}_"), F.regexp_replace("ranker", "[^A-Za-z0-9]+", ""),
                    F.lit("_"), F.regexp_replace("mode", "[^A-Za-z0-9]+", "_"), F.lit(f"_{run_ts}.json"))


def write_documents(items: DataFrame, runs: DataFrame, path: str) -> None:
    """``items(file_name, seq, id, value)`` (JSON texts) and ``runs(file_name, head, tail)``, one row per
    file -> a file of each name under ``path``: head, the items in order of ``seq`` with commas, tail.

    Files are few (the runs of an experiment); items are many and stay in the tasks."""
    spark = items.sparkSession
    frames = runs.orderBy("file_name").collect()
    items = materialize(items.select("file_name", "seq", "id", "value"), "document_items")
    first = items.groupBy("file_name").agg(F.min(F.struct("seq", "id", "value")).alias("first"))
    number = F.array_position(F.array(*[F.lit(r["file_name"]) for r in frames]), F.col("file_name"))
    comma = F.when(F.struct("seq", "id", "value") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    staging = scratch_path(spark, "document_parts")
    (items.join(F.broadcast(first), "file_name").withColumn("run", number)
     .repartitionByRange("run", "seq", "id", "value").sortWithinPartitions("run", "seq", "id", "value")
     .select("run", F.concat(comma, F.col("value")).alias("value"))
     .write.mode("overwrite").partitionBy("run").text(staging))
    for n, r in enumerate(frames, 1):
        join_files(spark, f"{staging}/run={n}", f"{path.rstrip('/')}/{r['file_name']}", r["head"], r["tail"])


def write_result_documents(results: DataFrame, path: str, eval_type: str, run_ts: str) -> None:
    """``results(ranker, mode, id, seq, ..., documents, snippets)`` -> one ``{"questions": [...]}`` file per run."""
    fields = [c for c in results.columns if c not in ("ranker", "mode", "id")]
    value = F.to_json(F.struct(F.col("id").cast("string").alias("id"), *fields))
    named = results.withColumn("file_name", file_name_of("results", eval_type, run_ts))
    items = materialize(named.select("file_name", "seq", F.col("id").cast("string").alias("id"), value.alias("value")), "result_items")
    runs = items.select("file_name").distinct().select("file_name", F.lit('{"questions": [\n').alias("head"), F.lit("]}\n").alias("tail"))
    write_documents(items, runs, path)


def write_metric_documents(per_question: DataFrame | None, macro: DataFrame, path: str, eval_type: str, run_ts: str) -> None:
    """``per_question(ranker, mode, id, seq, metrics...)`` (if any) and ``macro(ranker, mode, metrics...)`` -> one
    file per run with its per-question array, labels and macro metrics."""
    name = file_name_of("metrics", eval_type, run_ts).alias("file_name")
    labels = F.to_json(F.struct(F.lit(C.METRIC_FILE_EXTRACTOR).alias("keywords_stract"), F.col("ranker").alias("Ranked"),
                                F.col("mode").alias("Query_ranked"), metric_struct().alias("metrics")))
    runs = macro.select(name, F.lit('{"questions": [\n').alias("head"), F.concat(F.lit("], "), F.substring(labels, 2, 1 << 30), F.lit("\n")).alias("tail"))
    if per_question is None:
        items = empty(macro.sparkSession, "file_name string, seq bigint, id string, value string")
    else:
        value = F.to_json(F.struct(F.col("id").cast("string").alias("id"), *[F.col(m).cast("double").alias(METRIC_LABELS[m]) for m in METRICS]))
        items = per_question.select(name, "seq", F.col("id").cast("string").alias("id"), value.alias("value"))
    write_documents(items, runs, path)


def scan_metric_questions(spark: SparkSession, path: str) -> DataFrame:
    """The per-question arrays of metric files: ``(file_name, pos, id, s10 ... ndcg10)``."""
    if not path_exists(spark, path):
        return empty(spark, "file_name string, pos int, id string, " + ", ".join(f"{m} double" for m in METRICS))
    question = "struct<id: string, " + ", ".join(f"`{METRIC_LABELS[m]}`: double" for m in METRICS) + ">"
    raw = (spark.read.schema(f"questions array<{question}>").option("multiLine", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").json(path))
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), METRIC_NAME_RE, 1).alias("file_name"),
                      F.posexplode("questions").alias("pos", "q"))
    return (rows.filter((F.col("file_name") != "") & F.col("q").isNotNull())
            .select("file_name", "pos", "q.id", *[F.col("q")[METRIC_LABELS[m]].alias(m) for m in METRICS]))


def write_metrics(per_question: DataFrame | None, macro: DataFrame, path: str, eval_type: str, run_ts: str) -> None:
    """``per_question(ranker, mode, id, seq, metrics...)`` and
    ``macro(ranker, mode, metrics...)`` of each run."""
    summary = macro.select(file_name_of("metrics", eval_type, run_ts).alias("file_name"), F.lit(C.METRIC_FILE_EXTRACTOR).alias("keywords_stract"),
                           F.col("ranker").alias("Ranked"), F.col("mode").alias("Query_ranked"),
                           metric_struct().alias("metrics"))
    summary.write.mode("overwrite").partitionBy("file_name").json(path)
    if per_question is None:
        return
    rows = per_question.select("ranker", "mode", F.col("id").cast("string").alias("id"), "seq",
                               *[F.col(m).alias(METRIC_LABELS[m]) for m in METRICS])
    rows.write.mode("overwrite").partitionBy("ranker", "mode").json(path.rstrip("/") + "_questions")


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per metric file: ``(file_name, eval_type, reranker, query_type,
    s10 ... ndcg10)``. Names must start ``TRAIN_metrics``/``TEST_metrics`` and
    end ``.json``; ``Ranked``/``Query_ranked`` default to ``N/A``; files
    without a metrics object, or with an empty one, are skipped; the evaluation type is the prefix
    of the first file name."""
    cols = "file_name string, eval_type string, reranker string, query_type string, " + \
        ", ".join(f"{m} double" for m in METRICS)
    if not path_exists(spark, path):
        return empty(spark, cols)
    raw = (spark.read.schema(METRIC_FILE_SCHEMA).option("recursiveFileLookup", True).option("multiLine", True)
           .option("pathGlobFilter", "*.json").json(path))
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), METRIC_NAME_RE, 1).alias("file_name"),
                      "Ranked", "Query_ranked", "metrics")
    some = F.coalesce(*[F.col("metrics")[METRIC_LABELS[m]] for m in METRICS]).isNotNull()
    rows = rows.filter((F.col("file_name") != "") & some)
    # evaluation type from the first file name (a scalar subquery, no collect)
    first_name = rows.select(F.min("file_name")).scalar()
    return rows.select("file_name",
                       F.when(first_name.startswith("TRAIN_"), "TRAIN").when(first_name.startswith("TEST_"), "TEST")
                       .otherwise("UNKNOWN").alias("eval_type"),
                       F.coalesce("Ranked", F.lit("N/A")).alias("reranker"),
                       F.coalesce("Query_ranked", F.lit("N/A")).alias("query_type"),
                       *[F.col("metrics")[METRIC_LABELS[m]].alias(m) for m in METRICS])
