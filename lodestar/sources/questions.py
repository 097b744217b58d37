"""Question folders: ``{"questions": [...]}`` JSON files.

Only ``*.json`` files are read; a file that does not parse, or whose
``questions`` is not a list of objects, contributes nothing. Questions of
all files are concatenated (duplicates kept); ``seq`` orders them by file
name, then position in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .files import empty, path_exists

# Each question is read as its JSON text, so that no field is lost; the known
# ones are then taken from it.
FILE_SCHEMA = "questions array<string>"
QUESTION_SCHEMA = "id string, type string, body string, documents array<string>"
SCAN_SCHEMA = ("file_name string, pos int, seq bigint, id string, type string, body string, documents array<string>, "
               "raw string")


def question_type(body):
    """A type label derived from the text (the driver tables carry none)."""
    return (F.when(body.endswith("?"), F.lit("factoid")).when(F.char_length(body) < 120, F.lit("yesno"))
            .otherwise(F.lit("summary")))


def write_question_files(questions: DataFrame, path: str, per_file: int = 1000) -> None:
    """One JSON document per group of ``per_file`` consecutive ``seq`` values.

    ``questions(id, seq, body[, type][, documents])``; groups are bounded by
    ``per_file``, each becomes one file under ``grp=<n>/``.
    """
    q = questions
    if "type" not in q.columns:
        q = q.withColumn("type", question_type(F.col("body")))
    if "documents" not in q.columns:
        q = q.withColumn("documents", F.lit(None).cast("array<string>"))
    item = F.struct(F.col("id").cast("string").alias("id"), "type", "body", "documents")
    grouped = (q.groupBy(F.floor(F.col("seq") / per_file).alias("grp"))
               .agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("q")))).alias("qs")))
    out = grouped.select("grp", F.transform("qs", lambda s: s["q"]).alias("questions"))
    out.write.mode("overwrite").partitionBy("grp").json(path)


def scan_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, pos, seq, id, type, body, documents, raw)``.

    ``seq`` counts all questions from 0, by file name, then place in the file;
    a missing id becomes ``unknown_<n>`` (n = 1-based count). ``raw`` is the
    question's JSON object with every field it came with."""
    if not path_exists(spark, path):
        return empty(spark, SCAN_SCHEMA)
    raw = (spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path))
    rows = raw.select(F.col("_metadata.file_path").alias("file_name"),
                      F.posexplode("questions").alias("pos", "raw"))
    rows = rows.filter(F.col("raw").startswith("{")).withColumn("q", F.from_json("raw", QUESTION_SCHEMA))
    counts = rows.groupBy("file_name").agg((F.max("pos") + 1).alias("n"))
    # questions before each file: files are numbered in ranges of names, then one row per range
    # is summed up (two levels, no task sees all files); the ranges are written, so both levels read the same cut
    counts = materialize(counts.repartitionByRange("file_name").withColumn("part", F.spark_partition_id()), "file_counts")
    inside = Window.partitionBy("part").orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    offsets = (counts.withColumn("low", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
               .select("file_name", (F.col("low") + F.col("base")).alias("before")))
    rows = rows.join(offsets, "file_name")
    seq = F.col("before") + F.col("pos")
    return rows.select("file_name", F.col("pos").cast("int").alias("pos"), seq.alias("seq"),
                       F.coalesce(F.col("q.id"), F.concat(F.lit("unknown_"), (seq + 1).cast("string"))).alias("id"),
                       "q.type", "q.body", "q.documents", "raw")


def question_limit(questions: DataFrame, n: int) -> DataFrame:
    """The first ``n`` questions in ``seq`` order (a per-partition top-n, then a merge)."""
    return questions.orderBy("seq").limit(n)
