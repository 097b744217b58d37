"""Background word table (``word;frequency`` CSV) and word associations
(``{key: {word: weight}}`` JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import empty, path_exists

WORD_REPR_TYPE = "map<string, map<string, bigint>>"


def write_unigram_csv(unigrams: DataFrame, path: str) -> None:
    """``word;freq`` lines without a header."""
    (unigrams.select("word", F.col("freq").cast("string").alias("freq"))
     .write.mode("overwrite").option("sep", ";").option("header", False).csv(path))


def scan_unigrams(spark: SparkSession, path: str) -> DataFrame:
    """``(word, freq)``: rows whose frequency is not numeric are dropped; a
    missing file gives an empty table (weirdness is then disabled)."""
    if not path_exists(spark, path):
        return empty(spark, "word string, freq double")
    raw = (spark.read.schema("word string, freq string").option("sep", ";").option("header", False)
           .option("mode", "PERMISSIVE").csv(path))
    return (raw.select("word", F.expr("try_cast(freq AS double)").alias("freq"))
            .filter(F.col("freq").isNotNull() & ~F.isnan("freq")))


PARTS = 256


def write_word_repr_json(word_repr: DataFrame, path: str, parts: int = PARTS) -> None:
    """``word_repr(key, word, weight)`` as JSON objects ``{key: {word: weight}}``,
    one per line and (key, part): a key's words are dealt to ``parts`` parts by
    a fixed hash of the word, so a key with any number of words is
    written by many tasks and no row holds more than a part of it."""
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    inner = (word_repr.groupBy("key", part.alias("part"))
             .agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("m")))
    inner.select(F.to_json(F.map_from_arrays(F.array("key"), F.array("m"))).alias("value")).write.mode("overwrite").text(path)


def _inner_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(file, m)``: every ``key: {...}`` of the one object of each ``*.json`` file, as a map; null where a piece is
    no JSON. Files are cut at closing braces, so a large one is read by several tasks."""
    pieces = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("lineSep", "}").text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^[\s]*[{,]?[\s]*", "").alias("piece"))
              .filter(F.btrim("piece", F.lit(" \t\r\n")) != ""))
    return pieces.select("file", F.from_json(F.concat(F.lit("{"), F.col("piece"), F.lit("}}")), WORD_REPR_TYPE).alias("m"))


def scan_word_repr(spark: SparkSession, path: str) -> DataFrame:
    """``(key, word, weight)`` from the JSON objects under ``path``, one per
    line or one per file (a ``*.json`` file holds one object over any number
    of lines); a missing file gives an empty table (expansion returns the keys).

    A ``*.json`` file is read in pieces that end at closing braces. A brace inside a string makes a piece that
    is no JSON (its string stays open): such files alone are read as one value each."""
    if not path_exists(spark, path):
        return empty(spark, "key string, word string, weight bigint")
    lines = (spark.read.option("recursiveFileLookup", True).text(path)
             .filter(~F.col("_metadata.file_name").endswith(".json")).select(F.from_json("value", WORD_REPR_TYPE).alias("m")))
    pieces = _inner_objects(spark, path)
    odd = pieces.filter(F.col("m").isNull()).select("file").distinct()
    if not odd.isEmpty():
        whole = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("file"), F.from_json("value", WORD_REPR_TYPE).alias("m")))
        pieces = pieces.join(odd, "file", "left_anti").unionByName(whole.join(odd, "file", "left_semi"))
    outer = lines.unionByName(pieces.select("m")).select(F.explode("m").alias("key", "inner"))
    return outer.select("key", F.explode("inner").alias("word", "weight"))
