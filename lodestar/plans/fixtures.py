"""Input views derived from the driver's parquet tables.

- questions  <- ``benchmark`` (id = seq = item_id, body = text)
- articles   <- ``documents`` (title = text before the first newline,
  abstract = the rest, ``N/A`` without a newline)
- unigrams   <- word counts over ``conversations`` (the background corpus)
- word_repr  <- word associations from ``conversations``: how often a word
  stands next to a key word (both directions), keys limited to words of
  the questions. Adjacent pairs only, so the table grows linearly with
  the text, never with all pairs of a turn.
- qrels      <- documents that hold all words of a question in a row (the
  whole question, letter case and punctuation aside)
- q_emb / d_emb <- ``embeddings``: every 25th row (``vec_id % 25 = 0``) is a
  query vector, dealt to the (question, mode) pairs in turn; the others are
  document vectors (``doc_id = vec_id``)
- responses  <- the assistant's turns of the conversation that bears the question's id
- lemmas     <- background words that are another background word plus ``s``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import tokens_words
from ..operators.joins import salted_join
from ..operators.retrieval import small, split_articles
from ..session import materialize

QUERY_VECTOR_STEP = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.col("item_id").alias("seq"), F.col("text").alias("body"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_articles(table(spark, sf_dir, "documents").select("doc_id", "text"))


def unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return (c.select(F.explode(tokens_words("text")).alias("word")).groupBy("word")
            .agg(F.count(F.lit(1)).cast("double").alias("freq")))


def question_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select(F.explode(tokens_words("body")).alias("word")).distinct()


def word_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(tokens_words("text").alias("t"))
    n = F.size("t") - 1
    fwd = F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda a, b: F.struct(a.alias("key"), b.alias("word")))
    bwd = F.zip_with(F.slice("t", 2, n), F.slice("t", 1, n), lambda a, b: F.struct(a.alias("key"), b.alias("word")))
    pairs = (c.filter(F.size("t") > 1).select(F.explode(F.concat(fwd, bwd)).alias("p"))
             .select("p.key", "p.word").filter(F.col("key") != F.col("word")))
    vocab = question_vocabulary(spark, sf_dir).withColumnRenamed("word", "key")
    return (pairs.join(vocab, "key", "left_semi")
            .groupBy("key", "word").agg(F.count(F.lit(1)).alias("weight")))


def gold_pairs(questions: DataFrame, documents: DataFrame, n_anchors: int = 2) -> DataFrame:
    """``questions(id, body)``, ``documents(doc_id, text)`` -> distinct
    ``(id, doc_id)`` where the document's words hold the question's words in a row.

    No all-pairs comparison: a question is looked up by its ``n_anchors`` rarest
    words (by document counts), documents that hold them all are candidates, and
    only their texts are compared in full. A question without words has no pair."""
    q = questions.select("id", tokens_words("body").alias("w")).filter(F.size("w") > 0)
    words = q.select("id", F.explode(F.array_distinct("w")).alias("word"))
    held = (documents.select("doc_id", F.explode(F.array_distinct(tokens_words("text"))).alias("word"))
            .join(small(words.select("word").distinct()), "word", "left_semi"))
    held = materialize(held, "gold_words")  # read for the counts and for the candidates
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("id").orderBy("n", "word")
    anchors = (words.join(counts, "word").withColumn("r", F.row_number().over(rarest))
               .filter(F.col("r") <= n_anchors).select("id", "word"))
    anchors = materialize(anchors, "gold_anchors")
    asked = anchors.groupBy("id").agg(F.count(F.lit(1)).alias("asked"))
    cand = (salted_join(held, small(anchors), ["word"]).groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("c"))
            .join(asked, "id").filter(F.col("c") == F.col("asked")).select("id", "doc_id"))
    cand = materialize(cand, "gold_candidates")
    padded = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    # written, so that the comparison's filters are not moved below the cut, onto every text
    texts = materialize(documents.select("doc_id", "text").join(small(cand.select("doc_id").distinct()), "doc_id", "left_semi"), "gold_texts")
    texts = texts.select("doc_id", padded(tokens_words("text")).alias("norm"))
    return (cand.join(texts, "doc_id").join(q.select("id", padded(F.col("w")).alias("phrase")), "id")
            .filter(F.contains("norm", "phrase")).select("id", "doc_id").distinct())


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_pairs(questions(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(form, lemma)``."""
    words = unigrams(spark, sf_dir).select("word")
    forms = words.filter(F.col("word").endswith("s") & (F.char_length("word") > 1)).select(
        F.col("word").alias("form"), F.expr("substring(word, 1, char_length(word) - 1)").alias("lemma"))
    return forms.join(words.withColumnRenamed("word", "lemma"), "lemma", "left_semi").select("form", "lemma")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, turn, raw)``: stored model responses to the questions."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return (c.select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("raw"))
            .join(questions(spark, sf_dir).select("id"), "id", "left_semi"))


def retry_clauses(keywords: DataFrame) -> DataFrame:
    """One clause per question: all its keywords OR-ed."""
    return keywords.select("id", F.lit(1).alias("clause_no"), "term",
                           F.lit(None).cast("string").alias("field"), F.lit(False).alias("negated"))


def q_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, mode, vec)``: one stored vector per question and query mode."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % QUERY_VECTOR_STEP == 0)
    n = e.select(F.count(F.lit(1))).scalar()
    asked = questions(spark, sf_dir).select("id", F.posexplode(F.array(*[F.lit(m) for m in C.QUERY_MODES])).alias("m", "mode"))
    nth = (F.col("id") * len(C.QUERY_MODES) + F.col("m")) % n
    return (asked.select("id", "mode", (nth * QUERY_VECTOR_STEP).alias("vec_id")).join(e, "vec_id")
            .select("id", "mode", F.col("embedding").alias("vec")))


def d_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % QUERY_VECTOR_STEP != 0)
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")
