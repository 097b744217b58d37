"""Keyword extraction: word counts, weirdness, domain words, filter, expansion.

Ordering rules (the source's pandas sorts are unstable, so ties are ours):
counts by ``(count desc, word asc)``, weirdness by
``(round(w, 6) asc, count desc, word asc)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import has_alnum, tokens_words
from ..session import materialize
from .responses import parse_keyword_responses


def word_freq(questions: DataFrame, lemmas: DataFrame | None = None,
              text_col: str = "body") -> DataFrame:
    """``(id, word, count)``: lower-cased word tokens of each text, counted.

    ``lemmas(form, lemma)`` replaces each token by its lemma (unknown tokens
    stay as they are); the lemma is tokenised again, as the joined lemma
    string would be.
    """
    toks = questions.select("id", F.explode(tokens_words(text_col)).alias("word"))
    if lemmas is not None:
        lem = lemmas.select(F.lower("form").alias("word"), F.col("lemma"))
        lem = lem.groupBy("word").agg(F.min("lemma").alias("lemma"))
        toks = (toks.join(lem, "word", "left")
                .select("id", F.explode(tokens_words(F.coalesce("lemma", "word"))).alias("word")))
    return toks.groupBy("id", "word").agg(F.count(F.lit(1)).alias("count"))


def weirdness(lexicon: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``(id, word, count, weirdness)``.

    In the background table with frequency f: ``f / (count * N) * 1000`` with
    N the number of kept background rows; absent from it: 0.1. With an empty
    background the column is NULL (callers fall back to frequent words).
    """
    n_rows = unigrams.select(F.count(F.lit(1))).scalar()
    bg = unigrams.groupBy("word").agg(F.sum("freq").alias("freq"))
    j = lexicon.join(bg, "word", "left")
    w = (F.when(n_rows == 0, F.lit(None).cast("double"))
         .when(F.col("freq").isNull(), F.lit(C.OOV_WEIRDNESS))
         .otherwise(F.col("freq") / (F.col("count").cast("double") * n_rows) * 1000.0))
    return j.select("id", "word", "count", w.alias("weirdness"))


def domain_words(weird: DataFrame, threshold: float = C.WEIRDNESS_THRESHOLD,
                 fallback_n: int = C.FALLBACK_TOP_WORDS) -> DataFrame:
    """``(id, pos, term)``: words with weirdness strictly below the threshold,
    most specific first; without background scores, the ``fallback_n`` most
    frequent words."""
    by_w = Window.partitionBy("id").orderBy(F.round("weirdness", 6).asc(), F.col("count").desc(),
                                            F.col("word").asc())
    by_c = Window.partitionBy("id").orderBy(F.col("count").desc(), F.col("word").asc())
    scored = weird.filter(F.col("weirdness").isNotNull() & (F.col("weirdness") < threshold))
    scored = scored.select("id", F.row_number().over(by_w).alias("pos"), F.col("word").alias("term"))
    fallback = weird.filter(F.col("weirdness").isNull())
    fallback = (fallback.select("id", "word", F.row_number().over(by_c).alias("pos"))
                .filter(F.col("pos") <= fallback_n).select("id", "pos", F.col("word").alias("term")))
    return scored.unionByName(fallback)


def keyword_filter(keywords: DataFrame) -> DataFrame:
    """``(id, pos, term)`` lower-cased, without stop words, one-character
    terms and terms lacking a letter or digit."""
    low = F.lower("term")
    keep = (~low.isin(C.GENERAL_STOP_WORDS) & ~low.isin(C.MEDICAL_STOP_WORDS)
            & (F.char_length("term") > 1) & has_alnum("term"))
    return keywords.filter(F.col("term").isNotNull() & keep).select("id", "pos", low.alias("term"))


def keyword_dedup(keywords: DataFrame) -> DataFrame:
    """Order-preserving distinct: the first position of each term wins."""
    return keywords.groupBy("id", "term").agg(F.min("pos").alias("pos")).select("id", "pos", "term")


def question_keywords(questions: DataFrame, unigrams: DataFrame,
                      lemmas: DataFrame | None = None,
                      threshold: float = C.WEIRDNESS_THRESHOLD) -> DataFrame:
    """Extraction -> filter -> dedup, as used before searching."""
    kw = domain_words(weirdness(word_freq(questions, lemmas), unigrams), threshold)
    return keyword_dedup(keyword_filter(kw))


def parsed_responses(responses: DataFrame) -> DataFrame:
    """``responses(id, turn, raw)`` -> ``(id, pos, term)``: the keywords of all of a question's responses, in order."""
    place = Window.partitionBy("id").orderBy("turn", "pos")
    return (parse_keyword_responses(responses, ("id", "turn"))
            .select("id", F.row_number().over(place).alias("pos"), F.col("keyword").alias("term")))


def response_keywords(responses: DataFrame) -> DataFrame:
    """Stored responses -> filter -> dedup, as used before searching."""
    return keyword_dedup(keyword_filter(parsed_responses(responses)))


HEAVY = 1_000_000  # pairs of a key's questions and words
GRID = 16


def heavy_light_join(k: DataFrame, wr: DataFrame, heavy: int = HEAVY, grid: int = GRID) -> DataFrame:
    """``k(id, key) ⋈ wr(key, word, weight)``; keys with more than ``heavy`` pairs in a grid of cells."""
    counts = (k.groupBy("key").agg(F.count(F.lit(1)).alias("nk"))
              .join(wr.groupBy("key").agg(F.count(F.lit(1)).alias("nw")), "key")
              .filter(F.col("nk") * F.col("nw") > heavy).select("key"))
    cells = F.sequence(F.lit(0), F.lit(grid - 1))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(grid)).cast("int")
    hk = k.join(counts, "key", "left_semi").withColumn("a", of("id")).withColumn("b", F.explode(cells))
    hw = wr.join(counts, "key", "left_semi").withColumn("b", of("word")).withColumn("a", F.explode(cells))
    light = k.join(counts, "key", "left_anti").join(wr, "key")
    columns = ["key", "id", "word", "weight"]
    return light.select(*columns).unionByName(hk.join(hw, ["key", "a", "b"]).select(*columns))


def expand_keywords(keys: DataFrame, word_repr: DataFrame, n_top: int = C.EXPANSION_TOP_N,
                    exclude: DataFrame | None = None) -> DataFrame:
    """``(id, pos, term, source)``: the ``n_top`` associated words by summed
    weight over a question's keys, followed by the keys themselves.

    ``keys(id, pos, term)``; ``word_repr(key, word, weight)``; unknown keys
    contribute nothing; ``exclude(word)`` is removed before summing. Ties:
    ``(weight desc, word asc)``. Duplicates between both parts are kept.

    A key of many questions and many words is heavy: its questions and its words are dealt to
    a grid of ``GRID`` x ``GRID`` cells, each a task's worth of the join, and partial sums leave the cells.
    """
    wr = word_repr
    if exclude is not None:
        wr = wr.join(exclude.select("word").distinct(), "word", "left_anti")
    k = keys.select("id", F.col("term").alias("key"))
    joined = heavy_light_join(k, wr)
    summed = (joined.groupBy("id", "word").agg(F.sum("weight").alias("weight")))
    w = Window.partitionBy("id").orderBy(F.col("weight").desc(), F.col("word").asc())
    top = (summed.select("id", "word", F.row_number().over(w).alias("pos"))
           .filter(F.col("pos") <= n_top)
           .select("id", "pos", F.col("word").alias("term"), F.lit("expansion").alias("source")))
    kpos = Window.partitionBy("id").orderBy("pos")
    n_exp = top.groupBy("id").agg(F.count(F.lit(1)).alias("n_exp"))
    originals = (keys.join(n_exp, "id", "left")
                 .select("id", (F.coalesce("n_exp", F.lit(0)) + F.row_number().over(kpos)).alias("pos"),
                         "term", F.lit("key").alias("source")))
    return top.unionByName(originals)


def sort_word_repr(word_repr: DataFrame) -> DataFrame:
    """``(key, rank, word, weight)``: each key's words by weight desc (ties by word).

    Ranks in two levels, so a key with most rows is sorted by many tasks: rows are dealt to ranges of (key,
    weight, word), numbered inside their range, and the rows of a key in earlier ranges are added.
    The ranges are written, so both levels read the same cut."""
    order = [F.col("key").asc(), F.col("weight").desc(), F.col("word").asc()]
    ranged = materialize(word_repr.select("key", "word", "weight").repartitionByRange(*order)
                         .withColumn("part", F.spark_partition_id()), "ranked_ranges")
    held = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "part").orderBy(F.col("weight").desc(), F.col("word").asc())
    return (ranged.withColumn("r", F.row_number().over(inside)).join(base, ["key", "part"])
            .select("key", (F.col("r") + F.col("base")).cast("int").alias("rank"), "word", "weight"))
