"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a target number of words: its weight's share of the budget,
at most ``max_repeat`` times its own size, the excess shared again by weight
among the others. Sorted by cap over weight, the capped sources are a prefix,
so the final share follows from running sums over one row per source.

Within a source every document expects target / size copies. The documents
are laid out in a fixed order (size, then a hash of the id), their expected
copies are summed up to each of them, one offset per source is added, and a
document is taken once per integer crossed. Ordering by size makes the
taken words follow the target closely. All of it is integer arithmetic on
2**-24 units: exact, the same in every rerun and at every place in a source.

A document's place in its source is a sum of three counts (smaller sizes of
the source; lower hash buckets of its size; rows of its bucket), so no window
holds more than the distinct sizes of a source, 256 buckets, or one bucket of
one size: a source with a third of all rows, or a third of all rows being copies
of one text, is spread like any other.

``mix`` gives each document's share; ``emit`` gives the mix itself: whole rows, once per boundary crossed. For
that, the copies of a document (rows with the same id, size, source and text hash count as one
document several times) are numbered on both sides and met by an equi-join, so whole rows
move once.

Cases: null text has size 0 and is never taken; a null source is a source of its
own, placed last; a source of size 0 has target 0; repeated rows are documents
of their own; an empty table gives an empty result; ``mix`` reads only (id, text, source), ``emit`` carries every
column, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_REPEAT = 2
SEED = "mix"
UNIT_BITS = 24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size), one row each -> with ``target`` (double).

    The windows run over one row per source."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(place) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), nth))
    cap = F.col("source_size") * max_repeat
    ranked = ranked.withColumn("cap", cap)
    # by cap / weight: compared as cap * (product of the weights / weight), in integers
    product = 1
    for w in weights:
        product *= w
    order = [F.expr(f"cap * ({product} div weight)"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = ((F.sum("source_size").over(whole) * budget_percent - spent * 100).cast("double")
             / (F.sum("weight").over(after) * 100).cast("double"))
    shared = ranked.withColumn("share", share)
    shared = shared.withColumn("open", F.col("share") * F.col("weight") < F.col("cap"))
    share = F.first(F.when(F.col("open"), F.col("share")), ignorenulls=True).over(whole)
    return (shared.withColumn("share", share)
            .select("source", "source_size",
                    F.when(F.col("open"), F.col("share") * F.col("weight")).otherwise(F.col("cap").cast("double"))
                    .alias("target")))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> list:
    """Columns that a document's share depends on, and what tells it from others."""
    return [F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"),
            F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(source))).alias("src"),
            F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("h"), F.xxhash64(F.col(text)).alias("th")]


def shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeat: int = MAX_REPEAT,
           seed: str = SEED) -> DataFrame:
    """doc_id, src, th, size, source_size, target, copies (integer boundaries that the document crosses)."""
    rows = written(docs.select(*_sized(docs, doc_id, text, source)), "sized")
    bucket = F.substring("h", 1, 2)
    counts = rows.groupBy("src", "size", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by_bucket = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_size = counts.withColumn("low", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)))
    by_size = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    in_source = (rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
                 .select("src", "size", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("smaller")))
    places = in_size.join(in_source, ["src", "size"]).select("src", "size", "bucket", (F.col("low") + F.col("smaller")).alias("before"))
    targets = source_targets(rows.groupBy("source", "src").agg(F.sum("size").alias("source_size"))
                             .select("source", "source_size"), weights, budget_percent, max_repeat)
    targets = targets.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("src"),
        "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(1 << UNIT_BITS) / F.col("source_size")))
        .otherwise(F.lit(0)).cast("long").alias("rate"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, UNIT_BITS // 4), 16, 10)
        .cast("long").alias("offset"))
    nth = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id", "th"))
    placed = (rows.withColumn("bucket", bucket).withColumn("nth", nth).join(places, ["src", "size", "bucket"])
              .withColumn("place", F.col("nth") + F.col("before")).join(targets, "src"))
    upto = F.shiftright(F.col("place") * F.col("rate") + F.col("offset"), UNIT_BITS)
    below = F.shiftright((F.col("place") - 1) * F.col("rate") + F.col("offset"), UNIT_BITS)
    return placed.select("doc_id", "src", "th", "size", "source_size", "target", (upto - below).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return shares(docs, doc_id, text, source, **how).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def with_shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", name: str = "mixed", **how) -> DataFrame:
    """``docs`` with a struct column ``name``: size, source_size, target, and copies, how often the mix takes the row."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_sized(docs, doc_id, text, source)).drop("source", "h")
    same = ["doc_id", "src", "size", "th"]
    # rows that are alike in all that is told apart are numbered on either side: each meets one share
    numbered = lambda df, *order: df.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
    left, right = numbered(whole, F.lit(1)), numbered(shares(docs, doc_id, text, source, **how), F.desc("copies"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*same, "nth")]
    return (left.alias("l").join(right.alias("r"), on)
            .select("l.row", F.struct("r.size", "r.source_size", "r.target", "r.copies").alias("share"))
            .select("row.*", F.col("share").alias(name)))


def emit(docs: DataFrame, name: str = "mixed", **how) -> DataFrame:
    """The mix itself: every row of ``docs`` that has words, as often as it is taken, with a struct column
    ``name``: size, source_size, target, copies (of the row) and copy (which of them, from 1)."""
    taken = with_shares(docs, name=name, **how).filter((F.col(f"{name}.copies") > 0) & (F.col(f"{name}.size") > 0))
    number = F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))
    each = taken.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(name).alias("share"), F.explode(number).alias("copy"))
    return each.select("row.*", F.col("share").withField("copy", F.col("copy")).alias(name))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM {{docs}}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, 2 * source_size AS cap,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight FROM sources),
shared AS (SELECT *, ((sum(source_size) OVER () * 150 - coalesce(sum(cap) OVER (ORDER BY cap * (10 // weight), source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100)::DOUBLE
    / (sum(weight) OVER (ORDER BY cap * (10 // weight), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 100)::DOUBLE) AS share
  FROM ranked),
least_share AS (SELECT min_by(share, cap * (10 // weight)) AS share FROM shared WHERE share * weight < cap),
targets AS (SELECT source, source_size,
    CASE WHEN s.share * weight < cap THEN (SELECT share FROM least_share) * weight ELSE cap::DOUBLE END AS target
  FROM shared s),
placed AS (SELECT d.*, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS place,
    CASE WHEN t.source_size > 0 THEN floor(t.target * 16777216.0::DOUBLE / t.source_size)::BIGINT ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}' || coalesce(d.source, '')), 1, 6))::BIGINT AS off
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((((place * rate + off) >> 24) - (((place - 1) * rate + off) >> 24)) * size)::BIGINT AS taken
FROM placed
"""
