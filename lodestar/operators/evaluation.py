"""Effectiveness metrics at 10, per question and per run.

Semantics reproduced on purpose:
- P@10 divides by 10 even when fewer documents are returned;
- MAP@10 is the mean of P@i over the hits found, and 0 when fewer than 10
  documents were returned;
- NDCG@10 compares the sorted relevances (as truth) with the actual 0/1
  list (as scores), ties averaged; 0 for one document or none; closed form
  in ``ndcg_expr``;
- the reported MRR is carried forward from the last question with fewer
  than 10 documents (NULL before the first one); ``mrr`` is the true value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_url, extract_id

METRICS = ["s10", "p10", "r10", "f1_10", "map10", "mrr", "ndcg10"]
METRIC_LABELS = {"s10": "S@10", "p10": "P@10", "r10": "R@10", "f1_10": "F1@10",
                 "map10": "MAP@10", "mrr": "MRR", "ndcg10": "NDCG@10"}


def _dcg(m: Column) -> Column:
    """sum_{i=1..m} 1 / log2(i + 1); 0 for m < 1."""
    return F.when(m >= 1, F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                                      lambda acc, i: acc + 1.0 / F.log2(i + 1.0))).otherwise(F.lit(0.0))


def ndcg_expr(n: Column, r: Column, a: Column) -> Column:
    """n documents, r relevant among them, a relevant among the first r."""
    n, r, a = n.cast("int"), r.cast("int"), a.cast("int")
    dr, dn = _dcg(r), _dcg(n)
    nd, rd, ad = n.cast("double"), r.cast("double"), a.cast("double")
    val = (ad / rd * dr + (rd - ad) / (nd - rd) * (dn - dr)) / dr
    return (F.when(n <= 1, 0.0).when(r == 0, 0.0).when(r == n, 1.0).otherwise(val))


def first_question_rows(questions: DataFrame) -> DataFrame:
    """First question row per id (by ``seq``)."""
    w = Window.partitionBy("id").orderBy("seq")
    return questions.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def eval_metrics(ranked_docs: DataFrame, questions: DataFrame, qrels: DataFrame,
                 run_keys: list[str] | None = None, k: int = 10) -> DataFrame:
    """Per (run, question) metrics.

    ``ranked_docs(run..., id, rank, document)`` has one row per returned
    document URL (rank from 1) and one row with NULL document for a question
    that returned none; ``questions(id, seq)``; ``qrels(id, doc_id)`` gold
    pairs (a question without pairs expects the placeholder ``"0"``).
    """
    run_keys = list(run_keys or [])
    q = first_question_rows(questions.select("id", "seq"))
    gold = qrels.select("id", extract_id(doc_url("doc_id")).alias("key")).distinct()
    n_rel = gold.groupBy("id").agg(F.count(F.lit(1)).alias("n_rel"))
    gold_all = (q.select("id").join(n_rel, "id", "left").select("id", F.coalesce("n_rel", F.lit(1)).alias("n_rel")))
    placeholder = q.select("id").join(n_rel, "id", "left_anti").select("id", F.lit("0").alias("key"))
    gold_keys = gold.unionByName(placeholder).withColumn("rel", F.lit(1))
    d = ranked_docs.join(q.select("id", "seq"), "id")
    d = (d.withColumn("key", F.when(F.col("document").isNotNull(), extract_id("document")))
         .join(gold_keys, ["id", "key"], "left")
         .withColumn("rel", F.when(F.col("document").isNotNull(), F.coalesce("rel", F.lit(0)))))
    w = Window.partitionBy(*run_keys, "id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("cum", F.sum("rel").over(w))
    per = d.groupBy(*run_keys, "id", "seq").agg(
        F.count("document").alias("n"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("rel"))), F.lit(0)).alias("hits"),
        F.avg(F.when((F.col("rel") == 1) & (F.col("rank") <= k), F.col("cum") / F.col("rank"))).alias("ap"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
        F.collect_list(F.when(F.col("rel") == 1, F.col("rank"))).alias("hit_ranks"))
    per = per.join(gold_all, "id")
    p = F.col("hits") / float(k)
    r = F.col("hits") / F.col("n_rel")
    n_k = F.least(F.col("n"), F.lit(k))
    a = F.size(F.filter("hit_ranks", lambda x: x <= F.col("hits")))
    return per.select(
        *run_keys, "id", "seq", F.col("n").alias("n_docs"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("s10"),
        p.alias("p10"), r.alias("r10"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1_10"),
        F.when(F.col("n") < k, 0.0).otherwise(F.coalesce("ap", F.lit(0.0))).alias("map10"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        ndcg_expr(n_k, F.col("hits"), a).alias("ndcg10"))


def mrr_reported(metrics: DataFrame, run_keys: list[str] | None = None, k: int = 10,
                 block: int = 4096) -> DataFrame:
    """Adds ``mrr_reported``: MRR of the latest question (by ``seq``, itself
    included) that returned fewer than ``k`` documents.

    A two-level prefix scan, so no run is ever a single window partition:
    a window inside fixed-size ``seq`` blocks, then a window over one
    summary row per block carries values across blocks.
    """
    run_keys = list(run_keys or [])
    m = metrics.withColumn("_blk", F.floor(F.col("seq") / block))
    m = m.withColumn("_v", F.when(F.col("n_docs") < k, F.struct(F.col("seq"), F.col("mrr"))))
    w_in = Window.partitionBy(*run_keys, "_blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_local", F.last("_v", ignorenulls=True).over(w_in))
    blocks = m.groupBy(*run_keys, "_blk").agg(F.max("_v").alias("_bl"))
    w_b = Window.partitionBy(*run_keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*run_keys, "_blk", F.last("_bl", ignorenulls=True).over(w_b).alias("_carry"))
    m = m.join(blocks, [*run_keys, "_blk"])
    rep = F.coalesce(F.col("_local")["mrr"], F.col("_carry")["mrr"])
    return m.withColumn("mrr_reported", rep).drop("_blk", "_v", "_local", "_carry")


def macro_metrics(metrics: DataFrame, run_keys: list[str] | None = None) -> DataFrame:
    """Mean of every metric over the evaluated questions of a run;
    ``mrr`` is the mean of the reported (carried) values as published,
    ``mrr_true`` the mean of the true reciprocal ranks."""
    run_keys = list(run_keys or [])
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))  # noqa: E731  no question evaluated: zeros
    aggs = [mean(c).alias(c) for c in METRICS if c != "mrr"]
    aggs += [mean("mrr_reported").alias("mrr"), mean("mrr").alias("mrr_true"), F.count(F.lit(1)).alias("n_questions")]
    g = metrics.groupBy(*run_keys).agg(*aggs)
    return g.select(*run_keys, *METRICS, "mrr_true", "n_questions")


def run_stats(status: DataFrame, run_keys: list[str] | None = None) -> DataFrame:
    """Counters of a run from a per-question status table with columns
    ``has_body, n_extracted, n_keywords, initial_hits, retried, final_hits,
    partial_fetch``.

    A question from which no keyword was extracted leaves the run before the
    filter, the search and the retry: it counts as an extraction failure only.
    ``zero_hits`` = questions ending without a candidate (initial zero without
    retry plus failed retries)."""
    run_keys = list(run_keys or [])
    b = F.col("has_body") & (F.col("n_extracted") > 0)
    return status.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(F.when(F.col("has_body") & (F.col("n_extracted") == 0), 1).otherwise(0)).alias("extraction_failures"),
        F.sum(F.when(b & (F.col("n_keywords") == 0), 1).otherwise(0)).alias("zero_keywords"),
        F.sum(F.when(b & (F.col("final_hits") == 0), 1).otherwise(0)).alias("zero_hits"),
        F.sum(F.when(b & F.col("retried"), 1).otherwise(0)).alias("retries_started"),
        F.sum(F.when(b & F.col("retried") & (F.col("final_hits") == 0), 1).otherwise(0)).alias("retries_failed"),
        F.sum(F.when(b & F.col("partial_fetch"), 1).otherwise(0)).alias("partial_fetches"),
    ).select(*run_keys, "questions", "extraction_failures", "zero_keywords", "zero_hits", "retries_started",
             "retries_failed", "partial_fetches",
             (F.col("zero_keywords") / F.col("questions")).alias("zero_keywords_share"),
             (F.col("zero_hits") / F.col("questions")).alias("zero_hits_share"))
