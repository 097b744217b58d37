"""Configuration comparison over run-level metric rows (one row per run).

Input ``runs(run_no, ranker, mode, s10, p10, r10, f1_10, map10, mrr, ndcg10)``;
``run_no`` is the listing order (first row wins ties, as the report does).
Run tables hold one row per configuration, so the global orderings below
never see more rows than there are configurations. Values are compared
rounded to 6 digits, so ties do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import METRIC_LABELS, METRICS


def config_label(ranker="ranker", mode="mode"):
    return F.concat(F.col(ranker), F.lit(" ("), F.col(mode), F.lit(")"))


def present_metrics(runs: DataFrame) -> list[str]:
    cols = [m for m in METRICS if m in runs.columns]
    if not cols:
        raise ValueError("none of the expected metric columns is present")
    return cols


def compare_configs(runs: DataFrame, digits: int = 4) -> DataFrame:
    """``(position, label, ranker, mode, metrics...)`` rounded, best NDCG first."""
    cols = present_metrics(runs)
    if "ndcg10" not in cols:
        raise ValueError("sorting needs ndcg10")
    w = Window.orderBy(F.round("ndcg10", 6).desc(), F.col("run_no").asc())
    return runs.select(F.row_number().over(w).alias("position"), config_label().alias("label"), "ranker", "mode",
                       *[F.round(c, digits).alias(c) for c in cols])


def best_config(runs: DataFrame, metrics=("ndcg10", "map10")) -> DataFrame:
    """``(metric, label, value)``: the first run holding each metric's maximum."""
    out = None
    for m in metrics:
        best = runs.agg(F.max_by(F.struct(config_label().alias("label"), F.col(m).alias("value")),
                                 F.struct(F.round(m, 6), -F.col("run_no"))).alias("b"))
        part = best.select(F.lit(METRIC_LABELS[m]).alias("metric"), "b.label", F.round("b.value", 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def metric_series(runs: DataFrame, digits: int = 4) -> DataFrame:
    """``(metric, position, label, value)``: per metric, configurations by value desc."""
    cols = present_metrics(runs)
    long = runs.select("run_no", config_label().alias("label"),
                       F.explode(F.array(*[F.struct(F.lit(METRIC_LABELS[c]).alias("metric"),
                                                    F.col(c).cast("double").alias("value")) for c in cols])).alias("m"))
    long = long.select("run_no", "label", "m.metric", "m.value")
    w = Window.partitionBy("metric").orderBy(F.round("value", 6).desc(), F.col("run_no").asc())
    return long.select("metric", F.row_number().over(w).alias("position"), "label", F.round("value", digits).alias("value"))
