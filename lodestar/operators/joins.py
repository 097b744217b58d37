"""Equi-joins that stay balanced when one key holds a large share of rows.

No join here carries a broadcast hint: sizes estimated while planning run low
on exploded tables, so the choice is left to adaptive execution, which sees
real sizes, and which splits oversized partitions of a sort-merge join.

``salted_join`` does not wait for that: where the query side is small by
nature (the terms of the questions) and the other side is known to be
skewed (postings of frequent terms), the skewed side's rows are spread over
``buckets`` salt values and the small side is repeated once per value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 16


def salted_join(skewed: DataFrame, small: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``skewed ⋈ small`` (inner) on ``keys``: each key's rows of ``skewed`` meet
    in ``buckets`` tasks instead of one."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in skewed.columns]), F.lit(buckets)).cast("int")
    left = skewed.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
