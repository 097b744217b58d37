"""The salted join gives the rows of the plain join, hot keys included."""

from collections import Counter

from lodestar.operators.joins import salted_join


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 20}", i) for i in range(100)] + [(None, 1)],
                                "k string, v int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("zz", "d"), (None, "e")], "k string, w string")
    want = Counter(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))
    for buckets in (1, 7):
        got = salted_join(big, small, ["k"], buckets).select("k", "v", "w").collect()
        assert Counter(map(tuple, got)) == want
