"""A uniform shuffle into shards of exact sizes (DataFrame functions only).

The law is ``rows``: shard sizes differ by at most one row. Every order of the rows over the shards'
slots is equally likely, up to the quality of the hashes that serve as random numbers.

Method. Rows stand in parts: runs of ``PART_ROWS`` rows of a file, as the table lies. How many rows
each part gives to each shard is a matrix with the part sizes and the shard sizes as margins,
and for a uniform shuffle it follows the multivariate hypergeometric law. It is drawn exactly,
before any row moves. Parts form a tree (digits of a hash of the part); a node's counts are
dealt to its children, child by child and shard by shard, each count a hypergeometric number
given what is left. All nodes of a level are drawn at once, one row each; the root sees
only its children's totals. Rows of a part are then permuted (numbered by a hash), and the matrix
cuts the permutation into runs for the shards. Inside a shard rows are permuted again: counts of hash
buckets, and numbers inside a bucket, give the slots.

A hypergeometric number comes from ratio-of-uniforms rejection under a universal table mountain hat
(Stadlober), with log factorials by Stirling's series: a constant expected number of
tries at any size. Tries are an ordered list of at most ``TRIES`` (missing all of them has a chance of
1e-20 or less; the mode is taken then, so that sizes stay exact).

What moves: (file, row) keys while counts, permutations and slots are found; whole rows once, when they
meet their slots; and again only when ``write_shards`` lays the shards out. No window holds more than a
part, a bucket or the buckets of a shard, whatever texts or ids repeat.

Cases: rows are told apart by place, so nulls, repeated rows, equal ids and copies need no care; null
text counts no bytes (size 1, CRC of no bytes 0); an empty table gives an empty result; fewer rows than
shards leave shards empty; added columns are one struct, named by the caller; equal texts are not kept
together (groups of any size would break the exact sizes). The shuffle is fixed by the seed and the
table's files.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import scratch, written

SHARDS = 16
SEED = 20_231
PART_ROWS = 4_096
BUCKET_ROWS = 4_096
FAN_BITS = 6
TRIES = 64
HAT_WIDTH = 2 * math.sqrt(2 / math.e)
HAT_BASE = 3 - 2 * math.sqrt(3 / math.e)
SMALL_FACTORIALS = 32
_TWO_53 = float(1 << 53)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, from a table for small n."""
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(SMALL_FACTORIALS)])
    x = n.cast("double")
    series = ((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))
    return F.when(n < SMALL_FACTORIALS, F.get(table, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def uniform(*keys: Column) -> Column:
    """A double strictly between 0 and 1 from a hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / _TWO_53


def hypergeometric(good: Column, bad: Column, sample: Column, *keys: Column) -> Column:
    """How many of ``sample`` rows drawn without return are among the ``good``.

    ``keys`` choose the random numbers. Drawn for the rarer kind and the smaller of sample and rest,
    then turned round."""
    rare, total = F.least(good, bad), good + bad
    few = F.least(sample, total - sample)

    def log_weight(z: Column, c: Column) -> Column:
        return (log_factorial(z) + log_factorial(c["rare"] - z) + log_factorial(c["few"] - z)
                + log_factorial(c["often"] - c["few"] + z))

    def drawn(c: Column) -> Column:
        # ratio of uniforms: a try is a point (u, v) of the hat; w its quotient, z the count
        def one(state: Column, k: Column) -> Column:
            u, v = uniform(*keys, k, F.lit(1)), uniform(*keys, k, F.lit(2))
            fresh = let(u, lambda u: let(c["centre"] + c["spread"] * (v - 0.5) / u, lambda w: F.when(
                (w >= 0) & (w < c["end"]) & let(F.floor(w), lambda z: 2 * F.log(u) <= c["peak"] - log_weight(z, c)),
                F.floor(w))))
            return F.coalesce(state, fresh)
        tried = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("long"), one)
        return F.coalesce(tried, c["mode"])

    def with_peak(c: Column) -> Column:
        return let(F.struct(c["rare"].alias("rare"), c["often"].alias("often"), c["few"].alias("few"), c["mode"].alias("mode"),
                            c["centre"].alias("centre"), c["spread"].alias("spread"), c["end"].alias("end"),
                            log_weight(c["mode"], c).alias("peak")), drawn)

    share = rare.cast("double") / total
    deviation = F.sqrt((total - few).cast("double") * few * share * (1 - share) / (total - 1) + 0.5)
    mode = F.floor((few + 1).cast("double") * (rare + 1) / (total + 2))
    centre = few * share + 0.5
    setup = F.struct(rare.alias("rare"), F.greatest(good, bad).alias("often"), few.alias("few"), mode.alias("mode"),
                     centre.alias("centre"), (HAT_WIDTH * deviation + HAT_BASE).alias("spread"),
                     F.least(F.least(few, rare) + 1.0, F.floor(centre + 16 * deviation).cast("double")).alias("end"))

    def turned(z: Column) -> Column:
        z = F.when(good > bad, few - z).otherwise(z)
        return F.when(few < sample, good - z).otherwise(z)

    free = (good > 0) & (bad > 0) & (sample > 0) & (sample < total)
    return (F.when(free, let(let(setup, with_peak), turned))
            .when(good <= 0, F.lit(0)).when(bad <= 0, sample).when(sample <= 0, F.lit(0)).otherwise(good).cast("long"))


def dealt(sizes: Column, ids: Column, room: Column, seed: int) -> Column:
    """Deals the shards' ``room`` (array of counts) to children of the given ``sizes``: an array, for
    each child, of its count for every shard. sum(sizes) = sum(room)."""
    none = F.array().cast("array<bigint>")

    def child(state: Column, at: Column) -> Column:
        def shard(s: Column, j: Column) -> Column:
            there = F.get(state["room"], j)
            got = hypergeometric(there, s["rest"] - there, s["need"], F.lit(seed), F.get(ids, at), j)
            return let(got, lambda x: F.struct((s["rest"] - there).alias("rest"), (s["need"] - x).alias("need"),
                                               F.concat(s["row"], F.array(x)).alias("row")))
        start = F.struct(F.aggregate(state["room"], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("rest"),
                         F.get(sizes, at).alias("need"), none.alias("row"))
        return let(F.aggregate(F.sequence(F.lit(0), F.size(state["room"]) - 1), start, shard)["row"], lambda row: F.struct(
            F.zip_with(state["room"], row, lambda a, b: a - b).alias("room"),
            F.concat(state["rows"], F.array(row)).alias("rows")))
    start = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, child)["rows"]


def communication_matrix(parts: DataFrame, n_shards: int = SHARDS, seed: int = SEED, fan_bits: int = FAN_BITS) -> DataFrame:
    """(part, n) with distinct ``part`` -> (part, n, row): the rows that each part gives to each shard.

    The tree's depth follows the number of parts; a level's nodes are drawn in parallel."""
    parts = parts.select("part", F.col("n").cast("long").alias("n"), F.xxhash64(F.lit(seed), F.lit("part"), "part").alias("h"))
    count, rows = parts.agg(F.count(F.lit(1)), F.sum("n")).first()
    rows = rows or 0
    levels = max(0, math.ceil(math.log2(max(count, 1)) / fan_bits) - 1)
    root = F.array(*[F.lit(rows // n_shards + (j < rows % n_shards)).cast("bigint") for j in range(n_shards)])
    nodes: DataFrame | None = None  # the root's room is known

    def digits(level: int) -> Column:
        return F.shiftrightunsigned("h", 64 - fan_bits * level) if level else F.lit(0).cast("bigint")

    def deal(nodes: DataFrame | None, children: DataFrame, level: int) -> DataFrame:
        """children (node, id, n) -> (id, n, row)"""
        held = children.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("c"))
        rows = dealt(F.col("c.n"), F.col("c.id"), F.col("room"), seed + level)
        held = held.withColumn("room", root) if nodes is None else held.join(nodes, "node")
        return (held.select(F.arrays_zip(F.col("c.id").alias("id"), F.col("c.n").alias("n"), rows.alias("row")).alias("z"))
                .select(F.explode("z").alias("z")).select("z.id", "z.n", "z.row"))

    for level in range(levels):
        children = (parts.groupBy(digits(level).alias("node"), digits(level + 1).alias("id")).agg(F.sum("n").alias("n")))
        nodes = written(deal(nodes, children, level).select(F.col("id").alias("node"), F.col("row").alias("room")), "matrix_level")
    leaves = parts.select(digits(levels).alias("node"), F.col("part").alias("id"), "n")
    return deal(nodes, leaves, levels).withColumnRenamed("id", "part")


def shard_rows(docs: DataFrame, **how) -> DataFrame:
    """As ``shard_table``, for any rows: they are written first, so that each has a place."""
    scratch(docs.sparkSession)
    path = scratch_path(docs.sparkSession, "sharded_rows")
    docs.write.mode("overwrite").parquet(path)
    return shard_table(docs.sparkSession, path, **how)


def shard_table(spark: SparkSession, path: str, columns: list[str] | None = None, n_shards: int = SHARDS, seed: int = SEED,
                name: str = "place", part_rows: int = PART_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of a Parquet table with a struct ``name`` of ``shard`` (int) and ``slot`` (long, gapless from 0)."""
    table = spark.read.parquet(path)
    file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    keyed = table.select(*(columns if columns is not None else table.columns),
                         F.struct(file.alias("f"), row.alias("r")).alias("__key"))
    keys = table.select(file.alias("f"), row.alias("r"))
    part = F.xxhash64("f", F.floor(F.col("r") / part_rows))
    sizes = written(keys.groupBy("f", F.floor(F.col("r") / part_rows).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("last"))
                    .select(F.xxhash64("f", "run").alias("part"), "f", "n", "last"), "part_sizes")
    _distinct(table, sizes)
    matrix = written(communication_matrix(sizes.select("part", "n"), n_shards, seed), "communication_matrix")

    # permute inside each part: the matrix row's running sums cut the order into the shards' runs
    first = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "f", "r"), "f", "r"))
    order = keys.withColumn("part", part).withColumn("k", first)
    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda j: F.aggregate(
        F.slice("row", 1, j), F.lit(0).cast("bigint"), lambda a, x: a + x))
    cut = matrix.select("part", ends.alias("ends"))
    assigned = (order.join(cut, "part")
                .select("f", "r", F.size(F.filter("ends", lambda e: e < F.col("k"))).alias("shard"),
                        F.xxhash64(F.lit(seed), F.lit("slot"), "f", "r").alias("h")))
    # permute inside each shard: buckets by the leading bits of another hash
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n_rows / n_shards / bucket_rows))))
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    assigned = written(assigned.withColumn("bucket", bucket), "assigned")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = (assigned.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start")))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "f", "r")) - 1
    slots = (assigned.withColumn("nth", nth).join(starts, ["shard", "bucket"])
             .select(F.struct("f", "r").alias("__key"), F.struct("shard", (F.col("start") + F.col("nth")).alias("slot")).alias(name)))
    return keyed.join(slots, "__key").drop("__key")


def _distinct(table: DataFrame, sizes: DataFrame) -> None:
    """Files and parts are known by hashes; two of them under one hash would mix their rows."""
    files = table.select("_metadata.file_path").distinct().count()
    known, parts, distinct = sizes.agg(F.count_distinct("f"), F.count(F.lit(1)), F.count_distinct("part")).first()
    if files != known or parts != distinct:
        raise RuntimeError("two files or parts share a hash; write the table anew under other names")


def write_shards(sharded: DataFrame, path: str, name: str = "place") -> None:
    """Shards as folders ``shard=0`` ... of files whose rows follow in the order of their slots."""
    place = F.col(name)
    rows = sharded.select(place["shard"].alias("shard"), place["slot"].alias("slot"), *[c for c in sharded.columns if c != name])
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
