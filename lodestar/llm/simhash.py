"""SimHash near-duplicate detection by multi-index hashing.

A text's fingerprint is the bitwise majority of the hashes of its word
shingles. Fingerprints within ``max_bits`` = 2 differing bits are linked and the
links' connected components are the near-duplicate groups.

Search. The 64 bits are cut into two segments of 32. If two fingerprints differ
in at most two bits, they differ by at most one bit in the high segment, or not
at all in the low one. So one table per segment maps the segment's value to the
fingerprints that hold it; each fingerprint asks the high table for its own
value and every value one bit away (the Hamming ball of radius 1), the low table
for its own value (radius 0), and every match is verified on all 64 bits. Of two
values one bit apart only the one with the bit clear asks, so each pair meets
once.

A table entry with more than ``hot`` fingerprints (large groups of near copies)
is searched one level deeper instead: inside it the other segment's Hamming
ball is enumerated from both sides, and meeting points hold at most 33
fingerprints. So work stays linear in the number of fingerprints, no pair is
lost, and copies (equal fingerprints) are collapsed before any of it.

Cases: null, empty and wordless texts have fingerprint zero and are linked like
any other; fewer words than the shingle length make one shingle; repeated rows
are kept as rows of one component; null ids never name a component unless all
its ids are null; only (id, text) are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column, written
from .graph import components

SHINGLE = 3
MAX_BITS = 2
HOT = 256
SEED = 42
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' XXH64 bits, as an unsigned 64-bit number."""
    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1:].tolist())),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int = SHINGLE) -> Callable[[Column], Column]:
    """text -> struct(fp): the fingerprint's 64 bits as a signed long."""
    def start():
        return lambda text: (int(np.uint64(text_fingerprint(text, shingle)).astype(np.int64)),)

    return text_column(start, "fp long")


def _segments() -> list[tuple[int, Column, Column]]:
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    return [(0, high, low), (1, low, high)]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Distinct (fp) -> (a, b) pairs of fingerprints within ``max_bits`` <= 2."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with radii 1 and 0 cover at most two differing bits")
    power = [F.lit(1 << i).cast("long") for i in range(32)]
    entries = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), own.alias("value"), other.alias("other"))
        for s, own, other in _segments()])).alias("e")).select("fp", "e.*")
    # of the high segment's one-bit neighbours, those with a clear bit set
    up = F.filter(F.array(*[F.when(F.shiftrightunsigned("fp", 32).bitwiseAND(p) == 0,
                                   F.shiftrightunsigned("fp", 32).bitwiseOR(p)) for p in power]),
                  lambda v: v.isNotNull())
    probes = entries.withColumn("near", F.lit(0)).unionByName(
        fps.select("fp", F.lit(0).alias("seg"), F.explode(up).alias("value"),
                   F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("other"), F.lit(1).alias("near")))
    crowded = written(entries.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
                      .filter(F.col("n") > hot).select("seg", "value"), "crowded")

    def pairs(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
        held = held.select(*keys, F.col("fp").alias("b"))
        # at distance 0 both sides ask: keep the pair once
        return (asked.withColumnRenamed("fp", "a").join(held, keys)
                .filter(((F.col("near") == 1) | (F.col("a") < F.col("b")))
                        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
                .select("a", "b"))

    plain = pairs(probes, entries.join(crowded, ["seg", "value"], "left_anti"), ["seg", "value"])
    around = F.explode(F.concat(F.array("other"), F.array(*[F.col("other").bitwiseXOR(p) for p in power])))
    asked = probes.join(crowded, ["seg", "value"], "left_semi").withColumn(
        "point", F.when(F.col("near") == 1, F.array("other"))
        .otherwise(F.concat(F.array("other"), F.array(*[F.col("other").bitwiseXOR(p) for p in power]))))
    asked = asked.withColumn("point", F.explode("point"))
    held = entries.join(crowded, ["seg", "value"], "left_semi").withColumn("point", around)
    deep = pairs(asked, held, ["seg", "value", "point"])
    return plain.unionByName(deep).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest
    id reachable), component_root (smallest signed fingerprint of the group)."""
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(shingle)(F.col(text)).alias("f"))
                     .select("doc_id", "f.fp"), "fingerprints")
    return (prints.join(fingerprint_groups(prints, max_bits, hot), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                    "component_root"))


def fingerprint_groups(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp) -> one row per distinct fp: fp, component_root, component_id."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "classes")
    root = components(fingerprint_links(classes.select("fp"), max_bits, hot)).toDF("fp", "component_root")
    linked = classes.join(root, "fp", "left").withColumn("component_root", F.coalesce("component_root", "fp"))
    lowest = linked.groupBy("component_root").agg(F.min("lowest").alias("component_id"))
    return written(linked.join(lowest, "component_root").select("fp", "component_root", "component_id"), "groups")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest
    id (null ids last; equal ids: the first by text). Columns as in ``docs``."""
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                               fingerprint_column(shingle)(F.col(text)).alias("f")).select("row", "f.fp"), "rows")
    groups = fingerprint_groups(rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "fp"), max_bits, hot)
    order = Window.partitionBy("component_root").orderBy(F.col(f"row.`{text}`").asc_nulls_last())
    first = (rows.join(groups, "fp").filter(F.col(f"row.`{doc_id}`").eqNullSafe(F.col("component_id")))
             .withColumn("n", F.row_number().over(order)))
    return first.filter(F.col("n") == 1).select("row.*")
