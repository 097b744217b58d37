"""Benchmark decontamination as a prefix-filtered set join.

Every window of ``WINDOW`` consecutive item words (a shorter item: all its words)
is a set of word shingles that a document must contain whole, so the
overlap asked for is the set's full size, and the prefix that must share a
shingle with the document is one element long: the window's rarest shingle,
by document counts over the whole corpus (ties by hash). The join is on that
shingle. Each match then has to pass the length bound (the document has enough
words), the positional bound (the shingle's place in the window fixes where
the window would start, which must lie inside the document) and an exact
comparison of all the window's words.

The benchmark side is a broadcast index only up to ``block_chars`` item characters;
beyond that the items are cut into blocks by a hash of the item, the documents
pass each block, and their marks are merged by text, so memory stays bounded.
Documents are never shuffled for one block.

Cases: null, empty and wordless texts and items have no words and hit nothing;
an item of 1 to 12 words is one window; equal windows of several items are
compared once and name every item; an item without an id marks words and is
not named; repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, HashedWords, alnum_words, gram_hashes, hashed_alnum_words, text_column

WINDOW = 13
SHINGLE = 3
BLOCK_CHARS = 1_000_000
HITS = "n_words long, spans array<int>, items array<string>"


class Index:
    """The prefix index of one block of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, words in items:
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                owners[tuple(words[at:at + size])].add(item)
        self.windows = list(owners)
        self.items = [sorted(i for i in owners[w] if i is not None) for w in self.windows]
        self.shingles: list[np.ndarray] = []  # of each window, in order of place
        for words in hashed_alnum_words([b" ".join(w).decode("utf-8") for w in self.windows]) if self.windows else []:
            self.shingles.append(gram_hashes(words.hashes, min(SHINGLE, len(words))))
        self.short = sorted({len(w) for w in self.windows if len(w) < SHINGLE})
        self.known = np.unique(np.concatenate(self.shingles)) if self.windows else np.empty(0, np.uint64)

    def choose_prefixes(self, counts: dict[int, int]) -> None:
        """Places each window under its rarest shingle."""
        self.under: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, shingles in enumerate(self.shingles):
            at = min(range(len(shingles)), key=lambda i: (counts.get(int(shingles[i]), 0), int(shingles[i])))
            self.under[int(shingles[at])].append((number, at))
        self.prefixes = np.array(sorted(self.under), np.uint64)
        self.filter = bit_filter(self.prefixes)

    def hits(self, words: HashedWords) -> tuple[list[int], list[str]]:
        """Merged [start, end) spans of covered words, and the items found."""
        found, items = [], set()
        for size in [SHINGLE, *self.short]:
            grams = gram_hashes(words.hashes, size)
            for at in np.flatnonzero(present(grams, self.prefixes, self.filter)).tolist():
                for number, place in self.under[int(grams[at])]:
                    window, start = self.windows[number], at - place
                    if min(SHINGLE, len(window)) != size or start < 0 or start + len(window) > len(words):
                        continue
                    if words.slice(start, start + len(window)) == window:
                        found.append((start, start + len(window)))
                        items.update(self.items[number])
        spans: list[int] = []
        for start, end in sorted(found):
            if spans and start <= spans[-1]:
                spans[-1] = max(spans[-1], end)
            else:
                spans += [start, end]
        return spans, sorted(items)


FILTER_BITS = 20


def bit_filter(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << FILTER_BITS, bool)
    table[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return table


def present(grams: np.ndarray, values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which grams are among the sorted ``values``; the table only saves searches."""
    out = table[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    if len(maybe):
        at = np.searchsorted(values, grams[maybe])
        out[maybe] = values[np.minimum(at, len(values) - 1)] == grams[maybe]
    return out


def _document_counts(docs: DataFrame, text: str, index: Index) -> dict[int, int]:
    """In how many documents each of the index's shingles occurs, over the whole corpus."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((index.known, index.short))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, short = shared.value
        table, total = bit_filter(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                for words in hashed_alnum_words(batch.column(0).slice(at, CHUNK).to_pylist()):
                    for size in [SHINGLE, *short]:
                        grams = gram_hashes(words.hashes, size)
                        total[np.searchsorted(known, np.unique(grams[present(grams, known, table)]))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    if not len(index.known):
        return {}
    rows = (docs.select(F.col(text)).mapInArrow(count, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).collect())  # at most one row per shingle of the block
    return {int(np.int64(r["shingle"]).view(np.uint64)): r["n"] for r in rows}


def _merge_spans(parts: pd.Series) -> pd.Series:
    def one(lists) -> list[int]:
        out: list[int] = []
        for start, end in sorted((int(p[i]), int(p[i + 1])) for p in lists for i in range(0, len(p), 2)):
            if out and start <= out[-1]:
                out[-1] = max(out[-1], end)
            else:
                out += [start, end]
        return out

    return parts.map(one)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS,
                  name: str = "hits") -> DataFrame:
    """``docs`` with a struct column: n_words, spans (merged [start, end) word
    ranges covered by benchmark windows), items (ids found, sorted as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    chars = benchmark.select(F.sum(F.length(F.col(item_text)))).first()[0] or 0
    n_blocks = 1 + int(chars) // block_chars
    marked = []
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        index = Index([(r["item"], alnum_words(r["text"])) for r in part.collect()], window)  # bounded by block_chars
        index.choose_prefixes(_document_counts(docs, text, index))
        shared = spark.sparkContext.broadcast(index)

        def start(shared=shared):
            index = shared.value

            def chunk(texts: list[str | None]) -> list[tuple]:
                return [(len(words), *(index.hits(words) if index.windows else ([], [])))
                        for words in hashed_alnum_words(texts)]

            return chunk

        column = text_column(start, HITS, chunks=True)
        if n_blocks == 1:
            return docs.withColumn(name, column(F.col(text)))
        marked.append(docs.select(F.md5(F.col(text)).alias("key"), column(F.col(text)).alias("h"))
                      .filter(F.size("h.items") + F.size("h.spans") > 0)
                      .groupBy("key").agg(F.first("h").alias("h")).withColumn("block", F.lit(block)))
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    merge = F.pandas_udf(_merge_spans, "array<int>")
    key, spans, found = "__decontamination_key", "__decontamination_spans", "__decontamination_items"
    merged = (every.groupBy("key").agg(F.collect_list("h.spans").alias("s"), F.collect_list("h.items").alias("i"))
              .select(F.col("key").alias(key), merge("s").alias(spans), F.array_sort(F.array_distinct(F.flatten("i"))).alias(found)))
    count = text_column(lambda: lambda t: (len(alnum_words(t)),), "n long")
    return (docs.withColumn(key, F.md5(F.col(text))).join(merged, key, "left")
            .withColumn(name, F.struct(count(F.col(text))["n"].alias("n_words"),
                                       F.coalesce(spans, F.array().cast("array<int>")).alias("spans"),
                                       F.coalesce(found, F.array().cast("array<string>")).alias("items")))
            .drop(key, spans, found))


def covered_words(spans: str) -> Column:
    """Number of words inside merged [start, end) ranges."""
    places = F.sequence(F.lit(0), F.size(spans) - 1)
    return F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.aggregate(
        F.transform(places, lambda i: F.get(F.col(spans), i) * F.when(i % 2 == 0, -1).otherwise(1)),
        F.lit(0), lambda a, b: a + b)).cast("long")


def contaminated(name: str = "hits") -> Column:
    """Contract: a hit, and hit words at least 5 % of all."""
    hit = covered_words(f"{name}.spans")
    return (hit > 0) & (20 * hit >= F.col(f"{name}.n_words"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS rid
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS pos
        FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
grams AS (SELECT rid, pos, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win FROM places),
found AS (SELECT g.rid, g.pos, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.win = x.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
