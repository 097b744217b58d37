"""Product quantisation of vectors by value dictionaries.

A vector's components become integers floor(scale * x) and the vector is cut
into ``parts`` equal consecutive parts. Each part position has a codebook of at most
``entries`` integer entries, begun with the parts of the smallest ids and moved by
``rounds`` of assignment and averaging; a vector's code is the index of the nearest entry
of each part.

Method. Vectors are packed once into blocks of at most ``BLOCK_ROWS`` rows. A block holds, for
each dimension, the dictionary of its distinct integers and every row's code into it.
For a codebook, the squared differences of each distinct integer to all entries are
tabulated once per dimension and block (distinct values x entries); the distance of a row's
part to all entries is then a gather per dimension and an addition: no row is subtracted or
squared. Blocks bound the dictionaries, whatever the number of distinct values of the table.

A round is one pass over the blocks. Tasks send one row per used entry (counts and sums),
which Spark adds up; the driver sees the codebooks only: parts x entries x width numbers,
however many vectors there are. Blocks are a written table, so a lost executor costs its tasks.

Exactness. All is integer arithmetic. Ties go to the lower index; averages are floors; entries
that no part uses stay.

Cases: rows whose vector is null or holds null or non-finite components are dropped; a null id
never begins a codebook, its row is coded all the same; rows with equal ids are ordered by
their vectors when the codebooks are begun, and repeated rows each count; fewer rows
than entries give that many entries; vectors shorter than the longest are padded with zeros, and
the longest to a multiple of ``parts``; integers of 2**26 and more are an error; an empty table
gives an empty result. Only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import integer_matrix, whole, width as longest

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK_ROWS = 16_384

_BLOCK = "ids binary, no_id binary, labels binary, no_label binary, sizes binary, words binary, codes binary"


@dataclass
class Block:
    """Rows of a block by dimension: ``words[d]`` the distinct integers, ``codes[d]`` each row's place among them."""

    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    no_label: np.ndarray
    words: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, labels: pa.Array, matrix: np.ndarray) -> "Block":
        words, codes = [], np.empty((matrix.shape[1], len(matrix)), np.uint16)
        for d in range(matrix.shape[1]):
            distinct, codes[d] = np.unique(matrix[:, d], return_inverse=True)
            words.append(distinct)
        value = lambda a: np.asarray(a.fill_null(0), np.int64)
        none = lambda a: np.asarray(a.is_null())
        return cls(value(ids), none(ids), value(labels), none(labels), words, codes)

    def pack(self) -> dict[str, bytes]:
        sizes = np.array([len(w) for w in self.words], np.int64)
        return {"ids": self.ids.tobytes(), "no_id": self.no_id.tobytes(), "labels": self.labels.tobytes(),
                "no_label": self.no_label.tobytes(), "sizes": sizes.tobytes(),
                "words": np.concatenate([*self.words, np.empty(0, np.int64)]).tobytes(), "codes": self.codes.tobytes()}

    @classmethod
    def unpack(cls, row: dict[str, bytes]) -> "Block":
        sizes = np.frombuffer(row["sizes"], np.int64)
        ids = np.frombuffer(row["ids"], np.int64)
        words = np.split(np.frombuffer(row["words"], np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []
        return cls(ids, np.frombuffer(row["no_id"], bool), np.frombuffer(row["labels"], np.int64),
                   np.frombuffer(row["no_label"], bool), words,
                   np.frombuffer(row["codes"], np.uint16).reshape(len(sizes), len(ids)))

    def distances(self, part: int, book: np.ndarray) -> np.ndarray:
        """Squared distance of each row's part to every entry of that part's codebook (entries x span)."""
        entries, span = book.shape
        total = np.zeros((len(self.ids), entries), np.int64)
        for k in range(span):
            d = part * span + k
            table = (self.words[d][:, None] - book[None, :, k]) ** 2
            total += table[self.codes[d]]
        return total

    def nearest(self, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = self.distances(part, book)
        entry = total.argmin(1)
        return entry, total[np.arange(len(entry)), entry]

    def sums(self, d: int, entry: np.ndarray, entries: int) -> np.ndarray:
        """Sum of a dimension over the rows of every entry: each distinct integer times its rows there."""
        words = self.words[d]
        rows = np.bincount(self.codes[d].astype(np.int64) * entries + entry, minlength=len(words) * entries)
        return words @ rows.reshape(len(words), entries)


def _blocks_of(scale: int, dims: int, block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: table[c].combine_chunks()
            block = Block.of(column("id"), column("label"), integer_matrix(column("v"), scale, dims))
            return pa.RecordBatch.from_pylist([block.pack()])

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, block_rows - rows)
                held.append(batch.slice(0, take))
                rows += take
                batch = batch.slice(take)
                if rows == block_rows:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()
    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block.unpack(batch.slice(row, 1).to_pylist()[0])


def _sums(books: np.ndarray):
    """Counts and sums of the parts of every entry, once per task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, span = books.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, span), np.int64)
        for block in _unpacked(batches):
            for part in range(parts):
                entry, _ = block.nearest(part, books[part])
                counts[part] += np.bincount(entry, minlength=entries)
                for k in range(span):
                    sums[part, :, k] += block.sums(part * span + k, entry, entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e], pa.int64()),
            "total": pa.array(list(sums[p, e]), pa.list_(pa.int64()))})
    return add


def _codes(books: np.ndarray):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches):
            picked = [block.nearest(part, book) for part, book in enumerate(books)]
            entry = np.stack([e for e, _ in picked], 1).astype(np.uint8)
            hexed = entry.tobytes().hex()
            size = 2 * entry.shape[1]
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(block.ids, pa.int64(), mask=block.no_id),
                "label": pa.array(block.labels, pa.int64(), mask=block.no_label),
                "code": [hexed[i:i + size] for i in range(0, len(hexed), size)],
                "error": pa.array(sum(d for _, d in picked), pa.int64())})
    return code


@dataclass
class Codebooks:
    """``entries[part, entry, position]``; ``width`` components of a padded vector."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        picked = [self.entries[p, int(code[2 * p:2 * p + 2], 16)] for p in range(len(self.entries))]
        return np.concatenate(picked) / self.scale


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every kept vector, and the final codebooks."""
    if not 0 < entries <= 256 or not 0 < block_rows <= 1 << 16:
        raise ValueError("entries are two hex digits; a block's dictionary codes have 16 bits")
    kept = vectors.filter(whole(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                                                       F.col(vector).alias("v"))
    dims = -(-longest(kept, "v") // parts) * parts
    span = dims // parts
    first = kept.filter(F.col("id").isNotNull()).select("id", "v").orderBy("id", "v").limit(entries).collect()
    begun = integer_matrix(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, dims)
    books = np.ascontiguousarray(begun.reshape(len(first), parts, span).transpose(1, 0, 2))
    if not len(first):  # no id to begin with: one entry of zeros
        books = np.zeros((parts, 1, span), np.int64)
    blocks = written(kept.mapInArrow(_blocks_of(scale, dims, block_rows), _BLOCK), "vector_blocks")
    for _ in range(rounds):
        used = (blocks.mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
                .select("part", "entry", "n", F.posexplode_outer("total").alias("k", "s"))
                .groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
        books = books.copy()
        for r in used:
            if r["k"] is not None:
                books[r["part"], r["entry"], r["k"]] = r["s"] // r["n"]
    coded = blocks.mapInArrow(_codes(books), "vec_id long, label long, code string, error long")
    return coded, Codebooks(books, scale)


def vector_codes(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error (sum over equal labels, nulls together), codebooks_sha256."""
    coded, books = encode(vectors, **how)
    coded = written(coded, "vector_codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))


def _oracle() -> str:
    """The same in SQL, one common table per round."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS s FROM kept, (SELECT unnest(range({PARTS})) AS p))""",
             f"""b0 AS MATERIALIZED (SELECT p, e, s AS c FROM (
  SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES})"""]
    near = """a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, any_value(s) AS s, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT vec_id, label, parts.p, s, e, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN b{i} USING (p)) GROUP BY vec_id, p)"""
    move = """m{i} AS MATERIALIZED (
  SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY k) AS c FROM (
    SELECT p, best.e AS e, k, sum(s[k])::BIGINT AS t, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(s)) FROM parts) + 1)) AS k)
    GROUP BY ALL) GROUP BY p, e),
b{j} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))"""
    for i in range(ROUNDS):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(near.format(i=ROUNDS))
    return "WITH " + ",\n".join(steps) + f""",
coded AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
  sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY label),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN sums ON coded.label IS NOT DISTINCT FROM sums.label, book
"""


ORACLE = _oracle()
