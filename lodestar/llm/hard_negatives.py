"""Hard negatives by a vertical scan of columnar vectors (branch and bound on dimensions).

For each anchor row, its positives are the rows of its label with the highest scores (integer
inner products), and the negatives of a positive are the highest rows of other labels whose score
lies in a window given by the positive's score.

Method. Rows are packed once into blocks that hold one column per dimension, with its least
and greatest value. For an anchor the columns are read in descending magnitude of the
anchor's components. After every few columns a row's score lies between its partial sum plus the
least and plus the greatest that the unread columns can add; rows that cannot matter any more leave the
candidate bitmap. For positives that is an upper bound below the ``n_positives``-th best lower
bound; for negatives it is a score outside every window, or below the ``n_negatives``-th best
of each window that it can reach. What is left when all columns are read has exact scores, and its
exact windows are resolved. Nothing is approximate and no candidate is capped.

Distribution. Anchors, a stated set, are taken in passes of at most ``PASS_ANCHORS`` (dealt by hash); a
pass broadcasts that many vectors and reads all blocks once per phase. A task carries each
anchor's best from block to block, so later blocks are cut harder, and emits them once, at most
``n_positives`` rows an anchor or ``n_negatives`` a window; Spark ranks what the tasks found. Anchors
with equal positive scores share one window. Blocks, positives and negatives are written tables.

Cases: rows with a null label, a null vector or null or non-finite components take no part;
rows equal in id, label and vector are one row; a row with the anchor's own id is never its
positive or negative; a null id sorts last among ties and is never an anchor; a
positive score of 0 or less has the window that the inequality gives (0 alone, or none); anchors
without positives or windows without rows give no rows; vectors shorter than the longest are
padded with zeros; integers of 2**26 and more are an error; an empty table gives an empty result.
Only id, vector and label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written
from .vectors import integer_matrix, whole, width as longest

SCALE = 256
LABELS = 10
MOVED = 7
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
FLOOR_PERCENT, CEILING_PERCENT, POSITIVE_PERCENT = 30, 90, 100
BLOCK_ROWS = 8_192
PASS_ANCHORS = 16_384
READ = 4  # columns read between two looks at the bounds

NO_ID = np.iinfo(np.int64).max
LOW, HIGH = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4
_BLOCK = "ids binary, labels binary, least binary, greatest binary, columns binary"


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    columns: np.ndarray  # dimensions x rows

    @classmethod
    def of(cls, ids: pa.Array, labels: pa.Array, matrix: np.ndarray) -> "Block":
        columns = np.ascontiguousarray(matrix.T.astype(np.int32))
        return cls(np.asarray(ids.fill_null(int(NO_ID)), np.int64), np.asarray(labels, np.int64),
                   columns.min(1).astype(np.int64), columns.max(1).astype(np.int64), columns)

    def pack(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k in ("ids", "labels", "least", "greatest", "columns")}

    @classmethod
    def unpack(cls, row: dict[str, bytes]) -> "Block":
        ids, labels, least, greatest = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels", "least", "greatest"))
        return cls(ids, labels, least, greatest, np.frombuffer(row["columns"], np.int32).reshape(len(least), len(ids)))


class Scan:
    """One anchor's scan of one block: candidates, their partial scores and the reach of the unread columns."""

    def __init__(self, block: Block, vector: np.ndarray, candidates: np.ndarray):
        self.block, self.vector, self.rows = block, vector, candidates
        self.order = np.argsort(-np.abs(vector), kind="stable")
        a = vector[self.order]
        ends = np.stack([a * block.least[self.order], a * block.greatest[self.order]])
        after = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
        self.least, self.greatest = after(ends.min(0)), after(ends.max(0))
        self.partial = np.zeros(len(candidates), np.int64)

    def run(self, needed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of what ``needed(lower, upper)`` lets through to the last column."""
        for at in range(0, len(self.order), READ):
            if not len(self.rows):
                break
            for d in self.order[at:at + READ]:
                if self.vector[d]:
                    self.partial += self.vector[d] * self.block.columns[d][self.rows].astype(np.int64)
            read = min(at + READ, len(self.order))
            stay = needed(self.partial + self.least[read], self.partial + self.greatest[read])
            if not stay.all():
                self.rows, self.partial = self.rows[stay], self.partial[stay]
        return self.rows, self.partial


def _best(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` by score descending, then id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        high = scores >= floor
        scores, ids, labels = scores[high], ids[high], labels[high]
    first = np.lexsort((ids, -scores))[:k]
    return scores[first], ids[first], labels[first]


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value, or LOW where there are fewer."""
    return LOW if len(values) < k else int(np.partition(values, len(values) - k)[len(values) - k])


_NONE = (np.empty(0, np.int64),) * 3


class Positives:
    """The best rows of the anchor's own label."""

    def __init__(self, vector: np.ndarray, vec_id: int, label: int, k: int):
        self.vector, self.vec_id, self.label, self.k = vector, vec_id, label, k
        self.best = _NONE

    def read(self, block: Block) -> None:
        candidates = np.flatnonzero((block.labels == self.label) & (block.ids != self.vec_id))
        sure = _kth(self.best[0], self.k)
        rows, scores = Scan(block, self.vector, candidates).run(
            lambda lower, upper: upper >= max(sure, _kth(lower, self.k)))
        merged = [np.concatenate(x) for x in zip(self.best, (scores, block.ids[rows], block.labels[rows]))]
        self.best = _best(*merged, self.k)


def window_of(positive_score: int) -> tuple[int, int]:
    """Least and greatest negative score: 30 p <= 100 n <= 90 p."""
    return -(-FLOOR_PERCENT * positive_score // POSITIVE_PERCENT), CEILING_PERCENT * positive_score // POSITIVE_PERCENT


class Negatives:
    """The best rows of other labels in each of the anchor's windows."""

    def __init__(self, vector: np.ndarray, vec_id: int, label: int, scores: list[int], k: int):
        self.vector, self.vec_id, self.label, self.k = vector, vec_id, label, k
        self.windows = [(p, *window_of(p)) for p in sorted(set(scores))]
        self.windows = [w for w in self.windows if w[1] <= w[2]]
        self.best = {p: _NONE for p, _, _ in self.windows}

    def read(self, block: Block) -> None:
        if not self.windows:
            return
        candidates = np.flatnonzero((block.labels != self.label) & (block.ids != self.vec_id))

        def needed(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(lower), bool)
            for p, low, high in self.windows:
                inside = lower[(lower >= low) & (upper <= high)]
                floor = max(low, _kth(self.best[p][0], self.k), _kth(inside, self.k))
                stay |= (upper >= floor) & (lower <= high)
            return stay

        rows, scores = Scan(block, self.vector, candidates).run(needed)
        ids, labels = block.ids[rows], block.labels[rows]
        for p, low, high in self.windows:
            inside = (scores >= low) & (scores <= high)
            merged = [np.concatenate(x) for x in zip(self.best[p], (scores[inside], ids[inside], labels[inside]))]
            self.best[p] = _best(*merged, self.k)


def _blocks_of(scale: int, dims: int, block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            column = lambda c: table[c].combine_chunks()
            return pa.RecordBatch.from_pylist([Block.of(column("id"), column("label"), integer_matrix(column("v"), scale, dims)).pack()])

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, block_rows - sum(b.num_rows for b in held))
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(b.num_rows for b in held) == block_rows:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)
    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block.unpack(batch.slice(row, 1).to_pylist()[0])


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


_FOUND = "anchor int, anchor_id long, positive_score long, row_id long, score long, row_label long"


def _found(state: list[tuple[int, int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    lengths = [len(best[0]) for *_, best in state]
    column = lambda k: np.repeat(np.array([s[k] for s in state], np.int64), lengths)
    join = lambda k: np.concatenate([np.empty(0, np.int64), *[s[3][k] for s in state]])
    return pa.RecordBatch.from_pydict({
        "anchor": pa.array(column(0), pa.int32()), "anchor_id": column(1), "positive_score": column(2), "row_id": _ids(join(1)),
        "score": join(0), "row_label": join(2)})


def _find_positives(anchors, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids, labels = anchors.value
        state = [Positives(v, i, y, k) for v, i, y in zip(vectors, ids.tolist(), labels.tolist())]
        for block in _unpacked(batches):
            for one in state:
                one.read(block)
        yield _found([(n, one.vec_id, 0, one.best) for n, one in enumerate(state)])
    return find


def _find_negatives(anchors, windows, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, ids, labels), scores = anchors.value, windows.value
        state = [Negatives(v, i, y, scores.get(n, []), k) for n, (v, i, y) in enumerate(zip(vectors, ids.tolist(), labels.tolist()))]
        for block in _unpacked(batches):
            for one in state:
                one.read(block)
        yield _found([(n, one.vec_id, p, best) for n, one in enumerate(state) for p, best in one.best.items()])
    return find


def moved_label(vec_id: Column, label: Column, every: int = MOVED, labels: int = LABELS) -> Column:
    """The label that a row counts with: every ``every``-th id has the next one."""
    return F.when(vec_id % every == 0, (label + 1) % labels).otherwise(label)


def mine(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
         anchor_step: int = ANCHOR_STEP, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         block_rows: int = BLOCK_ROWS, pass_anchors: int = PASS_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, negative_label."""
    spark = vectors.sparkSession
    rows = (vectors.filter(whole(F.col(vector)) & F.col(label).isNotNull())
            .select(F.col(vec_id).cast("long").alias("id"), moved_label(F.col(vec_id), F.col(label).cast("long")).alias("label"),
                    F.col(vector).alias("v")).dropDuplicates())
    rows = written(rows, "negatives_rows")
    dims = longest(rows, "v")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(rows.repartition(tasks).mapInArrow(_blocks_of(scale, dims, block_rows), _BLOCK), "negatives_blocks")
    anchors = rows.filter(F.col("id") % anchor_step == 0)
    passes = -(-anchors.count() // pass_anchors)
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
              "negative_label int")
    path = scratch_path(spark, "negatives")
    for turn in range(max(1, passes)):
        dealt = anchors if passes < 2 else anchors.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(passes)) == turn)
        taken = dealt.select("id", "label", "v").orderBy("id", "label").toArrow()
        matrix = integer_matrix(taken["v"], scale, dims)
        sent = spark.sparkContext.broadcast((matrix, np.asarray(taken["id"], np.int64), np.asarray(taken["label"], np.int64)))
        order = [F.desc("score"), F.asc_nulls_last("row_id"), F.asc("row_label")]
        first = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
        positives = written(
            blocks.mapInArrow(_find_positives(sent, n_positives), _FOUND).withColumn("rank", first).filter(F.col("rank") <= n_positives)
            .select("anchor", "anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        scores: dict[int, list[int]] = {}
        for r in positives.select("anchor", "positive_score").distinct().collect():  # n_positives an anchor at most
            scores.setdefault(r["anchor"], []).append(r["positive_score"])
        first = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(*order))
        negatives = (
            blocks.mapInArrow(_find_negatives(sent, spark.sparkContext.broadcast(scores), n_negatives), _FOUND)
            .withColumn("rank", first).filter(F.col("rank") <= n_negatives)
            .select("anchor", "positive_score", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"),
                    F.col("row_label").cast("int").alias("negative_label")))
        part = positives.join(negatives, ["anchor", "positive_score"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "negative_label")
        part.write.mode("overwrite").parquet(f"{path}/{turn}")
        sent.destroy()
    return spark.read.schema(schema).parquet(*[f"{path}/{turn}" for turn in range(max(1, passes))])


ORACLE = f"""
WITH vecs AS MATERIALIZED (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM vecs a JOIN vecs r ON a.vec_id % {ANCHOR_STEP} = 0 AND r.vec_id IS DISTINCT FROM a.vec_id),
positives AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id))::INT AS rank,
  row_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {FLOOR_PERCENT} * positive_score <= {POSITIVE_PERCENT} * score AND {POSITIVE_PERCENT} * score <= {CEILING_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
