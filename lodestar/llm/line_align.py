"""Line deduplication by pairwise alignment.

Documents that overlap are found through shared line hashes, each pair is
aligned with patience diff, and the aligned common blocks are deleted from the
later document (by id).

Pairs. A passage is a run of lines with at least ``min_words`` words that has too
few without its last or without its first line; a line of so many words is a passage
alone. Runs that long are what is rare: shorter lines alone are boilerplate, not
overlap, and are no features. Every distinct passage of a document is a hashed feature,
whatever its frequency. A feature held by several documents is owned by the earliest,
and each other holder is paired with the owner. So a group of any size gives one pair per holder and
owner, never all pairs within the group. Every common block of enough words consists of
passages, so each part of it is met in a pair with some owner.

Alignment. What travels is not the documents but the lines of their shared passages: of the
later document all of them, of the owner the first place of each. A pair's lines are put together in
their order, with a mark wherever lines are missing between, and aligned. One alignment keeps one
increasing run and needs lines that are single on both sides; what it leaves (blocks in another order,
repeated lines) is aligned again, a passage of the later document with the owner's place of the
same feature, until every shared passage was met. Only lines that an alignment matched are deleted.

Blocks shorter than ``min_words`` words are left. Deletion is decided on the
input: a block is deleted because an earlier document has it, whatever becomes of
later ones, and the earliest holder keeps it.

Cases: null texts have no lines and stay as they are; empty lines and lines of
white space are never features alone and are deleted only inside a common block;
rows with the same id and text are one document (each row gets the same
result); a null id counts as later than any other; equal ids are ordered
by the hash of their text; a document without lines left has an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, run_hashes, word_count, written

MIN_WORDS = 5
PIECE = 200


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) whose second increases too."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience_matches(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Matched places (i, j), increasing in both, a[i] == b[j].

    Equal heads and tails match; then the lines that occur once on each side are
    the anchors, the longest increasing run of them is matched, and the
    gaps between are treated alike."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if count_b[b[j]] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(a0, a1) if count_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            matched.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(matched)


def common_blocks(earlier: Sequence[Hashable], later: Sequence[Hashable]) -> list[int]:
    """[start, end) line ranges of ``later`` that are common blocks, flat."""
    out: list[int] = []
    last = (-2, -2)
    for i, j in patience_matches(earlier, later):
        if (i - 1, j - 1) == last:
            out[-1] = j + 1
        else:
            out += [j, j + 1]
        last = (i, j)
    return out


def _in_order(lines: dict[int, int], side: str) -> tuple[list[int], list[Hashable]]:
    """Places and lines in the document's order; a mark like no other line where lines are missing between."""
    places: list[int] = []
    out: list[Hashable] = []
    for place in sorted(lines):
        if places and place != places[-1] + 1:
            places.append(-1)
            out.append((side, place))
        places.append(place)
        out.append(lines[place])
    return places, out


def align_passages(shared: list[tuple[int, int, Sequence[int], Sequence[int]]]) -> list[int]:
    """Flat [start, end) line ranges of the later document, from the passages that it shares
    with one owner: (start, the owner's start, own lines, the owner's lines)."""
    mine: dict[int, int] = {}
    theirs: dict[int, int] = {}
    for start, start0, lines, lines0 in shared:
        mine.update(zip(range(start, start + len(lines)), lines))
        theirs.update(zip(range(start0, start0 + len(lines0)), lines0))
    places, later = _in_order(mine, "later")
    _, earlier = _in_order(theirs, "earlier")
    out: list[int] = []
    block_end: dict[int, int] = {}  # place -> end of its block
    flat = common_blocks(earlier, later)
    for a, b in zip(flat[::2], flat[1::2]):
        start, end = places[a], places[b - 1] + 1
        out += [start, end]
        block_end.update(dict.fromkeys(range(start, end), end))
    for start, _, lines, lines0 in shared:
        if block_end.get(start, 0) < start + len(lines):
            flat = common_blocks(lines0, lines)
            out += [start + n for n in flat]
            if flat == [0, len(lines)]:
                block_end.update((n, max(block_end.get(n, 0), start + len(lines))) for n in range(start, start + len(lines)))
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each later document, from the passages that it shares with all its owners;
    ``PIECE`` documents leave Arrow's columns at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            held = part["p"].flatten()
            columns = dict(zip((f.name for f in held.type), held.flatten()))
            start, start0 = columns["s"].to_numpy().tolist(), columns["s0"].to_numpy().tolist()
            owner = list(zip(columns["id0"].to_pylist(), columns["th0"].to_numpy().tolist()))
            lines, lines0 = (columns[c].flatten().to_numpy() for c in ("lines", "lines0"))
            ends, ends0 = (np.cumsum(columns[c].value_lengths().to_numpy()).tolist() for c in ("lines", "lines0"))
            out, n = [], 0
            for count in part["p"].value_lengths().to_pylist():
                owners = defaultdict(list)
                for k in range(n, n + count):
                    own = lines[ends[k - 1] if k else 0:ends[k]].tolist()
                    owners[owner[k]].append((start[k], start0[k], own, lines0[ends0[k - 1] if k else 0:ends0[k]].tolist()))
                n += count
                out.append([x for shared in owners.values() for x in align_passages(sorted(shared, key=lambda x: x[:2]))])
            yield pa.RecordBatch.from_arrays([part["i"], part["h"], pa.array(out, pa.list_(pa.int32()))], ["i", "h", "blocks"])


def without_blocks(text: str, blocks: list[int], min_words: int = MIN_WORDS) -> tuple[str, int, int]:
    """The text without the lines of blocks that have enough words; lines, lines deleted."""
    lines = text.split("\n")
    words = [len(line.encode("utf-8").split()) for line in lines] if blocks else []
    gone = set()
    for start, end in zip(blocks[::2], blocks[1::2]):
        if sum(words[start:end]) >= min_words:
            gone.update(range(start, end))
    return "\n".join(line for n, line in enumerate(lines) if n not in gone), len(lines), len(gone)


def passages(lines: pd.Series, words: pd.Series, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Start, end, hash and document (its place in the series, ascending) of every passage
    of some documents (line hashes and words), all at once."""
    sizes = np.array([len(h) for h in lines], np.int64)
    last = np.cumsum(sizes)
    if not len(last) or not last[-1]:
        return (np.empty(0, np.int64),) * 4
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first, last, n = (last - sizes)[owner], last[owner], np.arange(last[-1])
    upto = np.concatenate([[0], np.cumsum(np.concatenate(list(words)), dtype=np.int64)])
    ends = np.searchsorted(upto, upto[:-1] + min_words)  # the shortest from each line on
    starts = np.searchsorted(upto, upto[1:] - min_words, "right") - 1  # and up to each line
    from_line, to_line = ends <= last, starts >= first
    to_line[from_line[np.maximum(starts, 0)] & (ends[np.maximum(starts, 0)] == n + 1)] = False  # the same run
    starts = np.concatenate([n[from_line], starts[to_line]])
    ends = np.concatenate([ends[from_line], n[to_line] + 1])
    order = np.argsort(owner[starts], kind="stable")
    starts, ends = starts[order], ends[order]
    hashes = run_hashes(np.concatenate(list(lines)).astype(np.int64).view(np.uint64), starts, ends).view(np.int64)
    return starts - first[starts], ends - first[starts], hashes, owner[starts]


def _features(lines: pd.Series, words: pd.Series, min_words: pd.Series) -> pd.DataFrame:
    starts, ends, hashes, place = passages(lines, words, int(min_words.iloc[0]))
    cut = np.searchsorted(place, np.arange(1, len(lines)))
    column = lambda x: pd.Series(np.split(x, cut), dtype="object", index=range(len(lines)))
    return pd.DataFrame({"f": column(hashes), "s": column(starts), "e": column(ends)})


def _pieces(fn: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """``fn`` over ``PIECE`` rows at a time, so that its arrays stay small."""
    def run(*columns: pd.Series) -> pd.DataFrame:
        done = [fn(*[c.iloc[k:k + PIECE] for c in columns]) for k in range(0, max(1, len(columns[0])), PIECE)]
        return pd.concat(done, ignore_index=True)

    return run


def passage_table(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, lines array<long>, words array<int>) -> one row per place of a passage:
    f (its hash), id, th, s (first line), lines."""
    found = F.pandas_udf(_pieces(_features), "f array<long>, s array<int>, e array<int>").asNondeterministic()
    each = F.transform(F.arrays_zip("x.f", "x.s", "x.e"), lambda p: F.struct(
        p["f"].alias("f"), p["s"].alias("s"), F.slice("lines", p["s"] + 1, p["e"] - p["s"]).alias("lines")))
    return (lines.select("id", "th", "lines", found("lines", "words", F.lit(min_words)).alias("x"))
            .select("id", "th", F.explode(each).alias("p")).select("p.f", "id", "th", "p.s", "p.lines"))


def overlapping(table: DataFrame) -> DataFrame:
    """Every place of a passage (``passage_table``) that an earlier document holds as well: id, th, s,
    lines, with the owner's id0, th0, s0, lines0 (its first place there)."""
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "s", "lines")
    document = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    owned = (table.groupBy("f").agg(F.min(place).alias("o"), F.max(document).alias("z"))
             .filter(F.col("z") != F.struct("o.last", "o.id", "o.th"))
             .select("f", F.col("o.id").alias("id0"), F.col("o.th").alias("th0"), F.col("o.s").alias("s0"), F.col("o.lines").alias("lines0")))
    return (table.join(owned, "f").drop("f")
            .filter(~(F.col("id").eqNullSafe(F.col("id0")) & (F.col("th") == F.col("th0")))))


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                      name: str = "aligned") -> DataFrame:
    """``docs`` with a struct column ``name``: text (what is left), n_lines, n_removed."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"))
    hashed = F.transform(F.split("t", "\n"), lambda x: F.when(F.btrim(x, F.lit(SPACE)) == "", F.lit(0)).otherwise(F.xxhash64(x)))
    counted = F.transform(F.split("t", "\n"), lambda x: word_count(x).cast("int"))
    lines = (rows.filter(F.col("t").isNotNull()).select("id", "th", hashed.alias("lines"), counted.alias("words"))
             .dropDuplicates(["id", "th"]))
    shared = overlapping(written(passage_table(lines, min_words), "passages"))
    blocks = (shared.groupBy(F.col("id").alias("i"), F.col("th").alias("h"))
              .agg(F.collect_list(F.struct("s", "lines", "id0", "th0", "s0", "lines0")).alias("p"))
              .mapInArrow(_align, f"i {lines.schema['id'].dataType.simpleString()}, h long, blocks array<int>"))

    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = [(t, 0, 0) if t is None else without_blocks(t, [] if b is None else b.tolist(), min_words) for t, b in zip(texts, found)]
        return pd.DataFrame({"text": pd.Series([x[0] for x in out], dtype="object"),
                             "n_lines": [x[1] for x in out], "n_removed": [x[2] for x in out]})

    apply = F.pandas_udf(apply, "text string, n_lines long, n_removed long").asNondeterministic()
    return (rows.join(blocks, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
            .select("row.*", apply("t", "blocks").alias(name)))
