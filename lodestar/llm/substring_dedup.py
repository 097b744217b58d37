"""Substring deduplication with compressed FM-indexes per shard.

A window is ``WINDOW`` = 35 consecutive words; a word goes if a window that covers
it also starts anywhere else.

1. Segments. Every window has a minimizer: the smallest hash among its
   seven-word grams. Consecutive windows with one minimizer form a segment.
   Equal windows have equal minimizers, so a minimizer that occurs once rules out
   all its windows; only segments with a repeated minimizer go on.
2. Classes. Segments with equal words are one class (64-bit content hash,
   pre-aggregated). All windows of a class with two members are repeated. What is
   left to search are classes of one segment whose minimizer has company.
3. Shards. Segments are dealt to shards by minimizer, so whatever could match
   meets in one shard, and a shard is sized by its number of words. A
   minimizer with more than ``hot`` classes is dealt window by window, by the window's
   own hash. Per shard an FM-index is built over the classes' words, written as
   seven-word grams at each of seven offsets, so a window is a pattern of five
   symbols; backward search over the wavelet matrix gives the matching statistics
   of all streamed segments at once, and windows whose five symbols occur at
   two or more places are reported as intervals.
4. Intervals are put together per document and the words inside dropped.

Every step is a Spark job over all rows; no group of copies, passage or
minimizer is a task of its own, and copies are never expanded into pairs.

Cases: null, empty and wordless texts have no words; documents of fewer than 35
words keep all; equal rows (id and text) are each other's copies; rows with
equal or null ids are told apart by their text; only (id, text) are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import CHUNK, gram_hashes, hashed_space_words, mixed, written
from .fm_index import FMIndex

WINDOW = 35
GRAM = 7
SYMBOLS = WINDOW // GRAM
LONGEST = 64            # windows in a segment
HOT = 5_000             # classes of one minimizer
SHARD_WORDS = 1_000_000


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    step, done = values, 1
    while 2 * done <= width:
        step = np.minimum(step[:-done], step[done:])
        done *= 2
    extra = width - done
    return np.minimum(step[:len(step) - extra], step[extra:]) if extra else step


def content_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words in each [start, end): a polynomial from prefix sums."""
    common._Powers.to(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * common._Powers.up[:len(hashes)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * common._Powers.down[starts] + length)


def segments_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, windows, minimizer, content hash, weight (2 if the minimizer
    occurs again in the text) of each segment of a text."""
    if len(hashes) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    grams = gram_hashes(hashes, GRAM)
    least = _sliding_least(grams, WINDOW - GRAM + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(least)))
    if sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(sizes, parts) - nth * LONGEST
        starts, sizes = np.repeat(starts, parts) + nth * LONGEST, np.minimum(left, LONGEST)
    minimizer = least[starts]
    ordered = np.sort(grams)
    again = np.searchsorted(ordered, minimizer, "right") - np.searchsorted(ordered, minimizer) > 1
    return starts, sizes, minimizer, content_hashes(hashes, starts, starts + sizes + WINDOW - 1), again + 1


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            found = [segments_of(w.hashes) for w in hashed_space_words(part.column(2).to_pylist())]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            start, windows, minimizer, content, weight = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(start.astype(np.int32)),
                 pa.array(windows.astype(np.int32)), pa.array(minimizer.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array(weight.astype(np.int32))], ["id", "th", "start", "windows", "m", "ch", "weight"])


def _repeated_windows(strings: list[np.ndarray], asked: np.ndarray) -> list[np.ndarray]:
    """For each asked segment (word hashes) of a shard, which windows occur at
    two or more places of the shard."""
    grams = [gram_hashes(s, GRAM) for s in strings]
    known, ids = np.unique(np.concatenate(grams), return_inverse=True)
    ids = np.split(ids.reshape(-1) + 1, np.cumsum([len(g) for g in grams])[:-1])
    gap = np.zeros(1, np.int64)
    text = np.concatenate([x for s in ids for offset in range(GRAM) for x in (s[offset::GRAM], gap)])
    index = FMIndex(text, len(known), SYMBOLS)
    streamed = [ids[i] for i in np.flatnonzero(asked)]
    reach = GRAM * (SYMBOLS - 1)
    patterns = np.concatenate([np.stack([s[k * GRAM:len(s) - reach + k * GRAM] for k in range(SYMBOLS)], axis=1) for s in streamed])
    found = index.matched(patterns, 2) == SYMBOLS
    return np.split(found, np.cumsum([len(s) - reach for s in streamed])[:-1])


def _search_shard(table: pa.Table) -> pa.Table:
    """One shard's rows (id, th, start, m, ch, offset, asked, words) -> covered word ranges."""
    key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("m", "ch", "offset")], axis=1)
    _, first = np.unique(key, axis=0, return_index=True)  # equal rows bring equal segments
    table = table.take(pa.array(np.sort(first)))
    asked = table.column("asked").to_numpy(zero_copy_only=False)
    rows, begins, ends = [], [], []
    if asked.any():
        strings = [np.frombuffer(w.as_buffer(), np.uint64) for w in table.column("words")]
        start = (table.column("start").to_numpy() + table.column("offset").to_numpy()).astype(np.int64)
        for row, flags in zip(np.flatnonzero(asked), _repeated_windows(strings, asked)):
            edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
            rows += [row] * (len(edges) // 2)
            begins += (start[row] + edges[::2]).tolist()
            ends += (start[row] + edges[1::2] + WINDOW - 1).tolist()
    at = pa.array(rows, pa.int64())
    return pa.table([table.column("id").take(at), table.column("th").take(at), pa.array(begins, pa.int32()),
                     pa.array(ends, pa.int32())], ["id", "th", "begin", "end"])


def repeated_ranges(docs: DataFrame, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, th, text) -> (id, th, begin, end): word ranges covered by repeated windows."""
    kind = docs.schema["id"].dataType.simpleString()
    found = written(docs.filter(F.length("text") >= 2 * WINDOW - 1).select("id", "th", "text").mapInArrow(
        _segments, f"id {kind}, th long, start int, windows int, m long, ch long, weight int"), "segments")
    twice = found.groupBy("m").agg(F.sum("weight").alias("w")).filter(F.col("w") > 1).select("m")
    candidates = written(found.join(twice, "m", "left_semi").drop("weight"), "candidates")
    one = F.struct("id", "th", "start", "windows")
    classes = written(candidates.groupBy("m", "ch").agg(F.count(F.lit(1)).alias("n"), F.first(one).alias("s"))
                      .select("m", "ch", "n", "s.*"), "classes")
    # classes that must be searched for or in: all of a minimizer with several, or a lone segment (repeats inside it)
    company = classes.groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    company = company.filter(F.col("least") == 1).select("m", (F.col("k") > hot).alias("spread"))
    searched = written(classes.join(company, "m"), "searched")
    words = searched.agg(F.sum(F.when(F.col("spread"), F.col("windows") * WINDOW).otherwise(F.col("windows") + WINDOW - 1))).first()[0]
    shards = 1 + int(words or 0) // shard_words
    wanted = searched.groupBy("id", "th").agg(F.collect_list(F.struct(
        "start", "windows", "m", "ch", (F.col("n") == 1).alias("asked"), "spread")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows, out = [], []
                for row, (text, want) in enumerate(zip(hashed_space_words(part.column(2).to_pylist()), part.column(3).to_pylist())):
                    for w in want:
                        a, n = w["start"], w["windows"]
                        pieces = [(i, 1) for i in range(n)] if w["spread"] else [(0, n)]
                        for offset, size in pieces:
                            words = text.hashes[a + offset:a + offset + size + WINDOW - 1]
                            place = int(gram_hashes(words, WINDOW)[0]) if w["spread"] else w["m"] % (1 << 64)
                            rows.append(row)
                            out.append((int(place % shards), a, w["m"], w["ch"], offset, w["asked"], words.tobytes()))
                rows = pa.array(rows, pa.int64())
                columns = list(zip(*out)) or [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    ["id", "th", "shard", "start", "m", "ch", "offset", "asked", "words"])

    texts = docs.filter(F.length("text") >= 2 * WINDOW - 1).select(F.col("id").alias("i"), F.col("th").alias("h"), "text")
    dealt = (texts.join(wanted, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")))
             .select("id", "th", "text", "want").mapInArrow(
                 cut, f"id {kind}, th long, shard long, start int, m long, ch long, offset int, asked boolean, words binary"))
    searched_for = dealt.groupBy("shard").applyInArrow(_search_shard, f"id {kind}, th long, begin int, end int")
    copies = (candidates.join(classes.filter(F.col("n") > 1).select("m", "ch"), ["m", "ch"], "left_semi")
              .select("id", "th", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("end")))
    return copies.unionByName(searched_for)


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    ranges = (repeated_ranges(rows, hot, shard_words).groupBy("id", "th")
              .agg(F.collect_list(F.struct("begin", "end")).alias("ranges")).withColumnsRenamed({"id": "i", "th": "h"}))
    joined = rows.join(ranges, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left").select("id", "text", "ranges")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                n_words, n_removed, kept = [], [], []
                for words, column in zip(map(common.space_words, part.column(1).to_pylist()), part.column(2)):
                    gone = np.zeros(len(words) + 1, np.int64)
                    if column.is_valid:
                        begin, end = (np.asarray(column.values.field(f)) for f in ("begin", "end"))
                        np.add.at(gone, begin, 1)
                        np.add.at(gone, end, -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(stays.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(drop, f"doc_id {kind}, n_words long, n_removed long, kept string")
