"""Helpers shared by the operators: word patterns, word hashing, row-wise
Python columns, written intermediates."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# Fixed values of the contracts: white space, and the word characters of
# the two word patterns ``[^\x20\x09-\x0D]+`` and
# ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
SPACE = " \t\n\x0b\x0c\r"
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))

MIX = np.uint64(0x9E3779B97F4A7C15)


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split() cuts at exactly these)."""
    return text.encode("utf-8").split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8").translate(_ALNUM).split() if text else []


_SPACES = bytes(0x20 if b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18  # bytes hashed at a time


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if n > len(cls.up):
            n = max(n, 2 * len(cls.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table, dtype=np.uint64))


class HashedWords:
    """The words of a text: where they stand in a UTF-8 buffer, and a 64-bit
    hash of each that depends on the word alone."""

    __slots__ = ("data", "starts", "ends", "hashes")

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.data, self.starts, self.ends, self.hashes = data, starts, ends, hashes

    def __len__(self) -> int:
        return len(self.starts)

    def slice(self, a: int, b: int) -> tuple[bytes, ...]:
        return tuple(self.data[i:j] for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in each word's bytes, for all words at once from prefix
    sums, then mixed; the buffer is taken in pieces cut between words."""
    parts, done = [np.empty(0, np.uint64)], 0
    while done < len(starts):
        first = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, first + _PIECE, "right")))
        a, b = starts[done:upto] - first, ends[done:upto] - first
        _Powers.to(int(b[-1]) + 1)
        codes = buffer[first:first + b[-1]].astype(np.uint64)
        codes += np.uint64(1)
        codes *= _Powers.up[:len(codes)]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        parts.append(mixed((sums[b] - sums[a]) * _Powers.down[a]))
        done = upto
    return np.concatenate(parts)


def hashed_words(texts: list[str | None], table: bytes) -> list[HashedWords]:
    """The hashed words of some texts, found in one joined buffer."""
    encoded = [t.encode("utf-8") if t else b"" for t in texts]
    data = b" ".join(encoded).translate(table)
    buffer = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buffer) + 2, bool)
    np.not_equal(buffer, 0x20, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = _word_hashes(buffer, starts, ends)
    last = np.searchsorted(starts, np.cumsum([len(e) + 1 for e in encoded])).tolist()
    return [HashedWords(data, starts[a:b], ends[a:b], hashes[a:b]) for a, b in zip([0, *last], last)]


def hashed_space_words(texts: list[str | None]) -> list[HashedWords]:
    return hashed_words(texts, _SPACES)


def hashed_alnum_words(texts: list[str | None]) -> list[HashedWords]:
    return hashed_words(texts, _ALNUM)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive symbols (len(h) - k + 1 values).

    A polynomial in the symbols' hashes, built by doubling, then mixed: equal
    runs get equal values wherever they stand."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    base = MIX | np.uint64(1)
    done, out, step, power = 0, None, h, base
    width = 1
    with np.errstate(over="ignore"):
        rest = k
        while rest:
            if rest & 1:
                if out is None:
                    out, done = step, width
                else:  # out covers `done` symbols, step the following `width`
                    n = len(h) - (done + width) + 1
                    out = out[:n] * power + step[done:done + n]
                    done += width
            rest >>= 1
            if rest:
                n = len(h) - 2 * width + 1
                step = step[:n] * power + step[width:width + n]
                power = power * power
                width *= 2
        return mixed(out + np.uint64(k))


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run [start, end) of symbols with the hashes ``h``, by prefix
    sums: equal runs get equal values wherever they stand."""
    _Powers.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _Powers.up[:len(h)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64) * MIX)


CHUNK = 32


def text_column(fn: Callable[[], Callable], schema: str, chunks: bool = False) -> Callable[[Column], Column]:
    """A struct column computed from a text, inside Arrow batches.

    ``fn()`` is called once per task and returns the function of one text
    (``None`` for null) to one tuple, or with ``chunks`` the function of a short
    list of texts to a list of tuples. The column is marked non-deterministic
    so that the optimizer never evaluates it twice (in a filter and again in a
    projection)."""
    kind = T.StructType.fromDDL(schema)
    names = kind.names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        each = fn()
        for series in batches:
            rows: list[tuple] = []
            for at in range(0, len(series), CHUNK):
                texts = [t if isinstance(t, str) else None for t in series.iloc[at:at + CHUNK]]
                rows += each(texts) if chunks else map(each, texts)
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="object") for i, n in enumerate(names)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, returnType=kind).asNondeterministic()


def scratch(spark: SparkSession) -> None:
    """Intermediates go to ``spark.checkpoint.dir``. Only a local session that
    names no such folder (tests) gets a private one."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="lodestar-llm-")
        spark.conf.set("spark.checkpoint.dir", path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder, read back:
    lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    scratch(spark)
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words (null: 0), JVM-side."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return (F.when(trimmed == "", F.lit(0))
            .otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))).cast("long")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the session was started
    elsewhere (a cluster gets it with ``--py-files`` or by installation)."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
