"""Quality rules on tokeniser fertility.

Public vocabularies are run over every text, word by word (each word preceded
by one space, so white space between words never counts): the byte-level BPE
vocabulary gives characters per token and the entropy of the text's tokens,
the sentence-piece vocabulary gives characters per token and the share of
byte-fallback tokens. A text is rejected when a measure leaves the band of
its main script, or when a base rule fails.

Tokens of a word must not depend on its neighbours, so each distinct word is
tokenised once per worker and remembered (up to a bound; the memory only saves
time). Words of plain letters, digits and signs are tokenised many at a time, one space before
each; words with any other character (white space of other kinds, marks, characters that a
vocabulary rewrites) each alone. Everything is a row-wise column: no shuffle, any number of rows.

``VOCABULARIES`` is a folder of public files that every executor must hold at the same path.

Cases: null and empty texts have zero counts, no measures and fail the base
rule; a text without letters has script ``none`` and its own band; repeated
rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, space_words, text_column

VOCABULARIES = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"
# Fixed value: the byte-level vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters that both vocabularies take as they are, whatever stands beside their word.
PLAIN = re.compile("[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03A1"
                   "\u03A3-\u03C9\u0410-\u044F\u05D0-\u05EA\u0627-\u063A\u0641-\u064A\u4E00-\u9FFF\uAC00-\uD7A3]+")

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

# First code point of each block of letters, and its script.
SCRIPT_BLOCKS = [
    (0x00, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xC0, "latin"),
    (0x250, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0x4DC0, "none"), (0x4E00, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "other"), (0xFE00, "none"),
    (0x20000, "han"), (0x32000, "none"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_BLOCKS})


@dataclass(frozen=True)
class Band:
    """Accepted range of each measure."""

    min_chars_per_token: float
    max_chars_per_token: float
    min_chars_per_piece: float
    max_fallback_share: float
    min_entropy: float  # bits per token


@dataclass(frozen=True)
class Bands:
    """Bands by main script of a text."""

    by_script: dict[str, Band] = field(default_factory=dict)
    default: Band = Band(0.30, 12.0, 0.30, 0.60, 4.0)


DEFAULT_BANDS = Bands(by_script={
    "latin": Band(1.60, 12.0, 1.60, 0.08, 4.5),
    "greek": Band(0.60, 12.0, 0.60, 0.30, 4.5),
    "cyrillic": Band(0.60, 12.0, 0.80, 0.30, 4.5),
    "han": Band(0.30, 6.0, 0.30, 0.60, 4.5),
    "none": Band(1.00, 12.0, 0.80, 0.30, 4.5),
})

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, script string, n_tokens long, n_pieces long, chars_per_token double, "
          "chars_per_piece double, fallback_share double, token_entropy double")


class Vocabulary:
    """Distinct words seen by this worker, with their tokens in both vocabularies."""

    def __init__(self, folder: str, limit: int = 250_000):
        import sentencepiece
        import tiktoken
        with open(f"{folder}/{BYTE_BPE}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens_word = np.zeros(max(ranks.values()) + 1, bool)
        self.opens_word[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.opens_piece = np.array([self.pieces.id_to_piece(i).startswith("\u2581") for i in range(len(self.is_byte))])
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.chars = self.used = 0
        self.sizes = np.zeros((4, 1024), np.int64)  # first token, tokens, pieces, byte pieces of a word
        self.tokens = np.zeros(8192, np.int32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit or self.chars > 20_000_000:
            self.reset()
        found = list(map(self.index.get, words))
        if None in found:
            new = dict.fromkeys(w for w, i in zip(words, found) if i is None)
            self._add(list(new))
            found = [self.index[w] if i is None else i for w, i in zip(words, found)]
        return np.array(found, np.int64)

    def _joined(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, tokens of each word, pieces and the word of each piece, of plain words."""
        if not plain:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        tokens = np.array(self.bpe.encode_ordinary(" " + " ".join(plain)), np.int32)
        of = np.cumsum(self.opens_word[tokens]) - 1  # no word holds a space: each space opens the next one
        pieces = np.array(self.pieces.encode(" ".join(plain)), np.int64)
        return tokens, np.bincount(of, minlength=len(plain)), pieces, np.cumsum(self.opens_piece[pieces]) - 1

    def _add(self, new: list[bytes]) -> None:
        at, n = len(self.index), len(new)
        texts = [w.decode("utf-8") for w in new]
        plain = [t for t in texts if PLAIN.fullmatch(t)]
        tokens, n_tokens, pieces, part_of = self._joined(plain)
        odd = [(w, t) for w, t in zip(new, texts) if not PLAIN.fullmatch(t)]
        if odd:
            more_tokens = [self.bpe.encode_ordinary(" " + t) for _, t in odd]
            more_pieces = [self.pieces.encode(t) for _, t in odd]
            count = lambda lists: np.fromiter(map(len, lists), np.int64, len(lists))
            tokens = np.concatenate([tokens, np.fromiter(chain.from_iterable(more_tokens), np.int32)])
            n_tokens = np.concatenate([n_tokens, count(more_tokens)])
            pieces = np.concatenate([pieces, np.fromiter(chain.from_iterable(more_pieces), np.int64)])
            part_of = np.concatenate([part_of, len(plain) + np.repeat(np.arange(len(odd)), count(more_pieces))])
        new = [t.encode("utf-8") for t in plain] + [w for w, _ in odd]
        if at + n > self.sizes.shape[1]:
            self.sizes = np.concatenate([self.sizes, np.zeros((4, max(n, at)), np.int64)], axis=1)
        if self.used + len(tokens) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros(max(len(tokens), len(self.tokens)), np.int32)])
        self.sizes[:, at:at + n] = (self.used + np.cumsum(n_tokens) - n_tokens, n_tokens,
                                    np.bincount(part_of, minlength=n),
                                    np.bincount(part_of, self.is_byte[pieces], minlength=n).astype(np.int64))
        self.tokens[self.used:self.used + len(tokens)] = tokens
        self.used += len(tokens)
        self.chars += sum(map(len, new))
        self.index.update(zip(new, range(at, at + n)))

    def text_tokens(self, ids: np.ndarray) -> np.ndarray:
        """The tokens of all words."""
        first, sizes = self.sizes[0, ids], self.sizes[1, ids]
        ends = np.cumsum(sizes)
        return self.tokens[np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)]


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    high = int(ids.max()) + 1
    pairs = ids[:-2] * high + ids[1:-1]
    if high ** 3 >= 2 ** 62:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, same, count = np.unique(pairs * high + ids[2:], return_inverse=True, return_counts=True)
    twice = count[same] > 1
    covered = np.zeros(len(ids), bool)
    covered[:-2] = twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


_STARTS = np.array([a for a, _ in SCRIPT_BLOCKS], np.uint32)
_CODES = np.array([SCRIPTS.index(s) for _, s in SCRIPT_BLOCKS])


def main_script(text: str) -> str:
    """Script of most letters (ties: the first by name)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if text.isascii():
        letters = ((points | 32) >= 97) & ((points | 32) <= 122)
        return "latin" if letters.any() else "none"
    count = np.bincount(_CODES[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(SCRIPTS))
    count[SCRIPTS.index("none")] = 0
    return SCRIPTS[int(count.argmax())] if count.any() else "none"


@cache
def vocabulary(folder: str) -> Vocabulary:
    """One per Python worker; later tasks of the worker find it filled."""
    return Vocabulary(folder)


NO_WORDS = (0, 0, 0, 0, 0, True, False, "none", 0, 0, None, None, None, None)


def measure(bands: Bands = DEFAULT_BANDS, vocabularies: str = VOCABULARIES) -> Callable[[], Callable]:
    def start():
        known = vocabulary(vocabularies)

        def one(text: str, ids: np.ndarray) -> tuple:
            n, chars = len(ids), len(text) - sum(map(text.count, SPACE))
            repeats = repeated_words(ids)
            failed = n < MIN_WORDS or 100 * repeats > 50 * n
            n_tokens, n_pieces, n_bytes = (int(x[ids].sum()) for x in known.sizes[1:])
            shares = np.unique(known.text_tokens(ids), return_counts=True)[1] / n_tokens
            entropy = -float(shares @ np.log2(shares))
            per_token, per_piece, fallback = chars / n_tokens, chars / max(n_pieces, 1), n_bytes / max(n_pieces, 1)
            script = main_script(text)
            band = bands.by_script.get(script, bands.default)
            fits = (band.min_chars_per_token <= per_token <= band.max_chars_per_token
                    and per_piece >= band.min_chars_per_piece and fallback <= band.max_fallback_share
                    and entropy >= band.min_entropy)
            return (n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed,
                    fits and not failed, script, n_tokens, n_pieces, per_token, per_piece, fallback, entropy)

        def chunk(texts: list[str | None]) -> list[tuple]:
            words = [space_words(t) for t in texts]
            ids = known.ids(list(chain.from_iterable(words)))
            ends = np.cumsum([len(w) for w in words])
            return [one(t, ids[e - len(w):e]) if w else NO_WORDS for t, w, e in zip(texts, words, ends)]

        return chunk

    return start


def fertility_rules(docs: DataFrame, text: str = "text", name: str = "fertility", bands: Bands = DEFAULT_BANDS,
                    vocabularies: str = VOCABULARIES) -> DataFrame:
    """``docs`` with a struct column ``name`` of base counts, measures and verdicts."""
    column: Callable[[Column], Column] = text_column(measure(bands, vocabularies), SCHEMA, chunks=True)
    return docs.withColumn(name, column(F.col(text)))
