"""Tokenisers and string helpers as built-in Column expressions.

All patterns avoid ``\\w`` and ``\\s``: Python treats them as Unicode classes,
Java and RE2 as ASCII. The explicit classes below mean the same thing in
Spark (java.util.regex) and in DuckDB (RE2), so oracles can reuse them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

# Python's str.isspace() set, i.e. what ``str.split()``/``str.strip()`` and
# the ``\s`` of Python's ``re`` treat as whitespace.
WS = (
    r"\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Unicode word character (Python ``\w`` on str patterns).
WORD = r"\p{L}\p{N}_"
STRIP_RE = rf"^[{WS}]+|[{WS}]+$"
# The same set as literal characters, for trim(): no regex needed to strip.
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# Plain characters first: their class is one table lookup a character, the class with
# all whitespace a chain of tests. Joined, the runs hold the same characters.
BM25_KEEP_RE = rf"[a-z0-9 ]++|[a-z0-9{WS}]++"
BM25_SPLIT_RE = rf"[{WS}]+"
TFIDF_TOKEN_RE = rf"[{WORD}]{{2,}}"
WORD_TOKEN_RE = rf"[{WORD}]+"
ALNUM_RE = r"[\p{L}\p{N}]"
URL_ID_RE = C.URL_ID_RE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.trim(col(c), F.lit(WS_CHARS))


def tokens_bm25(c: Column | str) -> Column:
    """Tokeniser 1: lower, delete ``[^a-z0-9\\s]``, split on whitespace.

    The runs of characters to keep are joined, which is the deletion: reading
    runs costs a seventh of replacing every dropped character. Only ``[a-z0-9]`` and
    whitespace remain, so the whitespace-separated tokens are exactly the maximal
    ``[a-z0-9]+`` runs (no empty tokens to filter)."""
    cleaned = F.array_join(F.regexp_extract_all(F.lower(col(c)), F.lit(BM25_KEEP_RE), 0), "")
    return F.regexp_extract_all(cleaned, F.lit("[a-z0-9]+"), 0)


def tokens_tfidf(c: Column | str, stop_words=C.TFIDF_STOP_WORDS) -> Column:
    """Tokeniser 2: lower, tokens of two or more word characters, minus stop words."""
    toks = F.regexp_extract_all(F.lower(col(c)), F.lit(TFIDF_TOKEN_RE), 0)
    if not stop_words:
        return toks
    return F.filter(toks, lambda t: ~t.isin(list(stop_words)))


def tokens_words(c: Column | str) -> Column:
    """Tokeniser 3: lower, maximal runs of word characters."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_TOKEN_RE), 0)


def has_alnum(c: Column | str) -> Column:
    return col(c).rlike(ALNUM_RE)


def doc_url(doc_id: Column | str) -> Column:
    return F.concat(F.lit(C.DOC_URL_PREFIX), col(doc_id).cast("string"))


def extract_id(url: Column | str) -> Column:
    """Trailing digits of a URL (optional final ``/``); anything else gives ``"0"``."""
    return F.coalesce(F.nullif(F.regexp_extract(col(url), URL_ID_RE, 1), F.lit("")), F.lit("0"))


def usable_part(c: Column | str) -> Column:
    """A title/abstract part counts only when non-empty and not the literal N/A."""
    c = col(c)
    return F.when(c.isNotNull() & (c != "") & (c != C.NOT_AVAILABLE), c)
