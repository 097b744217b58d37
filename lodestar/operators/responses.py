"""Parsing of stored model responses (the remote client itself is not built).

Keyword responses: the first ``[...]`` (non-greedy, across lines) is used
when it is a list of string literals only (items trimmed, empty ones
dropped; ``[]`` gives no keyword); otherwise the whole text is split on
commas/newlines, each piece stripped of whitespace and then of
``' " [ ]`` and spaces, and pieces of one character or none are dropped.

Rewritten queries: stripped; the listed prefixes removed case-insensitively
(each at most once, in order, stripping again after each); outer quotes
removed; valid when longer than 3 characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import WS, py_strip

_STR = C.STRING_LITERAL_RE
LIST_RE = C.LIST_RE
STRING_LIST_RE = rf"^\[[{WS}]*(?:{_STR}(?:[{WS}]*,[{WS}]*{_STR})*[{WS}]*,?)?[{WS}]*\]$"
ITEM_RE = _STR
PIECE_SPLIT_RE = C.PIECE_SPLIT_RE
PIECE_TRIM = C.PIECE_TRIM


def _unquote(item):
    """The text of a string literal: quotes off, the named escapes resolved,
    any other escaped character (quotes, the backslash) kept as itself."""
    body = F.substring(item, F.lit(2), F.char_length(item) - 2)
    body = F.replace(body, F.lit("\\\\"), F.lit("\x01"))
    for escape, meaning in C.LITERAL_ESCAPES.items():
        body = F.replace(body, F.lit(escape), F.lit(meaning))
    return F.replace(F.regexp_replace(body, r"\\(['\"])", "$1"), F.lit("\x01"), F.lit("\\"))


def parse_keyword_responses(responses: DataFrame, key_cols=("id",)) -> DataFrame:
    """``responses(keys..., raw)`` -> ``(keys..., pos, keyword, parsed_list)``."""
    keys = list(key_cols)
    lst = F.regexp_extract("raw", LIST_RE, 1)
    is_list = (lst != "") & lst.rlike(STRING_LIST_RE)
    items = F.transform(F.regexp_extract_all(lst, F.lit(ITEM_RE), 0), lambda t: py_strip(_unquote(t)))
    items = F.filter(items, lambda t: t != "")
    pieces = F.transform(F.split("raw", PIECE_SPLIT_RE), lambda p: F.trim(py_strip(p), F.lit(PIECE_TRIM)))
    pieces = F.filter(pieces, lambda p: F.char_length(p) > 1)
    arr = F.when(is_list, items).otherwise(pieces)
    out = responses.select(*keys, is_list.alias("parsed_list"), F.posexplode(arr).alias("pos", "keyword"))
    return out.select(*keys, (F.col("pos") + 1).alias("pos"), "keyword", "parsed_list")


def clean_query_responses(responses: DataFrame, key_cols=("id",)) -> DataFrame:
    """``responses(keys..., raw)`` -> ``(keys..., query, valid)``."""
    keys = list(key_cols)
    x = py_strip(F.coalesce(F.col("raw"), F.lit("")))
    for prefix in C.QUERY_PREFIXES:
        x = F.when(F.lower(x).startswith(prefix.lower()),
                   py_strip(F.substring(x, len(prefix) + 1, 1 << 30))).otherwise(x)
    x = F.trim(x, F.lit("\"'"))
    return responses.select(*keys, x.alias("query"), (F.char_length(x) > 3).alias("valid"))


def conversation_responses(conversations: DataFrame) -> DataFrame:
    """Every turn of the conversation table as a stored response: ``(conv_id, turn, raw)``."""
    return conversations.select("conv_id", "turn", F.col("text").alias("raw"))
