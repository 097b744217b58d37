"""Personal data: fixed patterns plus a skip-chain conditional random field.

The fixed patterns (e-mail, IP address, card number, phone number) find the base
spans. A conditional random field over the text's tokens then adds spans that the
patterns alone cannot see, such as credentials after a cue or a number
that is a phone number elsewhere in the same document.

Nodes are the words that hold a digit or an ``@``; every other word is fixed to
"outside" and enters through its neighbours' features. Neighbouring nodes share
chain potentials; distant nodes with the same or a similar token (equal after
stripping punctuation, or equal digits; six characters or more) share skip potentials, every
occurrence being tied to the first, so that any two are two steps apart however many there are.
Loopy belief propagation runs on all edges of a document at once until messages settle (loops
that never do end after a number of rounds that grows with the longest row of neighbours), so what
the document says in one place decides the label in another. Only messages whose inputs still change are
computed again.

Weights come from a bounded, documented sample (``sample_tokens`` distinct token rows, the
lowest by hash, each weighed by its count up to ``ROW_WEIGHT``; tied labels count up to ``TIE_WEIGHT``)
by pseudo-likelihood: labels are the base spans, for credentials a cue word before a long mixed
token, and for like tokens of the same document the label of one of them. A new span needs a
marginal of at least ``threshold``, the form its kind demands, and no overlap with a
base span. A node's features see the first 40 characters of its shape and the 48 characters before
it (two words); spans and forms are judged on the whole token.

Cases: null and empty texts have no spans; a text without digit or ``@`` is
done after one look; repeated rows are treated alike; rows keep any id; other
columns pass through. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Fixed values of the contract: kinds in order, and their patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = (*BASE_KINDS, "secret")
LABELS = ("outside", *KINDS)
N_LABELS = len(LABELS)
FEATURES = 256
SAMPLE_TOKENS = 12_000
THRESHOLD = 0.9
ROW_WEIGHT = 20
TIE_WEIGHT = 2
LOOP_ROUNDS = 60
SETTLED = 1e-4

NODE = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_CUE = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|auth|bearer)\b[\"']?\s*[=:]\s*[\"']?$")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=~^"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@`` (which no local part holds)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def valid(kind: str, text: str) -> bool:
    """Whether a text has the form its kind demands."""
    digits = _digits(text)
    if kind == "email":
        found = _emails(text)
        return found == [(0, len(text))]
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(0 < len(p) and _digits(p) == p and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return _LONG.fullmatch(text) is not None and bool(digits) and len(digits) < len(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if valid("ip", m.group()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Tokens:
    """The nodes of a document."""

    spans: list[tuple[int, int]]
    features: np.ndarray        # (n, per token) hashed feature numbers
    chain: np.ndarray           # (pairs, 2) nodes in a row
    skip: np.ndarray            # (pairs, 2) distant nodes with like tokens
    lone_left: np.ndarray       # the word before is no node
    lone_right: np.ndarray


def _key(core: str) -> str | None:
    digits = _digits(core)
    return digits if len(digits) >= 6 and len(digits) * 2 > len(core) else core.lower() if len(core) >= 6 else None


def _feature_numbers(text: str, start: int, end: int) -> list[int]:
    word = text[start:end]
    core = word.strip(_EDGE)
    digits = _digits(core)
    share = round(4 * len(digits) / max(len(core), 1))
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", core[:40]))[:12]
    before = text[max(0, start - 48):start]
    words = before.split()[-2:]
    names = [
        "one", f"size{min(len(core), 24) // 2}", f"digits{min(len(digits), 20)}", f"share{share}", f"shape{shape}",
        f"at{'@' in core}", f"dots{min(core.count('.'), 4)}", f"dash{min(core.count('-'), 3)}", f"plus{word[:1] == '+'}",
        f"bracket{word[:1] == '('}{word[-1:] == ')'}", f"quoted{word[:1] in '\"' + chr(39)}",
        f"cue{bool(_CUE.search(before))}", f"last{words[-1].lower().strip(_EDGE)[:12] if words else ''}{words[-1][-1:] if words else ''}",
        f"luhn{valid('card', core)}", f"ip{valid('ip', core)}", f"long{valid('secret', core)}",
    ]
    return [crc32(n.encode()) % FEATURES for n in names]


PER_TOKEN = 16


def tokens_of(text: str) -> Tokens | None:
    spans: list[tuple[int, int]] = []
    for m in NODE.finditer(text):
        start, floor = m.start(), spans[-1][1] if spans else 0
        while start > floor and text[start - 1] not in _SPACES:
            start -= 1
        spans.append((start, m.end()))
    if not spans:
        return None
    chain, skip, first = [], [], {}
    left, right = np.ones(len(spans), bool), np.ones(len(spans), bool)
    for n, (start, end) in enumerate(spans):
        if n and start - spans[n - 1][1] <= 8 and not text[spans[n - 1][1]:start].strip(" \t"):
            chain.append((n - 1, n))
            left[n] = right[n - 1] = False
        key = _key(text[start:end].strip(_EDGE))
        if key is not None and first.setdefault(key, n) != n:
            skip.append((first[key], n))
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    features = np.array([_feature_numbers(text, a, b) for a, b in spans])
    return Tokens(spans, features, pairs(chain), pairs(skip), left, right)


def weak_labels(text: str, tokens: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Base spans' kinds, credentials after a cue, and what has the form of a kind that a like token
    has elsewhere in the document."""
    out = np.zeros(len(tokens.spans), np.int64)
    at = 0
    for n, (start, end) in enumerate(tokens.spans):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        hit = next((k for a, k, b in spans[at:at + 4] if a < end and start < b), None)
        if hit is not None:
            out[n] = 1 + hit
        elif valid("secret", text[start:end].strip(_EDGE)) and _CUE.search(text[max(0, start - 48):start]):
            out[n] = LABELS.index("secret")
    said: dict[int, int] = {}  # first of like tokens -> label
    for a, b in tokens.skip.tolist():
        said[a] = said.get(a, 0) or int(out[a] or out[b])
    for a, b in [*tokens.skip.tolist(), *((a, a) for a in said)]:
        start, end = tokens.spans[b]
        if said[a] and not out[b] and valid(LABELS[said[a]], text[start:end].strip(_EDGE)):
            out[b] = said[a]
    return out


@dataclass
class Field:
    """Weights of the conditional random field."""

    unary: np.ndarray   # (FEATURES, labels)
    chain: np.ndarray   # (left label, right label)
    skip: np.ndarray    # (label, label), symmetric

    def marginals(self, t: Tokens, rounds: int | None = None) -> np.ndarray:
        """Loopy belief propagation, all messages at once, damped by half."""
        unary = self.unary[t.features].sum(axis=1)
        unary[t.lone_left] += self.chain[0]
        unary[t.lone_right] += self.chain[:, 0]
        edges = np.concatenate([t.chain, t.skip])
        if not len(edges):
            return _softmax(unary)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        e = len(edges)
        reverse = np.concatenate([np.arange(e) + e, np.arange(e)])
        kind = np.concatenate([np.zeros(len(t.chain), int), np.full(len(t.skip), 2)])
        kind = np.concatenate([kind, kind + (kind == 0)])
        weights = np.exp(np.stack([self.chain, self.chain.T, self.skip]))
        messages, belief = np.zeros((2 * e, N_LABELS)), unary.copy()
        active = np.arange(2 * e)
        for _ in range(LOOP_ROUNDS + 2 * _longest_row(t.chain) if rounds is None else rounds):
            cavity = belief[source[active]] - messages[reverse[active]]
            cavity -= cavity.max(axis=1, keepdims=True)
            new = np.log(np.einsum("el,elm->em", np.exp(cavity), weights[kind[active]]) + 1e-300)
            new -= new.mean(axis=1, keepdims=True)
            step = 0.5 * (new - messages[active])
            messages[active] += step
            np.add.at(belief, target[active], step)
            moved = active[np.abs(step).max(axis=1) > SETTLED]
            if not len(moved):
                break
            heard = np.zeros(len(belief), bool)
            heard[target[moved]] = True
            again = heard[source]
            again[moved] = True
            active = np.flatnonzero(again)
        return _softmax(belief)


def _longest_row(chain: np.ndarray) -> int:
    """Pairs in the longest row of neighbouring nodes (pairs in order)."""
    if not len(chain):
        return 0
    breaks = np.flatnonzero(chain[1:, 0] != chain[:-1, 1])
    return int(np.diff(np.concatenate([[-1], breaks, [len(chain) - 1]])).max())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(features: np.ndarray, left: np.ndarray, right: np.ndarray, skip: np.ndarray, labels: np.ndarray,
        penalty: float = 1e-3, rounds: int = 250) -> Field:
    """Maximum pseudo-likelihood: each token given its features and its
    neighbours' labels. skip: (n, labels) counts of the tied tokens' labels."""
    n = len(labels)
    x = np.zeros((n, FEATURES))
    np.add.at(x, (np.arange(n)[:, None], features), 1.0)
    one = np.eye(N_LABELS)
    design = np.hstack([x, one[left], one[right], skip])
    y, w = one[labels], np.zeros((design.shape[1], N_LABELS))
    v, step = w, 2.0 / max(np.square(design).sum(axis=1).mean(), 1e-9)
    for t in range(rounds):
        ahead = v - step * (design.T @ (_softmax(design @ v) - y) / n + penalty * v)
        v, w = ahead + t / (t + 3) * (ahead - w), ahead
    a, b, c = w[FEATURES:FEATURES + N_LABELS], w[FEATURES + N_LABELS:FEATURES + 2 * N_LABELS], w[-N_LABELS:]
    return Field(w[:FEATURES], np.clip((a + b.T) / 2, -3, 3), np.clip((c + c.T) / 2, -3, 3))


def _examples() -> Callable[[str | None], tuple]:
    """Text -> its tokens as training rows: features, labels of left, right, and tied tokens, own label."""
    def one(text: str | None) -> tuple:
        t = tokens_of(text) if text else None
        if t is None:
            return ([],)
        y = weak_labels(text, t, base_spans(text))
        left, right, skip = np.zeros(len(y), int), np.zeros(len(y), int), np.zeros((len(y), N_LABELS), int)
        left[t.chain[:, 1]], right[t.chain[:, 0]] = y[t.chain[:, 0]], y[t.chain[:, 1]]
        np.add.at(skip, (t.skip[:, 0], y[t.skip[:, 1]]), 1)
        np.add.at(skip, (t.skip[:, 1], y[t.skip[:, 0]]), 1)
        skip = np.minimum(skip, TIE_WEIGHT)
        rows = np.hstack([t.features, left[:, None], right[:, None], skip, y[:, None]])
        return (np.unique(rows, axis=0).tolist(),)

    return one


def train(docs: DataFrame, text: str = "text", sample_tokens: int = SAMPLE_TOKENS) -> Field | None:
    """Weights from at most ``sample_tokens`` distinct token rows of the corpus, the lowest by hash."""
    rows = (docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
            .select(F.explode(text_column(_examples, "rows array<array<int>>")(F.col("text"))["rows"]).alias("r"))
            .groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("r"), "r").limit(sample_tokens).collect())
    if not rows:
        return None
    r = np.repeat(np.array([x["r"] for x in rows]), [min(x["n"], ROW_WEIGHT) for x in rows], axis=0)
    k = PER_TOKEN
    return fit(r[:, :k], r[:, k], r[:, k + 1], r[:, k + 2:k + 2 + N_LABELS].astype(float), r[:, -1])


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Spans the field adds to the base ones."""
    t = tokens_of(text)
    if t is None:
        return []
    p = field.marginals(t)
    best = np.where(p.max(axis=1) >= threshold, p.argmax(axis=1), 0)
    joined = set(map(tuple, t.chain.tolist()))
    out, n, at = [], 0, 0
    while n < len(best):
        last = n
        while best[n] and (last, last + 1) in joined and best[last + 1] == best[n]:
            last += 1
        if best[n]:
            start, end = t.spans[n][0], t.spans[last][1]
            core = text[start:end].strip(_EDGE)
            start = text.index(core, start) if core else start
            end = start + len(core)
            while at < len(base) and base[at][2] <= start:
                at += 1
            free = not any(a < end and start < b for a, _, b in base[at:at + 8])
            if core and free and valid(LABELS[best[n]], core):
                out.append((start, int(best[n]) - 1, end))
        n = last + 1
    return out


SPANS = "spans array<struct<kind:string,start:int,stop:int,base:boolean>>"


def personal_data(docs: DataFrame, text: str = "text", name: str = "personal", threshold: float = THRESHOLD,
                  sample_tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """``docs`` with a struct column ``name``: all spans, by start, then kind as in ``KINDS``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text, sample_tokens))

    def start():
        field, worth = shared.value, re.compile("[0-9@]")

        def one(t: str | None) -> tuple:
            if not t or not worth.search(t):
                return ([],)
            base = base_spans(t)
            more = added_spans(t, field, base, threshold) if field else []
            return ([{"kind": KINDS[k], "start": a, "stop": b, "base": own}
                     for a, k, b, own in sorted([(*s, True) for s in base] + [(*s, False) for s in more])],)

        return one

    return docs.withColumn(name, text_column(start, SPANS)(F.col(text)))
