"""Language identification by hierarchical discrimination.

A text becomes a normalised vector of hashed character n-grams. A multinomial
logistic model predicts the language family; inside the family one-versus-one
linear support vector machines (squared hinge) separate the languages, the
language with most wins is predicted, margins break ties.

Models are fitted on the driver from a bounded, documented sample
(``sample_rows`` distinct texts, shared equally by the languages, the lowest by hash);
every document is then scored in its own row with the models broadcast (their
size is fixed by ``DIMENSIONS`` and the languages).

Cases: null texts and texts without a letter are ``und`` with score 0; without
anything to learn from every text is ``und``; languages outside ``FAMILIES``
form one more family; rows without an id are scored and never learned from; repeated
rows are scored alike; only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, text_column, written

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "iranian": ("fa", "ku", "ps"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("tr", "az", "kk", "uz"),
    "sinitic": ("zh", "yue"),
}
OTHER = "other"
DIMENSIONS = 2048
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 4000
SPREAD = 6  # standard deviations by which ranked hashes may be fewer than expected
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), OTHER)


def ngram_vector(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, length 1."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(DIMENSIONS)
    gram = np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        gram = gram[:n] * np.uint64(0x10001) + points[order - 1:]
        if order in ORDERS:
            at = mixed(gram + np.uint64(order << 56)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
            total += np.bincount(at.astype(np.int64), minlength=DIMENSIONS)
    out = np.sqrt(total)
    return (out / np.linalg.norm(out)).astype(np.float32)


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray                 # (DIMENSIONS + 1, families)
    languages: dict[str, list[str]]            # of each family
    pairs: dict[str, list[tuple[int, int]]]    # of each family's languages
    pair_weights: dict[str, np.ndarray]        # (DIMENSIONS + 1, pairs)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, np.float32(1))
        z = x @ self.family_weights
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        family = self.families[best]
        langs = self.languages[family]
        if len(langs) == 1:
            return langs[0], float(p[best])
        margins = x @ self.pair_weights[family]
        wins, sums, chance = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), m in zip(self.pairs[family], margins.tolist()):
            wins[i if m >= 0 else j] += 1
            sums[i], sums[j] = sums[i] + m, sums[j] - m
            q = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
            chance[i], chance[j] = chance[i] + q, chance[j] + 1 - q
        winner = max(range(len(langs)), key=lambda k: (wins[k], sums[k], -k))
        return langs[winner], float(p[best] * chance[winner] / (len(langs) - 1))


def _descend(gradient, shape: tuple[int, ...], step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent from zero."""
    w = v = np.zeros(shape)
    for t in range(rounds):
        ahead = v - step * gradient(v)
        v = ahead + t / (t + 3) * (ahead - w)
        w = ahead
    return w


def fit(x: np.ndarray, langs: list[str], penalty: float = 1e-4, rounds: int = 300) -> Model:
    """Family model and one-versus-one machines from sample vectors."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    known = sorted(set(langs))
    members = {f: [l for l in known if family_of(l) == f] for f in sorted({family_of(l) for l in known})}
    families = list(members)
    y = np.eye(len(families))[[families.index(family_of(l)) for l in langs]]

    def logistic(w):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return x.T @ (p - y) / len(x) + penalty * w

    family_weights = _descend(logistic, (x.shape[1], len(families)), 1.0, rounds) if len(families) > 1 else np.zeros((x.shape[1], 1))
    lang = np.array(langs)
    pairs, weights = {}, {}
    for f, own in members.items():
        pairs[f] = list(combinations(range(len(own)), 2))
        columns = []
        for i, j in pairs[f]:
            rows = x[(lang == own[i]) | (lang == own[j])]
            sign = np.where(lang[(lang == own[i]) | (lang == own[j])] == own[i], 1.0, -1.0)

            def hinge(w, rows=rows, sign=sign):
                slack = np.maximum(0, 1 - sign * (rows @ w))
                return -2 * rows.T @ (sign * slack) / len(rows) + penalty * w

            columns.append(_descend(hinge, (x.shape[1],), 0.25, rounds))
        weights[f] = np.array(columns).T.astype(np.float32) if columns else np.zeros((x.shape[1], 0), np.float32)
    return Model(families, family_weights.astype(np.float32), members, pairs, weights)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _vectors():
    return lambda t: (ngram_vector(t).tobytes() if t and _LETTER.search(t) else None,)


def last_hashes(rows: DataFrame, own: int) -> dict[str, int]:
    """(lang, h) -> per language its ``own``-th lowest distinct hash (all, if fewer: the highest). Hashes are spread
    evenly, so a language's count tells below which value that one lies: only the about ``own`` hashes under it are
    ranked, however many rows a language has. Two rows per language reach the driver."""
    hashes = written(rows.select("lang", "h").distinct(), "language_hashes")
    share = F.least(F.lit(1.0), F.lit(own + SPREAD * own ** 0.5 + SPREAD ** 2) / F.count(F.lit(1)))
    bounds = hashes.groupBy("lang").agg(share.alias("share")).collect()
    if not bounds:
        return {}
    within = F.create_map(*[F.lit(x) for r in bounds for x in (r["lang"], r["share"])])[F.col("lang")]
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = hashes.filter(F.col("h") / F.lit(2.0 ** 64) + 0.5 <= within).withColumn("n", nth).filter(F.col("n") <= own)
    return {r["lang"]: r["last"] for r in few.groupBy("lang").agg(F.max("h").alias("last")).collect()}


def train(docs: DataFrame, text: str, lang: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits from ``docs`` (already restricted to what may be learned from)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n_langs = rows.agg(F.approx_count_distinct("lang", 0.01)).first()[0]
    if not n_langs:
        return None
    # the sample is chosen on (lang, hash) alone; texts up to a language's last hash are then picked where they are
    # read, copies of one text once
    rows = rows.withColumn("h", F.xxhash64("text"))
    last = last_hashes(rows, max(2, sample_rows // n_langs))
    if not last:
        return None
    cut = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    sample = (rows.filter(F.col("h") <= cut[F.col("lang")])
              .select("lang", "h", text_column(_vectors, "v binary")(F.col("text")).alias("v")).select("lang", "h", "v.v")
              .dropDuplicates(["lang", "h"]).collect())
    sample = sorted(sample, key=lambda r: (r["lang"], r["h"]))
    sample = [r for r in sample if r["v"] is not None]
    if not sample:
        return None
    return fit(np.array([np.frombuffer(r["v"], np.float32) for r in sample]), [r["lang"] for r in sample])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3,
             held_out: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows outside the held-out fold."""
    fold = remainder(F.col(doc_id), folds)
    model = train(docs.filter(fold != held_out), text, lang, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        return lambda t: model.predict(ngram_vector(t)) if model and t and _LETTER.search(t) else (UNDETERMINED, 0.0)

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
                       text_column(start, "lang_pred string, score double")(F.col(text)).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
