"""Licence scan by ordered signature rules (DataFrame functions only).

A text becomes its lower-case words between single spaces. Texts that hold the longest
word of a keyword, be it inside a longer word, are looked at; those that hold a rule's whole keyword
(plain substring tests) meet that rule's regex, and every match is a detection: an interval of words with a label, a confidence
and the rule's priority. A detection inside another one's interval is
suppressed; of equal intervals the rule of higher priority stays. One running
maximum over a document's detections, longest first at each start, decides
that, so a document with very many detections costs no more than sorting them.

The base phrases are rules of their own that nothing suppresses.

Every text is read and normalised once: its number of words, and its words where they hold a gate word,
are written; rules, intervals and counts start from there.

Lower-casing A-Z uses the engine's ``lower`` where that changes other letters into other letters
outside ASCII only, which no base phrase holds and which never end a word. The two letters that
it would turn into ASCII (U+0130, U+212A) send their texts another way.

Cases: null, empty and wordless texts have no words and no labels (empty
strings, score 0, null places); rows with the same id and text are scanned alike;
null ids are kept; only (id, text) are read, so extra columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .license_rules import BASE, LICENSE_WORDS, Rule, rules

BASE_SCORE = 0.7


def joined_words(text: Column) -> Column:
    """' w0 w1 ... wn ' (no word: two spaces)."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a")), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    words = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.btrim(words), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_table(signatures: list[Rule]) -> Column:
    rows = [(n, r.label, r.keyword, r.pattern, r.score, False) for n, r in enumerate(signatures)]
    rows += [(n, label, phrase, phrase, BASE_SCORE, True) for n, (phrase, label) in enumerate(BASE.items(), len(rows))]
    return F.array(*[F.struct(F.lit(n).alias("priority"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"),
                              F.lit(f"(?<= )(?:{pattern})(?= )").alias("regex"), F.lit(float(score)).alias("score"),
                              F.lit(base).alias("base")) for n, label, keyword, pattern, score, base in rows])


def gate_words(signatures: list[Rule]) -> list[str]:
    """Words of which a text must hold one, alone or inside a longer word: the longest word of
    every keyword, and the spellings of ``licen``."""
    longest = {max(keyword.split(), key=len) for keyword in [*(r.keyword for r in signatures), *BASE]}
    return sorted(longest | set(LICENSE_WORDS if "licen" in longest else ()))


def gated(words: Column, signatures: list[Rule]) -> Column:
    """Whether the words hold a gate word, by the substring test of the rules' keywords. A gate word
    that holds another adds nothing; as the only element of an array the words are made once."""
    gates = gate_words(signatures)
    least = [w for w in gates if not any(v in w for v in gates if v != w)]
    return F.exists(F.array(words), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in least]))


def detections(docs: DataFrame, signatures: list[Rule]) -> DataFrame:
    """(id, th, words) -> id, th, priority, label, score, base, first, last (words, inclusive)."""
    hit = docs.select("id", "th", "words", F.explode(F.filter(
        _rule_table(signatures), lambda r: F.contains("words", r["keyword"]))).alias("r")).select("id", "th", "words", "r.*")
    found = (hit.withColumn("match", F.regexp_extract_all("words", F.col("regex"), F.lit(0)))
             .filter(F.size("match") > 0)
             .withColumn("before", F.slice(F.split("words", F.col("regex"), -1), F.lit(1), F.size("match"))))
    each = found.select("id", "th", "priority", "label", "score", "base", F.posexplode(F.arrays_zip(
        F.transform("before", _spaces).alias("gap"), F.transform("match", _spaces).alias("own"))).alias("n", "m"))
    each = each.select("*", F.col("m.gap").alias("gap"), F.col("m.own").alias("own")).distinct()
    # words before a match: the spaces of all gaps up to it and of all matches before it
    upto = Window.partitionBy("id", "th", "priority").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum(F.col("gap") + F.col("own")).over(upto) - F.col("own") - 1
    return each.withColumn("first", first).select("id", "th", "priority", "label", "score", "base", "first",
                                                  (F.col("first") + F.col("own")).alias("last"))


def surviving(found: DataFrame) -> DataFrame:
    """Detections that no other one's interval contains (base places all stay)."""
    order = (Window.partitionBy("id", "th", "base").orderBy("first", F.col("last").desc(), "priority")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (found.withColumn("reach", F.max("last").over(order))
            .filter(F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("last"))).drop("reach"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per document."""
    signatures = rules() if signatures is None else signatures
    # an array of one: the words are made once, whatever asks for them
    looked = F.transform(F.array(joined_words(F.col(text))), lambda w: F.struct(
        F.when(F.length(w) <= 2, F.lit(0)).otherwise(_spaces(w) - 1).cast("long").alias("n_words"),
        F.when(gated(w, signatures), w).alias("words")))[0]
    rows = written(docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), looked.alias("w"))
                   .select("id", "th", "w.n_words", "w.words"), "license_words")
    sizes = rows.select("id", "th", "n_words")
    found = surviving(detections(rows.filter("words IS NOT NULL").select("id", "th", "words"), signatures))
    by_doc = found.groupBy("id", "th").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    by_doc = by_doc.withColumnsRenamed({"id": "i", "th": "h"})
    return (sizes.join(by_doc, F.col("id").eqNullSafe(F.col("i")) & F.col("th").eqNullSafe(F.col("h")), "left")
            .select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))
