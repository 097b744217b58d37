"""Snippets and result assembly for the top documents of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import doc_url, usable_part

SNIPPET_FIELDS = ["document", "text", "beginSection", "endSection", "offsetInBeginSection",
                  "offsetInEndSection", "rerank_score", "rerank_position"]


def snippet_text(title, abstract, found):
    """(text, section) columns: ``title. abstract`` when both are usable,
    else whichever exists, else a placeholder; cut to 247 chars + ``...``
    when longer than 250; no article -> ``[Details unavailable]``."""
    t, a = usable_part(title), usable_part(abstract)
    full = (F.when(t.isNotNull() & a.isNotNull(), F.concat(t, F.lit(". "), a))
            .when(t.isNotNull(), t).when(a.isNotNull(), a).otherwise(F.lit(C.TITLE_ABSTRACT_NA)))
    sec = (F.when(a.isNotNull(), F.lit("abstract")).when(t.isNotNull(), F.lit("title"))
           .otherwise(F.lit(C.NOT_AVAILABLE)))
    cut = F.when(F.char_length(full) > C.MAX_SNIPPET_LEN,
                 F.concat(F.substring(full, 1, C.MAX_SNIPPET_LEN - 3), F.lit("..."))).otherwise(full)
    text = F.when(found, cut).otherwise(F.lit(C.DETAILS_UNAVAILABLE))
    section = F.when(found, sec).otherwise(F.lit(C.NOT_AVAILABLE))
    return text, section


def build_snippets(top: DataFrame, details: DataFrame) -> DataFrame:
    """``top(keys..., doc_id, score, rank)`` + ``details(id, doc_id, title,
    abstract, found)`` -> one snippet row per ranked document."""
    keys = [c for c in top.columns if c not in ("doc_id", "score", "rank")]
    d = details.select("id", "doc_id", "title", "abstract", "found")
    j = top.join(d, ["id", "doc_id"], "left")
    found = F.coalesce(F.col("found"), F.lit(False))
    text, section = snippet_text(F.col("title"), F.col("abstract"), found)
    return j.select(
        *keys, "doc_id",
        doc_url("doc_id").alias("document"), text.alias("text"),
        section.alias("beginSection"), section.alias("endSection"),
        F.lit(0).alias("offsetInBeginSection"),
        F.when(found, F.char_length(text)).otherwise(F.lit(0)).alias("offsetInEndSection"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("rerank_score"),
        F.col("rank").alias("rerank_position"))


def assemble_results(questions: DataFrame, snippets: DataFrame, run_keys: list[str] | None = None) -> DataFrame:
    """One row per (run, question): ``documents`` (URLs) and ``snippets`` in
    rank order; questions without documents get empty arrays.

    With run keys, ``questions`` already carries them (one row per run and
    question, see ``plans.pipeline.with_runs``); the join is on keys + id.
    """
    run_keys = list(run_keys or [])
    agg = (snippets.groupBy(*run_keys, "id")
           .agg(F.array_sort(F.collect_list(F.struct(F.col("rerank_position").alias("_ord"),
                                                 *[F.col(c) for c in SNIPPET_FIELDS])))
                .alias("s")))
    agg = agg.select(*run_keys, "id",
                     F.transform("s", lambda x: x["document"]).alias("documents"),
                     F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in SNIPPET_FIELDS])).alias("snippets"))
    empty = F.array().cast(agg.schema["snippets"].dataType)
    return (questions.join(agg, [*run_keys, "id"], "left")
            .select(*questions.columns,
                    F.coalesce("documents", F.array().cast("array<string>")).alias("documents"),
                    F.coalesce("snippets", empty).alias("snippets")))


def explode_results(results: DataFrame) -> DataFrame:
    """Flat form: one row per snippet. Questions without documents have no
    row here; they stay in the nested results with empty arrays."""
    base = [c for c in results.columns if c not in ("documents", "snippets")]
    e = results.select(*base, F.explode("snippets").alias("s"))
    return e.select(*base, *[F.col("s")[c].alias(c) for c in SNIPPET_FIELDS])


def strip_rerank_fields(results: DataFrame) -> DataFrame:
    """Drops ``rerank_score``/``rerank_position`` from every snippet; adds
    ``removed``: how many such fields the row's snippets held."""
    present = lambda s: s["rerank_score"].isNotNull().cast("int") + s["rerank_position"].isNotNull().cast("int")
    removed = F.aggregate(F.transform("snippets", present), F.lit(0), lambda a, n: a + n)
    return results.select(
        *[c for c in results.columns if c != "snippets"],
        F.transform("snippets", lambda s: s.dropFields("rerank_score", "rerank_position")).alias("snippets"),
        removed.alias("removed"))
