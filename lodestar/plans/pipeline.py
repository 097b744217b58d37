"""End-to-end plans: answer all questions, evaluate, compare configurations.

All questions are processed at once. Shuffle boundaries: postings and
document statistics (keyed by doc/term), candidate aggregation and top-k
(keyed by question), ranker statistics (keyed by question, term).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import evaluation as E
from ..operators import keywords as K
from ..operators import rerank as R
from ..operators import retrieval as RT
from ..operators import snippets as S
from ..functions.text import doc_url
from ..session import materialize
from . import fixtures as FX


PIPELINE_CORE_TERMS = 3  # terms AND-ed by the pipeline's first search


@dataclass
class Inputs:
    questions: DataFrame      # (id, seq, body)
    articles: DataFrame       # (doc_id, title, abstract)
    unigrams: DataFrame       # (word, freq)
    gold: DataFrame | Callable[[], DataFrame]  # (id, doc_id), or what finds them when they are asked for
    index: RT.TextIndex
    q_emb: DataFrame | None = None
    d_emb: DataFrame | None = None
    lemmas: DataFrame | None = None
    responses: DataFrame | None = None  # (id, turn, raw): stored model responses as the keyword source
    word_repr: DataFrame | None = None  # (key, word, weight): keywords are expanded from it
    clauses: DataFrame | None = None    # (id, clause_no, term, field, negated): the rewritten queries of the retry
    n_core: int = PIPELINE_CORE_TERMS
    persist: bool = True
    cache: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, persist: bool = True) -> "Inputs":
        """``persist=False`` keeps everything one lazy plan: for single operators
        only, a whole pipeline without written intermediates plans too long."""
        arts = FX.articles(spark, sf_dir)
        return cls(questions=FX.questions(spark, sf_dir), articles=arts,
                   unigrams=FX.unigrams(spark, sf_dir), gold=lambda: FX.qrels(spark, sf_dir),
                   index=RT.TextIndex.build(arts, persist=persist),
                   q_emb=FX.q_emb(spark, sf_dir), d_emb=FX.d_emb(spark, sf_dir), persist=persist)

    @property
    def qrels(self) -> DataFrame:
        """The gold pairs, searched for once."""
        return self.memo("qrels", lambda: self.gold() if callable(self.gold) else self.gold)

    def memo(self, name, fn):
        """Builds a shared intermediate once. In pipeline mode it is written as
        a table under the shared checkpoint folder (``session.materialize``),
        so later plans start from it: shallow plans, no recomputation, no
        lineage to replay when an executor is lost, real size statistics."""
        if name not in self.cache:
            df = fn()
            label = "_".join(map(str, name)) if isinstance(name, tuple) else str(name)
            self.cache[name] = materialize(df, label) if self.persist else df
        return self.cache[name]


def with_body(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("body").isNotNull() & (F.col("body") != ""))


def domain(inp: Inputs, threshold: float) -> DataFrame:
    """``(id, pos, term)``: domain words of every question, extracted once."""
    return inp.memo(("domain", threshold), lambda: K.domain_words(
        K.weirdness(K.word_freq(with_body(inp.questions), inp.lemmas), inp.unigrams), threshold))


def details(inp: Inputs) -> DataFrame:
    """The candidates' articles, fetched once."""
    return inp.memo("details", lambda: RT.fetch_details(candidates(inp), inp.articles))


def keywords(inp: Inputs, threshold: float = C.WEIRDNESS_THRESHOLD) -> DataFrame:
    """Filtered, de-duplicated keywords ``(id, pos, term)`` of every question: from stored responses
    if there are any, else by weirdness; with word associations, expanded."""
    def build() -> DataFrame:
        asked = with_body(inp.questions)
        if inp.responses is not None:
            kw = K.response_keywords(inp.responses.join(asked.select("id"), "id", "left_semi"))
        else:
            kw = K.keyword_dedup(K.keyword_filter(domain(inp, threshold)))
        if inp.word_repr is not None:
            kw = K.keyword_dedup(K.keyword_filter(K.expand_keywords(kw, inp.word_repr).drop("source")))
        return kw
    return inp.memo(("kw", threshold), build)


def extracted(inp: Inputs, threshold: float = C.WEIRDNESS_THRESHOLD) -> DataFrame:
    """``(id, n_extracted)``: keywords per question before the filter."""
    if inp.responses is not None:
        words = K.parsed_responses(inp.responses.join(with_body(inp.questions).select("id"), "id", "left_semi"))
        return words.groupBy("id").agg(F.count(F.lit(1)).alias("n_extracted"))
    return domain(inp, threshold).groupBy("id").agg(F.count(F.lit(1)).alias("n_extracted"))


def phrases(inp: Inputs) -> bool:
    """Extracted keywords and associated words are single tokens; those of responses may be phrases."""
    return inp.responses is not None


def first_search(inp: Inputs, max_results: int = C.MAX_SEARCH_RESULTS) -> DataFrame:
    """The hybrid search."""
    return inp.memo(("first", inp.n_core, max_results), lambda: RT.boolean_search(
        keywords(inp), inp.index, inp.n_core, max_results, phrases=phrases(inp)))


def candidates(inp: Inputs, max_results: int = C.MAX_SEARCH_RESULTS) -> DataFrame:
    """``(id, doc_id, retr_rank, total_count, query_used)``: the first search,
    replaced for questions it left empty by the retry with their stored clauses, or else with all
    their keywords OR-ed."""
    kw = keywords(inp)
    clauses = inp.clauses if inp.clauses is not None else FX.retry_clauses(kw)
    return inp.memo(("cand", inp.n_core, max_results), lambda: RT.search_with_retry(
        with_body(inp.questions), kw, clauses, inp.index, inp.n_core, max_results,
        phrases=phrases(inp) or inp.clauses is not None, fielded=inp.clauses is not None, first=first_search(inp, max_results)))


def ranked(inp: Inputs, ranker: str = "BM25", modes=("BODY",)) -> DataFrame:
    """``(mode, id, doc_id, score, rank)`` for every retrieved question."""
    q = R.rerank_query(with_body(inp.questions), keywords(inp), modes)
    return R.rank_with_fallback(q, candidates(inp), inp.articles, inp.index, ranker,
                                q_emb=inp.q_emb, d_emb=inp.d_emb)


def with_runs(questions: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    """One row per (ranker, mode, question), by exploding a literal list."""
    arr = F.array(*[F.struct(F.lit(r).alias("ranker"), F.lit(m).alias("mode")) for r, m in runs])
    return questions.select("*", F.explode(arr).alias("_run")).select("_run.ranker", "_run.mode", *questions.columns)


def results(inp: Inputs, ranker: str = "BM25", modes=("BODY",), k: int = C.TOP_N) -> DataFrame:
    """Nested results ``(ranker, mode, id, seq, body, documents, snippets)``,
    one row per question and mode, in the result-file shape."""
    top = R.top_k(ranked(inp, ranker, modes), k)
    snips = S.build_snippets(top, details(inp)).withColumn("ranker", F.lit(ranker))
    qs = with_runs(inp.questions, [(ranker, m) for m in modes])
    return S.assemble_results(qs, snips, ["ranker", "mode"])


def ranked_docs(res: DataFrame) -> DataFrame:
    """Flat ``(ranker, mode, id, rank, document)`` from nested results."""
    e = res.select("ranker", "mode", "id", F.posexplode_outer("documents").alias("p", "document"))
    return e.select("ranker", "mode", "id", (F.col("p") + 1).alias("rank"), "document")


def evaluate(inp: Inputs, res: DataFrame) -> DataFrame:
    """Per-question metrics incl. the carried-forward MRR, from nested results."""
    m = E.eval_metrics(ranked_docs(res), inp.questions, inp.qrels, ["ranker", "mode"])
    return E.mrr_reported(m, ["ranker", "mode"])


def top_documents(inp: Inputs, ranker: str, modes=("BODY",), k: int = C.TOP_N) -> DataFrame:
    """Flat ``(ranker, mode, id, rank, document)`` straight from the ranking:
    every question of every run, with a NULL document when it returned none
    (no snippet building needed to evaluate)."""
    top = R.top_k(ranked(inp, ranker, modes), k).select("mode", "id", "rank", doc_url("doc_id").alias("document"))
    qs = with_runs(inp.questions.select("id"), [(ranker, m) for m in modes])
    return qs.join(top, ["mode", "id"], "left").select("ranker", "mode", "id", "rank", "document")


def evaluate_ranking(inp: Inputs, rankers=C.RANKERS, modes=C.QUERY_MODES) -> DataFrame:
    """Per-question metrics of every (ranker, mode) run, incl. carried MRR."""
    docs = None
    for r in rankers:
        part = top_documents(inp, r, modes)
        docs = part if docs is None else docs.unionByName(part)
    m = E.eval_metrics(docs, inp.questions, inp.qrels, ["ranker", "mode"])
    return E.mrr_reported(m, ["ranker", "mode"])


def grid_runs(rankers=C.RANKERS, modes=C.QUERY_MODES) -> list[tuple[str, str]]:
    return [(r, m) for r in rankers for m in modes]


def grid_results(inp: Inputs, rankers=C.RANKERS, modes=C.QUERY_MODES) -> DataFrame:
    """Nested results of every (ranker, mode) configuration, in one plan."""
    res = None
    for r in rankers:
        part = results(inp, r, modes)
        res = part if res is None else res.unionByName(part)
    return res


def experiment_grid(inp: Inputs, rankers=C.RANKERS, modes=C.QUERY_MODES) -> DataFrame:
    """Macro metrics of every configuration: ``(run_no, ranker, mode, metrics...)``."""
    def build():
        macro = E.macro_metrics(evaluate_ranking(inp, rankers, modes), ["ranker", "mode"])
        order = F.array(*[F.struct(F.lit(r).alias("ranker"), F.lit(m).alias("mode"))
                          for r, m in grid_runs(rankers, modes)])
        run_no = F.array_position(order, F.struct(F.col("ranker"), F.col("mode")))
        return macro.select(run_no.cast("int").alias("run_no"), *macro.columns)
    return inp.memo(("grid", tuple(rankers), tuple(modes)), build)


def question_status(inp: Inputs) -> DataFrame:
    """Per-question status used by ``run_stats``."""
    nk = keywords(inp).groupBy("id").agg(F.count(F.lit(1)).alias("n_keywords"))
    first = first_search(inp).groupBy("id").agg(F.count(F.lit(1)).alias("initial_hits"))
    final = candidates(inp).groupBy("id").agg(F.count(F.lit(1)).alias("final_hits"))
    part = RT.fetch_status(details(inp)).select("id", "partial")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (inp.questions.select("id", (F.col("body").isNotNull() & (F.col("body") != "")).alias("has_body"))
            .join(extracted(inp), "id", "left").join(nk, "id", "left").join(first, "id", "left")
            .join(final, "id", "left").join(part, "id", "left")
            .select("id", "has_body", zero("n_extracted"), zero("n_keywords"), zero("initial_hits"),
                    F.col("initial_hits").isNull().alias("retried"), zero("final_hits"),
                    F.coalesce("partial", F.lit(False)).alias("partial_fetch")))
