"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import extract_id, tokens_bm25, tokens_tfidf, tokens_words
from ..operators import compare as CMP
from ..operators import evaluation as E
from ..operators import keywords as K
from ..operators import rerank as R
from ..operators import retrieval as RT
from ..operators import snippets as S
from . import fixtures as FX
from . import pipeline as P

def inputs(spark: SparkSession, sf_dir: str) -> P.Inputs:
    """Pipeline inputs per session and folder, kept on the session itself:
    shared intermediates are written once and reused by its later queries."""
    known = spark.__dict__.setdefault("_lodestar_inputs", {})
    if sf_dir not in known:
        known[sf_dir] = P.Inputs.load(spark, sf_dir)
    return known[sf_dir]


def lazy(spark: SparkSession, sf_dir: str) -> P.Inputs:
    """Inputs whose queries are one plan from the tables on."""
    return P.Inputs.load(spark, sf_dir, persist=False)


def _posexplode(df: DataFrame, key: str, arr) -> DataFrame:
    return df.select(key, F.posexplode(arr).alias("pos", "token")).select(key, (F.col("pos") + 1).alias("pos"), "token")


def q_tokenize_bm25(spark, d):
    return _posexplode(FX.table(spark, d, "documents"), "doc_id", tokens_bm25("text"))


def q_tokenize_tfidf(spark, d):
    return _posexplode(FX.table(spark, d, "documents"), "doc_id", tokens_tfidf("text"))


def q_tokenize_words(spark, d):
    return _posexplode(FX.table(spark, d, "documents"), "doc_id", tokens_words("text"))


def q_doc_text(spark, d):
    return RT.doc_text(FX.articles(spark, d)).select("doc_id", "text")


def q_word_freq(spark, d):
    return K.word_freq(FX.questions(spark, d))


def q_weirdness(spark, d):
    w = K.weirdness(K.word_freq(FX.questions(spark, d)), FX.unigrams(spark, d))
    return w.select("id", "word", "count", F.round("weirdness", 6).alias("weirdness"))


def q_domain_words(spark, d):
    return K.domain_words(K.weirdness(K.word_freq(FX.questions(spark, d)), FX.unigrams(spark, d)))


def q_domain_words_fallback(spark, d):
    empty = spark.createDataFrame([], "word string, freq double")  # no background table
    return K.domain_words(K.weirdness(K.word_freq(FX.questions(spark, d)), empty))


def q_keyword_filter(spark, d):
    return K.keyword_filter(q_domain_words(spark, d))


def q_keyword_dedup(spark, d):
    return K.keyword_dedup(K.keyword_filter(q_domain_words(spark, d)))


def q_clean_terms(spark, d):
    return RT.clean_terms(P.keywords(lazy(spark, d))).select("id", "k", "term")


def q_hybrid_query_string(spark, d):
    return RT.hybrid_query_string(P.keywords(lazy(spark, d)), n_core=2)


def q_boolean_search(spark, d):
    inp = inputs(spark, d)
    return RT.boolean_search(P.keywords(inp), inp.index, phrases=False)


def q_fetch_details(spark, d):
    inp = inputs(spark, d)
    det = P.details(inp)
    return det.join(RT.fetch_status(det), "id").select("id", "doc_id", "retr_rank", "title", "abstract", "found", "partial")


def _ranked(spark, d, ranker, mode="BODY"):
    inp = inputs(spark, d)
    q = R.rerank_query(P.with_body(inp.questions), P.keywords(inp), (mode,))
    if ranker != "EMBEDDING":
        q = q.drop("mode")
    cand = P.candidates(inp)
    if ranker == "BM25":
        return R.rerank_bm25(q, cand, inp.index)
    if ranker == "TF-IDF":
        return R.rerank_tfidf(q, cand, inp.index)
    return R.rerank_embedding(q, cand, inp.index, inp.q_emb, inp.d_emb).drop("mode")


def q_rerank_bm25(spark, d):
    return _ranked(spark, d, "BM25")


def q_rerank_tfidf(spark, d):
    return _ranked(spark, d, "TF-IDF")


def q_rerank_embedding(spark, d):
    return _ranked(spark, d, "EMBEDDING")


def q_rerank_query(spark, d):
    inp = lazy(spark, d)
    return R.rerank_query(P.with_body(inp.questions), P.keywords(inp))


def q_rank_with_fallback(spark, d):
    inp = inputs(spark, d)
    return P.ranked(inp, "BM25", ("KEYWORDS",)).drop("mode")


def q_topk_documents(spark, d):
    return R.top_k(_ranked(spark, d, "BM25"))


def q_build_snippets(spark, d):
    inp = inputs(spark, d)
    top = R.top_k(_ranked(spark, d, "BM25"))
    return S.build_snippets(top, P.details(inp)).drop("doc_id")


def q_pipeline_results(spark, d):
    return S.explode_results(P.results(inputs(spark, d), "BM25", ("BODY",))).drop("ranker", "mode")


def q_extract_id(spark, d):
    return FX.urls(spark, d).select("page_id", "url", extract_id("url").alias("extracted_id"))


def _round(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _bm25_body_eval(spark, d):
    inp = inputs(spark, d)
    return inp.memo("eval_bm25_body", lambda: P.evaluate_ranking(inp, ("BM25",), ("BODY",)))


def q_eval_metrics(spark, d):
    m = _bm25_body_eval(spark, d).select("id", "seq", "n_docs", *E.METRICS)
    return _round(m, E.METRICS)


def q_mrr_reported(spark, d):
    m = _bm25_body_eval(spark, d).select("id", "seq", "n_docs", "mrr", "mrr_reported")
    return _round(m, ["mrr", "mrr_reported"])


def q_macro_metrics(spark, d):
    m = E.macro_metrics(_bm25_body_eval(spark, d))
    return _round(m, E.METRICS + ["mrr_true"])


def q_experiment_grid(spark, d):
    g = P.experiment_grid(inputs(spark, d))
    return _round(g, E.METRICS + ["mrr_true"])


def q_compare_configs(spark, d):
    return CMP.compare_configs(P.experiment_grid(inputs(spark, d)))


def q_best_config(spark, d):
    return CMP.best_config(P.experiment_grid(inputs(spark, d)))


def q_metric_series(spark, d):
    return CMP.metric_series(P.experiment_grid(inputs(spark, d)))


QUERIES = {
    "tokenize_bm25": q_tokenize_bm25,
    "tokenize_tfidf": q_tokenize_tfidf,
    "tokenize_words": q_tokenize_words,
    "doc_text": q_doc_text,
    "word_freq": q_word_freq,
    "weirdness": q_weirdness,
    "domain_words": q_domain_words,
    "domain_words_fallback": q_domain_words_fallback,
    "keyword_filter": q_keyword_filter,
    "keyword_dedup": q_keyword_dedup,
    "clean_terms": q_clean_terms,
    "hybrid_query_string": q_hybrid_query_string,
    "boolean_search": q_boolean_search,
    "fetch_details": q_fetch_details,
    "rerank_query": q_rerank_query,
    "rerank_bm25": q_rerank_bm25,
    "rerank_tfidf": q_rerank_tfidf,
    "rerank_embedding": q_rerank_embedding,
    "rank_with_fallback": q_rank_with_fallback,
    "topk_documents": q_topk_documents,
    "build_snippets": q_build_snippets,
    "pipeline_results": q_pipeline_results,
    "extract_id": q_extract_id,
    "eval_metrics": q_eval_metrics,
    "mrr_reported": q_mrr_reported,
    "macro_metrics": q_macro_metrics,
    "experiment_grid": q_experiment_grid,
    "compare_configs": q_compare_configs,
    "best_config": q_best_config,
    "metric_series": q_metric_series,
}


# ------------------------------------------------------------- sources/sinks
from ..operators import responses as RS  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import articles as SA  # noqa: E402
from ..sources import background as SB  # noqa: E402
from ..sources import questions as SQ  # noqa: E402
from ..sources import runs as SR  # noqa: E402

RUN_TS = "1970-01-01_00-00-00"  # fixed so file names are reproducible


def q_scan_questions(spark, d):
    path = scratch_path(spark, "questions")
    SQ.write_question_files(FX.questions(spark, d), path)
    return SQ.scan_questions(spark, path).select("id", "type", "body")


def q_question_limit(spark, d):
    return SQ.question_limit(FX.questions(spark, d), 20)


def q_scan_unigrams(spark, d):
    path = scratch_path(spark, "unigrams")
    SB.write_unigram_csv(FX.unigrams(spark, d), path)
    return SB.scan_unigrams(spark, path)


def q_scan_word_repr(spark, d):
    path = scratch_path(spark, "word_repr")
    SB.write_word_repr_json(FX.word_repr(spark, d), path)
    return SB.scan_word_repr(spark, path)


def q_parse_articles(spark, d):
    path = scratch_path(spark, "articles_xml")
    SA.write_article_xml(FX.articles(spark, d), path)
    return SA.parse_articles(spark, path)


def q_parse_pages(spark, d):
    return SA.parse_pages(FX.table(spark, d, "pages"))


def _write_bm25_results(spark, d):
    inp = inputs(spark, d)

    def build():
        path = scratch_path(spark, "results")
        SR.write_result_documents(P.results(inp, "BM25", ("BODY",)), path, "TRAIN", RUN_TS)
        return path
    if "results_path" not in inp.cache:
        inp.cache["results_path"] = build()
    return inp.cache["results_path"]


def q_write_results(spark, d):
    res = SR.scan_result_files(spark, _write_bm25_results(spark, d))
    return S.explode_results(res.select("id", "seq", "body", "documents", "snippets"))


def q_strip_rerank_fields(spark, d):
    res = SR.scan_result_files(spark, _write_bm25_results(spark, d)).select("id", "documents", "snippets")
    st = S.strip_rerank_fields(res)
    e = st.select("id", "removed", F.explode("snippets").alias("s"))
    return e.select("id", "removed", *[F.col("s")[c].alias(c) for c in S.SNIPPET_FIELDS[:6]])


def q_write_metrics(spark, d):
    per = _bm25_body_eval(spark, d)
    path = scratch_path(spark, "metrics")
    SR.write_metric_documents(per, E.macro_metrics(per, ["ranker", "mode"]), path, "TRAIN", RUN_TS)
    back = SR.scan_metric_questions(spark, path).withColumn("id", F.col("id").cast("bigint"))
    return _round(back.join(per.select("id", "seq"), "id").select("id", "seq", *E.METRICS), E.METRICS)


def q_scan_metrics(spark, d):
    inp = inputs(spark, d)
    grid = P.experiment_grid(inp)
    path = scratch_path(spark, "metrics")
    SR.write_metric_documents(None, grid, path, "TRAIN", RUN_TS)
    return _round(SR.scan_metrics(spark, path), E.METRICS)


def q_parse_keyword_responses(spark, d):
    return RS.parse_keyword_responses(RS.conversation_responses(FX.table(spark, d, "conversations")),
                                      ("conv_id", "turn"))


def q_clean_query_responses(spark, d):
    return RS.clean_query_responses(RS.conversation_responses(FX.table(spark, d, "conversations")),
                                    ("conv_id", "turn"))


# ---------------------------------------------------- keywords and retrieval
def q_expand_keywords(spark, d):
    return K.expand_keywords(P.keywords(lazy(spark, d)), FX.word_repr(spark, d))


def q_sort_word_repr(spark, d):
    return K.sort_word_repr(FX.word_repr(spark, d))


def retry_clauses(kw: DataFrame) -> DataFrame:
    """Clause 1: every keyword OR-ed; clause 2 (negated): the last keyword of
    questions with at least three keywords."""
    pos_cl = FX.retry_clauses(kw)
    n = kw.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("maxpos"))
    neg = (kw.join(n, "id").filter((F.col("n") >= 3) & (F.col("pos") == F.col("maxpos")))
           .select("id", F.lit(2).alias("clause_no"), "term", F.lit(None).cast("string").alias("field"),
                   F.lit(True).alias("negated")))
    return pos_cl.unionByName(neg)


def q_clause_search(spark, d):
    inp = inputs(spark, d)
    return RT.clause_search(retry_clauses(P.keywords(inp)), inp.index, phrases=False, fielded=False)


def q_search_with_retry(spark, d):
    inp = inputs(spark, d)
    kw = P.keywords(inp)
    return RT.search_with_retry(P.with_body(inp.questions), kw, FX.retry_clauses(kw), inp.index, inp.n_core,
                                phrases=False, fielded=False, first=P.first_search(inp))


def q_run_stats(spark, d):
    return _round(E.run_stats(P.question_status(inputs(spark, d))), ["zero_keywords_share", "zero_hits_share"])


def q_word_freq_lemmas(spark, d):
    return K.word_freq(FX.questions(spark, d), FX.lemmas(spark, d))


def q_gold_pairs(spark, d):
    return FX.qrels(spark, d)


def q_response_keywords(spark, d):
    return K.response_keywords(FX.responses(spark, d))


def q_empty_body(spark, d):
    res = P.results(inputs(spark, d), "BM25", ("BODY",))
    has = F.col("body").isNotNull() & (F.col("body") != "")
    return res.select("id", has.alias("has_body"), F.size("documents").alias("n_documents"))


QUERIES.update({
    "scan_questions": q_scan_questions,
    "question_limit": q_question_limit,
    "scan_unigrams": q_scan_unigrams,
    "scan_word_repr": q_scan_word_repr,
    "parse_articles": q_parse_articles,
    "parse_pages": q_parse_pages,
    "write_results": q_write_results,
    "strip_rerank_fields": q_strip_rerank_fields,
    "write_metrics": q_write_metrics,
    "scan_metrics": q_scan_metrics,
    "parse_keyword_responses": q_parse_keyword_responses,
    "clean_query_responses": q_clean_query_responses,
    "expand_keywords": q_expand_keywords,
    "sort_word_repr": q_sort_word_repr,
    "clause_search": q_clause_search,
    "search_with_retry": q_search_with_retry,
    "run_stats": q_run_stats,
    "empty_body": q_empty_body,
    "word_freq_lemmas": q_word_freq_lemmas,
    "response_keywords": q_response_keywords,
    "gold_pairs": q_gold_pairs,
})
