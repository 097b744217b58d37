"""Operator semantics on hand-written rows: fallbacks, phrases, clauses, keywords."""

import pytest

from lodestar.operators import keywords as K
from lodestar.operators import rerank as R
from lodestar.operators import responses as RS
from lodestar.operators import retrieval as RT


def arts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, abstract string")


def test_boolean_search_core_rest_and_phrases(spark):
    a = arts(spark, [(1, "alpha beta gamma", "N/A"), (2, "alpha delta", "x"), (3, "beta gamma alpha", "N/A"),
                     (4, "gamma", "alpha")])
    idx = RT.TextIndex.build(a)
    kw = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "gamma"), (1, 3, "delta"),
                                (2, 1, "beta gamma"), (2, 2, "alpha")], "id long, pos int, term string")
    got = {(r["id"], r["doc_id"]): (r["retr_rank"], r["total_count"]) for r in RT.boolean_search(kw, idx).collect()}
    # q1: alpha required, gamma or delta -> docs 1,2,3,4 ; q2: phrase "beta gamma" + alpha -> 1 and 3
    assert {d for (q, d) in got if q == 1} == {1, 2, 3, 4}
    assert {d for (q, d) in got if q == 2} == {1, 3}
    assert got[(2, 1)] == (1, 2)
    capped = RT.boolean_search(kw, idx, max_results=1).collect()
    assert all(r["total_count"] >= 1 for r in capped) and len([r for r in capped if r["id"] == 1]) == 1


def test_boolean_search_field(spark):
    a = arts(spark, [(1, "alpha", "beta"), (2, "beta", "alpha")])
    idx = RT.TextIndex.build(a)
    kw = spark.createDataFrame([(1, 1, "alpha")], "id long, pos int, term string")
    assert [r["doc_id"] for r in RT.boolean_search(kw, idx, field="title").collect()] == [1]


def test_clause_search_negation(spark):
    a = arts(spark, [(1, "alpha beta", "N/A"), (2, "alpha gamma", "N/A"), (3, "delta", "N/A")])
    idx = RT.TextIndex.build(a)
    cl = spark.createDataFrame([(1, 1, "alpha", None, False), (1, 1, "delta", None, False), (1, 2, "beta", None, True),
                                (2, 1, "zzz", None, True)],
                               "id long, clause_no int, term string, field string, negated boolean")
    got = sorted((r["id"], r["doc_id"]) for r in RT.clause_search(cl, idx).collect())
    assert got == [(1, 2), (1, 3)]  # question 2 has only a negated clause -> nothing


def test_rank_fallbacks(spark):
    a = arts(spark, [(1, "N/A", "N/A"), (2, "", "N/A"), (10, "good text here", "N/A"), (11, "other text", "N/A"),
                     (20, "ééé", "N/A"), (21, "ààà", "N/A")])
    idx = RT.TextIndex.build(a)
    cand = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (2, 11, 1), (2, 10, 2), (3, 99, 1), (3, 98, 2),
                                  (4, 21, 1), (4, 20, 2)], "id long, doc_id long, retr_rank int")
    q = spark.createDataFrame([(i, "text") for i in (1, 2, 3, 4)], "id long, query string")
    out = {}
    for r in R.rank_with_fallback(q, cand, a, idx, "BM25").collect():
        out.setdefault(r["id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert sorted(out[1]) == [(1, 2, 0.0), (2, 1, 0.0)]      # articles but no usable text
    assert sorted(out[3]) == [(1, 99, 0.0), (2, 98, 0.0)]    # no article found at all
    assert sorted(out[4]) == [(1, 21, 0.0), (2, 20, 0.0)]    # usable text, no tokens: retrieval order
    assert [d for _, d, _ in sorted(out[2])] == [11, 10] or [d for _, d, _ in sorted(out[2])] == [10, 11]
    tf = {r["id"]: r for r in R.rank_with_fallback(q, cand, a, idx, "TF-IDF").collect() if r["rank"] == 1}
    assert tf[4]["doc_id"] == 20  # TF-IDF has a vocabulary here (ééé, ààà): zero scores tie by doc_id


def test_tfidf_empty_vocabulary_keeps_retrieval_order(spark):
    a = arts(spark, [(5, "the and", "N/A"), (6, "of it", "N/A")])
    idx = RT.TextIndex.build(a)
    cand = spark.createDataFrame([(1, 6, 1), (1, 5, 2)], "id long, doc_id long, retr_rank int")
    q = spark.createDataFrame([(1, "what is the")], "id long, query string")
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in R.rerank_tfidf(q, cand, idx).collect())
    assert got == [(1, 6, 0.0), (2, 5, 0.0)]


def test_tfidf_matches_reference_formula(spark):
    import math
    a = arts(spark, [(1, "cat sat mat", "N/A"), (2, "dog sat log", "N/A")])
    idx = RT.TextIndex.build(a)
    cand = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "id long, doc_id long, retr_rank int")
    q = spark.createDataFrame([(1, "cat dog cat")], "id long, query string")
    got = {r["doc_id"]: r["score"] for r in R.rerank_tfidf(q, cand, idx).collect()}
    n = 3
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    qv = {"cat": 2 * idf(2), "dog": idf(2)}
    d1 = {"cat": idf(2), "sat": idf(2), "mat": idf(1)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expect = sum(qv[t] * d1.get(t, 0) for t in qv) / (norm(qv) * norm(d1))
    assert got[1] == pytest.approx(round(expect, 6), abs=1e-6)


def test_weirdness_and_fallback(spark):
    q = spark.createDataFrame([(1, "Alpha alpha beta gamma")], "id long, body string")
    lex = K.word_freq(q)
    ug = spark.createDataFrame([("alpha", 50.0), ("beta", 1.0), ("zeta", 3.0)], "word string, freq double")
    w = {r["word"]: r["weirdness"] for r in K.weirdness(lex, ug).collect()}
    assert w["gamma"] == 0.1
    assert w["alpha"] == pytest.approx(50 / (2 * 3) * 1000)
    empty = spark.createDataFrame([], "word string, freq double")
    fb = K.domain_words(K.weirdness(lex, empty)).orderBy("pos").collect()
    assert [r["term"] for r in fb] == ["alpha", "beta", "gamma"]


def test_lemmas_and_filter_and_expansion(spark):
    q = spark.createDataFrame([(1, "Cells cells the IL")], "id long, body string")
    lem = spark.createDataFrame([("cells", "cell")], "form string, lemma string")
    assert {r["word"]: r["count"] for r in K.word_freq(q, lem).collect()} == {"cell": 2, "the": 1, "il": 1}
    kw = spark.createDataFrame([(1, 1, "The"), (1, 2, "BRCA1"), (1, 3, "x"), (1, 4, "__"), (1, 5, "brca1")],
                               "id long, pos int, term string")
    f = K.keyword_dedup(K.keyword_filter(kw)).collect()
    assert [(r["pos"], r["term"]) for r in f] == [(2, "brca1")]
    keys = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id long, pos int, term string")
    wr = spark.createDataFrame([("a", "x", 2), ("b", "x", 2), ("a", "y", 3), ("b", "a", 9), ("q", "z", 99)],
                               "key string, word string, weight long")
    ex = K.expand_keywords(keys, wr, n_top=2, exclude=spark.createDataFrame([("y",)], "word string"))
    assert [r["term"] for r in ex.orderBy("pos").collect()] == ["a", "x", "a", "b"]


def test_response_parsing(spark):
    df = spark.createDataFrame([(1, "['a b', 'c']"), (2, "x1, y2"), (3, "['x', 3]")], "id int, raw string")
    got = {}
    for r in RS.parse_keyword_responses(df).collect():
        got.setdefault(r["id"], []).append(r["keyword"])
    assert got == {1: ["a b", "c"], 2: ["x1", "y2"]}
    q = spark.createDataFrame([(1, "Query: 'BRCA1 AND x'"), (2, "  q ")], "id int, raw string")
    got = {r["id"]: (r["query"], r["valid"]) for r in RS.clean_query_responses(q).collect()}
    assert got == {1: ("BRCA1 AND x", True), 2: ("q", False)}
