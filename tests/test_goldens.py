"""Literal goldens: values the published outputs pin down (see FIXTURES.md §3)."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import extract_id, tokens_bm25, tokens_tfidf, tokens_words
from lodestar.operators import evaluation as E
from lodestar.operators import rerank as R
from lodestar.operators import retrieval as RT
from lodestar.operators import snippets as S


def _index(spark, rows):
    arts = spark.createDataFrame(rows, "doc_id long, title string, abstract string")
    return arts, RT.TextIndex.build(arts)


def test_bm25_single_candidate_golden(spark):
    # one candidate: every idf is ln(0.5/1.5) < 0 -> floor eps*mean(idf); 'describe' absent
    arts, idx = _index(spark, [(1, "rankmhc rankmhc rankmhc rankmhc x", "N/A")])
    q = spark.createDataFrame([(7, "describe rankmhc")], "id long, query string")
    cand = spark.createDataFrame([(7, 1, 1)], "id long, doc_id long, retr_rank int")
    r = R.rerank_bm25(q, cand, idx).collect()
    # 5 tokens, tf 4; two distinct terms both with idf ln(1/3): eps = 0.25*ln(1/3)
    idf = 0.25 * math.log(0.5 / 1.5)
    expect = idf * 4 * 2.5 / (4 + 1.5 * (0.25 + 0.75 * 5 / 5))
    assert r[0]["score"] == pytest.approx(round(expect, 6), abs=1e-6)


def test_bm25_stored_value(spark):
    # the stored value -0.499369222 = eps idf * tf 4 with dl = avgdl (single document)
    idf = 0.25 * math.log(1 / 3)
    assert idf * 4 * 2.5 / (4 + 1.5) == pytest.approx(-0.499369222, abs=1e-9)


def _metrics(spark, docs, gold, qid=1):
    rows = [(qid, i + 1, f"http://www.ncbi.nlm.nih.gov/pubmed/{d}") for i, d in enumerate(docs)] or [(qid, None, None)]
    rd = spark.createDataFrame(rows, "id long, rank int, document string")
    qs = spark.createDataFrame([(qid, 1)], "id long, seq long")
    qr = spark.createDataFrame([(qid, g) for g in gold], "id long, doc_id long")
    return E.eval_metrics(rd, qs, qr).collect()[0]


def test_ndcg_golden_rank6(spark):
    m = _metrics(spark, [10, 11, 12, 13, 14, 99, 16, 17, 18, 19], [99])
    assert m["ndcg10"] == pytest.approx(0.393728815, abs=1e-9)
    assert m["map10"] == pytest.approx(1 / 6)
    assert m["mrr"] == pytest.approx(1 / 6)


def test_ndcg_golden_two_docs(spark):
    m = _metrics(spark, [10, 99], [99])
    assert m["ndcg10"] == pytest.approx(0.630929754, abs=1e-9)
    assert m["map10"] == 0.0  # fewer than 10 documents


def test_ndcg_golden_seven_docs(spark):
    m = _metrics(spark, [1, 2, 10, 3, 11, 12, 13], [1, 2, 3])
    # n 7, r 3 relevant among them, two in the first three
    assert m["ndcg10"] == pytest.approx(0.843475626, abs=1e-9)


def test_single_relevant_document(spark):
    m = _metrics(spark, [5], [5])
    assert (m["s10"], m["p10"], m["r10"]) == (1.0, 0.1, 1.0)
    assert m["f1_10"] == pytest.approx(0.181818, abs=1e-6)
    assert m["ndcg10"] == 0.0 and m["map10"] == 0.0


def test_no_documents_and_placeholder_gold(spark):
    m = _metrics(spark, [], [])
    assert m["n_docs"] == 0 and m["s10"] == 0.0 and m["mrr"] == 0.0 and m["ndcg10"] == 0.0


def test_mrr_carried_forward(spark):
    rows = [(1, 1, "http://x/pubmed/5")]  # short question, hit at 1
    rows += [(2, i + 1, f"http://x/pubmed/{100 + i}") for i in range(10)]  # 10 docs, hit at 6
    rd = spark.createDataFrame(rows, "id long, rank int, document string")
    qs = spark.createDataFrame([(1, 1), (2, 2)], "id long, seq long")
    qr = spark.createDataFrame([(1, 5), (2, 105)], "id long, doc_id long")
    out = {r["id"]: r for r in E.mrr_reported(E.eval_metrics(rd, qs, qr)).collect()}
    assert out[1]["mrr_reported"] == 1.0 and out[2]["mrr_reported"] == 1.0
    assert out[2]["mrr"] == pytest.approx(1 / 6)


def test_mrr_reported_across_blocks(spark):
    rows = [(i, 1, "http://x/pubmed/1" if i == 3 else "http://x/pubmed/2") for i in range(1, 6)]
    rd = spark.createDataFrame(rows, "id long, rank int, document string")
    qs = spark.createDataFrame([(i, i * 1000) for i in range(1, 6)], "id long, seq long")
    qr = spark.createDataFrame([(i, 1) for i in range(1, 6)], "id long, doc_id long")
    got = {r["id"]: r["mrr_reported"] for r in E.mrr_reported(E.eval_metrics(rd, qs, qr), block=2000).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0}


def test_snippet_goldens(spark):
    long_abs = "y" * 400
    arts = spark.createDataFrame([(1, "Title ending.", long_abs), (2, "t" * 64, "N/A"), (3, "N/A", "N/A")],
                                 "doc_id long, title string, abstract string")
    det = RT.fetch_details(spark.createDataFrame([(9, 1, 1), (9, 2, 2), (9, 3, 3), (9, 4, 4)],
                                                 "id long, doc_id long, retr_rank int"), arts)
    top = spark.createDataFrame([(9, 1, 1.5, 1), (9, 2, 0.5, 2), (9, 3, 0.0, 3), (9, 4, 0.0, 4)],
                                "id long, doc_id long, score double, rank int")
    s = {r["doc_id"]: r for r in S.build_snippets(top, det).collect()}
    assert s[1]["text"] == ("Title ending.. " + long_abs)[:247] + "..." and s[1]["offsetInEndSection"] == 250
    assert s[1]["beginSection"] == "abstract"
    assert s[2]["text"] == "t" * 64 and s[2]["beginSection"] == "title" and s[2]["offsetInEndSection"] == 64
    assert s[3]["text"] == "[Title/Abstract N/A]" and s[3]["beginSection"] == "N/A"
    assert s[4]["text"] == "[Details unavailable]" and s[4]["offsetInEndSection"] == 0
    assert s[1]["document"] == "http://www.ncbi.nlm.nih.gov/pubmed/1"


def test_extract_id(spark):
    df = spark.createDataFrame([("http://www.ncbi.nlm.nih.gov/pubmed/39555889",), ("http://x/12/",), ("abc",), (None,)],
                               "url string")
    assert [r[0] for r in df.select(extract_id("url")).collect()] == ["39555889", "12", "0", "0"]


def test_hybrid_query_string(spark):
    kw = spark.createDataFrame([(1, 1, "a b"), (1, 2, "cd"), (1, 3, "ef"), (2, 1, 'x"'), (2, 2, "yy"), (2, 3, "zz")],
                               "id long, pos int, term string")
    got = {r["id"]: r["query"] for r in RT.hybrid_query_string(kw, n_core=1).collect()}
    assert got[1] == '"a b" AND (cd OR ef)'
    assert got[2] == "x AND (yy OR zz)"
    got2 = {r["id"]: r["query"] for r in RT.hybrid_query_string(kw, n_core=2, field="Title/Abstract").collect()}
    assert got2[1] == '(("a b" AND cd) AND ef)[Title/Abstract]'


def test_tokenisers(spark):
    df = spark.createDataFrame([("The IL-6 élan_vital, x  über alles",)], "t string")
    r = df.select(tokens_bm25("t").alias("a"), tokens_tfidf("t").alias("b"), tokens_words("t").alias("c")).first()
    assert r["a"] == ["the", "il6", "lan_vital".replace("_", ""), "x", "ber", "alles"]
    assert r["b"] == ["il", "élan_vital", "über", "alles"]
    assert r["c"] == ["the", "il", "6", "élan_vital", "x", "über", "alles"]
