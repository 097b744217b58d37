"""Edge behaviour of search, retry, gold pairs, statistics, fallbacks and file formats, on hand-written rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import evaluation as E
from lodestar.operators import rerank as R
from lodestar.operators import responses as RS
from lodestar.operators import retrieval as RT
from lodestar.operators import snippets as S
from lodestar.plans import fixtures as FX
from lodestar.plans import pipeline as P
from lodestar.sources import articles as SA
from lodestar.sources import background as SB
from lodestar.sources import questions as SQ
from lodestar.sources import runs as SR


def arts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, abstract string")


def test_search_fields(spark):
    idx = RT.TextIndex.build(arts(spark, [(1, "alpha", "beta"), (2, "beta", "alpha"), (3, "gamma", "alpha beta"), (4, "x", "y")]))
    kw = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "beta gamma")], "id long, pos int, term string")
    one = kw.filter("pos = 1")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(RT.boolean_search(one, idx, field="title")) == [1]
    assert ids(RT.boolean_search(one, idx, field="Title/Abstract")) == [1, 2, 3]
    assert ids(RT.boolean_search(kw, idx, field="abstract")) == []  # the phrase is in no abstract
    with pytest.raises(ValueError):
        RT.boolean_search(one, idx, field="journal")
    clauses = "id long, clause_no int, term string, field string, negated boolean"
    cl = spark.createDataFrame([(1, 1, "alpha", "Title/Abstract", False), (1, 2, "gamma", "title", True)], clauses)
    assert ids(RT.clause_search(cl, idx)) == [1, 2]
    with pytest.raises(Exception, match="unknown search field"):
        RT.clause_search(spark.createDataFrame([(1, 1, "alpha", "journal", False)], clauses), idx).collect()


def test_search_without_core_terms(spark):
    idx = RT.TextIndex.build(arts(spark, [(1, "alpha", "N/A"), (2, "beta", "N/A")]))
    kw = spark.createDataFrame([(1, 1, '""'), (1, 2, "alpha"), (1, 3, "beta")], "id long, pos int, term string")
    assert sorted(r["doc_id"] for r in RT.boolean_search(kw, idx).collect()) == [1, 2]


def pipeline_inputs(spark, questions, articles, unigrams=(("zzz", 1.0),), **kw):
    a = arts(spark, articles)
    q = spark.createDataFrame(questions, "id long, seq long, body string")
    return P.Inputs(questions=q, articles=a, unigrams=spark.createDataFrame(list(unigrams), "word string, freq double"),
                    gold=spark.createDataFrame([], "id long, doc_id long"), index=RT.TextIndex.build(a, persist=True), persist=True, **kw)


def test_retry_feeds_the_results(spark):
    """Question 2's three core terms meet in no document; its retry finds one."""
    inp = pipeline_inputs(spark, [(1, 1, "alpha beta gamma"), (2, 2, "alpha delta omega"), (3, 3, ""), (4, 4, "nothing")],
                          [(10, "alpha beta gamma", "N/A"), (11, "delta", "N/A")])
    used = {(r["id"], r["doc_id"]): r["query_used"] for r in P.candidates(inp).collect()}
    assert used == {(1, 10): "hybrid", (2, 10): "direct", (2, 11): "direct"}
    out = {r["id"]: list(r["documents"]) for r in P.results(inp, "BM25", ("BODY",)).collect()}
    assert len(out[1]) == 1 and len(out[2]) == 2 and out[3] == [] and out[4] == []
    stats = E.run_stats(P.question_status(inp)).first()
    assert (stats["questions"], stats["extraction_failures"], stats["retries_started"], stats["retries_failed"]) == (4, 0, 2, 1)


def test_questions_without_keywords_are_ranked_by_their_body(spark):
    q = spark.createDataFrame([(1, "the body"), (2, "other")], "id long, body string")
    kw = spark.createDataFrame([(2, 1, "term")], "id long, pos int, term string")
    got = {(r["mode"], r["id"]): r["query"] for r in R.rerank_query(q, kw).collect()}
    assert got["BODY", 1] == "the body" and got["KEYWORDS", 1] == "" and got["BODY + KEYWORDS", 1] == "the body "
    assert got["KEYWORDS", 2] == "term"


def test_empty_query_ranks_nothing(spark):
    a = arts(spark, [(1, "N/A", "N/A")])
    cand = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 99, 1)], "id long, doc_id long, retr_rank int")
    q = spark.createDataFrame([(1, ""), (2, "text"), (3, "")], "id long, query string")
    got = sorted((r["id"], r["doc_id"]) for r in R.rank_with_fallback(q, cand, a, RT.TextIndex.build(a), "BM25").collect())
    assert got == [(2, 1), (3, 99)]  # nothing fetched at all: the search order stands


def test_bm25_floor_is_the_mean_over_all_candidate_terms(spark):
    import math
    a = arts(spark, [(1, "common rare", "N/A"), (2, "common other", "N/A"), (3, "common common third", "N/A")])
    cand = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "id long, doc_id long, retr_rank int")
    q = spark.createDataFrame([(1, "common rare")], "id long, query string")
    got = {r["doc_id"]: r["score"] for r in R.rerank_bm25(q, cand, RT.TextIndex.build(a)).collect()}
    idf = lambda df: math.log(3 - df + 0.5) - math.log(df + 0.5)
    floor = 0.25 * (idf(3) + 3 * idf(1)) / 4
    part = lambda w, tf, dl: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (7 / 3)))
    want = {1: part(floor, 1, 2) + part(idf(1), 1, 2), 2: part(floor, 1, 2), 3: part(floor, 2, 3)}
    assert got == pytest.approx({k: round(v, 6) for k, v in want.items()}, abs=2e-6)


def test_embedding_follows_the_query_mode(spark):
    a = arts(spark, [(1, "x", "N/A"), (2, "y", "N/A")])
    cand = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "id long, doc_id long, retr_rank int")
    q = spark.createDataFrame([("BODY", 1, "b"), ("KEYWORDS", 1, "k")], "mode string, id long, query string")
    qe = spark.createDataFrame([(1, "BODY", [1.0, 0.0]), (1, "KEYWORDS", [0.0, 1.0])], "id long, mode string, vec array<double>")
    de = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "doc_id long, vec array<double>")
    got = {r["mode"]: r["doc_id"] for r in R.rerank_embedding(q, cand, RT.TextIndex.build(a), qe, de).collect() if r["rank"] == 1}
    assert got == {"BODY": 1, "KEYWORDS": 2}


def test_gold_pairs(spark):
    q = spark.createDataFrame([(1, "BRCA1"), (2, "what does brca1 do?"), (3, "???"), (4, None), (5, "a a a")], "id long, body string")
    d = spark.createDataFrame([(1, "Here BRCA1 is."), (2, "brca12 only"), (3, "So, what does BRCA1 do? It"), (4, None), (5, "a a b a")],
                              "doc_id long, text string")
    assert sorted(map(tuple, FX.gold_pairs(q, d).collect())) == [(1, 1), (1, 3), (2, 3)]


def test_macro_of_no_question_is_zero(spark):
    cols = ", ".join(f"{m} double" for m in E.METRICS) + ", mrr_reported double, id long"
    r = E.macro_metrics(spark.createDataFrame([], cols)).first()
    assert all(r[m] == 0.0 for m in E.METRICS) and r["n_questions"] == 0


def test_run_stats_tell_extraction_from_filtering(spark):
    rows = [(1, True, 0, 0, 0, True, 0, False), (2, True, 2, 0, 0, True, 0, False), (3, True, 2, 2, 5, False, 5, True), (4, False, 0, 0, 0, True, 0, False)]
    r = E.run_stats(spark.createDataFrame(rows, "id long, has_body boolean, n_extracted long, n_keywords long, initial_hits long, "
                                                "retried boolean, final_hits long, partial_fetch boolean")).first()
    assert (r["extraction_failures"], r["zero_keywords"], r["zero_hits"], r["retries_started"], r["partial_fetches"]) == (1, 1, 1, 1, 1)


def test_strip_counts_the_fields_present(spark):
    row = "document: string, text: string, rerank_score: double, rerank_position: int"
    df = spark.createDataFrame([(1, [("u", "t", 1.0, 1), ("v", "t", None, 2), ("w", "t", None, None)]), (2, [])],
                               f"id long, snippets array<struct<{row}>>")
    out = {r["id"]: (r["removed"], r["snippets"]) for r in S.strip_rerank_fields(df).collect()}
    assert out[1][0] == 3 and out[2][0] == 0 and set(out[1][1][0].asDict()) == {"document", "text"}


def test_fetch_keeps_missing_and_repeated_candidates(spark):
    a = arts(spark, [(1, "t", "a")])
    cand = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 9, 1), (2, 1, 1)], "id long, doc_id long, retr_rank int")
    got = sorted((r["id"], r["doc_id"], r["retr_rank"], r["found"]) for r in RT.fetch_details(cand, a).collect())
    assert got == [(1, 1, 2, True), (1, 9, 1, False), (2, 1, 1, True)]


def test_escapes_in_list_responses(spark):
    df = spark.createDataFrame([(1, r"['a\nb', 'it\'s', 'back\\n', 'tab\tx']")], "id int, raw string")
    assert [r["keyword"] for r in RS.parse_keyword_responses(df).collect()] == ["a\nb", "it's", "back\\n", "tab\tx"]


def test_article_batches(spark, tmp_dir):
    os.makedirs(tmp_dir)
    put = lambda name, text: open(f"{tmp_dir}/{name}", "w").write(text)
    put("a.xml", '<?xml version="1.0"?><AnyRoot><PubmedArticle><PMID> 1 </PMID><ArticleTitle>T <i>in</i>line</ArticleTitle>'
                 '<Abstract><AbstractText Label="aim">A <b>x</b></AbstractText>\n<AbstractText> B </AbstractText><AbstractText Label="no"/>'
                 '</Abstract></PubmedArticle>\n<PubmedArticle><PMID>2</PMID></PubmedArticle></AnyRoot>')
    put("b.xml", "<PubmedArticleSet><PubmedArticle><PMID>3</PMID><ArticleTitle>bad</ArticleTitle></PubmedArticle><PubmedArticle>")
    put("c.xml", "<PubmedArticleSet><PubmedArticle><PMID>2</PMID><ArticleTitle>later</ArticleTitle></PubmedArticle></PubmedArticleSet>")
    put("d.xml", "")
    got = sorted(map(tuple, SA.parse_articles(spark, tmp_dir).collect()))
    assert got == [("1", "T inline", "AIM: A x B"), ("2", "later", "N/A")]


def test_question_files_number_and_keep_everything(spark, tmp_dir):
    os.makedirs(tmp_dir)
    json.dump({"questions": [{"body": "no id", "snippets": [{"text": "s"}], "year": 3}, {"id": "b", "body": "B"}]},
              open(f"{tmp_dir}/f1.json", "w"), indent=2)
    json.dump({"questions": [{"body": "C"}, "not an object"]}, open(f"{tmp_dir}/f2.json", "w"))
    rows = SQ.scan_questions(spark, tmp_dir).orderBy("seq").collect()
    assert [(r["seq"], r["id"]) for r in rows] == [(0, "unknown_1"), (1, "b"), (2, "unknown_3")]
    assert json.loads(rows[0]["raw"]) == {"body": "no id", "snippets": [{"text": "s"}], "year": 3}


def test_indented_metric_and_result_files(spark, tmp_dir):
    os.makedirs(tmp_dir)
    m = {"S@10": 1, "P@10": 0.1, "R@10": 1, "F1@10": 0.2, "MAP@10": 0, "MRR": 1, "NDCG@10": 0.5}
    json.dump({"Ranked": "BM25", "Query_ranked": "BODY", "metrics": m}, open(f"{tmp_dir}/TRAIN_metrics_a.json", "w"), indent=2)
    json.dump({"Ranked": "BM25", "metrics": {}}, open(f"{tmp_dir}/TRAIN_metrics_empty.json", "w"), indent=2)
    rows = SR.scan_metrics(spark, tmp_dir).collect()
    assert [(r["file_name"], r["query_type"], r["ndcg10"]) for r in rows] == [("TRAIN_metrics_a.json", "BODY", 0.5)]
    json.dump({"questions": [{"id": "q", "body": "B", "documents": ["u"], "snippets": [
        {"document": "u", "text": "t", "offsetInEndSection": 1, "rerank_score": 0.5, "rerank_position": 1}]}]},
        open(f"{tmp_dir}/TRAIN_results_x.json", "w"), indent=2)
    r = [x for x in SR.scan_result_files(spark, tmp_dir).collect() if x["id"]][0]
    assert (r["id"], list(r["documents"]), r["snippets"][0]["rerank_score"]) == ("q", ["u"], 0.5)
    assert S.strip_rerank_fields(SR.scan_result_files(spark, tmp_dir).filter("id is not null")).first()["removed"] == 2


def test_word_associations_in_both_file_shapes(spark, tmp_dir):
    os.makedirs(tmp_dir + "/whole")
    json.dump({"a": {"b": 3, "c": 1}, "d": {"b": 2}}, open(f"{tmp_dir}/whole/organised.json", "w"), indent=2)
    want = [("a", "b", 3), ("a", "c", 1), ("d", "b", 2)]
    back = SB.scan_word_repr(spark, tmp_dir + "/whole")
    assert sorted(map(tuple, back.collect())) == want
    SB.write_word_repr_json(back, tmp_dir + "/lines")
    assert sorted(map(tuple, SB.scan_word_repr(spark, tmp_dir + "/lines").collect())) == want


def test_gold_pairs_are_found_when_asked_for(spark, monkeypatch):
    """Loading the inputs, as each query does, does not search the corpus for gold pairs."""
    asked = []
    monkeypatch.setattr(FX, "qrels", lambda *_: asked.append(1) or spark.createDataFrame([(1, 2)], "id long, doc_id long"))
    monkeypatch.setattr(FX, "table", lambda *_: spark.createDataFrame(
        [(1, "a b", 1, [1.0])], "doc_id long, text string, vec_id long, embedding array<float>").withColumn("item_id", F.col("doc_id")))
    inp = P.Inputs.load(spark, "/none", persist=False)
    assert not asked and [tuple(r) for r in inp.qrels.collect()] == [(1, 2)] and asked


def test_usable_documents_are_found_without_stripping_texts_twice(spark):
    """The filter looks for a first kept character only; what is kept and how it is stripped stays the same."""
    rows = [(1, "a", "N/A"), (2, " \x1c", "N/A"), (3, "N/A", "　b\x85"), (4, None, ""), (5, " ", "\t"), (6, "", " c d\n")]
    texts = RT.doc_text(spark.createDataFrame(rows, "doc_id long, title string, abstract string"))
    assert {r["doc_id"]: r["text"] for r in texts.collect()} == {1: "a", 3: "b", 6: "c d"}
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("trim(" in line.replace("ltrim(", "") for line in filters), plan


def test_bm25_runs_are_read_as_plain_characters_first(spark):
    text = "a1\tb c,dé \x85e  f--g　\n0"
    df = spark.createDataFrame([(text,)], "t string")
    runs, tokens = df.select(F.regexp_extract_all("t", F.lit(T.BM25_KEEP_RE), 0), T.tokens_bm25("t")).first()
    assert tokens == ["a1", "b", "cd", "e", "fg", "0"]
    assert runs[0] == "a1" and "".join(runs) == "".join(c for c in text if c in "a1bcdefg0" or c.isspace())
