"""The written index and the rankers on it against plain Python, on random rows: phrases, fields, folders,
blocks, and terms beyond what a broadcast may hold."""

import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import keywords as K
from lodestar.operators import rerank as R
from lodestar.operators import retrieval as RT
from lodestar.plans import pipeline as P
from lodestar.sources import runs as SR

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]


def articles(rng, n):
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    return [(i, text(5) or "N/A", text(9) or "N/A") for i in range(n)]


def fields_of(row):
    part = lambda x: [] if x == "N/A" else x.split()
    title, abstract = part(row[1]), part(row[2])
    return {"text": title + abstract, "title": title, "abstract": abstract}


def holds(tokens, phrase):
    return any(tokens[i:i + len(phrase)] == phrase for i in range(len(tokens) - len(phrase) + 1))


@pytest.fixture(params=["broadcast", "shuffle"])
def index(request, spark, monkeypatch):
    rows = articles(random.Random(7), 120)
    monkeypatch.setattr(RT, "BLOCK_DOCS", 13)
    monkeypatch.setattr(RT, "SLICES", 3)
    if request.param == "shuffle":
        monkeypatch.setattr(RT, "small", lambda df, rows=0: df)
    table = spark.createDataFrame(rows, "doc_id long, title string, abstract string")
    index = RT.TextIndex.build(table, persist=True)
    assert index.shape() == (16, math.ceil(sum(bool(fields_of(r)["text"]) for r in rows) / 13))
    return rows, index


@pytest.mark.parametrize("field", [None, "title/abstract"])
def test_hybrid_search_with_phrases(spark, index, field):
    rows, index = index
    rng = random.Random(3)
    kw = [(q, p, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3])))) for q in range(25) for p in range(1, rng.randrange(2, 6))]
    want = {}
    for q in range(25):
        terms = [t.split() for i, _, t in kw if i == q]
        found = []
        for r in rows:
            tokens = fields_of(r)
            searched = [tokens["text"]] if field is None else [tokens["title"], tokens["abstract"]]
            hit = [any(holds(x, t) for x in searched) for t in terms]
            if all(hit[:2]) and (len(terms) <= 2 or any(hit[2:])):
                found.append((-sum(hit), r[0]))
        for n, (m, d) in enumerate(sorted(found)[:20], 1):
            want[q, d] = (n, len(found), -m)
    got = RT.boolean_search(spark.createDataFrame(kw, "id long, pos int, term string"), index, 2, 20, field)
    assert {(r["id"], r["doc_id"]): (r["retr_rank"], r["total_count"], r["matched"]) for r in got.collect()} == want


def test_clauses_with_fields_and_phrases(spark, index):
    rows, index = index
    clauses = [(1, 1, "alpha beta", "title", False), (1, 1, "gamma", None, False), (1, 2, "zeta", "abstract", True),
               (2, 1, "beta beta", None, False), (2, 2, "eta", "Title/Abstract", False), (3, 1, "nothing here", None, False)]
    def hit(r, term, field):
        f = fields_of(r)
        return any(holds(f[x], term.split()) for x in {None: ["text"], "title": ["title"], "abstract": ["abstract"]}.get(field, ["title", "abstract"]))
    want = set()
    for q in (1, 2, 3):
        for r in rows:
            own = [c for c in clauses if c[0] == q]
            groups = {c[1] for c in own if not c[4]}
            if all(any(hit(r, c[2], c[3]) for c in own if c[1] == g) for g in groups) and not any(hit(r, c[2], c[3]) for c in own if c[4]):
                want.add((q, r[0]))
    got = RT.clause_search(spark.createDataFrame(clauses, "id long, clause_no int, term string, field string, negated boolean"), index)
    assert {(r["id"], r["doc_id"]) for r in got.collect()} == want and want


def test_phrases_do_not_read_texts(spark, index):
    _, index = index
    kw = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "eta")], "id long, pos int, term string")
    RT.boolean_search(kw, index).collect()
    plan = RT.boolean_search(kw, index)._jdf.queryExecution().executedPlan().toString()
    assert "occ_docs" in plan and "title#" not in plan and "abstract#" not in plan


@pytest.mark.parametrize("cap", [3, 6, 7, 9, 5000])
@pytest.mark.parametrize("persist", [True, False])
def test_tfidf_shares_statistics_between_queries(spark, cap, persist):
    """Vocabularies that the query changes near the edge, against a restatement per query."""
    rng = random.Random(cap)
    words = [f"{c}{c}" for c in "abcdefghijk"]
    docs = {i: [rng.choice(words[:9]) for _ in range(rng.randrange(1, 12))] for i in range(40)}
    docs[40] = []
    cand = [(q, d, n + 1) for q in range(6) for n, d in enumerate(rng.sample(sorted(docs), 12))]
    queries = [(m, q, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for q in range(6) for m in ("A", "B", "C")]
    table = spark.createDataFrame([(i, " ".join(t) or "x", "N/A") for i, t in docs.items()], "doc_id long, title string, abstract string")
    got = R.rerank_tfidf(spark.createDataFrame(queries, "mode string, id long, query string"),
                         spark.createDataFrame(cand, "id long, doc_id long, retr_rank int"), RT.TextIndex.build(table, persist), max_features=cap)
    want = {}
    for m, q, text in queries:
        if not text:
            continue
        own = [d for i, d, _ in cand if i == q]
        corpus = [Counter(docs[d]) for d in own] + [Counter(text.split())]
        total = sum(corpus, Counter())
        vocabulary = sorted(total, key=lambda t: (-total[t], t))[:cap]
        idf = {t: math.log((1 + len(corpus)) / (1 + sum(t in c for c in corpus))) + 1 for t in vocabulary}
        vectors = [{t: c[t] * idf[t] for t in vocabulary if t in c} for c in corpus]
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        for d, v in zip(own, vectors):
            n = norm(v) * norm(vectors[-1])
            want[m, q, d] = sum(x * vectors[-1].get(t, 0) for t, x in v.items()) / n if n else 0.0
    rows = got.collect()
    assert {(r["mode"], r["id"], r["doc_id"]) for r in rows} == set(want)
    for r in rows:
        assert r["score"] == pytest.approx(want[r["mode"], r["id"], r["doc_id"]], abs=2e-6)


def test_a_key_of_all_questions_spreads(spark):
    k = spark.range(300).select("id", F.lit("hot").alias("key")).unionByName(spark.createDataFrame([(1, "cold")], "id long, key string"))
    wr = spark.range(200).select(F.lit("hot").alias("key"), F.concat(F.lit("w"), "id").alias("word"), F.col("id").alias("weight"))
    wr = wr.unionByName(spark.createDataFrame([("cold", "w1", 5)], "key string, word string, weight long"))
    rows = K.heavy_light_join(k, wr, heavy=1000, grid=4)
    assert rows.count() == 300 * 200 + 1 == k.join(wr, "key").count()
    assert sorted(map(tuple, rows.filter("id = 1").collect())) == sorted(map(tuple, k.join(wr, "key").filter("id = 1").select("key", "id", "word", "weight").collect()))
    keys = k.withColumn("pos", F.lit(1)).withColumnRenamed("key", "term").select("id", "pos", "term")
    top = K.expand_keywords(keys, wr).filter("id = 1 AND source = 'expansion'").orderBy("pos").collect()
    assert [r["term"] for r in top] == ["w199", "w198", "w197"]


def test_ranks_of_a_hot_key_are_dealt(spark):
    rows = [("hot", f"w{i:04d}", i % 7) for i in range(3000)] + [("cold", "b", 1), ("cold", "a", 1), ("cold", "c", 2)]
    got = K.sort_word_repr(spark.createDataFrame(rows, "key string, word string, weight long").repartition(5)).collect()
    for key in ("hot", "cold"):
        order = sorted([r for r in rows if r[0] == key], key=lambda r: (-r[2], r[1]))
        assert [(r["word"], r["rank"]) for r in sorted((r for r in got if r["key"] == key), key=lambda r: r["rank"])] == [
            (w, n) for n, (_, w, _) in enumerate(order, 1)]
    assert K.sort_word_repr(spark.createDataFrame([], "key string, word string, weight long")).count() == 0


def test_run_documents_are_one_file_each(spark, tmp_dir):
    rows = [(r, "BODY", i, i, f"question {i} \"quoted\"", [f"u/{i}"] * (i % 3)) for r in ("BM25", "TF-IDF") for i in range(50)]
    results = spark.createDataFrame(rows, "ranker string, mode string, id long, seq long, body string, documents array<string>").withColumn(
        "snippets", F.array(F.struct(F.lit("d").alias("document"), F.lit(1.5).alias("rerank_score")))).repartition(7)
    SR.write_result_documents(results, tmp_dir, "TRAIN", "t")
    assert sorted(f for f in os.listdir(tmp_dir) if not f.startswith((".", "_"))) == ["TRAIN_results_BM25_BODY_t.json", "TRAIN_results_TFIDF_BODY_t.json"]
    document = json.load(open(f"{tmp_dir}/TRAIN_results_BM25_BODY_t.json"))
    assert list(document) == ["questions"] and [q["id"] for q in document["questions"]] == [str(i) for i in range(50)]
    assert document["questions"][4]["documents"] == ["u/4"] and document["questions"][0]["snippets"][0]["rerank_score"] == 1.5
    assert SR.scan_result_files(spark, tmp_dir).count() == 100


def test_metric_documents_hold_their_questions(spark, tmp_dir):
    from lodestar.operators.evaluation import METRICS
    one = ", ".join(f"{m} double" for m in METRICS)
    macro = spark.createDataFrame([("BM25", "BODY", *[0.5] * 7), ("BM25", "BODY + KEYWORDS", *[0.25] * 7)], f"ranker string, mode string, {one}")
    per = spark.createDataFrame([("BM25", "BODY", i, 9 - i, *[i / 10] * 7) for i in range(10)], f"ranker string, mode string, id long, seq long, {one}")
    SR.write_metric_documents(per, macro, tmp_dir, "TRAIN", "t")
    document = json.load(open(f"{tmp_dir}/TRAIN_metrics_BM25_BODY_t.json"))
    assert document["Ranked"] == "BM25" and document["metrics"]["MRR"] == 0.5
    assert [q["id"] for q in document["questions"]] == [str(i) for i in range(9, -1, -1)] and document["questions"][0]["S@10"] == 0.9
    assert json.load(open(f"{tmp_dir}/TRAIN_metrics_BM25_BODY_KEYWORDS_t.json"))["questions"] == []
    assert SR.scan_metrics(spark, tmp_dir).count() == 2 and SR.scan_metric_questions(spark, tmp_dir).count() == 10


def test_pipeline_on_stored_responses(spark):
    """Keywords of the responses (phrases too), expansion and the stored clauses of the retry all reach the results."""
    table = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, "beta alpha", "gamma"), (3, "delta", "word"), (4, "eps", "N/A")],
                                  "doc_id long, title string, abstract string")
    none = lambda schema: spark.createDataFrame([], schema)
    inp = P.Inputs(questions=spark.createDataFrame([(1, 1, "q one"), (2, 2, "q two"), (3, 3, "q three")], "id long, seq long, body string"),
                   articles=table, unigrams=none("word string, freq double"), gold=none("id long, doc_id long"),
                   index=RT.TextIndex.build(table, persist=True),
                   responses=spark.createDataFrame([(1, 0, "['Alpha beta', 'gamma']"), (2, 0, "unfindable, the"), (3, 1, "key")], "id long, turn long, raw string"),
                   word_repr=spark.createDataFrame([("key", "delta", 3)], "key string, word string, weight long"),
                   clauses=spark.createDataFrame([(2, 1, "eps", "title", False)], "id long, clause_no int, term string, field string, negated boolean"),
                   n_core=1)
    assert {(r["id"], r["term"]) for r in P.keywords(inp).collect()} == {(1, "alpha beta"), (1, "gamma"), (2, "unfindable"), (3, "delta"), (3, "key")}
    got = {(r["id"], r["doc_id"], r["query_used"]) for r in P.candidates(inp).collect()}
    assert got == {(1, 1, "hybrid"), (2, 4, "direct")}
    assert P.results(inp, "BM25", ("KEYWORDS",)).count() == 3
    assert P.question_status(inp).filter("n_extracted > 0").count() == 3


def test_rankers_count_the_candidates_only(spark):
    """Texts that no question has among its candidates are not counted; the same candidates are counted once."""
    table = spark.createDataFrame([(i, f"alpha beta w{i}", "N/A") for i in range(30)], "doc_id long, title string, abstract string")
    index = RT.TextIndex.build(table, persist=True)
    cand = spark.createDataFrame([(1, 3, 1), (1, 5, 2), (2, 5, 1)], "id long, doc_id long, retr_rank int")
    queries = spark.createDataFrame([(1, "w3 w9"), (2, "alpha")], "id long, query string")
    got = {(r["id"], r["doc_id"]): r["rank"] for r in R.rerank_bm25(queries, cand, index).collect()}
    assert got == {(1, 3): 1, (1, 5): 2, (2, 5): 1}
    assert "bm25_forward" not in index.tables and index.among(cand) is index.among(cand)
    assert sorted(r["doc_id"] for r in index.among(cand).forward().collect()) == [3, 5]


def test_a_block_is_a_task_and_its_texts_move_once(spark, monkeypatch):
    monkeypatch.setattr(RT, "BLOCK_DOCS", 50)
    written = []
    monkeypatch.setattr(RT, "materialize", lambda df, name, by=None: written.append((name, df)) or df)
    table = spark.createDataFrame([(i % 400, f"alpha w{i}", "N/A") for i in range(500)], "doc_id long, title string, abstract string")
    index = RT.TextIndex.build(table, persist=True)
    rows = index.blocks().select("term", F.explode("docs").alias("d")).collect()
    assert sorted(r["d"] for r in rows if r["term"] == "alpha") == sorted(i % 400 for i in range(500))
    plan = dict(written)["blocks"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "direct_shuffle_partition_id" in plan and ", 10)" in plan


def test_an_unknown_query_term_takes_its_place_in_the_vocabulary(spark):
    """A query term that no candidate holds can push the last term out of a capped vocabulary."""
    table = spark.createDataFrame([(1, "aa aa aa bb", "N/A"), (2, "bb cc", "N/A")], "doc_id long, title string, abstract string")
    cand = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "id long, doc_id long, retr_rank int")
    got = R.rerank_tfidf(spark.createDataFrame([(1, "zz zz zz zz bb")], "id long, query string"), cand, RT.TextIndex.build(table, True), max_features=2)
    # vocabulary: zz 4 times; aa and bb 3 times, aa first
    assert {r["doc_id"]: r["score"] for r in got.collect()} == {1: 0.0, 2: 0.0}
