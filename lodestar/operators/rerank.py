"""Re-rankers over each question's own candidate set.

Collection statistics (N, avgdl, df, idf, vocabulary) are scoped to the
candidates of one question, never to the whole corpus, so they are grouped
aggregates keyed by question. Ranking ties: ``(round(score, 6) desc,
doc_id asc)``; fallbacks keep retrieval order (``retr_rank``).

``queries`` carries the key columns (``id`` plus optional run keys such as
``mode``) and ``query``; ``cand`` is ``(id, doc_id, retr_rank)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import tokens_bm25, tokens_tfidf
from ..session import materialize
from .retrieval import TextIndex, small

SCORE_DIGITS = 6


def rerank_query(questions: DataFrame, keywords: DataFrame,
                 modes: Sequence[str] = C.QUERY_MODES) -> DataFrame:
    """``(mode, id, query)``: BODY, KEYWORDS (space-joined filtered keywords,
    empty when none is left) or BODY + KEYWORDS."""
    kw = (keywords.groupBy("id")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))),
                                        lambda s: s["term"]), " ").alias("kw")))
    q = questions.select("id", "body").join(kw, "id", "left").withColumn("kw", F.coalesce("kw", F.lit("")))
    q = q.select("id", "body", "kw", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    text = (F.when(F.col("mode") == "BODY", F.col("body"))
            .when(F.col("mode") == "KEYWORDS", F.col("kw"))
            .otherwise(F.concat(F.col("body"), F.lit(" "), F.col("kw"))))
    return q.select("mode", "id", text.alias("query"))


def _keys(queries: DataFrame) -> list[str]:
    return [c for c in queries.columns if c != "query"]


def _rank(scored: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(
        F.when(F.col("fallback"), F.col("retr_rank")).asc_nulls_first(),
        F.round("score", SCORE_DIGITS).desc(), F.col("doc_id").asc())
    return scored.select(*keys, "doc_id", F.round("score", SCORE_DIGITS).alias("score"),
                         F.row_number().over(w).alias("rank"))


def usable_candidates(cand: DataFrame, index: TextIndex) -> DataFrame:
    """Candidates whose document has usable text."""
    return cand.select("id", "doc_id", "retr_rank").join(index.usable_ids, "doc_id", "left_semi").select(
        "id", "doc_id", "retr_rank")


def rerank_bm25(queries: DataFrame, cand: DataFrame, index: TextIndex,
                k1: float = C.BM25_K1, b: float = C.BM25_B, eps: float = C.BM25_EPSILON) -> DataFrame:
    """Okapi BM25 with the epsilon floor: a negative idf is replaced by
    ``eps * mean(idf)`` over all distinct terms of the question's candidates.

    Documents come from the forward table of the candidates, and
    each gives up its counts of the query's terms only. An idf is negative only for a
    term in more than half of the candidates, so the mean over all candidate
    terms is built just for questions with such a query term.
    -> ``(keys..., doc_id, score, rank)``. All candidates without tokens
    (avgdl 0) make the ranking fall back to retrieval order, scores 0.
    """
    keys = _keys(queries)
    asked = queries.filter(F.col("query").isNotNull() & (F.col("query") != ""))
    index = index.among(cand)
    c = usable_candidates(cand, index)
    docs = index.forward()
    # statistics over one question's candidates (at most the search cap): windows, not joins with themselves
    per_question = Window.partitionBy("id")
    cl = (c.join(docs.select("doc_id", "dl"), "doc_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
          .withColumn("n", F.count(F.lit(1)).over(per_question)).withColumn("sumdl", F.sum("dl").over(per_question)))
    if index.persist:
        cl = materialize(cl, "bm25_candidates")
    qt = (asked.select(*keys, F.explode(tokens_bm25("query")).alias("term"))
          .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf")))
    qt = _coded(qt, index, index.vocabulary()).filter("code IS NOT NULL").drop("term")
    if index.persist:
        qt = materialize(qt, "bm25_queries")
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # (id, code, doc_id, tf, dl, ...) of query terms only
    terms = qt.select("id", "code").distinct()
    hits = (cl.join(terms, "id").join(_counts_of(docs, terms, index), ["doc_id", "code"])
            .withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("id", "code"))).withColumn("idf", idf))
    floored = hits.filter("idf < 0").select("id").distinct()
    floor = (cl.select("id", "doc_id", "n").join(floored, "id", "left_semi").join(docs.select("doc_id", "codes"), "doc_id")
             .repartition("id").select("id", "n", F.explode("codes").alias("code"))
             .groupBy("id", "n", "code").agg(F.count(F.lit(1)).alias("df"))
             .groupBy("id").agg((F.avg(idf) * eps).alias("eps_idf")))
    weight = F.when(F.col("idf") < 0, F.col("eps_idf")).otherwise(F.col("idf"))
    norm = k1 * (1 - b + b * F.col("dl") / (F.col("sumdl") / F.col("n")))
    scores = (hits.join(floor, "id", "left").join(qt, ["id", "code"])
              .select(*keys, "doc_id", (F.col("qtf") * weight * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("s"))
              .groupBy(*keys, "doc_id").agg(F.sum("s").alias("score")))
    scored = (asked.select(*keys).join(cl, "id").join(scores, [*keys, "doc_id"], "left")
              .select(*keys, "doc_id", "retr_rank", (F.col("sumdl") == 0).alias("fallback"),
                      F.when(F.col("sumdl") == 0, F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score")))
    return _rank(scored, keys)


def _coded(terms: DataFrame, index: TextIndex, vocabulary: DataFrame) -> DataFrame:
    """``terms`` with the vocabulary's ``code`` (null: not in it). The vocabulary is cut to the terms first."""
    wanted = terms.select("term").distinct()
    known = vocabulary.join(small(wanted) if index.persist else wanted, "term", "left_semi")
    return terms.join(known, "term", "left")


def _counts_of(docs: DataFrame, codes: DataFrame, index: TextIndex) -> DataFrame:
    """``(doc_id, code, tf)`` of the documents for the given codes only."""
    wanted = codes.select("code").distinct()
    return (docs.select("doc_id", F.explode(F.arrays_zip("codes", "tfs")).alias("x"))
            .select("doc_id", F.col("x.codes").alias("code"), F.col("x.tfs").alias("tf"))
            .join(small(wanted) if index.persist else wanted, "code", "left_semi"))


def tfidf_statistics(asked: DataFrame, cand: DataFrame, docs: DataFrame, index: TextIndex,
                     max_features: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What all queries of a question share, built once.

    ``asked(id, code)``: the terms of any of the question's queries (null: of no candidate); ``cand(id, doc_id)``; ``docs``: a
    forward table. A query changes the counts of its own terms only, so at most as many other terms
    enter or leave the vocabulary, all near its edge. The terms are thus either *plain* (in
    every query's vocabulary, with the same weight), or *special* (asked, or near the
    edge), or out.

    -> ``(id, doc_id, plain)``: the sum of squared weights of a candidate's plain terms (a candidate
    without terms is absent); ``(id, code, df, tot)``: the special terms; ``(id, room)``: the places
    that the plain terms leave in the vocabulary."""
    # by question first: the exploded rows then meet where they are
    rows = (cand.select("id", "doc_id").join(docs.select("doc_id", "codes", "tfs"), "doc_id").repartition("id")
            .select("id", "doc_id", F.explode(F.arrays_zip("codes", "tfs")).alias("x"))
            .select("id", "doc_id", F.col("x.codes").alias("code"), F.col("x.tfs").alias("tf")))
    n = cand.groupBy("id").agg(F.count(F.lit(1)).alias("n_docs"))
    a = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n_asked"))
    order = Window.partitionBy("id").orderBy(F.col("tot").desc(), F.col("code").asc())
    n_asked = F.coalesce("n_asked", F.lit(0))
    sure, out = F.lit(max_features) - n_asked, F.lit(max_features) + n_asked
    ranked = (rows.groupBy("id", "code").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tot"))
              .withColumn("r", F.row_number().over(order))
              .join(asked.withColumn("is_asked", F.lit(True)), ["id", "code"], "left").join(n, "id").join(a, "id", "left"))
    special = F.col("is_asked").isNotNull() | (F.col("r") > sure)
    kept = (ranked.filter(F.col("is_asked").isNotNull() | (F.col("r") <= out))
            .select("id", "code", "df", "tot", special.alias("special"), (F.log((F.col("n_docs") + 2.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    if index.persist:
        kept = materialize(kept, "tfidf_terms")
    weight = F.when(F.col("special"), 0.0).otherwise(F.col("tf") * F.col("idf"))
    plain = (rows.join(kept.select("id", "code", "special", "idf"), ["id", "code"], "left")
             .groupBy("id", "doc_id").agg(F.coalesce(F.sum(weight * weight), F.lit(0.0)).alias("plain")))
    room = kept.groupBy("id").agg((F.lit(max_features) - F.count_if(~F.col("special"))).alias("room"))
    return plain, kept.filter("special").select("id", "code", "df", "tot"), room


def rerank_tfidf(queries: DataFrame, cand: DataFrame, index: TextIndex, max_features: int = C.TFIDF_MAX_FEATURES,
                 stop_words=C.TFIDF_STOP_WORDS) -> DataFrame:
    """Cosine of L2-normalised tf-idf vectors; the query is a document of
    the corpus (n = candidates + 1), ``idf = ln((1+n)/(1+df)) + 1``, and only
    the ``max_features`` terms with the highest total count are kept
    (ties by term). No vocabulary at all -> retrieval order, scores 0.

    Counts, ranks and norms of a question's candidates are built once
    (``tfidf_statistics``); a query (mode) then corrects them by its own terms and the terms at the
    vocabulary's edge, a short list.

    -> ``(keys..., doc_id, score, rank)``.
    """
    keys = _keys(queries)
    kind = "tfidf" if stop_words is C.TFIDF_STOP_WORDS else f"tfidf_{len(stop_words)}"
    of = lambda text: tokens_tfidf(text, stop_words)
    index = index.among(cand)
    vocabulary = index.vocabulary(kind, of)
    c = usable_candidates(cand, index)
    q = queries.filter(F.col("query").isNotNull() & (F.col("query") != ""))
    qt = (q.select(*keys, F.explode(of("query")).alias("term"))
          .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf")))
    qt = _coded(qt, index, vocabulary)
    if index.persist:
        qt = materialize(qt, "tfidf_queries")
    docs = index.forward(kind, of)
    asked = qt.select("id", "term", "code").distinct().select("id", "code")
    plain, special, room = tfidf_statistics(asked, c, docs, index, max_features)
    if index.persist:
        plain, special = materialize(plain, "tfidf_plain"), materialize(special, "tfidf_special")
    # the special terms of each query's corpus, and those of them that its vocabulary takes
    qk = q.select(*keys).join(c.groupBy("id").agg(F.count(F.lit(1)).alias("n_docs")), "id")
    codes = special.select("code").distinct()
    named = vocabulary.join(small(codes) if index.persist else codes, "code", "left_semi")
    known = q.select(*keys).join(special.join(named, "code"), "id").drop("code")
    stat = (known.join(qt.drop("code"), [*keys, "term"], "full")
            .select(*keys, "term", F.coalesce("qtf", F.lit(0)).alias("qtf"),
                    (F.coalesce("df", F.lit(0)) + F.when(F.col("qtf").isNotNull(), 1).otherwise(0)).alias("df"),
                    (F.coalesce("tot", F.lit(0)) + F.coalesce("qtf", F.lit(0))).alias("tot")))
    wv = Window.partitionBy(*keys).orderBy(F.col("tot").desc(), F.col("term").asc())
    idf = F.log((F.col("n_docs") + 2.0) / (F.col("df") + 1.0)) + 1.0
    vocab = (stat.withColumn("vr", F.row_number().over(wv)).join(qk, keys).join(room, "id", "left")
             .filter(F.col("vr") <= F.coalesce("room", F.lit(max_features)))
             .select(*keys, "term", "qtf", idf.alias("idf")))
    norms = vocab.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("nq"))
    # a query's candidates: special terms that are in its vocabulary, on top of the plain ones
    weight = F.col("tf") * F.col("idf")
    own = (vocab.join(named, "term").join(c.select("id", "doc_id"), "id").join(_counts_of(docs, special, index), ["doc_id", "code"])
           .groupBy(*keys, "doc_id").agg(F.sum(weight * weight).alias("own"), F.sum(weight * F.col("qtf") * F.col("idf")).alias("dot")))
    base = (q.select(*keys).join(c, "id").join(norms, keys, "left").join(plain, ["id", "doc_id"], "left")
            .join(own, [*keys, "doc_id"], "left")
            .withColumn("nd", F.sqrt(F.coalesce("plain", F.lit(0.0)) + F.coalesce("own", F.lit(0.0)))))
    # no term in the query nor in any candidate: no vocabulary
    terms = F.max(F.when(F.col("plain").isNotNull() | F.col("nq").isNotNull(), True)).over(Window.partitionBy(*keys))
    scored = base.select(*keys, "doc_id", "retr_rank", terms.isNull().alias("fallback"),
                         F.when((F.col("nq") > 0) & (F.col("nd") > 0), F.coalesce("dot", F.lit(0.0)) / (F.col("nq") * F.col("nd")))
                         .otherwise(F.lit(0.0)).alias("score"))
    return _rank(scored, keys)


def rerank_embedding(queries: DataFrame, cand: DataFrame, index: TextIndex,
                     q_emb: DataFrame, d_emb: DataFrame) -> DataFrame:
    """Cosine between the stored vector of the query and each candidate's
    stored vector; a missing or zero vector scores 0. ``q_emb(id[, mode], vec)``
    (one vector per query text), ``d_emb(doc_id, vec)``.

    -> ``(keys..., doc_id, score, rank)``.
    """
    keys = _keys(queries)
    on = [k for k in keys if k in q_emb.columns]
    c = usable_candidates(cand, index.among(cand))
    qv = q_emb.select(*on, "vec").withColumnRenamed("vec", "qv").withColumn("qv", F.transform("qv", lambda x: x.cast("double")))
    qv = qv.withColumn("qn", _norm("qv"))
    # stored vectors cover the corpus: cut to the candidates before they move
    dv = (index.of_docs(d_emb, c)
          .select("doc_id", F.transform("vec", lambda x: x.cast("double")).alias("dv")).withColumn("dn", _norm("dv")))
    dot = F.aggregate(F.zip_with("qv", "dv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    base = (queries.filter(F.col("query").isNotNull() & (F.col("query") != "")).select(*keys)
            .join(c.join(dv, "doc_id", "left"), "id").join(qv, on, "left"))
    score = F.when((F.col("qn") > 0) & (F.col("dn") > 0), dot / (F.col("qn") * F.col("dn"))).otherwise(F.lit(0.0))
    scored = base.select(*keys, "doc_id", "retr_rank", F.lit(False).alias("fallback"),
                         F.coalesce(score, F.lit(0.0)).alias("score"))
    return _rank(scored, keys)


def _norm(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def rank_with_fallback(queries: DataFrame, cand: DataFrame, articles: DataFrame,
                       index: TextIndex, ranker: str = "BM25", **kw) -> DataFrame:
    """Dispatch on the ranker name, with the pipeline's fallbacks:
    no article found -> retrieval order, score 0; articles but no usable
    text -> found articles in retrieval order, score 0, unless the query is
    empty: an empty query ranks nothing.

    -> ``(keys..., doc_id, score, rank)``.
    """
    keys = _keys(queries)
    pairs = cand.select("id", "doc_id")
    found_pairs = pairs.join(articles.select("doc_id"), "doc_id", "left_semi").withColumn("found", F.lit(True))
    n_found = found_pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_found"))
    n_usable = usable_candidates(cand, index.among(cand)).groupBy("id").agg(F.count(F.lit(1)).alias("n_usable"))
    status = (pairs.select("id").distinct().join(n_found, "id", "left").join(n_usable, "id", "left")
              .select("id", F.coalesce("n_found", F.lit(0)).alias("n_found"),
                      F.coalesce("n_usable", F.lit(0)).alias("n_usable")))
    ok_ids = status.filter(F.col("n_usable") > 0).select("id")
    qok = queries.join(ok_ids, "id", "left_semi")
    if ranker == "BM25":
        ranked = rerank_bm25(qok, cand, index)
    elif ranker == "TF-IDF":
        ranked = rerank_tfidf(qok, cand, index)
    elif ranker == "EMBEDDING":
        ranked = rerank_embedding(qok, cand, index, kw["q_emb"], kw["d_emb"])
    else:
        raise ValueError(f"unknown ranker {ranker!r}")
    fb = queries.join(status.filter(F.col("n_usable") == 0), "id")
    asked = F.col("query").isNotNull() & (F.col("query") != "")
    fb_docs = (fb.join(cand.select("id", "doc_id", "retr_rank"), "id").join(found_pairs, ["id", "doc_id"], "left")
               .filter((F.col("n_found") == 0) | (F.col("found").isNotNull() & asked)))
    w = Window.partitionBy(*keys).orderBy("retr_rank")
    fallback = fb_docs.select(*keys, "doc_id", F.lit(0.0).alias("score"), F.row_number().over(w).alias("rank"))
    return ranked.unionByName(fallback)


def top_k(ranked: DataFrame, k: int = C.TOP_N) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)

