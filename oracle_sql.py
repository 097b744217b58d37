"""DuckDB restatements of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's
views, the same regex classes (no \\w / \\s), the same tie-breaks and
6-digit rounding of scores.
"""

from __future__ import annotations

from lodestar.functions import constants as C

# Patterns written out for this engine's regular expressions (RE2).
SPACE = (r"\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
NOT_BM25 = rf"[^a-z0-9{SPACE}]"
SPACES = rf"[{SPACE}]+"
TWO_OR_MORE = r"[\p{L}\p{N}_]{2,}"
ONE_OR_MORE = r"[\p{L}\p{N}_]+"
ENDS = rf"^[{SPACE}]+|[{SPACE}]+$"
STRING_LITERAL = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
FIRST_LIST = r"(?s)(\[.*?\])"
STRING_LIST = rf"^\[[{SPACE}]*(?:{STRING_LITERAL}(?:[{SPACE}]*,[{SPACE}]*{STRING_LITERAL})*[{SPACE}]*,?)?[{SPACE}]*\]$"


def _lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def TOK1(x: str) -> str:
    return (f"list_filter(string_split_regex(regexp_replace(lower({x}), '{NOT_BM25}', '', 'g'), "
            f"'{SPACES}'), lambda t: t <> '')")


def TOK2(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '{TWO_OR_MORE}'), "
            f"lambda t: NOT list_contains({_lit_list(C.TFIDF_STOP_WORDS)}, t))")


def TOK3(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{ONE_OR_MORE}')"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '{ENDS}', '', 'g')"  # Python str.strip()


def USABLE(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL AND {x} <> '' AND {x} <> 'N/A' THEN {x} END)"


STOP_GENERAL = _lit_list(C.GENERAL_STOP_WORDS)
STOP_MEDICAL = _lit_list(C.MEDICAL_STOP_WORDS)
NL = "chr(10)"

# name -> (dependencies, body)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name, deps, body):
    VIEWS[name] = (deps, body)


view("v_questions", [], "SELECT item_id AS id, item_id AS seq, text AS body FROM benchmark")
view("v_articles", [], f"""
SELECT doc_id,
  CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, 1, strpos(text, {NL}) - 1) ELSE text END AS title,
  CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, strpos(text, {NL}) + 1) ELSE 'N/A' END AS abstract
FROM documents""")
view("v_doc_text", ["v_articles"], f"""
SELECT doc_id, title, abstract, text FROM (
  SELECT doc_id, title, abstract, {STRIP(f"concat_ws(' ', {USABLE('title')}, {USABLE('abstract')})")} AS text
  FROM v_articles) WHERE text <> ''""")
view("v_postings", ["v_doc_text"], f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK1('text')}) AS term FROM v_doc_text)
GROUP BY doc_id, term""")
view("v_doclen", ["v_postings"], "SELECT doc_id, sum(tf) AS dl FROM v_postings GROUP BY doc_id")
view("v_unigrams", [], f"""
SELECT word, count(*)::DOUBLE AS freq FROM (SELECT unnest({TOK3('text')}) AS word FROM conversations) GROUP BY word""")
view("v_wf", ["v_questions"], f"""
SELECT id, word, count(*) AS count FROM (SELECT id, unnest({TOK3('body')}) AS word FROM v_questions) GROUP BY id, word""")
view("v_weird", ["v_wf", "v_unigrams"], """
SELECT f.id, f.word, f.count,
  CASE WHEN (SELECT count(*) FROM v_unigrams) = 0 THEN NULL
       WHEN u.freq IS NULL THEN 0.1
       ELSE u.freq / (f.count * (SELECT count(*) FROM v_unigrams)) * 1000 END AS weirdness
FROM v_wf f LEFT JOIN v_unigrams u ON u.word = f.word""")
view("v_domain", ["v_weird"], """
SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(weirdness, 6), count DESC, word) AS pos, word AS term
FROM v_weird WHERE weirdness < 10""")
view("v_kwf", ["v_domain"], f"""
SELECT id, pos, lower(term) AS term FROM v_domain
WHERE NOT list_contains({STOP_GENERAL}, lower(term)) AND NOT list_contains({STOP_MEDICAL}, lower(term))
  AND length(term) > 1 AND regexp_matches(term, '[\\p{{L}}\\p{{N}}]')""")
view("v_keywords", ["v_kwf"], "SELECT id, min(pos) AS pos, term FROM v_kwf GROUP BY id, term")
view("v_terms", ["v_keywords"], f"""
SELECT id, k, pos, replace(term, '"', '') AS term FROM (
  SELECT id, pos, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM (
    SELECT id, pos, {STRIP('term')} AS term FROM v_keywords) WHERE length(term) > 1)
WHERE replace(term, '"', '') <> ''""")
view("v_sterms", ["v_terms"], f"SELECT id, k, term, k <= 1 AS core, {TOK1('term')} AS toks FROM v_terms")
view("v_need", ["v_sterms"], """
SELECT id, sum(CASE WHEN core THEN 1 ELSE 0 END) AS n_core, sum(CASE WHEN core THEN 0 ELSE 1 END) AS n_rest
FROM v_sterms GROUP BY id""")
view("v_hits", ["v_sterms", "v_postings", "v_doc_text"], f"""
SELECT DISTINCT s.id, s.k, s.core, p.doc_id FROM v_sterms s JOIN v_postings p ON len(s.toks) = 1 AND p.term = s.toks[1]
UNION
SELECT DISTINCT s.id, s.k, s.core, d.doc_id FROM v_sterms s JOIN v_doc_text d
  ON len(s.toks) > 1 AND contains(' ' || array_to_string({TOK1('d.text')}, ' ') || ' ', ' ' || array_to_string(s.toks, ' ') || ' ')""")
view("v_ok", ["v_hits", "v_need"], """
SELECT h.id, h.doc_id, count(*) AS matched
FROM v_hits h JOIN v_need n ON n.id = h.id
GROUP BY h.id, h.doc_id, n.n_core, n.n_rest
HAVING sum(CASE WHEN h.core THEN 1 ELSE 0 END) = n.n_core
   AND (n.n_rest = 0 OR sum(CASE WHEN h.core THEN 0 ELSE 1 END) > 0)""")
view("v_search", ["v_ok"], """
SELECT id, doc_id, retr_rank, total_count, matched FROM (
  SELECT id, doc_id, matched, row_number() OVER (PARTITION BY id ORDER BY matched DESC, doc_id) AS retr_rank,
         count(*) OVER (PARTITION BY id) AS total_count FROM v_ok) WHERE retr_rank <= 500""")
def search_views(n_core: int) -> str:
    """Hybrid search with ``n_core`` core terms; returns the result view."""
    sfx = f"_c{n_core}"
    view("v_sterms" + sfx, ["v_terms"], f"SELECT id, k, term, k <= {n_core} AS core, {TOK1('term')} AS toks FROM v_terms")
    view("v_need" + sfx, ["v_sterms" + sfx], f"""
SELECT id, sum(CASE WHEN core THEN 1 ELSE 0 END) AS n_core, sum(CASE WHEN core THEN 0 ELSE 1 END) AS n_rest
FROM v_sterms{sfx} GROUP BY id""")
    view("v_hits" + sfx, ["v_sterms" + sfx, "v_postings", "v_doc_text"], f"""
SELECT DISTINCT s.id, s.k, s.core, p.doc_id FROM v_sterms{sfx} s JOIN v_postings p ON len(s.toks) = 1 AND p.term = s.toks[1]
UNION
SELECT DISTINCT s.id, s.k, s.core, d.doc_id FROM v_sterms{sfx} s JOIN v_doc_text d
  ON len(s.toks) > 1 AND contains(' ' || array_to_string({TOK1('d.text')}, ' ') || ' ', ' ' || array_to_string(s.toks, ' ') || ' ')""")
    view("v_search" + sfx, ["v_hits" + sfx, "v_need" + sfx], f"""
SELECT id, doc_id, retr_rank, total_count, matched FROM (
  SELECT id, doc_id, matched, row_number() OVER (PARTITION BY id ORDER BY matched DESC, doc_id) AS retr_rank,
         count(*) OVER (PARTITION BY id) AS total_count FROM (
    SELECT h.id, h.doc_id, count(*) AS matched FROM v_hits{sfx} h JOIN v_need{sfx} n ON n.id = h.id
    GROUP BY h.id, h.doc_id, n.n_core, n.n_rest
    HAVING sum(CASE WHEN h.core THEN 1 ELSE 0 END) = n.n_core
       AND (n.n_rest = 0 OR sum(CASE WHEN h.core THEN 0 ELSE 1 END) > 0)))
WHERE retr_rank <= 500""")
    return "v_search" + sfx


def clause_views(name: str, clauses_sql: str, deps: list[str]) -> str:
    view(name + "_t", deps, f"""
SELECT id, clause_no, term, negated, {TOK1('term')} AS toks FROM ({clauses_sql})
WHERE term IS NOT NULL AND {STRIP('term')} <> ''""")
    view(name + "_h", [name + "_t", "v_postings", "v_doc_text"], f"""
SELECT DISTINCT c.id, c.clause_no, c.term, c.negated, p.doc_id FROM {name}_t c JOIN v_postings p
  ON len(c.toks) = 1 AND p.term = c.toks[1]
UNION
SELECT DISTINCT c.id, c.clause_no, c.term, c.negated, d.doc_id FROM {name}_t c JOIN v_doc_text d
  ON len(c.toks) > 1 AND contains(' ' || array_to_string({TOK1('d.text')}, ' ') || ' ', ' ' || array_to_string(c.toks, ' ') || ' ')""")
    view(name, [name + "_t", name + "_h"], f"""
SELECT id, doc_id, retr_rank, total_count, matched FROM (
  SELECT id, doc_id, matched, row_number() OVER (PARTITION BY id ORDER BY matched DESC, doc_id) AS retr_rank,
         count(*) OVER (PARTITION BY id) AS total_count FROM (
    SELECT p.id, p.doc_id, p.matched FROM (
      SELECT id, doc_id, count(DISTINCT clause_no) AS ch, count(DISTINCT CAST(clause_no AS VARCHAR) || chr(1) || term) AS matched
      FROM {name}_h WHERE NOT negated GROUP BY id, doc_id) p
    JOIN (SELECT id, count(DISTINCT clause_no) AS n_pos FROM {name}_t WHERE NOT negated GROUP BY id) n ON n.id = p.id
    WHERE p.ch = n.n_pos
      AND NOT EXISTS (SELECT 1 FROM {name}_h x WHERE x.negated AND x.id = p.id AND x.doc_id = p.doc_id)))
WHERE retr_rank <= 500""")
    return name


RETRY_CLAUSES = "SELECT id, 1 AS clause_no, term, false AS negated FROM v_keywords"
clause_views("v_clause2", RETRY_CLAUSES + """
UNION ALL
SELECT k.id, 2 AS clause_no, k.term, true AS negated FROM v_keywords k
JOIN (SELECT id, count(*) AS n, max(pos) AS mp FROM v_keywords GROUP BY id) x ON x.id = k.id
WHERE x.n >= 3 AND k.pos = x.mp""", ["v_keywords"])
clause_views("v_retryc", RETRY_CLAUSES, ["v_keywords"])


def retry_view(n_core: int) -> str:
    first = search_views(n_core)
    name = f"v_retry_c{n_core}"
    view(name, [first, "v_retryc", "v_questions"], f"""
SELECT id, doc_id, retr_rank, total_count, 'hybrid' AS query_used FROM {first}
UNION ALL
SELECT id, doc_id, retr_rank, total_count, 'direct' AS query_used FROM v_retryc
WHERE id IN (SELECT id FROM v_questions WHERE body IS NOT NULL AND body <> '')
  AND id NOT IN (SELECT id FROM {first})""")
    return name


retry_view(3)
retry_view(1)

# what the pipeline ranks: three core terms first, then the retry
view("v_final", ["v_retry_c3"], "SELECT * FROM v_retry_c3")
view("v_cand", ["v_final", "v_doc_text"], """
SELECT id, doc_id, retr_rank FROM v_final WHERE doc_id IN (SELECT doc_id FROM v_doc_text)""")
view("v_kwstr", ["v_keywords"], "SELECT id, string_agg(term, ' ' ORDER BY pos) AS kw FROM v_keywords GROUP BY id")
view("v_rq", ["v_questions", "v_kwstr"], """
SELECT m.mode, q.id, CASE WHEN m.mode = 'BODY' THEN q.body WHEN m.mode = 'KEYWORDS' THEN k.kw
                          ELSE q.body || ' ' || k.kw END AS query
FROM v_questions q
JOIN (SELECT x.id, coalesce(s.kw, '') AS kw FROM v_questions x LEFT JOIN v_kwstr s ON s.id = x.id) k ON k.id = q.id,
     (SELECT unnest(['BODY', 'KEYWORDS', 'BODY + KEYWORDS']) AS mode) m
WHERE q.body IS NOT NULL AND q.body <> ''""")
# --- BM25 over each question's candidates ---
view("v_bm_cl", ["v_cand", "v_doclen"], """
SELECT c.id, c.doc_id, c.retr_rank, coalesce(d.dl, 0) AS dl FROM v_cand c LEFT JOIN v_doclen d ON d.doc_id = c.doc_id""")
view("v_bm_st", ["v_bm_cl"], "SELECT id, count(*) AS n, sum(dl) AS sumdl, sum(dl) / count(*) AS avgdl FROM v_bm_cl GROUP BY id")
view("v_bm_ct", ["v_cand", "v_postings"], "SELECT c.id, c.doc_id, p.term, p.tf FROM v_cand c JOIN v_postings p ON p.doc_id = c.doc_id")
view("v_bm_df", ["v_bm_ct", "v_bm_st"], """
SELECT t.id, t.term, ln(s.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
FROM v_bm_ct t JOIN v_bm_st s ON s.id = t.id GROUP BY t.id, t.term, s.n""")
view("v_bm_eps", ["v_bm_df"], "SELECT id, avg(idf) * 0.25 AS eps FROM v_bm_df GROUP BY id")


def _mk(mode: str) -> str:
    return mode.replace(" + ", "_").lower()


def bm25_view(mode: str) -> str:
    """Registers the BM25 views for one query mode; returns the result view."""
    m = _mk(mode)
    view(f"v_bm_q_{m}", ["v_rq"], f"SELECT id, query FROM v_rq WHERE mode = '{mode}' AND query IS NOT NULL AND query <> ''")
    view(f"v_bm_qt_{m}", [f"v_bm_q_{m}"], f"""
SELECT id, term, count(*) AS qtf FROM (SELECT id, unnest({TOK1('query')}) AS term FROM v_bm_q_{m}) GROUP BY id, term""")
    view(f"v_bm_qidf_{m}", [f"v_bm_qt_{m}", "v_bm_df", "v_bm_eps"], f"""
SELECT qt.id, qt.term, qt.qtf, CASE WHEN d.idf < 0 THEN e.eps ELSE d.idf END AS idf
FROM v_bm_qt_{m} qt JOIN v_bm_df d ON d.id = qt.id AND d.term = qt.term JOIN v_bm_eps e ON e.id = qt.id""")
    view(f"v_bm_sc_{m}", [f"v_bm_qidf_{m}", "v_bm_ct", "v_bm_cl", "v_bm_st"], f"""
SELECT t.id, t.doc_id, sum(q.qtf * q.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * cl.dl / s.avgdl))) AS score
FROM v_bm_qidf_{m} q JOIN v_bm_ct t ON t.id = q.id AND t.term = q.term
JOIN v_bm_cl cl ON cl.id = t.id AND cl.doc_id = t.doc_id JOIN v_bm_st s ON s.id = t.id
GROUP BY t.id, t.doc_id""")
    view(f"v_bm25_{m}", [f"v_bm_q_{m}", f"v_bm_sc_{m}", "v_cand", "v_bm_st"], f"""
SELECT id, doc_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY id ORDER BY CASE WHEN fb THEN retr_rank END ASC NULLS FIRST,
                     round(score, 6) DESC, doc_id) AS rank
FROM (SELECT c.id, c.doc_id, c.retr_rank, s.sumdl = 0 AS fb,
        CASE WHEN s.sumdl = 0 THEN 0.0 ELSE coalesce(sc.score, 0.0) END AS score
      FROM v_cand c JOIN v_bm_st s ON s.id = c.id LEFT JOIN v_bm_sc_{m} sc ON sc.id = c.id AND sc.doc_id = c.doc_id
      WHERE c.id IN (SELECT id FROM v_bm_q_{m}))""")
    return f"v_bm25_{m}"


for _m in C.QUERY_MODES:
    bm25_view(_m)


view("v_tf_post", ["v_doc_text"], f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK2('text')}) AS term FROM v_doc_text) GROUP BY doc_id, term""")
view("v_tf_n", ["v_cand"], "SELECT id, count(*) AS n_docs FROM v_cand GROUP BY id")
view("v_tf_ct", ["v_cand", "v_tf_post"], "SELECT c.id, c.doc_id, p.term, p.tf FROM v_cand c JOIN v_tf_post p ON p.doc_id = c.doc_id")
view("v_tf_dstat", ["v_tf_ct"], "SELECT id, term, count(*) AS df_d, sum(tf) AS tot_d FROM v_tf_ct GROUP BY id, term")


def tfidf_view(mode: str) -> str:
    m = _mk(mode)
    view(f"v_tf_q_{m}", ["v_rq"], f"SELECT id, query FROM v_rq WHERE mode = '{mode}' AND query IS NOT NULL AND query <> ''")
    view(f"v_tf_qt_{m}", [f"v_tf_q_{m}"], f"""
SELECT id, term, count(*) AS qtf FROM (SELECT id, unnest({TOK2('query')}) AS term FROM v_tf_q_{m}) GROUP BY id, term""")
    view(f"v_tf_stat_{m}", [f"v_tf_q_{m}", f"v_tf_qt_{m}", "v_tf_dstat"], f"""
SELECT coalesce(d.id, q.id) AS id, coalesce(d.term, q.term) AS term, coalesce(q.qtf, 0) AS qtf,
       coalesce(d.df_d, 0) + CASE WHEN q.qtf IS NOT NULL THEN 1 ELSE 0 END AS df,
       coalesce(d.tot_d, 0) + coalesce(q.qtf, 0) AS tot
FROM (SELECT * FROM v_tf_dstat WHERE id IN (SELECT id FROM v_tf_q_{m})) d
FULL OUTER JOIN v_tf_qt_{m} q ON q.id = d.id AND q.term = d.term""")
    view(f"v_tf_vocab_{m}", [f"v_tf_stat_{m}", "v_tf_n"], f"""
SELECT s.id, s.term, s.qtf, ln((n.n_docs + 2.0) / (s.df + 1.0)) + 1.0 AS idf FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY tot DESC, term) AS vr FROM v_tf_stat_{m}) s
JOIN v_tf_n n ON n.id = s.id WHERE s.vr <= 5000""")
    view(f"v_tf_qn_{m}", [f"v_tf_vocab_{m}"], f"""
SELECT id, sqrt(sum((qtf * idf) * (qtf * idf))) AS nq FROM v_tf_vocab_{m} WHERE qtf > 0 GROUP BY id""")
    view(f"v_tf_dw_{m}", [f"v_tf_vocab_{m}", "v_tf_ct"], f"""
SELECT t.id, t.doc_id, t.term, t.tf * v.idf AS wd, v.qtf * v.idf AS wq
FROM v_tf_ct t JOIN v_tf_vocab_{m} v ON v.id = t.id AND v.term = t.term""")
    view(f"v_tfidf_{m}", [f"v_tf_q_{m}", f"v_tf_dw_{m}", f"v_tf_qn_{m}", f"v_tf_vocab_{m}", "v_cand"], f"""
SELECT id, doc_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY id ORDER BY CASE WHEN fb THEN retr_rank END ASC NULLS FIRST,
                     round(score, 6) DESC, doc_id) AS rank
FROM (SELECT c.id, c.doc_id, c.retr_rank, vv.id IS NULL AS fb,
        CASE WHEN qn.nq > 0 AND dn.nd > 0 THEN coalesce(dot.dot, 0.0) / (qn.nq * dn.nd) ELSE 0.0 END AS score
      FROM v_cand c
      LEFT JOIN (SELECT DISTINCT id FROM v_tf_vocab_{m}) vv ON vv.id = c.id
      LEFT JOIN (SELECT id, doc_id, sqrt(sum(wd * wd)) AS nd FROM v_tf_dw_{m} GROUP BY id, doc_id) dn
             ON dn.id = c.id AND dn.doc_id = c.doc_id
      LEFT JOIN (SELECT id, doc_id, sum(wd * wq) AS dot FROM v_tf_dw_{m} WHERE wq > 0 GROUP BY id, doc_id) dot
             ON dot.id = c.id AND dot.doc_id = c.doc_id
      LEFT JOIN v_tf_qn_{m} qn ON qn.id = c.id
      WHERE c.id IN (SELECT id FROM v_tf_q_{m}))""")
    return f"v_tfidf_{m}"


def _vsum(expr_i: str, arr: str) -> str:
    return f"list_reduce(list_transform(range(1, len({arr}) + 1), lambda i: {expr_i}), lambda acc, x: acc + x)"


view("v_qemb", ["v_questions"], f"""
SELECT id, mode, v AS qv, sqrt({_vsum('v[i] * v[i]', 'v')}) AS qn
FROM (SELECT q.id, m.mode, CAST(e.embedding AS DOUBLE[]) AS v
      FROM v_questions q, (VALUES (0, 'BODY'), (1, 'KEYWORDS'), (2, 'BODY + KEYWORDS')) m(n, mode), embeddings e
      WHERE e.vec_id = 25 * ((q.id * 3 + m.n) % (SELECT count(*) FROM embeddings WHERE vec_id % 25 = 0)))""")
view("v_demb", [], f"""
SELECT vec_id AS doc_id, v AS dv, sqrt({_vsum('v[i] * v[i]', 'v')}) AS dn
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 25 <> 0)""")


def emb_view(mode: str) -> str:
    m = _mk(mode)
    view(f"v_emb_{m}", ["v_rq", "v_cand", "v_qemb", "v_demb"], f"""
SELECT id, doc_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, doc_id) AS rank
FROM (SELECT c.id, c.doc_id,
        CASE WHEN q.qn > 0 AND d.dn > 0 THEN {_vsum('q.qv[i] * d.dv[i]', 'q.qv')} / (q.qn * d.dn) ELSE 0.0 END AS score
      FROM v_cand c LEFT JOIN v_qemb q ON q.id = c.id AND q.mode = '{mode}' LEFT JOIN v_demb d ON d.doc_id = c.doc_id
      WHERE c.id IN (SELECT id FROM v_rq WHERE mode = '{mode}' AND query IS NOT NULL AND query <> ''))""")
    return f"v_emb_{m}"


for _m in C.QUERY_MODES:
    tfidf_view(_m)
    emb_view(_m)

# ranking with the pipeline fallbacks (no article found / no usable text)
view("v_status", ["v_final", "v_articles", "v_doc_text"], """
SELECT s.id, count(a.doc_id) AS n_found, count(t.doc_id) AS n_usable
FROM v_final s LEFT JOIN v_articles a ON a.doc_id = s.doc_id LEFT JOIN v_doc_text t ON t.doc_id = s.doc_id
GROUP BY s.id""")


def ranked_view(ranker: str, mode: str) -> str:
    m = _mk(mode)
    inner = {"BM25": f"v_bm25_{m}", "TF-IDF": f"v_tfidf_{m}", "EMBEDDING": f"v_emb_{m}"}[ranker]
    name = f"v_rank_{ranker.replace('-', '').lower()}_{m}"
    view(name, [inner, "v_status", "v_final", "v_articles", "v_rq"], f"""
SELECT r.id, r.doc_id, r.score, r.rank FROM {inner} r JOIN v_status st ON st.id = r.id WHERE st.n_usable > 0
UNION ALL
SELECT s.id, s.doc_id, 0.0 AS score, row_number() OVER (PARTITION BY s.id ORDER BY s.retr_rank) AS rank
FROM v_final s JOIN v_status st ON st.id = s.id LEFT JOIN v_articles a ON a.doc_id = s.doc_id
JOIN v_rq q ON q.id = s.id AND q.mode = '{mode}'
WHERE st.n_usable = 0 AND (st.n_found = 0 OR (a.doc_id IS NOT NULL AND q.query IS NOT NULL AND q.query <> ''))""")
    return name


for _r in C.RANKERS:
    for _m in C.QUERY_MODES:
        ranked_view(_r, _m)


def with_views(sql: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{sql}" if ctes else sql


def _tok_sql(tok) -> str:
    return (f"SELECT doc_id, pos, token FROM (SELECT doc_id, unnest({tok('text')}) AS token, "
            f"generate_subscripts({tok('text')}, 1) AS pos FROM documents)")


BM25_BODY = ["v_bm25_body"]

SNIPPET_SQL = f"""
SELECT r.id, 'http://www.ncbi.nlm.nih.gov/pubmed/' || r.doc_id AS document,
  CASE WHEN length(fulltext) > 250 THEN substr(fulltext, 1, 247) || '...' ELSE fulltext END AS text,
  sec AS "beginSection", sec AS "endSection", 0 AS "offsetInBeginSection",
  length(CASE WHEN length(fulltext) > 250 THEN substr(fulltext, 1, 247) || '...' ELSE fulltext END) AS "offsetInEndSection",
  r.score AS rerank_score, r.rank AS rerank_position
FROM (SELECT r.*, a.title, a.abstract,
        CASE WHEN {USABLE('a.title')} IS NOT NULL AND {USABLE('a.abstract')} IS NOT NULL THEN a.title || '. ' || a.abstract
             WHEN {USABLE('a.title')} IS NOT NULL THEN a.title
             WHEN {USABLE('a.abstract')} IS NOT NULL THEN a.abstract
             ELSE '[Title/Abstract N/A]' END AS fulltext,
        CASE WHEN {USABLE('a.abstract')} IS NOT NULL THEN 'abstract'
             WHEN {USABLE('a.title')} IS NOT NULL THEN 'title' ELSE 'N/A' END AS sec
      FROM v_bm25_body r JOIN v_articles a ON a.doc_id = r.doc_id WHERE r.rank <= 10) r"""

ORACLES: dict[str, str] = {
    "tokenize_bm25": _tok_sql(TOK1),
    "tokenize_tfidf": _tok_sql(TOK2),
    "tokenize_words": _tok_sql(TOK3),
    "doc_text": with_views("SELECT doc_id, text FROM v_doc_text", ["v_doc_text"]),
    "word_freq": with_views("SELECT id, word, count FROM v_wf", ["v_wf"]),
    "weirdness": with_views("SELECT id, word, count, round(weirdness, 6) AS weirdness FROM v_weird", ["v_weird"]),
    "domain_words": with_views("SELECT id, pos, term FROM v_domain", ["v_domain"]),
    "domain_words_fallback": with_views("""
SELECT id, pos, word AS term FROM (
  SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY count DESC, word) AS pos FROM v_wf) WHERE pos <= 3""",
                                        ["v_wf"]),
    "keyword_filter": with_views("SELECT id, pos, term FROM v_kwf", ["v_kwf"]),
    "keyword_dedup": with_views("SELECT id, pos, term FROM v_keywords", ["v_keywords"]),
    "clean_terms": with_views("SELECT id, k, term FROM v_terms", ["v_terms"]),
    "hybrid_query_string": with_views("""
SELECT id, concat_ws(' AND ',
    CASE WHEN count(*) FILTER (WHERE k <= 2) > 1 THEN '(' || string_agg(qt, ' AND ' ORDER BY k) FILTER (WHERE k <= 2) || ')'
         ELSE string_agg(qt, ' AND ' ORDER BY k) FILTER (WHERE k <= 2) END,
    CASE WHEN count(*) FILTER (WHERE k > 2) > 1 THEN '(' || string_agg(qt, ' OR ' ORDER BY k) FILTER (WHERE k > 2) || ')'
         ELSE string_agg(qt, ' OR ' ORDER BY k) FILTER (WHERE k > 2) END) AS query
FROM (SELECT id, k, CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END AS qt FROM v_terms)
GROUP BY id""", ["v_terms"]),
    "boolean_search": with_views("SELECT id, doc_id, retr_rank, total_count, matched FROM v_search", ["v_search"]),
    "fetch_details": with_views("""
SELECT s.id, s.doc_id, s.retr_rank, a.title, a.abstract, a.doc_id IS NOT NULL AS found,
  count(a.doc_id) OVER (PARTITION BY s.id) < count(*) OVER (PARTITION BY s.id) AS partial
FROM v_final s LEFT JOIN v_articles a ON a.doc_id = s.doc_id""", ["v_final", "v_articles"]),
    "rerank_query": with_views("SELECT mode, id, query FROM v_rq", ["v_rq"]),
    "rerank_bm25": with_views("SELECT * FROM v_bm25_body", BM25_BODY),
    "topk_documents": with_views("SELECT * FROM v_bm25_body WHERE rank <= 10", BM25_BODY),
    "build_snippets": with_views(SNIPPET_SQL, BM25_BODY + ["v_articles"]),
    "rerank_tfidf": with_views("SELECT * FROM v_tfidf_body", ["v_tfidf_body"]),
    "rerank_embedding": with_views("SELECT * FROM v_emb_body", ["v_emb_body"]),
    "rank_with_fallback": with_views("SELECT * FROM v_rank_bm25_keywords", ["v_rank_bm25_keywords"]),
    "extract_id": """
SELECT page_id, url, coalesce(nullif(regexp_extract(url, '([0-9]+)/?$', 1), ''), '0') AS extracted_id FROM pages""",
}

ORACLES["pipeline_results"] = with_views(f"""
SELECT q.id, q.seq, q.body, s.document, s.text, s."beginSection", s."endSection", s."offsetInBeginSection",
       s."offsetInEndSection", s.rerank_score, s.rerank_position
FROM v_questions q JOIN ({SNIPPET_SQL}) s ON s.id = q.id""", BM25_BODY + ["v_articles", "v_questions"])

# ---------------------------------------------------------------- evaluation
URL = "'http://www.ncbi.nlm.nih.gov/pubmed/'"


def EXTRACT_ID(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '([0-9]+)/?$', 1), ''), '0')"


def DCG(m: str) -> str:
    return f"(CASE WHEN {m} >= 1 THEN list_sum(list_transform(range(1, {m} + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0.0 END)"


view("v_qrels", ["v_questions"], f"""
SELECT DISTINCT q.id, d.doc_id
FROM (SELECT id, ' ' || array_to_string({TOK3('body')}, ' ') || ' ' AS phrase FROM v_questions WHERE len({TOK3('body')}) > 0) q
JOIN (SELECT doc_id, ' ' || array_to_string({TOK3('text')}, ' ') || ' ' AS norm FROM documents) d ON contains(d.norm, q.phrase)""")
view("v_gold", ["v_qrels", "v_questions"], f"""
SELECT DISTINCT id, {EXTRACT_ID(f"{URL} || doc_id")} AS key FROM v_qrels
UNION ALL
SELECT id, '0' AS key FROM v_questions WHERE id NOT IN (SELECT id FROM v_qrels)""")
view("v_nrel", ["v_gold"], "SELECT id, count(*) AS n_rel FROM v_gold GROUP BY id")


def eval_view(ranker: str, mode: str) -> str:
    rv = ranked_view(ranker, mode)
    name = "v_ev_" + rv[len("v_rank_"):]
    view(name + "_d", [rv, "v_questions", "v_gold"], f"""
SELECT d.id, d.seq, d.rank, d.document, d.rel,
       sum(d.rel) OVER (PARTITION BY d.id ORDER BY d.rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
FROM (SELECT q.id, q.seq, r.rank, r.document,
        CASE WHEN r.document IS NULL THEN NULL WHEN g.key IS NOT NULL THEN 1 ELSE 0 END AS rel
      FROM v_questions q
      LEFT JOIN (SELECT id, rank, {URL} || doc_id AS document FROM {rv} WHERE rank <= 10) r ON r.id = q.id
      LEFT JOIN v_gold g ON g.id = q.id AND g.key = {EXTRACT_ID('r.document')}) d""")
    view(name + "_a", [name + "_d", "v_nrel"], f"""
SELECT d.id, d.seq, count(d.document) AS n, CAST(coalesce(sum(d.rel), 0) AS BIGINT) AS hits, n.n_rel,
       avg(CASE WHEN d.rel = 1 THEN d.cum / d.rank END) AS ap,
       min(CASE WHEN d.rel = 1 THEN d.rank END) AS first_hit,
       count(CASE WHEN d.rel = 1 AND d.rank <= (SELECT CAST(coalesce(sum(x.rel), 0) AS BIGINT) FROM {name}_d x WHERE x.id = d.id) THEN 1 END) AS a
FROM {name}_d d JOIN v_nrel n ON n.id = d.id GROUP BY d.id, d.seq, n.n_rel""")
    view(name, [name + "_a"], f"""
SELECT id, seq, n AS n_docs, s10, p10, r10,
  CASE WHEN p10 + r10 > 0 THEN 2 * p10 * r10 / (p10 + r10) ELSE 0.0 END AS f1_10,
  map10, mrr, ndcg10,
  last_value(CASE WHEN n < 10 THEN mrr END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS mrr_reported
FROM (SELECT *, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS s10, hits / 10.0 AS p10, hits / n_rel AS r10,
        CASE WHEN n < 10 THEN 0.0 ELSE coalesce(ap, 0.0) END AS map10,
        coalesce(1.0 / first_hit, 0.0) AS mrr,
        CASE WHEN n <= 1 THEN 0.0 WHEN hits = 0 THEN 0.0 WHEN hits = n THEN 1.0
             ELSE (a / hits * {DCG('hits')} + (hits - a) / (n - hits) * ({DCG('n')} - {DCG('hits')})) / {DCG('hits')} END
          AS ndcg10
      FROM {name}_a)""")
    return name


METRIC_SQL = ["s10", "p10", "r10", "f1_10", "map10", "mrr", "ndcg10"]


def _r(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


GRID = [(r, m) for r in C.RANKERS for m in C.QUERY_MODES]
_grid_parts = []
for _i, (_r_, _m_) in enumerate(GRID, start=1):
    _ev = eval_view(_r_, _m_)
    _grid_parts.append((_ev, f"""
SELECT {_i} AS run_no, '{_r_}' AS ranker, '{_m_}' AS mode,
  avg(s10) AS s10, avg(p10) AS p10, avg(r10) AS r10, avg(f1_10) AS f1_10, avg(map10) AS map10,
  coalesce(avg(mrr_reported), 0.0) AS mrr, avg(ndcg10) AS ndcg10, avg(mrr) AS mrr_true, count(*) AS n_questions
FROM {_ev}"""))
view("v_runs", [p for p, _ in _grid_parts], "\nUNION ALL\n".join(sql for _, sql in _grid_parts))

ORACLES.update({
    "eval_metrics": with_views(f"SELECT id, seq, n_docs, {_r(METRIC_SQL)} FROM v_ev_bm25_body", ["v_ev_bm25_body"]),
    "mrr_reported": with_views("SELECT id, seq, n_docs, round(mrr, 6) AS mrr, round(mrr_reported, 6) AS mrr_reported "
                               "FROM v_ev_bm25_body", ["v_ev_bm25_body"]),
    "macro_metrics": with_views(f"""
SELECT {_r(METRIC_SQL)}, round(mrr_true, 6) AS mrr_true, n_questions FROM (
  SELECT avg(s10) AS s10, avg(p10) AS p10, avg(r10) AS r10, avg(f1_10) AS f1_10, avg(map10) AS map10,
         coalesce(avg(mrr_reported), 0.0) AS mrr, avg(ndcg10) AS ndcg10, avg(mrr) AS mrr_true, count(*) AS n_questions
  FROM v_ev_bm25_body)""", ["v_ev_bm25_body"]),
    "experiment_grid": with_views(f"SELECT run_no, ranker, mode, {_r(METRIC_SQL)}, round(mrr_true, 6) AS mrr_true, "
                                  "n_questions FROM v_runs", ["v_runs"]),
    "compare_configs": with_views(f"""
SELECT row_number() OVER (ORDER BY round(ndcg10, 6) DESC, run_no) AS position, ranker || ' (' || mode || ')' AS label,
       ranker, mode, {_r(METRIC_SQL, 4)} FROM v_runs""", ["v_runs"]),
    "best_config": with_views("""
SELECT 'NDCG@10' AS metric, label, round(value, 4) AS value FROM (
  SELECT ranker || ' (' || mode || ')' AS label, ndcg10 AS value FROM v_runs ORDER BY round(ndcg10, 6) DESC, run_no LIMIT 1)
UNION ALL
SELECT 'MAP@10' AS metric, label, round(value, 4) AS value FROM (
  SELECT ranker || ' (' || mode || ')' AS label, map10 AS value FROM v_runs ORDER BY round(map10, 6) DESC, run_no LIMIT 1)""",
                              ["v_runs"]),
    "metric_series": with_views("""
SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY round(value, 6) DESC, run_no) AS position, label,
       round(value, 4) AS value
FROM (SELECT run_no, ranker || ' (' || mode || ')' AS label, unnest(['S@10', 'P@10', 'R@10', 'F1@10', 'MAP@10', 'MRR', 'NDCG@10']) AS metric,
             unnest([s10, p10, r10, f1_10, map10, mrr, ndcg10]) AS value FROM v_runs)""", ["v_runs"]),
})

# ---------------------------------------------------------- sources / sinks

view("v_word_repr", ["v_questions"], f"""
SELECT key, word, count(*) AS weight FROM (
  SELECT t[i] AS key, t[i + 1] AS word
  FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {TOK3('text')} AS t FROM conversations))
  UNION ALL
  SELECT t[i + 1] AS key, t[i] AS word
  FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {TOK3('text')} AS t FROM conversations)))
WHERE key <> word AND key IN (SELECT unnest({TOK3('body')}) FROM v_questions)
GROUP BY key, word""")

RESULT_COLS = ('document, text, "beginSection", "endSection", "offsetInBeginSection", "offsetInEndSection", '
               'rerank_score, rerank_position')

ORACLES.update({
    "scan_questions": """
SELECT CAST(item_id AS VARCHAR) AS id,
  CASE WHEN suffix(text, '?') THEN 'factoid' WHEN length(text) < 120 THEN 'yesno' ELSE 'summary' END AS type,
  text AS body
FROM benchmark""",
    "question_limit": with_views("SELECT id, seq, body FROM v_questions ORDER BY seq LIMIT 20", ["v_questions"]),
    "scan_unigrams": with_views("SELECT word, freq FROM v_unigrams", ["v_unigrams"]),
    "scan_word_repr": with_views("SELECT key, word, weight FROM v_word_repr", ["v_word_repr"]),
    "sort_word_repr": with_views("""
SELECT key, row_number() OVER (PARTITION BY key ORDER BY weight DESC, word) AS rank, word, weight FROM v_word_repr""",
                                 ["v_word_repr"]),
    "parse_articles": with_views(f"""
SELECT CAST(doc_id AS VARCHAR) AS pmid, {STRIP('title')} AS title,
  CASE WHEN abstract = 'N/A' OR len(parts) = 0 THEN 'N/A' ELSE array_to_string(parts, ' ') END AS abstract
FROM (SELECT doc_id, title, abstract,
        list_filter(list_transform(string_split(abstract, {NL}),
          lambda p, i: CASE WHEN {STRIP('p')} = '' THEN '' WHEN i = 1 AND len(string_split(abstract, {NL})) > 1
                            THEN 'BACKGROUND: ' || {STRIP('p')} ELSE {STRIP('p')} END), lambda x: x <> '') AS parts
      FROM v_articles)""", ["v_articles"]),
    "parse_pages": """
SELECT page_id, replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') AS title FROM pages""",
    "write_results": with_views(f"""
SELECT CAST(q.id AS VARCHAR) AS id, q.seq, q.body, {", ".join("s." + c.strip() for c in RESULT_COLS.split(","))}
FROM v_questions q JOIN ({SNIPPET_SQL}) s ON s.id = q.id""", BM25_BODY + ["v_articles", "v_questions"]),
    "strip_rerank_fields": with_views(f"""
SELECT CAST(q.id AS VARCHAR) AS id, 2 * count(s.document) OVER (PARTITION BY q.id) AS removed,
  s.document, s.text, s."beginSection", s."endSection", s."offsetInBeginSection", s."offsetInEndSection"
FROM v_questions q JOIN ({SNIPPET_SQL}) s ON s.id = q.id""", BM25_BODY + ["v_articles", "v_questions"]),
    "write_metrics": with_views(f"SELECT id, seq, {_r(METRIC_SQL)} FROM v_ev_bm25_body", ["v_ev_bm25_body"]),
    "scan_metrics": with_views(f"""
SELECT 'TRAIN_metrics_' || regexp_replace(ranker, '[^A-Za-z0-9]+', '', 'g') || '_'
         || regexp_replace(mode, '[^A-Za-z0-9]+', '_', 'g') || '_1970-01-01_00-00-00.json' AS file_name,
       'TRAIN' AS eval_type, ranker AS reranker, mode AS query_type, {_r(METRIC_SQL)}
FROM v_runs""", ["v_runs"]),
})

# ------------------------------------------------------- stored responses
def _sqlq(pattern: str) -> str:
    """A regex as a SQL string literal (quotes doubled, backslashes kept)."""
    return "'" + pattern.replace("'", "''") + "'"


_PIECES = (f"list_filter(list_transform(string_split_regex(raw, {_sqlq('[,' + chr(10) + ']')}), "
           f"lambda p: trim({STRIP('p')}, {_sqlq(chr(39) + chr(34) + '[] ')})), lambda p: length(p) > 1)")
_UNQ = f"replace(substr(t, 2, length(t) - 2), {_sqlq(chr(92) * 2)}, chr(1))"
for _escape, _code in (("n", 10), ("t", 9), ("r", 13)):
    _UNQ = f"replace({_UNQ}, {_sqlq(chr(92) + _escape)}, chr({_code}))"
_UNQ = f"replace(regexp_replace({_UNQ}, {_sqlq(chr(92) * 2 + '([' + chr(39) + chr(34) + '])')}, {_sqlq(chr(92) + '1')}, 'g'), chr(1), {_sqlq(chr(92))})"
_ITEMS = f"list_filter(list_transform(regexp_extract_all(lst, {_sqlq(STRING_LITERAL)}), lambda t: {STRIP(_UNQ)}), lambda t: t <> '')"

ORACLES["parse_keyword_responses"] = f"""
SELECT conv_id, turn, pos, keyword, parsed_list FROM (
  SELECT conv_id, turn, parsed_list, unnest(arr) AS keyword, generate_subscripts(arr, 1) AS pos FROM (
    SELECT conv_id, turn, parsed_list, CASE WHEN parsed_list THEN {_ITEMS} ELSE {_PIECES} END AS arr FROM (
      SELECT conv_id, turn, raw, lst, lst <> '' AND regexp_matches(lst, {_sqlq(STRING_LIST)}) AS parsed_list FROM (
        SELECT conv_id, turn, text AS raw, regexp_extract(text, {_sqlq(FIRST_LIST)}, 1) AS lst
        FROM conversations))))"""

ORACLES["response_keywords"] = f"""
WITH parsed AS ({ORACLES["parse_keyword_responses"]}),
said AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS pos, keyword AS term
  FROM parsed JOIN conversations USING (conv_id, turn) WHERE role = 'assistant' AND conv_id IN (SELECT item_id FROM benchmark))
SELECT id, min(pos) AS pos, lower(term) AS term FROM said
WHERE NOT list_contains({STOP_GENERAL}, lower(term)) AND NOT list_contains({STOP_MEDICAL}, lower(term))
  AND length(term) > 1 AND regexp_matches(term, '[\\p{{L}}\\p{{N}}]')
GROUP BY id, lower(term)"""


def _strip_prefix(x: str, prefix: str) -> str:
    return (f"(CASE WHEN starts_with(lower({x}), {_sqlq(prefix.lower())}) "
            f"THEN {STRIP(f'substr({x}, {len(prefix) + 1})')} ELSE {x} END)")


_q = STRIP("coalesce(text, '')")
for _p in C.QUERY_PREFIXES:
    _q = _strip_prefix(_q, _p)
_q = f"trim({_q}, {_sqlq(chr(34) + chr(39))})"
ORACLES["clean_query_responses"] = f"""
SELECT conv_id, turn, query, length(query) > 3 AS valid FROM (
  SELECT conv_id, turn, {_q} AS query FROM conversations)"""

# ------------------------------------------- expansion, clauses, retry, stats
view("v_exp", ["v_keywords", "v_word_repr"], """
SELECT k.id, w.word, sum(w.weight) AS weight FROM v_keywords k JOIN v_word_repr w ON w.key = k.term GROUP BY k.id, w.word""")
view("v_exp_top", ["v_exp"], """
SELECT id, pos, word AS term, 'expansion' AS source FROM (
  SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS pos FROM v_exp) WHERE pos <= 3""")
ORACLES["expand_keywords"] = with_views("""
SELECT id, pos, term, source FROM v_exp_top
UNION ALL
SELECT k.id, coalesce(n.n_exp, 0) + row_number() OVER (PARTITION BY k.id ORDER BY k.pos) AS pos, k.term, 'key' AS source
FROM v_keywords k LEFT JOIN (SELECT id, count(*) AS n_exp FROM v_exp_top GROUP BY id) n ON n.id = k.id""",
                                        ["v_exp_top", "v_keywords"])


view("v_status_q", ["v_questions", "v_domain", "v_keywords", "v_search_c3", "v_final", "v_articles"], """
SELECT q.id, q.body IS NOT NULL AND q.body <> '' AS has_body, coalesce(x.n, 0) AS n_extracted, coalesce(k.n, 0) AS n_keywords,
       coalesce(s.n, 0) AS initial_hits, coalesce(s.n, 0) = 0 AS retried, coalesce(f.n, 0) AS final_hits,
       coalesce(f.partial, false) AS partial_fetch
FROM v_questions q
LEFT JOIN (SELECT id, count(*) AS n FROM v_domain GROUP BY id) x ON x.id = q.id
LEFT JOIN (SELECT id, count(*) AS n FROM v_keywords GROUP BY id) k ON k.id = q.id
LEFT JOIN (SELECT id, count(*) AS n FROM v_search_c3 GROUP BY id) s ON s.id = q.id
LEFT JOIN (SELECT r.id, count(*) AS n, count(a.doc_id) < count(DISTINCT r.doc_id) AS partial
           FROM v_final r LEFT JOIN v_articles a ON a.doc_id = r.doc_id GROUP BY r.id) f ON f.id = q.id""")
view("v_lemmas", ["v_unigrams"], """
SELECT word AS form, substr(word, 1, length(word) - 1) AS lemma FROM v_unigrams
WHERE suffix(word, 's') AND length(word) > 1 AND substr(word, 1, length(word) - 1) IN (SELECT word FROM v_unigrams)""")
ORACLES["gold_pairs"] = with_views("SELECT id, doc_id FROM v_qrels", ["v_qrels"])
ORACLES["word_freq_lemmas"] = with_views(f"""
SELECT id, word, count(*) AS count FROM (
  SELECT id, unnest({TOK3('lemma')}) AS word FROM (
    SELECT t.id, coalesce(l.lemma, t.word) AS lemma
    FROM (SELECT id, unnest({TOK3('body')}) AS word FROM v_questions) t LEFT JOIN v_lemmas l ON l.form = t.word))
GROUP BY id, word""", ["v_questions", "v_lemmas"])

ORACLES.update({
    "clause_search": with_views("SELECT * FROM v_clause2", ["v_clause2"]),
    "search_with_retry": with_views("SELECT * FROM v_retry_c3", ["v_retry_c3"]),
    "run_stats": with_views("""
SELECT questions, extraction_failures, zero_keywords, zero_hits, retries_started, retries_failed, partial_fetches,
       round(zero_keywords / questions, 6) AS zero_keywords_share, round(zero_hits / questions, 6) AS zero_hits_share
FROM (SELECT count(*) AS questions,
        count(*) FILTER (WHERE has_body AND n_extracted = 0) AS extraction_failures,
        count(*) FILTER (WHERE has_body AND n_extracted > 0 AND n_keywords = 0) AS zero_keywords,
        count(*) FILTER (WHERE has_body AND n_extracted > 0 AND final_hits = 0) AS zero_hits,
        count(*) FILTER (WHERE has_body AND n_extracted > 0 AND retried) AS retries_started,
        count(*) FILTER (WHERE has_body AND n_extracted > 0 AND retried AND final_hits = 0) AS retries_failed,
        count(*) FILTER (WHERE has_body AND n_extracted > 0 AND partial_fetch) AS partial_fetches
      FROM v_status_q)""", ["v_status_q"]),
    "empty_body": with_views("""
SELECT q.id, q.body IS NOT NULL AND q.body <> '' AS has_body, count(r.doc_id) AS n_documents
FROM v_questions q LEFT JOIN (SELECT * FROM v_bm25_body WHERE rank <= 10) r ON r.id = q.id GROUP BY q.id, q.body""",
                             ["v_questions", "v_bm25_body"]),
})
