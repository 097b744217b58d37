"""Boolean candidate retrieval over an inverted index built with Spark.

The remote search service is re-aimed onto our own corpus table. A term is
normalised with the BM25 tokeniser on both sides; a term of several tokens
is a phrase: its tokens must stand at consecutive positions. Result order is
``(matched distinct terms desc, doc_id asc)`` in place of the service's
relevance order; ``total_count`` is counted before the cap.

Two tables serve the searches and rankers. ``blocks``, over the corpus, has one row per term and block of
documents: the documents that hold it; ``occurrences``, for phrases, has the places as well. A block is a
task: texts move once, to the task of their block, and become terms there. ``forward`` has one row per
document (the numbers of its terms, and counts); rankers read it of the candidates only (``TextIndex.among``).
Blocks are stored in folders by a hash of the term, so a search reads only the folders of its terms, and what
it reads is joined with the (few) terms before anything moves: the postings never cross the network. A
term of a third of all documents is many rows of bounded size. Matches travel as
arrays, one row per question, term and block; they become rows only inside the task that counts
them, and the cap keeps at most its number per task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import WS_CHARS, py_strip, tokens_bm25, usable_part
from ..session import materialize, setting


def split_articles(documents: DataFrame) -> DataFrame:
    """``(doc_id, title, abstract)`` from raw texts: the title is the text
    before the first newline, the abstract what follows it (``N/A`` when
    there is no newline)."""
    nl = F.instr("text", "\n")
    return documents.select(
        "doc_id",
        F.when(nl > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text")).alias("title"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(C.NOT_AVAILABLE)).alias("abstract"),
    )


def doc_text(articles: DataFrame) -> DataFrame:
    """``(doc_id, title, abstract, text)`` for usable documents only: text is
    the non-empty, non-N/A parts joined by a space and stripped."""
    text = F.concat_ws(" ", usable_part("title"), usable_part("abstract"))
    # whether anything is left shows at the first character kept: the filter does not strip whole texts
    return (articles.filter(F.ltrim(text, F.lit(WS_CHARS)) != "")
            .select("doc_id", "title", "abstract", py_strip(text).alias("text")))


BLOCK_DOCS = 4_096       # documents per block, about: what one task groups by term
FOLDERS = 16             # folders of terms; a block has one file in each
SLICES = 16              # parts, of whole blocks, in which a question's matches are counted,
SLICE_DOCS = 262_144     # more where a part would have more documents
BLOCK_TERMS = 1_000_000  # terms of a block that are grouped by hashing; beyond them by sorting, which may spill
SEARCH_PAIRS = 500_000   # pairs of a question and a document per task of a search, about
BROADCAST_ROWS = 100_000  # rows of terms or ids that are sent to every task at most


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows (counted, not estimated)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counted_terms(texts: DataFrame, tokens=tokens_bm25) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, term, tf)``. Texts are dealt by document before they
    become tokens: many tasks tokenise, however few files hold them, and counts need no further shuffle."""
    return (texts.repartition("doc_id").select("doc_id", F.explode(tokens("text")).alias("term"))
            .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary_table(counted: DataFrame) -> DataFrame:
    """``(term, code)``: distinct terms with numbers that rise in the order of the terms (numbers of
    rows in range partitions), so rankers sort and group by numbers."""
    return (counted.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")
            .withColumn("code", F.monotonically_increasing_id()))


def forward_table(counted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """-> ``(doc_id, dl, codes, tfs)``: one row per document with tokens. A term of most documents
    is an oversized partition of the join, which adaptive execution splits."""
    return (counted.join(vocabulary, "term").groupBy("doc_id")
            .agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("code", "tf")).alias("t"))
            .select("doc_id", "dl", F.col("t.code").alias("codes"), F.col("t.tf").alias("tfs")))


def block_table(texts: DataFrame, folders: int, blocks: int, terms: Column, held: Column | str) -> DataFrame:
    """``(doc_id, field, text)`` -> ``(part, field, term, block, held)``: what a block of
    documents holds of a term, as an array of ``held``; ``terms`` makes the rows of a text. The texts are dealt
    by block, a task each, however large the corpus; their terms are made, grouped and written there."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    dealt = texts.withColumn("block", block).repartitionById(blocks, "block").select("doc_id", "field", "block", terms)
    return (dealt.groupBy("block", "field", "term").agg(F.collect_list(held).alias("held"))
            .select(folder_of("term", folders).alias("part"), "field", "term", "block", "held")
            .sortWithinPartitions("part", "field", "term"))


def folder_of(term, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


@dataclass
class TextIndex:
    """Usable document texts plus the tables every search and ranker reads.

    With ``persist`` each table is written once, when it is first asked for; without, everything
    stays one lazy plan (for small tables: searches read all blocks)."""

    docs: DataFrame       # (doc_id, title, abstract, text)
    persist: bool = False
    tables: dict = field(default_factory=dict)

    @classmethod
    def build(cls, articles: DataFrame, persist: bool = False) -> "TextIndex":
        return cls(doc_text(articles), persist)

    def derived(self, name: str, fn, by: str | None = None) -> DataFrame:
        if name not in self.tables:
            df = fn()
            if by is None or not self.persist:
                self.tables[name] = materialize(df, name) if self.persist else df
            else:  # a block's lists are grouped by hashing, not sorted from the 128th term on
                with setting(df.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(BLOCK_TERMS)):
                    self.tables[name] = materialize(df, name, by)
        return self.tables[name]

    def vocabulary(self, kind: str = "bm25", tokens=tokens_bm25) -> DataFrame:
        """``(term, code)`` over the combined texts, by the tokeniser that ``kind`` names."""
        return self.derived(f"{kind}_vocabulary", lambda: vocabulary_table(self.counted(kind, tokens)))

    def counted(self, kind: str = "bm25", tokens=tokens_bm25) -> DataFrame:
        """``(doc_id, term, tf)`` over the combined texts."""
        return self.derived(f"{kind}_counted", lambda: counted_terms(self.docs.select("doc_id", "text"), tokens))

    def forward(self, kind: str = "bm25", tokens=tokens_bm25) -> DataFrame:
        """``(doc_id, dl, codes, tfs)`` over the combined texts."""
        return self.derived(f"{kind}_forward", lambda: forward_table(self.counted(kind, tokens), self.vocabulary(kind, tokens)))

    @property
    def doc_len(self) -> DataFrame:
        """``(doc_id, dl)``; documents without tokens are absent."""
        return self.forward().select("doc_id", "dl")

    @property
    def usable_ids(self) -> DataFrame:
        """``(doc_id)`` of usable documents (a small table, built once)."""
        return self.derived("usable_ids", lambda: self.docs.select("doc_id"))

    def of_docs(self, table: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of a table by ``doc_id`` that the ids ask for, cut before they move."""
        ids = ids.select("doc_id").distinct()
        return table.join(small(ids) if self.persist else ids, "doc_id", "left_semi")

    def among(self, cand: DataFrame) -> "TextIndex":
        """The index over the documents that ``cand`` names, for rankers: their statistics are those of the
        candidates, so no other text is tokenised for them. Built once for the same ``cand``."""
        if not self.persist:
            return TextIndex(self.of_docs(self.docs, cand))
        key = ("among", id(cand))  # cand itself is kept as well, so its id is not given again
        if key not in self.tables:
            self.tables[key] = (cand, TextIndex(materialize(self.of_docs(self.docs, cand), "candidate_texts"), True))
        return self.tables[key][1]

    def shape(self) -> tuple[int, int]:
        """(folders of terms, blocks of documents) for the number of usable documents."""
        if not self.persist:
            return 1, 1
        if "shape" not in self.tables:
            self.tables["shape"] = (FOLDERS, max(1, math.ceil(self.size() / BLOCK_DOCS)))
        return self.tables["shape"]

    def size(self) -> int:
        """The number of usable documents."""
        if "size" not in self.tables:
            self.tables["size"] = self.usable_ids.count()
        return self.tables["size"]

    def deal(self, matched: DataFrame, terms: DataFrame) -> DataFrame:
        """Matches ``(id, block, ...)`` in tasks by question and ``slice`` of the blocks; the number of
        tasks follows that of questions and documents, not the (packed) bytes of the matches."""
        if not self.persist:
            return matched.withColumn("slice", F.lit(0)).repartition("id")
        slices = max(SLICES, math.ceil(self.size() / SLICE_DOCS))
        asked = terms.select("id").distinct().count()
        tasks = min(asked * slices, math.ceil(asked * self.size() / SEARCH_PAIRS))
        return matched.withColumn("slice", F.col("block") % slices).repartition(max(1, tasks), "id", "slice")

    def fields(self) -> DataFrame:
        """``(doc_id, field, text)``: the combined text (field ``text``), title and abstract."""
        parts = F.array(*[F.struct(F.lit(f).alias("field"), t.alias("text")) for f, t in (
            ("text", F.col("text")), ("title", py_strip(usable_part("title"))), ("abstract", py_strip(usable_part("abstract"))))])
        return (self.docs.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*")
                .filter(F.col("text").isNotNull() & (F.col("text") != "")))

    def blocks(self, fielded: bool = False) -> DataFrame:
        """``(part, field, term, block, docs)``, the documents of a block that hold a term, in folders by ``part``."""
        def build() -> DataFrame:
            # distinct within the row: no token is grouped, no count is written for a search
            texts = self.fields() if fielded else self.docs.select("doc_id", F.lit("text").alias("field"), "text")
            terms = F.explode(F.array_distinct(tokens_bm25("text"))).alias("term")
            return block_table(texts, *self.shape(), terms, "doc_id").withColumnRenamed("held", "docs")
        return self.derived("field_blocks" if fielded else "blocks", build, by="part")

    def occurrences(self, fielded: bool = False) -> DataFrame:
        """``(part, field, term, block, occ_docs, occ_pos)``: each occurrence of a term in a block
        (document, position); a table of its own, for phrases only."""
        texts = self.fields() if fielded else self.docs.select("doc_id", F.lit("text").alias("field"), "text")
        return self.derived("field_occurrences" if fielded else "occurrences", lambda: block_table(
            texts, *self.shape(), F.posexplode(tokens_bm25("text")).alias("pos", "term"), F.struct("doc_id", "pos"))
            .select("part", "field", "term", "block", F.col("held.doc_id").alias("occ_docs"), F.col("held.pos").alias("occ_pos")), by="part")

    def of_terms(self, blocks: DataFrame, terms: DataFrame) -> DataFrame:
        """The blocks in the folders of the given terms only."""
        if not self.persist:
            return blocks
        parts = [r[0] for r in terms.select(folder_of("term", self.shape()[0])).distinct().collect()]  # folder numbers
        return blocks.filter(F.col("part").isin(parts))


def clean_terms(keywords: DataFrame) -> DataFrame:
    """``(id, k, pos, term)``: stripped terms longer than one character,
    numbered ``k`` in keyword order; quotes are then removed and terms left
    empty are dropped (they keep their ``k``, as in the source)."""
    t = keywords.select("id", "pos", py_strip("term").alias("term"))
    t = t.filter(F.col("term").isNotNull() & (F.char_length("term") > 1))
    t = t.select("id", "pos", F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("k"),
                 F.regexp_replace("term", '"', "").alias("term"))
    return t.filter(F.col("term") != "").select("id", "k", "pos", "term")


def _quoted(term):
    return F.when(F.instr(term, " ") > 0, F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def _join_part(arr, sep):
    joined = F.array_join(arr, sep)
    return F.when(F.size(arr) > 1, F.concat(F.lit("("), joined, F.lit(")"))).when(F.size(arr) == 1, joined)


def hybrid_query_string(keywords: DataFrame, n_core: int = C.CORE_TERMS,
                        field: str | None = None) -> DataFrame:
    """``(id, query)``: core terms AND-ed, the rest OR-ed, parts AND-ed."""
    t = clean_terms(keywords).select("id", "k", _quoted(F.col("term")).alias("term"))
    g = t.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("k"), (F.col("k") <= n_core).alias("core"), "term"))).alias("ts"))
    core = F.transform(F.filter("ts", lambda s: s["core"]), lambda s: s["term"])
    rest = F.transform(F.filter("ts", lambda s: ~s["core"]), lambda s: s["term"])
    q = F.concat_ws(" AND ", _join_part(core, " AND "), _join_part(rest, " OR "))
    if field:
        q = F.concat(F.lit("("), q, F.lit(f")[{field}]"))
    return g.select("id", q.alias("query"))


# Names a field restriction may use -> the fields searched.
SEARCH_FIELDS = {"text": ["text"], "title": ["title"], "abstract": ["abstract"], "title/abstract": ["title", "abstract"]}


def check_field(field: str | None) -> None:
    if field is not None and field.lower() not in SEARCH_FIELDS:
        raise ValueError(f"unknown search field {field!r}; known: {', '.join(SEARCH_FIELDS)}")


def searched_fields(field) -> Column:
    """The fields a restriction names (NULL: the combined text); an unknown
    name is an error when the row is read."""
    known = F.when(field.isNull(), F.array(F.lit("text")))
    for name, fields in SEARCH_FIELDS.items():
        known = known.when(F.lower(field) == name, F.array(*[F.lit(f) for f in fields]))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown search field "), field)).cast("array<string>"))


def _prepared(terms: DataFrame, fielded: bool) -> DataFrame:
    """``terms(id, k, term, field, extra...)`` -> one row per field and token, with its place
    among the term's tokens (``at``) and their number (``nt``)."""
    extra = [c for c in terms.columns if c not in ("id", "k", "term", "field")]
    t = terms.select("id", "k", *extra, tokens_bm25("term").alias("toks"),
                     (F.explode(searched_fields(F.col("field"))) if fielded else F.lit("text")).alias("field"))
    return t.select("id", "k", *extra, "field", F.size("toks").alias("nt"), F.posexplode("toks").alias("at", "term"))


def _joined(tokens: DataFrame, index: TextIndex, blocks: DataFrame) -> DataFrame:
    """Tokens with their blocks. The blocks are cut to the tokens' folders by the scan and to the
    tokens where they are read; more tokens than a broadcast may hold are joined by a shuffle of those folders."""
    found = index.of_terms(blocks, tokens).drop("part")
    return found.join(small(tokens) if index.persist else tokens, ["field", "term"])


def _term_docs(terms: DataFrame, index: TextIndex, phrases: bool, fielded: bool) -> DataFrame:
    """``terms(id, k, term, field, extra...)`` -> ``(id, k, extra..., slice, doc_id)`` for every
    document that holds the term, in tasks by question and slice of the blocks."""
    keys = [c for c in terms.columns if c not in ("term", "field")]
    tokens = _prepared(terms, fielded)
    if index.persist and phrases:
        tokens = materialize(tokens, "search_tokens")
    single = tokens.filter("nt = 1") if phrases else tokens.dropDuplicates([*keys, "field", "term"])
    matched = _joined(single, index, index.blocks(fielded)).select(*keys, "block", "docs")
    if phrases:
        # positions of the first token that each occurrence stands for, met by all tokens
        occurrences = F.zip_with("occ_docs", "occ_pos", lambda d, p: F.struct(d.alias("d"), (p - F.col("at")).alias("p")))
        starts = (_joined(tokens.filter("nt > 1"), index, index.occurrences(fielded))
                  .select(*keys, "field", "nt", "block", F.struct(F.size("occ_docs").alias("n"), occurrences.alias("o")).alias("s"))
                  .groupBy(*keys, "field", "nt", "block").agg(F.array_sort(F.collect_list("s")).alias("s"))
                  .filter(F.size("s") == F.col("nt")))
        met = F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0]["o"], lambda a, x: F.array_intersect(a, x["o"]))
        matched = matched.unionByName(starts.select(*keys, "block", F.array_distinct(F.transform(met, lambda o: o["d"])).alias("docs")))
    hits = index.deal(matched, terms).select(*keys, "slice", F.explode("docs").alias("doc_id"))
    return hits.dropDuplicates() if fielded else hits  # a term may match in the title and in the abstract


def _cap(matches: DataFrame, max_results: int) -> DataFrame:
    """Top ``max_results`` per question by (matched desc, doc_id) plus the
    uncapped count. The count is a grouped aggregate (partial, skew-free);
    the rank filter becomes a partial ``WindowGroupLimit`` before the shuffle."""
    total = matches.groupBy("id").agg(F.count(F.lit(1)).alias("total_count"))
    w = Window.partitionBy("id").orderBy(F.col("matched").desc(), F.col("doc_id").asc())
    top = (matches.select("id", "doc_id", "matched", F.row_number().over(w).alias("retr_rank"))
           .filter(F.col("retr_rank") <= max_results))
    return top.join(total, "id").select("id", "doc_id", "retr_rank", "total_count", "matched")


def boolean_search(keywords: DataFrame, index: TextIndex, n_core: int = C.CORE_TERMS,
                   max_results: int = C.MAX_SEARCH_RESULTS, field: str | None = None, phrases: bool = True) -> DataFrame:
    """Hybrid search: documents holding every core term (the first ``n_core``)
    and, when there are other terms, at least one of them.

    One pass: each question's terms meet in tasks of one slice of the documents.
    ``phrases=False`` promises one-token terms.
    ``keywords(id, pos, term)`` -> ``(id, doc_id, retr_rank, total_count, matched)``.
    """
    check_field(field)
    fielded = field is not None
    t = clean_terms(keywords).select("id", "k", "term", (F.col("k") <= n_core).alias("core"),
                                     F.lit(field).cast("string").alias("field"))
    need = t.groupBy("id").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"))
    hits = (_term_docs(t, index, phrases, fielded).groupBy("id", "slice", "doc_id")
            .agg(F.count_if("core").alias("core_hits"), F.count_if(~F.col("core")).alias("rest_hits")))
    ok = (hits.join(small(need) if index.persist else need, "id")
          .filter((F.col("core_hits") == F.col("n_core")) & ((F.col("n_rest") == 0) | (F.col("rest_hits") > 0)))
          .select("id", "doc_id", (F.col("core_hits") + F.col("rest_hits")).alias("matched")))
    return _cap(ok, max_results)


def clause_search(clauses: DataFrame, index: TextIndex, max_results: int = C.MAX_SEARCH_RESULTS,
                  phrases: bool = True, fielded: bool = True) -> DataFrame:
    """Structured query: AND across clauses, OR inside a clause, ``negated``
    clauses exclude. ``clauses(id, clause_no, term, field, negated)``.
    A question needs at least one positive clause. ``fielded=False`` promises
    that no clause names a field."""
    c = clauses.select("id", F.col("clause_no").alias("grp"), "term", "field",
                       F.coalesce("negated", F.lit(False)).alias("negated"),
                       F.row_number().over(Window.partitionBy("id").orderBy("clause_no", "term")).alias("k"))
    c = c.filter(F.col("term").isNotNull() & (py_strip("term") != ""))
    need = (c.filter(~F.col("negated")).groupBy("id").agg(F.count_distinct("grp").alias("n_pos")))
    positive = ~F.col("negated")
    per_clause = (_term_docs(c, index, phrases, fielded).groupBy("id", "slice", "doc_id", "grp", "negated")
                  .agg(F.count(F.lit(1)).alias("n")))
    per_doc = per_clause.groupBy("id", "slice", "doc_id").agg(
        F.count_if(positive & F.col("grp").isNotNull()).alias("clauses_hit"), F.count_if("negated").alias("excluded"),
        F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("matched"))
    ok = (per_doc.filter("excluded = 0").join(small(need) if index.persist else need, "id")
          .filter(F.col("clauses_hit") == F.col("n_pos")).select("id", "doc_id", "matched"))
    return _cap(ok, max_results)


def search_with_retry(questions: DataFrame, keywords: DataFrame, clauses: DataFrame,
                      index: TextIndex, n_core: int = C.CORE_TERMS, max_results: int = C.MAX_SEARCH_RESULTS,
                      phrases: bool = True, fielded: bool = True, first: DataFrame | None = None) -> DataFrame:
    """Initial hybrid search; questions left without a hit (or without any
    keyword) retry with their structured clauses, whose result replaces it.

    ``first``: the initial result, when it is at hand.
    -> ``(id, doc_id, retr_rank, total_count, query_used)``.
    """
    if first is None:
        first = boolean_search(keywords, index, n_core, max_results, phrases=phrases)
    ids = questions.select("id")
    missing = ids.join(first.select("id").distinct(), "id", "left_anti")
    retry = clause_search(clauses.join(missing, "id", "left_semi"), index, max_results, phrases, fielded)
    cols = ["id", "doc_id", "retr_rank", "total_count"]
    return (first.select(*cols, F.lit("hybrid").alias("query_used"))
            .unionByName(retry.select(*cols, F.lit("direct").alias("query_used"))))


def fetch_details(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """``(id, doc_id, retr_rank, title, abstract, found)``: distinct candidates
    with their article; missing articles stay with ``found = false``.

    The corpus is read once and cut to the wanted ids by a semi-join before
    its text moves; the few articles left are then looked up. A document that
    many questions want is one article row; its many candidate rows are an
    oversized partition that adaptive execution splits."""
    cand = candidates.groupBy("id", "doc_id").agg(F.min("retr_rank").alias("retr_rank"))
    wanted = (articles.select("doc_id", "title", "abstract")
              .join(small(cand.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("found", F.lit(True)))
    return (cand.join(wanted, "doc_id", "left")
            .select("id", "doc_id", "retr_rank", "title", "abstract", F.coalesce("found", F.lit(False)).alias("found")))


def fetch_status(details: DataFrame) -> DataFrame:
    """``(id, requested, n_found, partial)`` per question."""
    return (details.groupBy("id").agg(F.count_distinct("doc_id").alias("requested"),
                                      F.count_distinct(F.when(F.col("found"), F.col("doc_id"))).alias("n_found"))
            .withColumn("partial", F.col("n_found") < F.col("requested")))
