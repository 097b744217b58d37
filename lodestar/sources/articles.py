"""Article batches as XML (``PubmedArticleSet``) and raw web pages.

Parsed per file with built-in XPath functions: the pmid is the first
``PMID``, the title all text of the first ``ArticleTitle`` (``N/A`` when
absent), the abstract the ``AbstractText`` parts of the first ``Abstract``,
each trimmed, labelled ``LABEL: text`` when it has a ``Label``, joined by a
space (``N/A`` when none is left). Any root element will do. A batch that is
not well-formed XML is dropped whole; a later duplicate pmid replaces an
earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .files import empty, path_exists


XML_INVALID_RE = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def xml_escape(c):
    """Escape markup characters; drop characters XML 1.0 cannot carry."""
    c = F.regexp_replace(c, XML_INVALID_RE, "")
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def write_article_xml(articles: DataFrame, path: str, batch_size: int = 2000) -> None:
    """``articles(doc_id, title, abstract)`` as XML batches of ``batch_size``
    consecutive ids. Abstract paragraphs (lines) become ``AbstractText``
    elements; when there are several, the first is labelled ``background``."""
    paras = F.split(F.col("abstract"), "\n")
    texts = F.transform(paras, lambda p, i: F.concat(
        F.when((i == 0) & (F.size(paras) > 1), F.lit('<AbstractText Label="background">'))
        .otherwise(F.lit("<AbstractText>")), xml_escape(p), F.lit("</AbstractText>")))
    abstract = F.when(F.col("abstract") == "N/A", F.lit("")).otherwise(
        F.concat(F.lit("<Abstract>"), F.array_join(texts, ""), F.lit("</Abstract>")))
    art = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"),
                   F.lit("</PMID><Article><ArticleTitle>"), xml_escape(F.col("title")),
                   F.lit("</ArticleTitle>"), abstract, F.lit("</Article></MedlineCitation></PubmedArticle>"))
    batches = (articles.select(F.floor(F.col("doc_id") / batch_size).alias("grp"), F.col("doc_id"), art.alias("a"))
               .groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("doc_id", "a"))).alias("xs")))
    out = batches.select("grp", F.concat(F.lit("<?xml version=\"1.0\"?><PubmedArticleSet>"),
                                         F.array_join(F.transform("xs", lambda s: s["a"]), ""),
                                         F.lit("</PubmedArticleSet>")).alias("value"))
    out.write.mode("overwrite").partitionBy("grp").text(path)


ARTICLE_RE = r"(?s)<PubmedArticle[\s>].*?</PubmedArticle>"
ABSTRACT_RE = r"(?s)<Abstract[\s>].*?</Abstract>"
ABSTRACT_TEXT_RE = r"(?s)<AbstractText(?:\s[^>]*)?>.*?</AbstractText>"


def parse_articles(spark: SparkSession, path: str) -> DataFrame:
    """``(pmid, title, abstract)`` from every XML batch file under ``path``."""
    if not path_exists(spark, path):
        return empty(spark, "pmid string, title string, abstract string")
    raw = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
           .select(F.col("_metadata.file_path").alias("file"), "value"))
    # a batch that does not parse to its end is kept by the parser as a corrupt record
    parsed = F.from_xml("value", "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    ok = raw.filter(F.trim("value") != "").filter(parsed["_corrupt_record"].isNull())
    arts = ok.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(ARTICLE_RE), 0)).alias("pos", "a"))
    first_abs = F.regexp_extract("a", ABSTRACT_RE, 0)
    parts = F.transform(F.regexp_extract_all(first_abs, F.lit(ABSTRACT_TEXT_RE), 0),
                        lambda t: F.struct(py_strip(F.xpath_string(t, F.lit("/AbstractText"))).alias("text"),
                                           F.xpath_string(t, F.lit("/AbstractText/@Label")).alias("label")))
    parts = F.filter(parts, lambda p: p["text"] != "")
    labelled = F.transform(parts, lambda p: F.when(p["label"] != "", F.concat(F.upper(p["label"]), F.lit(": "), p["text"]))
                           .otherwise(p["text"]))
    has_title = F.xpath_boolean("a", F.lit("count(//ArticleTitle) > 0"))
    rows = arts.select(
        "file", "pos",
        py_strip(F.xpath_string("a", F.lit("(//PMID)[1]"))).alias("pmid"),
        F.when(has_title, py_strip(F.xpath_string("a", F.lit("(//ArticleTitle)[1]")))).otherwise(F.lit("N/A")).alias("title"),
        F.when(F.size(labelled) > 0, F.array_join(labelled, " ")).otherwise(F.lit("N/A")).alias("abstract"))
    rows = rows.filter(F.col("pmid") != "")
    w = Window.partitionBy("pmid").orderBy(F.col("file").desc(), F.col("pos").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("pmid", "title", "abstract")


def parse_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, title)``: the first ``<title>`` of each page, ``&amp;`` unescaped."""
    t = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", F.replace(t, F.lit("&amp;"), F.lit("&")).alias("title"))
