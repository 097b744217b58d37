import os
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PASSAGE = " ".join(f"shared{i}" for i in range(40))
LONG = " ".join(f"w{i % 977} x{i % 13}." + ("\n" if i % 11 == 0 else "") for i in range(30_000))
#: (doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, odd white space.
EDGE = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n\x0b\x0c\r ", "fr", "b"), (None, "no id here", "en", "a"),
    (4, "one", "en", None), (5, LONG, "en", "a"), (6, f"before {PASSAGE} after", "en", "a"),
    (6, f"before {PASSAGE} after", "en", "a"), (7, f"other words first {PASSAGE}", "de", "a"), (7, "same id, other text", "de", "b"),
    (8, "Ünïcode word   \U0001F600 ß\x1cß", "de", "c"), (9, "GNU General Public License\n\nApache-License: CC BY mit LICENSE", "en", "c"),
    (10, "mail a.b@c.example.org +1 (200) 555-0100 10.0.0.1 4111 1111 1111 1111", "en", "c"), (None, None, None, None),
    (11, "a " * 200, "en", "a"), (12, "x" * 50_000, "en", "a"), (13, f"{PASSAGE} {PASSAGE}", "es", "a"), (14, "one", "en", "a"),
    (15, "0" * 5_000 + ".1.1.1 and 1.1.1." + "9" * 5_000 + " card " + "4" * 6_000 + " +" + "1" * 5_000, "en", "c"),
]
EXTRA = ["row", "id", "th", "fp", "f", "h", "words", "size", "lines", "key", "i", "s", "text_hash", "label", "score"]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), *["extra"] * len(EXTRA)) for r in EDGE]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def docs(spark):
    from lodestar.llm.common import documents
    return documents(spark, SF)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(os.path.join(SF, "benchmark.parquet"))


@pytest.fixture(scope="session", autouse=True)
def importable_workers(spark):
    from lodestar.llm.common import importable
    importable(spark)
