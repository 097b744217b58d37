"""Learned operators on held-out rows, mixing, line alignment, graph helpers and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import common, fm_index, language, line_align, mixing, quality_classifier
from lodestar.llm.graph import components
from tests.llm.conftest import SF, WORD

SF_LARGER = "/root/testdata/sf0.01"


def test_hashed_words_are_the_words():
    texts = [None, "", "a bb\tccc\n", "x" * 300_000 + " y", "é é 👍 z", " ".join(map(str, range(50_000)))]
    for t, h in zip(texts, common.hashed_space_words(texts)):
        words = [w.encode() for w in WORD.findall(t or "")]
        assert list(h.slice(0, len(h))) == words
        alone = [common.hashed_space_words([w.decode()])[0].hashes[0] for w in words[:20]]
        assert h.hashes[:20].tolist() == alone


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
def test_gram_hashes_are_equal_for_equal_runs_only(symbols, k):
    h = common.mixed(np.array(symbols, np.uint64) + np.uint64(1))
    grams = common.gram_hashes(h, k).tolist()
    runs = [tuple(symbols[i:i + k]) for i in range(len(symbols) - k + 1)]
    assert len(grams) == len(runs)
    assert len(set(zip(grams, runs))) == len(set(grams)) == len(set(runs))


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=5, max_size=20), min_size=1, max_size=6), st.integers(1, 3))
def test_fm_index_matching_statistics(strings, least):
    text = np.concatenate([np.array([*s, 0]) for s in strings])
    index = fm_index.FMIndex(text, int(text.max()), 5)
    patterns = np.array([s[k:k + 5] for s in strings for k in range(len(s) - 4)])
    got = index.matched(patterns, least)
    for p, n in zip(patterns.tolist(), got.tolist()):
        want = 0
        for size in range(1, 6):
            places = sum(s[k:k + size] == p[5 - size:] for s in strings for k in range(len(s) - size + 1))
            want = size if places >= least and want == size - 1 else want
        assert n == want


@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_matches(a, b):
    pairs = line_align.patience_matches(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    once = [x for x in set(a) & set(b) if a.count(x) == b.count(x) == 1]
    assert len(pairs) >= bool(once)
    if a == b:
        assert len(pairs) == len(a)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000)]
    edges += [(2000, 2000 + k) for k in range(1, 100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def common_hash(text):
    import xxhash
    return np.uint64(xxhash.xxh64_intdigest((text or "").encode(), seed=42)).astype(np.int64).item()


@pytest.mark.parametrize("name,min_words", [("docs", 5), ("docs", 20), ("docs", 2), ("edge", 5), ("empty", 5)])
def test_line_alignment(request, name, min_words):
    table = request.getfixturevalue(name)
    done = line_align.deduplicate_lines(table, min_words=min_words, name="x_")
    assert done.columns == [*table.columns, "x_"]
    got = Counter(tuple(r) for r in done.select("doc_id", "x_.text", "x_.n_lines", "x_.n_removed").collect())
    assert got == whole_lines([(r["doc_id"], r["text"]) for r in table.collect()], min_words)


def test_alignment_decides_alone():
    """A passage of the owner whose lines are others (a hash shared by chance) deletes nothing."""
    assert line_align.align_passages([(3, 7, [11, 12], [11, 12]), (9, 1, [21, 22], [31, 32])]) == [3, 5]
    # another order, and repeats: the first alignment keeps one run, the rest is aligned after it
    blocks = line_align.align_passages([(0, 5, [1, 2], [1, 2]), (4, 0, [3], [3]), (6, 5, [1, 2], [1, 2])])
    assert {n for a, b in zip(blocks[::2], blocks[1::2]) for n in range(a, b)} == {0, 1, 4, 6, 7}


def test_a_banner_ships_lines_not_documents(spark):
    """400 documents share one line with a long owner: what is aligned stays near the corpus."""
    banner = "one banner line that every document of the site holds"
    owner = "\n".join([banner, *[f"the long first document has line number {k}" for k in range(3_000)]])
    rows = [(0, owner)] + [(i, f"short {i}\n{banner}\nother {i}") for i in range(1, 401)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    lines = table.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("lines"),
                         F.transform(F.split("text", "\n"), lambda x: F.size(F.split(x, " "))).alias("words"))
    shipped = line_align.overlapping(line_align.passage_table(lines)).agg(
        F.sum(F.size("lines") + F.size("lines0"))).first()[0]
    total = sum(len(t.split("\n")) for _, t in rows)
    assert 0 < shipped <= total
    got = Counter(tuple(r) for r in line_align.deduplicate_lines(table, name="x").select("doc_id", "x.*").collect())
    assert got == whole_lines(rows) and sum(r[3] * n for r, n in got.items()) == 400


def test_line_alignment_deletes_from_the_later_only(spark):
    block = "\n".join(f"a rare sentence of the common block number {k}" for k in range(5))
    rows = [(1, f"first start\n{block}\nfirst end"), (2, f"other start\nmore here\n{block}\nother end"), (3, block), (4, "first start")]
    got = {r["doc_id"]: r["x"] for r in line_align.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), name="x").collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "other start\nmore here\nother end"
    assert got[3]["text"] == "" and got[4]["text"] == "first start"  # two words are no block


def test_frequent_passages_are_deleted(spark):
    """Many holders of a line, no two with the same neighbours."""
    line = "one line that is long enough to be a passage"
    rows = [(i, f"before {i}\n{line}\nafter {i}") for i in range(30)] + [(i, line) for i in range(30, 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["x"]["text"] for r in line_align.deduplicate_lines(table, name="x").collect()}
    assert got == {i: rows[0][1] if i == 0 else f"before {i}\nafter {i}" if i < 30 else "" for i in range(60)}


def whole_lines(rows, min_words=line_align.MIN_WORDS):
    """(id, text) rows -> Counter of (id, text left, lines, deleted): without every line that
    stands in a run of enough words that an earlier document also holds."""
    distinct = sorted({(i is None, i or 0, common_hash(t)): t for i, t in rows if t is not None}.items())
    seen, left = set(), {}
    for key, t in distinct:
        raw = t.split("\n")
        lines = [x if x.strip(common.SPACE) else "" for x in raw]
        words = [len(x.encode().split()) for x in raw]
        runs = set()
        for n in range(len(raw)):
            end = next((e for e in range(n + 1, len(raw) + 1) if sum(words[n:e]) >= min_words), None)
            start = next((s for s in range(n, -1, -1) if sum(words[s:n + 1]) >= min_words), None)
            runs |= ({(n, end)} if end is not None else set()) | ({(start, n + 1)} if start is not None else set())
        gone = {n for s, e in runs if tuple(lines[s:e]) in seen for n in range(s, e)}
        seen |= {tuple(lines[s:e]) for s, e in runs}
        left[key] = ("\n".join(x for n, x in enumerate(raw) if n not in gone), len(raw), len(gone))
    return Counter((i, None, 0, 0) if t is None else (i, *left[i is None, i or 0, common_hash(t)]) for i, t in rows)


def test_order_and_repeats_of_an_owner_shield_nothing(spark):
    p, q = ("\n".join(f"{x} sentence number {k} of a common block" for k in range(3)) for x in "PQ")
    short = "\n".join(f"two {k}" for k in range(4))
    texts = [f"{p}\nu\n{q}", f"{q}\nv", f"{q}\nw\n{p}", f"{q}\nx\n{q}\ny", f"z\n{q}\n{p}\n{q}",
             f"{short}\na\n{short}", f"b\n{short}\nc", f"{short}\nd\n{short}\ne\n{short}", "two 1\ntwo 2"]
    rows = list(enumerate(texts))
    done = line_align.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), name="x")
    got = Counter(tuple(r) for r in done.select("doc_id", "x.*").collect())
    assert [t for _, t, _, _ in sorted(got)] == [texts[0], "v", "w", "x\ny", "z", texts[5], "b\nc", "d\ne", texts[8]]
    assert got == whole_lines(rows)


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_line_alignment_is_whole(request, name):
    table = request.getfixturevalue(name)
    done = line_align.deduplicate_lines(table, name="x_").select("doc_id", "x_.text", "x_.n_lines", "x_.n_removed")
    assert Counter(tuple(r) for r in done.collect()) == whole_lines([(r["doc_id"], r["text"]) for r in table.collect()])


def test_mixing(edge, empty, docs):
    for table in (edge, docs):
        rows = mixing.mix(table).collect()
        assert len(rows) == table.count()
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(table).collect())
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in rows)
    by_source = mixing.mix(docs.withColumn("source", F.lit("one"))).agg(F.sum("taken"), F.max("target"), F.max("size")).first()
    assert abs(by_source[0] - by_source[1]) <= by_source[2]
    assert mixing.mix(empty).count() == 0


def test_the_mix_holds_whole_rows(edge, docs, empty):
    """Emitted rows, repeats and all columns included, are what the shares say."""
    for table in (edge, docs, docs.unionByName(docs.limit(30)), empty):
        rows = mixing.emit(table, name="mixed_")
        assert rows.columns == [*table.columns, "mixed_"]
        rows = rows.collect()
        want = Counter()
        for r in mixing.mix(table).collect():
            if r["taken"]:
                want[r["doc_id"], r["size"]] += r["taken"] // r["size"]
        assert Counter((r["doc_id"], r["mixed_"]["size"]) for r in rows if r["mixed_"]["size"]) == want
        assert all(r["mixed_"]["size"] == len(WORD.findall(r["text"] or "")) and 1 <= r["mixed_"]["copy"] <= r["mixed_"]["copies"] <= 2 for r in rows)
        source = Counter((r["doc_id"], r["text"]) for r in table.collect())
        for key, n in Counter((r["doc_id"], r["text"]) for r in rows).items():
            assert n <= 2 * source[key]


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 1000, "d": 10, None: 500, "e": 0}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    capped, share = set(), 0.0
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        share = left / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s, w in weights.items() if s not in capped and share * w >= 2 * sizes[s]}
        if not more:
            break
        capped |= more
    assert got == pytest.approx({s: 2.0 * sizes[s] if s in capped else share * weights[s] for s in sizes})


def test_language(spark, edge, empty):
    from lodestar.llm.queries import QUERIES
    truth = dict(spark.read.parquet(f"{SF_LARGER}/documents.parquet").select("doc_id", "lang").collect())
    rows = [r for r in QUERIES["op6_language_hierarchy"](spark, SF_LARGER).collect()]
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.5
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = language.identify(edge).collect()
    assert len(got) == edge.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("own", [1, 5, 40, 5000])
def test_language_sample_cut(spark, own):
    """The cut of each language's sample is its n-th lowest distinct hash, also where few hashes are ranked."""
    rows = spark.range(12_000).select(F.when(F.col("id") % 3 > 0, "aa").when(F.col("id") < 60, "bb").otherwise("cc").alias("lang"),
                                      F.xxhash64((F.col("id") / 2).cast("int")).alias("h"))
    hashes = {}
    for r in rows.collect():
        hashes.setdefault(r["lang"], set()).add(r["h"])
    assert language.last_hashes(rows, own) == {k: sorted(v)[:own][-1] for k, v in hashes.items()}
    assert language.last_hashes(rows.filter("false"), own) == {}


def test_language_family_first():
    assert language.family_of("de") == language.family_of("en-GB") == "germanic" and language.family_of("tlh") == "other"
    rng = np.random.default_rng(0)
    centers = {x: rng.normal(size=language.DIMENSIONS) for x in ("en", "de", "fr", "es", "tlh")}
    langs = [x for x in centers for _ in range(20)]
    x = np.array([centers[l] + 0.3 * rng.normal(size=language.DIMENSIONS) for l in langs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.fit(x, langs)
    assert model.families == ["germanic", "other", "romance"]
    assert [model.predict(v.astype(np.float32))[0] for v in x] == langs


def test_quality(spark, edge, empty):
    from lodestar.llm.queries import QUERIES
    truth = dict(spark.read.parquet(f"{SF_LARGER}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op8_random_indexing_quality"](spark, SF_LARGER).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int")
    assert quality_classifier.score_quality(edge, labels).count() == edge.count()
    none = quality_classifier.score_quality(edge, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.score_quality(empty, labels).count() == 0


def test_context_sums_follow_the_definition():
    words = common.hashed_space_words(["a b c a d", "b a"])
    contexts = quality_classifier.Contexts()
    for w in words:
        contexts.add(quality_classifier.bucket(w))
    contexts.flush()
    places, signs = quality_classifier.index_vectors()
    want = np.zeros_like(contexts.total)
    for w in words:
        b = quality_classifier.bucket(w).tolist()
        for i, own in enumerate(b):
            want[own, -1] += 1
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if j != i:
                    np.add.at(want[own], places[b[j]], signs[b[j]])
    assert np.allclose(contexts.total, want)


def test_pipeline(spark):
    """The stages one after the other equal a run over plain Python versions."""
    from lodestar.llm import fertility
    from tests.llm.test_base_contracts import contamination, fingerprint, grouped
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    measured = fertility.measure()()([t for _, t, _ in rows])
    rows = [r for r, m in zip(rows, measured) if m[6]]
    source = {i: s for i, _, s in rows}
    left = whole_lines([(i, t) for i, t, _ in rows])
    rows = [(i, t) for (i, t, _, gone), n in left.items() for _ in range(n) if not gone or WORD.search(t)]
    prints = [(i, fingerprint(t)) for i, t in rows]
    groups = grouped(prints)
    rows = [r for r, (i, p) in zip(rows, prints) if groups[p] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, c in zip(rows, contamination(rows, items)) if not c[5]]
    want = mixing.mix(spark.createDataFrame([(i, t, source[i]) for i, t in rows], "doc_id long, text string, source string"))
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "source").collect()) == Counter((i, t, source[i]) for i, t in rows)
    assert all(r["copies"] * r["size"] == r["taken"] for r in got.collect())
    assert 50 < len(rows) < 200


def test_stages_handle_odd_rows(spark, edge, empty):
    for table in (edge, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "mix_sources":
                assert docs.columns == table.columns, name
        assert docs.count() <= table.count()
    # each on all odd rows: a filter keeps whole rows of its input, a rewrite keeps the ids, a mix keeps every row
    before = Counter((r["doc_id"], r["text"]) for r in edge.collect())
    after = {name: stage(spark, edge, SF).collect() for name, stage in corpus_pipeline.STAGES}
    for name in ("quality_rules", "near_dedup", "decontaminate"):
        kept = Counter((r["doc_id"], r["text"]) for r in after[name])
        assert all(n <= before[k] for k, n in kept.items()), name
    from lodestar.llm import fertility
    judged = zip(before, fertility.measure()()([t for _, t in before]))
    assert Counter((r["doc_id"], r["text"]) for r in after["quality_rules"]) == Counter({k: before[k] for k, m in judged if m[6]})
    assert len(after["near_dedup"]) < edge.count() and None in {r["text"] for r in after["decontaminate"]}
    lines = whole_lines([(r["doc_id"], r["text"]) for r in edge.collect()])
    want = Counter({(i, t): n for (i, t, _, gone), n in lines.items() if not gone or WORD.search(t)})
    assert Counter((r["doc_id"], r["text"]) for r in after["line_dedup"]) == want
    assert Counter((r["doc_id"], r["text"]) for r in after["mix_sources"]) == before
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name
