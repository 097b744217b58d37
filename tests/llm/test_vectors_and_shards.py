"""Vector codes, hard negatives and shards against plain restatements, on small tables and on rows
with nulls, ties, repeats, odd lengths and extra columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives, queries, sharding, vector_codes
from lodestar.llm.vectors import embeddings
from lodestar.session import scratch_path
from tests.llm.conftest import EDGE, SF
from tests.llm.test_base_contracts import multiset

random.seed(11)
SAME = [0.25] * 16
ODD = [
    (None, [0.5] * 16, 1), (1, None, 1), (2, [None] + [0.1] * 15, 1), (3, [float("nan")] + [0.1] * 15, 2),
    (4, [float("inf")] * 16, 2), (5, [-0.3, 0.2] * 8, None), (6, [0.1] * 15, 3), (7, [], 3), (9, [-1e-9] * 16, 3), (9, [-1e-9] * 16, 3),
    *[(100 + i, SAME, i % 3) for i in range(40)],
    *[(200 + i, [random.uniform(-1, 1) for _ in range(16)], i % 10) for i in range(260)],
    (700, [-0.0] * 16, 4), (800, [-2.0] * 16, 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, "extra", "extra", 1) for r in ODD]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, v string, part int")


@pytest.fixture(params=["table", "odd", "few", "none"])
def vectors(request, spark, odd):
    return {"table": embeddings(spark, SF), "odd": odd, "few": odd.filter("vec_id in (9, 100, 101, 203)"), "none": odd.filter("false")}[request.param]


def kept_rows(vectors, scale):
    """(id, label, integers padded to the longest) of the whole vectors."""
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in vectors.collect()]
    rows = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = max((len(v) for _, _, v in rows), default=0)
    return [(i, y, v, [math.floor(scale * x) for x in v] + [0] * (width - len(v))) for i, y, v in rows]


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    rows = kept_rows(vectors, 4096)
    width = len(rows[0][3]) if rows else 0
    span = -(-width // parts)
    cut = lambda v: [(v + [0] * (span * parts - width))[p * span:(p + 1) * span] for p in range(parts)]
    data = [(i, y, cut(v)) for i, y, _, v in rows]
    begun = sorted([r for r in rows if r[0] is not None], key=lambda r: (r[0], r[2]))[:entries]
    books = [[cut(r[3])[p] for r in begun] or [[0] * span] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in data:
                members[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])]
    coded = [(i, y, [nearest(v[p], books[p]) for p in range(parts)]) for i, y, v in data]
    totals = Counter()
    for _, y, c in coded:
        totals[y] += sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), totals[y], digest) for i, y, c in coded]


@pytest.mark.parametrize("block_rows", [16_384, 37])
def test_vector_codes(vectors, block_rows):
    got = vector_codes.vector_codes(vectors, block_rows=block_rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert multiset(got.collect()) == multiset(plain_codes(vectors))


def test_vector_codes_decode_near(spark):
    table = embeddings(spark, SF)
    coded, books = vector_codes.encode(table)
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}
    for r in coded.collect():
        lost = np.floor(vectors[r["vec_id"]] * 4096) - books.decode(r["code"]) * 4096
        assert int((lost ** 2).sum()) == r["error"]


def test_components_beyond_the_limit_are_an_error(spark):
    huge = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    for run in (vector_codes.vector_codes, hard_negatives.mine):
        with pytest.raises(Exception, match="exceeds"):
            run(huge).collect()


def plain_negatives(vectors):
    rows = {(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, tuple(v), tuple(w))
            for i, y, v, w in kept_rows(vectors, 256) if y is not None}
    # a vector's length takes no part once padded, but rows of other lengths are other rows
    out = []
    last = lambda i: (i is None, i or 0)
    for a, y, _, v in rows:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), last(i), z, i) for i, z, _, w in rows if i != a))
        for p, _, _, i in [s for s in scored if s[2] == y][:5]:
            inside = [s for s in scored if s[2] != y and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, i, n, s[3], -p, -s[0]) for n, s in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("block_rows,pass_anchors", [(8_192, 16_384), (23, 2)])
def test_hard_negatives(vectors, block_rows, pass_anchors):
    got = hard_negatives.mine(vectors, block_rows=block_rows, pass_anchors=pass_anchors)
    assert multiset(got.drop("negative_label").collect()) == multiset(plain_negatives(vectors))


def test_scan_drops_candidates_early():
    """Columns in descending magnitude: rows far below the best are dropped before the small columns."""
    rng = np.random.default_rng(5)
    matrix = rng.integers(-20, 20, (4_000, 64))
    matrix[:8, :4] = 60
    block = hard_negatives.Block(np.arange(4_000), np.zeros(4_000, np.int64), matrix.min(0), matrix.max(0), matrix.T.astype(np.int32))
    vector = np.concatenate([[500] * 4, [1] * 60])
    sizes = []

    def needed(lower, upper):
        sizes.append(len(lower))
        return upper >= hard_negatives._kth(lower, 5)
    rows, scores = hard_negatives.Scan(block, vector, np.arange(4_000)).run(needed)
    assert sizes[0] == 4_000 and sizes[1] <= 8
    assert sorted(scores)[-5:] == sorted((matrix @ vector).tolist())[-5:]


# ------------------------------------------------------------------ shards
@pytest.mark.parametrize("good,bad,sample", [(3, 5, 4), (2, 2, 2), (7, 1, 5), (40, 60, 30), (500, 300, 700), (1000, 15000, 1000)])
def test_hypergeometric_law(spark, good, bad, sample):
    n = 20_000
    drawn = spark.range(n).select(sharding.hypergeometric(F.lit(good), F.lit(bad), F.lit(sample), F.lit(3), F.col("id")).alias("x"))
    seen = {r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()}
    chi = cells = rest = rest_due = 0
    for k in range(sample + 1):
        due = n * math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
        if due == 0:
            assert k not in seen
        elif due < 5:
            rest, rest_due = rest + seen.get(k, 0), rest_due + due
        else:
            chi, cells = chi + (seen.get(k, 0) - due) ** 2 / due, cells + 1
    if rest_due > 1:
        chi, cells = chi + (rest - rest_due) ** 2 / rest_due, cells + 1
    assert chi < (cells - 1) + 4 * math.sqrt(2 * (cells - 1)) + 4


def test_hypergeometric_edges_and_huge(spark):
    rows = [(0, 5, 3), (5, 0, 3), (4, 4, 0), (4, 4, 8), (1, 0, 1), (0, 0, 0), (10**12, 10**12, 10**11)]
    df = spark.createDataFrame(rows, "g long, b long, n long")
    got = [r[0] for r in df.select(sharding.hypergeometric(F.col("g"), F.col("b"), F.col("n"), F.lit(1))).collect()]
    assert got[:6] == [0, 3, 0, 4, 1, 0]
    assert abs(got[6] - 5 * 10**10) < 6 * math.sqrt(10**11 / 4)


@pytest.mark.parametrize("fan_bits", [2, 6])
def test_matrix_keeps_its_margins(spark, fan_bits):
    sizes = {p: 1 + (p * 37) % 91 for p in range(150)}
    parts = spark.createDataFrame(list(sizes.items()), "part long, n long")
    rows = sharding.communication_matrix(parts, 7, fan_bits=fan_bits).collect()
    assert {r["part"]: sum(r["row"]) for r in rows} == sizes and len(rows) == len(sizes)
    assert min(min(r["row"]) for r in rows) >= 0
    total = sum(sizes.values())
    assert [sum(r["row"][j] for r in rows) for j in range(7)] == [total // 7 + (j < total % 7) for j in range(7)]


def test_matrix_cells_follow_the_law(spark):
    """Cells have the hypergeometric mean and variance, through three levels of the tree."""
    parts = spark.createDataFrame([(p, 12) for p in range(1_500)], "part long, n long")
    cells = [r["row"][0] for r in sharding.communication_matrix(parts, 3, fan_bits=4).collect()]
    want = 12 * (1 / 3) * (2 / 3) * (18_000 - 12) / 17_999
    assert np.mean(cells) == 4  # margins are exact
    assert abs(np.var(cells) - want) < 5 * want * math.sqrt(2 / len(cells))


def checked_shards(rows, n_shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < n_shards for s in slots)
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_query(spark):
    import zlib
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    run = lambda: queries.op11_hypergeometric_shards(spark, SF)
    rows = run().collect()
    checked_shards(rows)
    assert multiset(rows) == multiset(run().collect())
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert dict(run().dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                                  "slot": "bigint", "grown_shard": "int"}
    assert {r["shard"] for r in rows if r["doc_id"] < 60} > {r["shard"] for r in rows if r["doc_id"] < 3}


@pytest.mark.parametrize("how", [{}, {"part_rows": 2, "bucket_rows": 1, "n_shards": 5}, {"n_shards": 40}])
def test_shards_of_odd_rows(edge, how):
    got = sharding.shard_rows(edge, **how)
    rows = got.select("*", "place.shard", "place.slot").collect()
    checked_shards(rows, how.get("n_shards", 16))
    assert Counter((r["doc_id"], r["text"], r["score"]) for r in rows) == Counter((r[0], r[1], "extra") for r in EDGE)


def test_shards_of_nothing(empty):
    assert sharding.shard_rows(empty).collect() == []


def test_shards_place_is_uniform(spark):
    """Shard and slot know nothing of a row's place, its part, or its neighbours."""
    path = scratch_path(spark, "many")
    spark.range(6_000).repartitionByRange(3, "id").write.parquet(path)
    rows = sharding.shard_table(spark, path, n_shards=4, part_rows=500, bucket_rows=100).select("id", "place.*").collect()
    checked_shards(rows, 4)
    place = np.empty(6_000)
    for r in rows:
        place[r["id"]] = r["shard"] * 1_500 + r["slot"]
    n = len(place)
    ranks = np.arange(n)
    assert abs(np.corrcoef(ranks, place)[0, 1]) < 4 / math.sqrt(n)
    assert abs(np.corrcoef(place[1:], place[:-1])[0, 1]) < 4 / math.sqrt(n)
    assert abs(np.corrcoef(ranks % 500, place % 1_500)[0, 1]) < 4 / math.sqrt(n)
    cells, _, _ = np.histogram2d(ranks, place, bins=12)
    chi = ((cells - n / 144) ** 2 / (n / 144)).sum()
    assert abs(chi - 121) < 4 * math.sqrt(2 * 121)


def test_written_shards_follow_their_slots(spark, docs):
    path = scratch_path(spark, "shards")
    sharding.write_shards(sharding.shard_rows(docs.select("doc_id", "text"), n_shards=4), path)
    back = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index").collect()
    checked_shards(back, 4)
    by_file = defaultdict(list)
    for r in sorted(back, key=lambda r: (r["file_path"], r["row_index"])):
        by_file[r["file_path"]].append(r["slot"])
    assert all(s == sorted(s) for s in by_file.values())
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
