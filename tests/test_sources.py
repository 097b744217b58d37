"""File sources: malformed inputs, missing files, round trips."""

import json
import os

from lodestar.sources import background as SB
from lodestar.sources import questions as SQ
from lodestar.sources import runs as SR


def test_question_folder_scan(spark, tmp_dir):
    os.makedirs(tmp_dir)
    json.dump({"questions": [{"id": "a", "type": "yesno", "body": "Is x?"}, {"body": "no id"}]},
              open(f"{tmp_dir}/f1.json", "w"))
    json.dump({"questions": [{"id": "b", "body": "B"}]}, open(f"{tmp_dir}/f2.json", "w"))
    open(f"{tmp_dir}/bad.json", "w").write("{not json")
    json.dump({"questions": "not a list"}, open(f"{tmp_dir}/f3.json", "w"))
    json.dump({"questions": [{"id": "c", "body": "C"}]}, open(f"{tmp_dir}/skip.txt", "w"))
    rows = SQ.scan_questions(spark, tmp_dir).orderBy("seq").collect()
    assert [r["body"] for r in rows] == ["Is x?", "no id", "B"]
    assert rows[0]["id"] == "a" and rows[1]["id"] == "unknown_2" and rows[2]["id"] == "b"
    assert [r["id"] for r in SQ.question_limit(SQ.scan_questions(spark, tmp_dir), 1).collect()] == ["a"]


def test_question_files_round_trip(spark, tmp_dir):
    q = spark.createDataFrame([(i, i, f"body {i}") for i in range(2500)], "id long, seq long, body string")
    SQ.write_question_files(q, tmp_dir, per_file=1000)
    back = SQ.scan_questions(spark, tmp_dir)
    assert back.count() == 2500
    assert back.select("file_name").distinct().count() == 3


def test_missing_sources_are_empty(spark):
    assert SB.scan_unigrams(spark, "/nonexistent/u.csv").count() == 0
    assert SB.scan_word_repr(spark, "/nonexistent/w.json").count() == 0
    assert SQ.scan_questions(spark, "/nonexistent/q").count() == 0
    assert SR.scan_metrics(spark, "/nonexistent/m").count() == 0


def test_unigram_csv_coerces_numbers(spark, tmp_dir):
    os.makedirs(tmp_dir)
    open(f"{tmp_dir}/u.csv", "w").write("the;100\nword;frequency\ncell;2.5\nbad;\nx;1e3\n")
    got = {r["word"]: r["freq"] for r in SB.scan_unigrams(spark, tmp_dir).collect()}
    assert got == {"the": 100.0, "cell": 2.5, "x": 1000.0}


def test_word_repr_round_trip(spark, tmp_dir):
    wr = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("d", "b", 2)], "key string, word string, weight long")
    SB.write_word_repr_json(wr, tmp_dir, parts=2)
    assert sorted(map(tuple, SB.scan_word_repr(spark, tmp_dir).collect())) == [("a", "b", 3), ("a", "c", 1), ("d", "b", 2)]


def test_metric_scan_filters_names(spark, tmp_dir):
    os.makedirs(tmp_dir)
    m = {"S@10": 1, "P@10": 0.1, "R@10": 1, "F1@10": 0.2, "MAP@10": 0, "MRR": 1, "NDCG@10": 0.5}
    json.dump({"Ranked": "BM25", "metrics": m}, open(f"{tmp_dir}/TRAIN_metrics_BM25_x.json", "w"))
    json.dump({"Ranked": "BM25", "metrics": m}, open(f"{tmp_dir}/other_metrics.json", "w"))
    json.dump({"Ranked": "BM25", "metrics": {}}, open(f"{tmp_dir}/TRAIN_metrics_empty.json", "w"))
    json.dump({"Ranked": "BM25"}, open(f"{tmp_dir}/TEST_metrics_none.json", "w"))
    rows = SR.scan_metrics(spark, tmp_dir).collect()
    names = sorted(r["file_name"] for r in rows)
    assert names == ["TRAIN_metrics_BM25_x.json"]
    r = [x for x in rows if x["file_name"] == "TRAIN_metrics_BM25_x.json"][0]
    assert r["query_type"] == "N/A" and r["ndcg10"] == 0.5 and r["eval_type"] == "TRAIN"


def test_one_large_association_file_is_read_by_many_tasks(spark, tmp_dir):
    os.makedirs(tmp_dir)
    data = {f"key{i}": {f"w{k}": i * k for k in range(i % 5)} for i in range(4000)}
    json.dump(data, open(f"{tmp_dir}/one_line.json", "w"))
    json.dump({f"other {k}": v for k, v in data.items()}, open(f"{tmp_dir}/indented.json", "w"), indent=2)
    json.dump({}, open(f"{tmp_dir}/empty.json", "w"))
    want = sorted((f"{p}{k}", w, n) for p in ("", "other ") for k, m in data.items() for w, n in m.items())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert SB._inner_objects(spark, tmp_dir).rdd.getNumPartitions() > 3
        assert sorted(map(tuple, SB.scan_word_repr(spark, tmp_dir).collect())) == want
        # a brace inside a string: that file is read whole
        json.dump({"odd } key": {"a}": 1, '"{': 2}, "plain": {"b": 3}}, open(f"{tmp_dir}/odd.json", "w"))
        more = [("odd } key", "a}", 1), ("odd } key", '"{', 2), ("plain", "b", 3)]
        assert sorted(map(tuple, SB.scan_word_repr(spark, tmp_dir).collect())) == sorted(want + more)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
