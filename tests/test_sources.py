import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from presswork.providers import base
from presswork.sources import files
from presswork.streaming import buckets

S = StructType([StructField("k", StringType()), StructField("v", LongType())])


def test_tolerant_and_strict_json_lines(spark, tmp_path):
    p = tmp_path / "log.json"
    p.write_text('{"k": "a", "v": 1}\n\nnot json\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n')
    assert files.read_json_lines(spark, str(p), S).count() == 3
    assert {r["k"] for r in files.done_keys(spark, str(p), S, ["k"]).collect()} == {"a", "b"}
    assert files.done_keys(spark, str(tmp_path / "none"), S, ["k"]).count() == 0
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_json_lines(spark, str(p), S, strict=True).collect()


def test_shards_manifest_and_view(spark, tmp_path):
    d = f"file://{tmp_path}"
    files.write_shards(spark.range(1000), d + "/t", 100)
    assert len(files.shards(spark, d + "/t")) >= 10
    assert files.first_existing(spark, [d + "/no", d + "/t"]) == d + "/t"
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [d + "/no"])
    m = lambda rows: spark.createDataFrame(rows, "shard string, n long")
    files.manifest_upsert(spark, d + "/m", m([("a", 1), ("b", 2)]), ["shard"])
    got = files.manifest_upsert(spark, d + "/m", m([("b", 5), ("c", 7)]), ["shard"])
    assert {r["shard"]: r["n"] for r in got.collect()} == {"a": 1, "b": 5, "c": 7}
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for cols, n in ((None, 1), (["id"], 1), (["other"], 2)):
        assert files.materialize(spark, d + "/v", build, columns=cols).count() == 3 and len(calls) == n


def test_report_and_bullets(spark, tmp_path):
    one = spark.createDataFrame([("x", 1)], "k string, v long")
    path = f"file://{tmp_path}/r"
    assert files.write_json_report(one, path) == {"k": "x", "v": 1}
    assert files.read_json_document(spark, path) == {"k": "x", "v": 1}
    assert files.bullets(one, "{k}: {v}") == "- x: 1"
    with pytest.raises(ValueError):
        files.write_json_report(one.limit(0), path)


class Fussy(base.Labeler):
    labels = ("yes", "no")

    def __call__(self, text):
        if text == "boom":
            raise RuntimeError("failed")
        return ("yes" if "good" in text else "no" if text else "perhaps"), 1.7, "because"


def test_labels_have_a_status_each(spark):
    df = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "boom"), ("4", None), ("5", "good")], "k string, t string")
    done = spark.createDataFrame([("5",)], "k string")
    got = {r["k"]: r for r in base.label_rows(df, "k", "t", Fussy(), done).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["label"], got["1"]["confidence"], got["1"]["label_status"]) == ("yes", 1.0, "ok")
    assert got["3"]["label_status"] == "error" and got["4"]["label_status"] == "parse_error"


def test_retry_pauses_and_gives_up():
    slept, tries = [], []

    def call():
        tries.append(1)
        raise base.Retry

    with pytest.raises(base.Retry):
        base.with_retry(call, tries=4, cap=3, sleep=slept.append)
    assert len(tries) == 4 and slept == [1, 2, 3]


def test_replies(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('Well: {"a": 2} ok',), ("none",), (None,)], "r string")
    assert [x["parsed"]["a"] if x["parsed"] else None for x in base.parse_reply(df, "r", "a long").collect()] == [1, 2, None, None]


def test_gazetteer_offsets(spark):
    df = spark.createDataFrame([(1, "In Rome and Rome again. Oslo"), (2, None)], "id int, t string")
    got = [(r["entity_surface"], r["char_start"], r["char_end"]) for r in base.gazetteer_mentions(df, "t", {"Rome": "p", "Oslo": "p"}, ["id"]).collect()]
    assert sorted(got) == [("Oslo", 24, 28), ("Rome", 3, 7), ("Rome", 12, 16)]


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = spark.range(200).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 3600).alias("ts"), F.lit(1.0).alias("value"))
    rows.unionByName(rows.where("id < 50")).repartition(6).write.parquet(src)
    s = lambda: buckets.read_files(spark, src, rows.schema, 2)
    got = buckets.run_to_table(buckets.window_counts(s(), "ts", [], "1 day", "30 days"), "w", "complete")
    want = buckets.window_counts(spark.read.parquet(src), "ts", [], "1 day", "30 days")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert buckets.run_to_table(buckets.deduplicated(s(), ["id"], "ts", "30 days"), "d").count() == 200


def test_gazetteer_tables_edges_and_passes(spark):
    df = spark.createDataFrame([(1, "machine learnings, machine learning; New York City", 0.1), (2, "", 0.2), (3, None, 0.3)], "id int, t string, raw_score double")
    names = spark.createDataFrame([("machine learning", "t"), ("New York", "p"), ("New York City", "p"), ("York", "x"), (None, "x"), ("...", "x")], "name string, label string")
    want = [("New York", "p", 37), ("New York City", "p", 37), ("York", "x", 41), ("machine learning", "t", 19)]
    for part in (500, 1):
        got = [(r["entity_surface"], r["raw_label"], r["char_start"]) for r in base.gazetteer_mentions(df, "t", names, ["id"], part).collect()]
        assert sorted(got) == sorted((a, b, c) for a, b, c in want)
    assert base.gazetteer_mentions(df, "t", names.limit(0), ["id"]).count() == 0


def test_http_labels_retry_and_errors():
    import http.server
    import json
    import threading

    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][1]["content"]
            seen.append(text)
            code = 429 if seen.count("later") == 1 and text == "later" else 400 if text == "bad" else 200
            self.send_response(code)
            self.end_headers()
            reply = 'Sure: {"label": "1", "confidence": "0.7", "reason": "so"}' if text != "odd" else "no json"
            self.wfile.write(json.dumps({"choices": [{"message": {"content": reply}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = base.HttpLabeler(f"http://127.0.0.1:{server.server_port}/", "m", "Label it.", ("0", "1"))
    assert base.with_retry(lambda: ask("later"), sleep=lambda _: None) == ("1", 0.7, "so") and seen.count("later") == 2
    assert ask("odd")[0] == "no json"
    with pytest.raises(ValueError):
        ask("bad")
    server.shutdown()
    dead = base.HttpLabeler(f"http://127.0.0.1:{server.server_port}/", "m", "x", ("0", "1"), timeout=0.2)
    server.server_close()
    with pytest.raises(base.Retry):
        dead("x")


def test_an_unfinished_manifest_version_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    m = lambda rows: spark.createDataFrame(rows, "shard string, n long")
    files.manifest_upsert(spark, path, m([("a", 1)]), ["shard"])
    os.makedirs(tmp_path / "m" / "v-000000000009")  # a writer that broke off
    assert files.read_manifest(spark, path).collect()[0]["n"] == 1
    for k in range(4):
        files.manifest_upsert(spark, path, m([("a", k)]), ["shard"])
    assert files.read_manifest(spark, path).collect()[0]["n"] == 3
    assert len(files._versions(spark, path)) == 2


def test_packed_rows_and_truth_values(spark):
    df = spark.createDataFrame([("x" * n,) for n in (5, 900, 90, 5000)] + [(None,)], "t string")
    got = base.packed(df, "t").collect()
    assert sorted(r["len_range"] for r in got) == [0, 0, 1, 4, 5]
    v = spark.createDataFrame([(" TRUE",), ("0",), ("maybe",), (None,), ("",)], "v string")
    assert [r["b"] for r in v.select(base.as_bool(F.col("v")).alias("b")).collect()] == [True, False, None, None, False]


def test_terms_and_density(spark):
    from presswork.providers import models

    df = spark.createDataFrame([("a", "solar power grid of power"), ("a", "solar grid"), ("b", "court judge of grid"), (None, "x y"), ("b", None)], "topic string, t string")
    got = models.class_terms(df, "topic", "t", 2, ["of"]).collect()
    assert {r["topic"] for r in got} == {"a", "b"} and {r["rank"] for r in got} == {1, 2}
    v = {r["term"]: r["n"] for r in models.ngram_vocabulary(df, "t", 1, 1.0, ["of"]).collect()}
    assert v["solar"] == 2 and v["grid"] == 3 and v["power grid power"] == 1 and "of" not in v
    pts = [(i, [1.0, 0.01 * (i % 3), 0.0], 0) for i in range(40)] + [(99, [-1.0, 0.3, -2.0], 0)]
    d = models.density_noise(spark.createDataFrame(pts, "k int, v array<double>, topic int"), "k", "v", "topic")
    assert {r["k"] for r in d.where("not dense").collect()} == {99} and d.count() == 41


def test_vectors_and_batches(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    spark.range(25).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v")).write.parquet(path)
    assert files.read_vectors(spark, path, "v", 25, 2).count() == 25
    for wrong in ({"rows": 24}, {"size": 3}):
        with pytest.raises(ValueError):
            files.read_vectors(spark, path, "v", **wrong)
    assert [len(b) for b in files.record_batches(spark.range(25), 10)] == [10, 10, 5]
    assert list(files.record_batches(spark.range(0), 10)) == []
