import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.sources import decks, files, records, telemetry


def decode(path, content):
    if content == b"!":
        raise ValueError("no image")
    return [(p, 1, 1) for p in content.split(b"\x00")] if content != b"?" else []


def test_every_input_has_one_verdict(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in {"a.pdf": b"two\x00pages", "b.doc": b"x", "c.PNG": b"!", "sub/d.jpg": b"one", "e.png": b"", "f.png": b"?", "unasked.png": b"one"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    wanted = ["a.pdf", "b.doc", "c.PNG", "sub/d.jpg", "e.png", "f.png", "gone.pdf", "gone.doc", "a.pdf", None, ""]
    df = spark.createDataFrame([(w, k) for k, w in enumerate(wanted)], "path string, status int")
    pages, verdicts = files.ingest(df, str(tmp_path / "in"), decode)
    got = sorted((r.path or "", r.status, r.total_pages, (r.error or "").partition(":")[0]) for r in verdicts.collect())
    assert got == sorted(
        [("a.pdf", "accepted", 2, "")] * 2
        + [("b.doc", "skipped", 0, files.UNSUPPORTED), ("c.PNG", "failed", 0, "ValueError"), ("sub/d.jpg", "accepted", 1, ""), ("e.png", "failed", 0, files.MISSING), ("f.png", "failed", 0, files.EMPTY), ("gone.pdf", "failed", 0, files.MISSING), ("gone.doc", "skipped", 0, files.UNSUPPORTED)]
        + [("", "skipped", 0, files.UNSUPPORTED)] * 2
    )
    assert sorted((r.path, r.page_number, r.total_pages, bytes(r.image)) for r in pages.collect()) == [("a.pdf", 1, 2, b"two"), ("a.pdf", 2, 2, b"pages"), ("sub/d.jpg", 1, 1, b"one")]
    assert files.batch_summary(verdicts).first().asDict() == {"batch_size": 11, "accepted": 3, "skipped": 4, "failed": 4, "total_pages": 5}


def test_a_folder_that_is_not_there(spark, tmp_path):
    wanted = spark.createDataFrame([("a.pdf",)], "path string")
    pages, verdicts = files.ingest(wanted, str(tmp_path / "none"), decode)
    assert pages.collect() == [] and [(r.status, r.error) for r in verdicts.collect()] == [("failed", files.MISSING)]
    assert files.batch_summary(files.ingest(wanted.limit(0), str(tmp_path / "none"), decode)[1]).first().batch_size == 0


def test_broken_decks_keep_their_text(spark, tmp_path):
    texts = {"a": '{"deck_id": "a", "n": 1}', "b": "{broken", "c": '{"deck_id": "c", "n": "many"}', "d": ""}
    for k, t in texts.items():
        (tmp_path / f"{k}.json").write_text(t)
    kind = "deck_id string, n int"
    got = {r.path.rpartition("/")[2][0]: (r.status, r.raw_record) for r in decks.verdicts(spark, str(tmp_path), kind).collect()}
    assert got["a"] == ("accepted", None) and got["b"][0] == got["c"][0] == "failed" and got["b"][1].strip() == texts["b"] and got["c"][1].strip() == texts["c"]
    assert {r.deck_id for r in decks.read_json(spark, str(tmp_path), kind).collect() if r.deck_id} >= {"a"}
    assert decks.RAW in decks.read_json(spark, str(tmp_path)).columns


# -- records ---------------------------------------------------------------


def test_sanitized_types(spark):
    df = spark.sql(
        """SELECT cast('NaN' as double) a, cast('-Infinity' as float) b, 1.5D c, array(cast('Infinity' as double), 2D, null) d, map(1, cast('NaN' as double), 2, 3D) e, cast('hi' as binary) f, date'2024-01-02' g,
        timestamp'2024-01-02 03:04:05' h, interval '1' day i, named_struct('x', map(date'2024-01-01', array(named_struct('y', cast('NaN' as float))))) j, null k, cast(1.10 as decimal(10,2)) l, cast(null as struct<z:double>) m, true n"""
    )
    got = json.loads(records.sanitize(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    assert got["a"] is None and got["b"] is None and got["c"] == 1.5 and got["d"] == [None, 2.0, None] and got["e"] == {"1": None, "2": 3.0}
    assert got["f"] == "aGk=" and got["g"] == "2024-01-02" and got["h"] == "2024-01-02 03:04:05" and "1" in got["i"]
    assert got["j"] == {"x": {"2024-01-01": [{"y": None}]}} and got["k"] is None and float(got["l"]) == 1.1 and got["m"] is None and got["n"] is True


def test_keys_that_become_equal(spark):
    kind = T.MapType(T.DoubleType(), T.IntegerType())
    df = spark.createDataFrame([({1.0: 1, 2.0: 2},), (None,), ({},)], T.StructType([T.StructField("m", kind)]))
    out = df.select(records.sanitized(F.col("m"), kind).alias("m")).collect()
    assert [r.m for r in out] == [{"1.0": 1, "2.0": 2}, None, {}]


TEXTS = ['{"a": NaN, "b": "NaN Infinity, NaN]", "c": [1, -Infinity, {"d": Infinity}]}', '{"a": 1, "z": {"y": "x"}}', '[1, "two"]', '"Infinity"', "7", "null", "broken {", "", None, '{"a": 1, "a": 2}', '{"q": "a \\" NaN \\\\"}']


def test_texts_of_unlike_shapes(spark):
    df = records.parsed(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string"))
    got = {r.id: r.j for r in df.select("id", F.to_json("record").alias("j")).collect()}

    def plain(t):
        pairs = lambda kv: dict(kv) if len({k for k, _ in kv}) == len(kv) else (_ for _ in ()).throw(ValueError())
        try:
            return json.loads(t, parse_constant=lambda _: None, object_pairs_hook=pairs)
        except (TypeError, ValueError):
            return "no json"

    for k, t in enumerate(TEXTS):
        want = plain(t)
        assert (got[k] is None and want == "no json") or json.loads(got[k]) == want, (t, got[k])
    assert [r.v for r in df.orderBy("id").select(records.value(F.col("record"), "$.z.y").alias("v")).collect()][:2] == [None, "x"]
    assert {(r.id, r.field) for r in records.fields(df.where("id < 4"), ["id"]).collect()} == {(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "z")}
    assert records.shape(df.where("id < 2")).startswith("OBJECT<a:")


def test_round_trip(spark):
    df = spark.createDataFrame([(1, [1.5, float("nan")], {"x": 2}), (2, None, None)], "id int, a array<double>, m map<string,int>")
    v = records.to_variant(df)
    again = records.parsed(v.select(F.to_json("record").alias("text"))).select(F.to_json("record").alias("j"))
    assert sorted(r.j for r in again.collect()) == sorted(r.j for r in v.select(F.to_json("record").alias("j")).collect())
    assert [r.x for r in v.select(records.value(F.col("record"), "$.m.x", "int").alias("x")).collect()] == [2, None]
    assert math.isclose(v.select(records.value(F.col("record"), "$.a[0]", "double").alias("x")).first().x, 1.5)


# -- telemetry -------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 100])
def test_stages_are_counted_as_they_run(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("four").alias("text"))
    stages = [("half", lambda d: d.where("doc_id % 2 = 0")), ("twice", lambda d: d.union(d)), ("count", lambda d: d.groupBy().count()), ("other", lambda d: d.sparkSession.range(3))]
    out, table = telemetry.run_stages(docs, stages)
    got = [(r.stage, r.rows_in, r.rows_out, r.bytes_in or 0) for r in table.orderBy("place").collect()]
    assert got[0] == ("half", n, n // 2, 4 * n) and got[1][0] == "twice" and got[1][2] == n and got[2][1:3] == (n, 1) and got[3][1:3] == (None, 3)
    assert out.count() == 3 and all(r.seconds > 0 for r in table.collect())
