import random
import threading

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import profiles, proofreading
from scriptorium.sources import profile_store as store
from scriptorium.streaming import corrections as co


def loop(actions):
    """(key, ord, place, current) by lists."""
    out, state = [], {}
    for key, o, action, text in sorted(actions, key=lambda x: (repr(x[0]), x[1])):
        texts, at = state.get(key, ([], -1))
        if action == "push":
            texts, at = [*texts[: at + 1], text], at + 1
        elif action == "undo" and at > 0:
            at -= 1
        elif action == "redo" and at < len(texts) - 1:
            at += 1
        state[key] = texts, at
        out.append((key, o, at, texts[at] if at >= 0 else None))
    return out


def actions(n=400, users=(1, 2, 3, None), seed=1):
    r = random.Random(seed)
    return [(r.choice(users), k, r.choice(("push", "push", "undo", "redo", "other")), r.choice((f"text {k}", None))) for k in range(n)]


KIND = "user long, ord long, action string, text string"


def test_history_equals_lists(spark):
    rows = actions()
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert sorted(map(tuple, proofreading.history(df, ["user"]).collect()), key=repr) == sorted(loop(rows), key=repr)
    assert proofreading.history(df.limit(0), ["user"]).collect() == []


def test_a_long_history_of_one_user(spark):
    n = 60_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("user"), F.col("id").alias("ord"), F.when(F.col("id") % 5 == 4, "undo").otherwise("push").alias("action"), F.concat(F.lit("t"), "id").alias("text"))
    got = proofreading.history(df, ["user"])
    assert got.count() == n
    assert got.orderBy(F.desc("ord")).first()["place"] == 3 * (n // 5) - 1


def test_live_history_grows_by_its_events(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", co.ROCKSDB)
    try:
        rows = actions(users=(1, 2, 3))
        (tmp_path / "in").mkdir()
        live = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        got = []

        def run(part):
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = co.live_history(live, ["user"]).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()

        run(rows[:150])
        run(rows[150:300])
        run(rows[200:300])  # events that have been there
        run(rows[300:])
        assert sorted(got, key=repr) == sorted(loop(rows), key=repr)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_apply_with_feedback(spark):
    docs = spark.createDataFrame([(1, "The boy road a bike."), (2, "nothing"), (3, None)], "doc_id long, text string")
    accepted = spark.createDataFrame([(1, "u", "s1", 8, 12, "road", "rode"), (1, "u", "s1", 8, 12, "road", "rode"), (1, "u", "s2", 15, 19, "bike", "bicycle")], "doc_id long, user_id string, suggestion_id string, begin int, stop int, original string, proposed string")
    out, events = co.apply_with_feedback(docs, accepted)
    assert {r.doc_id: r.corrected_text for r in out.collect()} == {1: "The boy rode a bicycle.", 2: "nothing", 3: None}
    assert sorted((r.suggestion_id, r.original, r.accepted) for r in events.collect()) == [("s1", "road", "rode"), ("s2", "bike", "bicycle")]


def test_each_correction_reaches_the_ledger_once(spark, tmp_path):
    kind = "user_id string, doc_id long, suggestion_id string, original string, accepted string"
    rows = [("u" + str(k % 3), k % 7, f"s{k}", "road", "rode" if k % 2 else "road") for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20] + rows[:5], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "ledger")

    def ids():
        return sorted((r.doc_id, r.suggestion_id) for r in co.entries(spark, path, kind).collect())

    assert ids() == []
    co.to_ledger(live, path, str(tmp_path / "a")).awaitTermination()
    want = sorted((r[1], r[2]) for r in rows)
    assert ids() == want
    # the last batch once more, as after a driver lost between its write and its commit
    commits = sorted((tmp_path / "a" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "a" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    co.to_ledger(live, path, str(tmp_path / "a")).awaitTermination()
    assert ids() == want
    # the whole stream anew, in other batches
    co.to_ledger(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), path, str(tmp_path / "b")).awaitTermination()
    assert ids() == want
    got = {r.user_id: (r.documents_processed, r.corrections_accepted) for r in profiles.summary(co.entries(spark, path, kind)).collect()}
    assert got == {f"u{k}": (20, 10) for k in range(3)}


# -- the store -------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id string, original string, accepted string")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "profiles")
    assert store.latest(spark, path) == 0 and store.read(spark, path).collect() == []
    (new,) = store.load(spark, path, "a b/c").collect()
    assert new.user_id == "a_b_c" and new.documents_processed == 0 and new.writing_style.slant == "vertical" and new.character_confusions["v"] == {"y": 0.35, "u": 0.20}
    assert store.load(spark, path, "a b/c").collect() == [new] and store.latest(spark, path) == 1
    store.record(events(spark, [("u", "road", "rode"), ("u", "skv", "sky"), ("a_b_c", "x", "x")]), path)
    old = store.read(spark, path).collect()
    by = {r.user_id: r for r in old}
    assert by["u"].corrections_accepted == 2 and by["u"].systematic_errors == {"road": 1, "skv": 1} and by["u"].character_confusions["v"] == {"y": 0.40, "u": 0.20}
    assert by["u"].character_confusions["a"] == {"g": 0.30, "o": 0.25} or by["u"].character_confusions["a"]["o"] >= 0.20
    assert by["a_b_c"].documents_processed == 1 and by["a_b_c"].corrections_accepted == 0
    store.record(events(spark, [("u", "road", "rode")]), path)
    assert {r.user_id: r.systematic_errors for r in store.read(spark, path).collect()}["u"] == {"road": 2, "skv": 1}
    # readers of the version before see what they saw
    assert sorted(store.read(spark, path, 2).collect()) == sorted(old)
    store.reset(spark, path, "u")
    assert {r.user_id: r.documents_processed for r in store.read(spark, path).collect()} == {"u": 0, "a_b_c": 1}
    with pytest.raises(ValueError):
        store.read(spark, path, 99)


def test_one_of_two_writers_is_refused_and_nothing_is_lost(spark, tmp_path):
    path = str(tmp_path / "profiles")
    row = lambda u: spark.range(1).select(*store.fresh(F.lit(u)))
    base = store.latest(spark, path)
    assert store.commit(row("first"), path, base) == 1
    with pytest.raises(store.Conflict):
        store.commit(row("second"), path, base)
    assert [r.user_id for r in store.read(spark, path).collect()] == ["first"]
    assert store.update(spark, path, lambda known: row("second")) == 2
    # threads that count up the same profile: each reads anew until its version is taken
    threads = [threading.Thread(target=store.record, args=(events(spark, [("n", "a", "b")]), path)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r.user_id: r for r in store.read(spark, path).collect()}
    assert got["n"].documents_processed == 4 and got["n"].custom_vocabulary == {"b": 4} and set(got) == {"first", "second", "n"}
    assert store.latest(spark, path) == 6
