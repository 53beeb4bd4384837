from pyspark.sql import functions as F

from scriptorium.operators import profiles
from scriptorium.sources import decks, files
from scriptorium.streaming import profiles as stream


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"two\x00pages")
    (tmp_path / "b.doc").write_bytes(b"x")
    (tmp_path / "c.PNG").write_bytes(b"!")
    docs = files.read_documents(spark, str(tmp_path))
    assert {r.path.rpartition("/")[2]: r.status for r in docs.collect()} == {"a.pdf": "accepted", "b.doc": "skipped", "c.PNG": "accepted"}

    def decode(path, content):
        if content == b"!":
            raise ValueError("no image")
        return [(p, 1, 1) for p in content.split(b"\x00")]

    got = files.pages(docs, decode).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.total_pages) for r in got] == [(1, 2), (2, 2), (0, 0)] and "no image" in got[2].error


def test_export(spark, tmp_path):
    files.export(spark.createDataFrame([("d 1", "plain", "# md")], "name string, plain_text string, markdown string"), str(tmp_path / "out"), F.col("name"))
    assert spark.read.text(str(tmp_path / "out/md")).select("value").first()[0] == "# md"


def test_deck_library(spark, tmp_path):
    path = str(tmp_path / "lib")
    rows = [(f"d{k}", f"Talk {k}", f"2024-01-0{k}", float(k)) for k in range(1, 5)]
    decks.save(spark.createDataFrame(rows, "deck_id string, source_document_title string, created_at string, mastery_percentage double"), path)
    lib = decks.read(spark, path)
    assert [r.deck_id for r in decks.listed(lib).collect()] == ["d4", "d3", "d2", "d1"]
    assert decks.get(lib, "d2").count() == 1 and decks.get(lib, "none").count() == 0 and decks.search(lib, "talk 3").count() == 1
    assert decks.delete(spark, path, "d2") and not decks.delete(spark, path, "d2")
    spark.catalog.refreshByPath(path)
    assert {r.deck_id for r in decks.read(spark, path).collect()} == {"d1", "d3", "d4"}


def test_deck_removal_goes_on_after_a_lost_driver(spark, tmp_path):
    path = tmp_path / "lib"
    decks.save(spark.createDataFrame([("a", "A"), ("b", "B")], "deck_id string, source_document_title string"), str(path))
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit("a")), F.lit(64))).first()[0]
    (path / f"part={part}").rename(path / f"_old-{part}")
    assert decks.delete(spark, str(path), "a")
    spark.catalog.refreshByPath(str(path))
    assert {r.deck_id for r in decks.read(spark, str(path)).collect()} == {"b"} and not list(path.glob("_*-*"))


def test_broken_json_decks_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"deck_id": "a", "created_at": "1"}')
    (tmp_path / "b.json").write_text("{broken")
    assert decks.read_json(spark, str(tmp_path), "deck_id string, created_at string").where("deck_id is not null").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("u", "road", "rode"), ("u", "road", "rode"), ("v", "a", "a")]
    df = spark.createDataFrame(rows, "user_id string, original string, accepted string")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream.to_memory(stream.word_counts(live), "stream_words", str(tmp_path / "state")).awaitTermination()
    assert {tuple(r) for r in spark.sql("select user_id, word, n from stream_words").collect()} == {tuple(r) for r in profiles.words(df).select("user_id", "word", "n").collect()}
