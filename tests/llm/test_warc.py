import hashlib

from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptorium.llm import warc


def pages(spark, n=40):
    rows = [(k * 90, f"http://h/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(n)] + [(None, None, None), (7, "http://x", ""), (7, "http://x", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_records_follow_each_other(spark):
    archive = warc.records(pages(spark), 1024)
    place = warc.leaves(archive).collect()
    body = {r.digest: r.record for r in archive.collect()}
    rows = sorted((Row(**r.asDict(), record=body[r.digest]) for r in place), key=lambda r: (r.file, r.seq))
    end = {}
    for r in rows:
        assert r.start == end.get(r.file, 0) and r.length == len(r.record.encode())
        end[r.file] = r.start + r.length
    whole = "".join(r.record for r in rows if r.file == 0).encode()
    got = list(warc.parse(whole))
    assert [(s, n) for s, n, _, _ in got] == [(r.start, r.length) for r in rows if r.file == 0]
    assert [h["warc-target-uri"] for _, _, h, _ in got] == [r.record.split("Target-URI: ")[1].split("\r\n")[0] for r in rows if r.file == 0]


def test_damage_is_located(spark):
    p = pages(spark)
    damaged = p.withColumn("html", F.when(F.col("page_id").isin(90, 1080, 3510), "#broken").otherwise(F.col("html"))).where("page_id is null or page_id <> 1800")
    got = {(r.warc_file, r.record_offset): r for r in warc.fixity(warc.records(p), warc.records(damaged)).collect()}
    bad = {r.page_id for r in got.values() if not r.intact}
    assert {90, 1080, 3510, 1800} <= bad
    assert None not in bad and 7 not in bad and 0 not in bad
    a, b = warc.leaves(warc.records(p)), warc.leaves(warc.records(damaged))
    mine, theirs = ({(r.file, r.seq): r for r in x.collect()} for x in (a, b))
    want = {k for k in mine.keys() | theirs.keys() if mine.get(k) != theirs.get(k) and (k not in mine or k not in theirs or mine[k][3:] != theirs[k][3:])}
    shape = warc.Shape.of(a, b)
    found = {tuple(r) for r in warc.audit(warc.tree(a, shape), warc.tree(b, shape), shape).collect()}
    assert found == want


def test_equal_replicas_and_empty(spark):
    p = pages(spark)
    assert all(r.intact for r in warc.fixity(warc.records(p), warc.records(p)).collect())
    none = p.limit(0)
    assert warc.fixity(warc.records(none), warc.records(none)).count() == 0
    assert not any(r.intact for r in warc.fixity(warc.records(p), warc.records(none)).collect())


def test_digest(spark):
    for r in warc.records(pages(spark)).collect():
        assert r.digest == hashlib.sha256(r.record.encode()).hexdigest() and r.length == len(r.record.encode())


def test_files(spark, tmp_path):
    body = [r.record.encode() for r in warc.records(pages(spark)).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(body))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(warc.compress, body)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(body)
    data = (tmp_path / "b.warc.gz").read_bytes()
    import gzip

    for r in got:
        if r.path.endswith("gz"):
            assert gzip.decompress(data[r.start : r.start + r.length]).endswith(bytes(r.payload) + b"\r\n\r\n")


def test_damaged_files_give_what_stands_before_the_damage(spark, tmp_path):
    body = [r.record.encode() for r in warc.records(pages(spark, 3)).collect()]
    no_length = body[1].replace(b"Content-Length", b"Content-Size")
    for name, data in {"cut.warc": b"".join(body)[:-9], "size.warc": body[0] + no_length + body[2], "cut.warc.gz": warc.compress(body[0]) + warc.compress(body[1])[:-9], "empty.warc": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert {k: [r.error is None for r in v] for k, v in got.items()} == {"cut.warc": [True] * (len(body) - 1) + [False], "size.warc": [True, False], "cut.warc.gz": [True, False]}


def test_one_page_id_of_many_rows_is_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_RECORDS", 50)
    rows = [(7, f"http://h/{k % 40}", "x" * (k % 9)) for k in range(600)] + [(None, "u", "long " * 100_000)] * 3
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("f")).withColumn("seq", F.lit(1))
    at = {}
    for r in sorted(warc.leaves(warc.records(p)).collect(), key=lambda r: (r.file, r.seq)):
        seq, end, last = at.get(r.file, (0, 0, ""))
        assert (r.seq, r.start) == (seq, end) and r.digest >= last
        at[r.file] = seq + 1, end + r.length, r.digest
    assert sum(n for n, _, _ in at.values()) == 603
    damaged = p.withColumn("html", F.when(F.col("url") == "http://h/3", "!").otherwise(F.col("html")))
    out = warc.fixity(warc.records(p), warc.records(damaged)).collect()
    assert len(out) == 603 and any(not r.intact for r in out)


def test_one_lost_record_is_one_finding(spark):
    """Every later record of the file stands elsewhere in the replica, but is there."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(200)] + [(50, "http://x/50", "<p>1</p>" * 0)], "page_id long, url string, html string")
    mine = warc.records(pages, per_file=64)
    lost = warc.records(pages.where("page_id <> 20"), per_file=64)
    assert [r.page_id for r in warc.fixity(mine, lost).where("not intact").collect()] == [20]
    assert warc.fixity(lost, mine).where("not intact").count() == 0
    # one of two equal records is missing: one finding
    once = warc.records(pages.dropDuplicates(["page_id"]), per_file=64)
    assert [r.page_id for r in warc.fixity(mine, once).where("not intact").collect()] == [50]
    # a wrong byte beside a lost record
    both = warc.records(pages.where("page_id <> 20").withColumn("html", F.when(F.col("page_id") == 30, "?").otherwise(F.col("html"))), per_file=64)
    assert sorted(r.page_id for r in warc.fixity(mine, both).where("not intact").collect()) == [20, 30]
