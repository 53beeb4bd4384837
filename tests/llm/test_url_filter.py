import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import url_filter as uf

CASES = [
    ("http://A.Example.ORG/en/12?x=/es/", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("https://example.org/es", "example.org", "/es", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://org", "org", "", None, "allow"),
    ("ftp://www.spam-farm.example.com/en/3", "www.spam-farm.example.com", "/en/3", None, "block"),
    ("https://spam-farm.example.org/en/3", "spam-farm.example.org", "/en/3", "org/", "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b.net/c://d.org/", "b.net", "/c://d.org/", None, "allow"),
]


def test_judgements(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "page_id long, url string").withColumn("host", F.lit("clash"))
    spam = [f"spam-farm.example.{x}" for x in ("com", "net", "org")]
    got = [tuple(r)[1:] for r in uf.judge(df, blocked=[*uf.BLOCKED_HOSTS, *spam]).orderBy("page_id").collect()]
    assert got == [c[1:] for c in CASES]


def test_special_names_are_blocked_by_default(spark):
    df = spark.createDataFrame([(1, "http://a.b.TEST/x"), (2, "http://test.net/x"), (3, "http://localhost"), (4, "http://example.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in uf.judge(df).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_collisions_are_confirmed():
    strings = [b"a.com/x", b"b.com/", b"z.com/"]
    shard = uf.Shard(np.frombuffer(uf.pack_shard(np.array([7, 7, 9]), strings, np.array([1, 2, 3]), np.array([2, 1, 1])), np.uint8))
    asked = ["b.com/", "a.com/x", "c.com/", "a.com/x", "z.com/", "q"]
    probe, entry = shard.find(np.array([7, 7, 7, 7, 9, 11]), np.array([1, 2, 1, 1, 1, 1]), lambda p: asked[p])
    assert sorted(zip(probe.tolist(), entry.tolist(), strict=True)) == [(0, 1), (1, 0), (4, 2)]


def test_a_table_of_hosts_in_many_shards(spark):
    hosts = spark.range(20_000).selectExpr("concat('h', id * 3, IF(id % 2 = 0, '.net', '.x.org')) AS host", "id AS page_id").union(spark.createDataFrame([(None, 1)], "host string, page_id long"))
    urls = [(k, f"http://www.h{k}.{t}/p?q") for k in range(0, 70_000, 7) for t in ("net", "x.org")]
    urls += [(None, "http://h0.net"), (None, "http://h0.net"), (1, "http://h3.x.org/" + "long/" * 100_000)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    shards, lengths = uf.publish(uf.entries_of(spark, (), hosts), 100_000)
    assert len(shards) > 5 and lengths == [0]
    listed = {f"h{k * 3}" + (".net" if k % 2 == 0 else ".x.org") for k in range(20_000)}
    got = uf.judge(df, (), hosts, 100_000).collect()
    assert len(got) == len(urls)
    assert all(r.verdict == ("block" if r.host.removeprefix("www.") in listed else "allow") for r in got)


def test_of_equal_entries_one_stays(spark):
    e = uf.entries_of(spark, [("allow", "a.com", ""), ("block", "a.com", ""), ("allow", "b.com", "")], ["b.com", "c.com", "c.com"])
    assert {(r.host, r.flags) for r in e.collect()} == {("a.com", 3), ("b.com", 2), ("c.com", 1)}


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_the_query_blocks_by_the_array(spark):
    """Hosts of a given table are blocked where no rule fits, as the SQL has it; without them nothing else would be."""
    import duckdb

    from scriptorium.llm.queries import op4_url_filter

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = sorted((tuple(r) for r in op4_url_filter(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({uf.SQL})").fetchall(), key=repr)
    plain = {r.page_id: r.verdict for r in uf.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), blocked=()).collect()}
    assert sum(v == "block" and rule is None for _, _, _, rule, v in got) > 20
    assert all(plain[i] == "allow" for i, _, _, rule, v in got if rule is None)
