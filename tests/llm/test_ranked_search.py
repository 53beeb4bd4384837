import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import common, ranked_search
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def loops(docs, items, k=10):
    """(item_id, rank, doc_id, score) over all documents, term by term."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out.extend((item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1))
    return out


def items():
    own = cases.texts()
    return [(1, own[0]), (2, own[3][:200]), (2, own[3][:200]), (3, None), (4, ""), (5, "?!  \n"), (6, "walk1 WALK1 stone2 nowhere"), (7, "über gaß éé"), (8, "spam"), (None, own[12]), (9, "zzz"), (10, " ".join(own[:20]))]


def tables(spark, docs, queries):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, term string, rank int, score int").withColumn("a.b", F.lit(1)).repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, row int").withColumn("a.b", F.lit(1))
    return d, q


@pytest.mark.parametrize("k", [1, 3, 10])
def test_against_loops(spark, k):
    d, q = tables(spark, cases.rows(), items())
    assert Counter(map(tuple, ranked_search.search(d, q, k).collect())) == Counter(loops(cases.rows(), items(), k))


def test_small_rows_and_blocks(spark):
    d, q = tables(spark, cases.rows(2), items())
    index = ranked_search.Index.write(d, common.scratch(spark, "index"), row_bytes=3000)
    assert index.rows.count() > 5
    got = ranked_search.Index(spark, index.path).search(q, block_bytes=4000)
    assert Counter(map(tuple, got.collect())) == Counter(loops(cases.rows(2), items()))


def test_many_equal_scores(spark):
    """Copies beyond the rank limit, and documents whose bounds are all alike."""
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(i, f"other text {i}") for i in range(100, 140)] + [(None, "same words here")] * 3
    queries = [(1, "same"), (2, "other 117"), (3, "same other")]
    d, q = tables(spark, docs, queries)
    assert Counter(map(tuple, ranked_search.search(d, q).collect())) == Counter(loops(docs, queries))


def test_empty(spark):
    d, q = tables(spark, cases.rows(), items())
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for docs, queries in ((d.limit(0), q), (d, q.limit(0)), (none, q), (d, none.withColumnRenamed("doc_id", "item_id"))):
        assert ranked_search.search(docs, queries).collect() == []


def test_a_long_text_is_read_in_parts(monkeypatch):
    text = ("Wörd one-two  3x\n" * 500).encode()
    want = terms(text.decode())
    for part in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(ranked_search, "PART", part)
        assert [w.decode() for p in ranked_search.terms(text) for w in p] == want


def test_very_long_document(spark):
    docs = [(1, "needle " + "hay stack " * 150_000), (2, "needle in hay"), (3, "x" * 1_000_000)]
    queries = [(1, "needle hay"), (2, "x" * 1_000_000)]
    d, q = tables(spark, docs, queries)
    assert Counter(map(tuple, ranked_search.search(d, q).collect())) == Counter(loops(docs, queries))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1 << 31), st.integers(10, 1 << 40)), min_size=1, max_size=20))
def test_bytes_bound_impacts(pairs):
    tf, m = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    f = ranked_search.impacts(tf, m)
    byte = -(-f // ranked_search.STEP)
    assert (byte <= 255).all() and (byte * ranked_search.STEP >= f).all()
    assert (np.where(byte > 0, (byte - 1) * ranked_search.STEP + 1, 0) <= f).all()


def test_measures_past_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert ranked_search.measures(n, 10**11, 10**14).tolist() == [10, 10 + 90 * 10**20 // 10**14]


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = ranked_search.search(*(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark")))
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(ranked_search.SQL).fetchall())
