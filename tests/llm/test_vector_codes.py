import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, width string, code int"


def loops(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) by full searches in plain Python."""
    kept = [(i, [math.floor(v * 4096) for v in np.float32(x).astype(float)], label) for i, x, label in rows if x and None not in x and all(map(math.isfinite, x)) and len(x) % parts == 0]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(parts)]
    ids = {}
    for i, x, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ids.setdefault(i, x)
    book = [[cut(x)[p] for x in list(ids.values())[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    near = lambda p, x: min((dist(x, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, x, _ in kept:
                got[near(p, cut(x)[p])[1]].append(cut(x)[p])
            for k, own in got.items():
                book[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, [near(p, x) for p, x in enumerate(cut(v))], label) for i, v, label in kept]
    by_label = Counter()
    for _, n, label in found:
        by_label[label] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), by_label[label], sha) for i, n, label in found]


def table(spark, rows):
    return spark.createDataFrame([(i, x, label, "w", 3) for i, x, label in rows], SCHEMA).repartition(3)


def vectors(seed, n, dims=64, grid=None):
    r = random.Random(seed)
    draw = (lambda: r.choice(grid)) if grid else (lambda: r.gauss(0, 0.2))
    return [(i * 3, [draw() for _ in range(dims)], r.choice([None, 0, 1, 2])) for i in range(n)]


HARD = [
    (7, None, 1), (8, [None] * 64, 1), (9, [float("nan")] + [0.0] * 63, 1), (10, [float("inf")] * 64, 2), (11, [float("-inf")] * 64, 2), (12, [], 1), (13, [0.1] * 63, 1), (14, [0.1] * 8, 0),
    (None, [0.25] * 64, None), (None, [0.5] * 64, 4), (21, [0.0] * 64, 1), (21, [-0.1] * 64, 1), (21, [-0.1] * 64, 1),
]


@pytest.mark.parametrize("rows", [vectors(1, 60), vectors(2, 80, grid=(0.0, 0.25, -0.25)), vectors(3, 9), vectors(4, 30) * 2, [(i, [0.5] * 64, 1) for i in range(40)]], ids=["plain", "ties", "few", "repeated", "equal"])
def test_against_full_searches(spark, rows):
    got = Counter(map(tuple, vector_codes.coded(table(spark, rows)).collect()))
    assert got == Counter(loops(rows))


def test_hard_rows(spark):
    rows = vectors(5, 40) + HARD
    want = loops([r for r in rows if r[1] is None or len(r[1]) in (0, 64)])
    assert Counter(map(tuple, vector_codes.coded(table(spark, rows)).collect())) == Counter(want)


@pytest.mark.parametrize("size", [3e4, 1e12, 3e38])
def test_large_components(spark, size):
    rows = [(i, [v * size for v in x], label) for i, x, label in vectors(6, 40, grid=(-1.0, 0.125, 0.5, 0.99))]
    got = {r.vec_id: r for r in vector_codes.coded(table(spark, rows)).collect()}
    for i, code, error, label_error, sha in loops(rows):
        r = got[i]
        assert (r.code, r.codebooks_sha256) == (code, sha)
        assert r.error == (error if error < 1 << 63 else None)
        whole = all(e < 1 << 63 for _, _, e, t, _ in loops(rows) if t == label_error)
        assert r.label_error == (label_error if whole and label_error < 1 << 63 else None)


def test_empty(spark):
    assert vector_codes.coded(table(spark, []).where("false")).collect() == []
    assert vector_codes.coded(table(spark, [(1, None, 2), (2, [None] * 8, 1)])).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 6, 8, 16])
@pytest.mark.parametrize("kind", [np.int64, object])
def test_bounds_never_pass_the_distance(width, kind):
    r = np.random.default_rng(width)
    for spread in (1, 3, 1000, 1 << 26):
        x, e = (r.integers(-spread, spread + 1, (n, width)).astype(kind) for n in (50, 16))
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        for blocks in vector_codes.levels(width):
            (s, q), (t, u) = vector_codes.summary(x, blocks), vector_codes.summary(e, blocks)
            assert (vector_codes.bounds(s[:, None], q[:, None], t[None], u[None], width // blocks) <= d).all()
        best, dist, _ = vector_codes.nearest(x, e)
        assert (best == np.argmin(d, 1)).all() and (dist == d.min(1)).all()


def test_bounds_spare_distances():
    r = np.random.default_rng(0)
    x = np.repeat(r.integers(-3000, 3000, (400, 1)), 8, 1) + r.integers(-60, 60, (400, 8))
    assert vector_codes.nearest(x, x[:16])[2] < 400 * 16 // 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=12), st.integers(1, 6))
def test_ties_go_to_the_lower_index(rows, k):
    x = np.array(rows, np.int64)
    e = x[:k]
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    best, dist, _ = vector_codes.nearest(x, e)
    assert best.tolist() == d.argmin(1).tolist() and dist.tolist() == d.min(1).tolist()


def test_decoded_gives_the_error(spark):
    rows = vectors(8, 50)
    codes, book = vector_codes.compress(table(spark, rows))
    ints = {i: [math.floor(v * 4096) for v in np.float32(x).astype(float)] for i, x, _ in rows}
    for r in vector_codes.decoded(codes, book).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.ints, ints[r.vec_id], strict=True)) == r.error


def test_sql_gives_the_same_rows(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = Counter(map(tuple, vector_codes.coded(spark.read.parquet(path)).collect()))
    assert got == Counter(con.sql(vector_codes.sql()).fetchall())


def test_dotted_and_clashing_columns(spark):
    rows = vectors(9, 20)
    odd = table(spark, rows).withColumn("a.b", F.lit(1)).withColumn("vector", F.lit("x")).withColumn("error", F.lit(2))
    assert Counter(map(tuple, vector_codes.coded(odd).collect())) == Counter(loops(rows))
