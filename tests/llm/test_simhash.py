import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from scriptorium.llm import simhash as sh
from scriptorium.llm.components import components
from tests.llm import cases


def brute_print(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


@pytest.mark.parametrize("limit", [sh.LIMIT, 2])
def test_against_brute_force(spark, limit):
    rows = cases.rows()
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = sorted(((i, f"{p:016x}", least.get(x)) for (i, _), p, x in zip(rows, prints, label, strict=True)), key=repr)
    assert sorted(map(tuple, sh.near_duplicates(cases.documents(spark), limit=limit).collect()), key=repr) == want


@pytest.mark.parametrize("limit", [sh.LIMIT, 8])
def test_no_link_is_lost(spark, limit):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:12]:
        for _ in range(25):
            x = b
            for k in r.sample(range(64), r.randrange(1, 5)):
                x ^= 1 << k
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(sh.links(df, limit)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_masks_cover_the_radius():
    masks = sh.submasks((1 << 64) - 1)
    r = random.Random(1)
    for _ in range(3000):
        d = sum(1 << k for k in r.sample(range(64), 4))
        assert any(not m & d for m in masks)


def test_one_of_each(spark):
    docs = cases.documents(spark)
    kept = sh.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in sh.near_duplicates(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == groups


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (100, 90)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and got[100] == 90


def test_empty(spark):
    assert sh.near_duplicates(cases.empty(spark)).count() == 0 and sh.one_of_each(cases.empty(spark)).count() == 0


def test_buckets_across_batches_and_columns_of_any_name(spark):
    r = np.random.default_rng(5)
    fp = np.unique(r.integers(0, 1 << 12, 3000, np.uint64))
    key = np.zeros(len(fp), np.int64)
    rows = [pa.RecordBatch.from_arrays([pa.array(key), pa.array(key), pa.array(fp.view(np.int64))], names=["fixed", "key", "fp"]).slice(a, 100) for a in range(0, len(fp), 100)]
    out = [x for b in sh._link(iter(rows), 50) for x in b.to_pylist()]
    assert all(x["over"] for x in out) and sorted(x["b"] for x in out) == fp.tolist()
    out = [x for b in sh._link(iter(rows), 1 << 20) for x in b.to_pylist()]
    assert not any(x["over"] for x in out) and len(out) == len(fp) - 1  # a spanning tree: 12 bits in use
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8)], "doc_id long, text string, rid long, __rid long")
    assert [tuple(x) for x in sh.one_of_each(docs).collect()] == [(1, "a b c", 5, 6)]
