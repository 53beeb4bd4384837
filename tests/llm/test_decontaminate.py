import math
import random

import pytest

from scriptorium.llm import decontaminate as dc
from tests.llm import cases


def shingles(t, w):
    return {tuple(t[i : i + w]) for i in range(len(t) - w + 1)}


def brute(docs, items):
    out = []
    for d, text in docs:
        words = (text or "").encode().lower().split()
        for i, item in items:
            own = (item or "").encode().lower().split()
            if own:
                w = min(5, len(own))
                s = shingles(own, w)
                n = len(s & shingles(words, w))
                if n >= math.ceil(0.8 * len(s) - 1e-9):
                    out.append((d, i, len(s), n, n / len(s)))
    return sorted(out, key=repr)


def items(docs):
    r = random.Random(4)
    out = [(k, cases.prose(r, 30)) for k in range(6)]
    words = docs[2][1].split()
    out += [(10, " ".join(words[5:40])), (11, " ".join(words[5:20] + ["zz"] + words[21:45])), (12, "two THREE"), (13, None), (14, ""), (15, " ".join(words[10:14]).upper()), (10, " ".join(words[5:40]))]
    changed = words[0:40]
    changed[20] = "qq"
    out.append((16, " ".join(changed)))
    for k in range(4, 37, 8):
        changed[k] = "rr"
    return [*out, (17, " ".join(changed))]


@pytest.mark.parametrize("block", [32 << 20, 500])
def test_against_brute_force(spark, block):
    docs = cases.rows()
    bench = items(docs)
    df = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, dc.contained(cases.documents(spark), df, block_bytes=block).collect()), key=repr)
    assert got == brute(docs, bench)
    assert len(got) > 4


def test_clean_keeps_the_others(spark):
    docs, bench = cases.rows(), items(cases.rows())
    df = spark.createDataFrame(bench, "item_id long, text string")
    leaks = {r[0] for r in brute(docs, bench)}
    got = dc.clean(cases.documents(spark), df)
    assert got.columns == cases.documents(spark).columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((i for i, _ in docs if i not in leaks), key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contained(cases.documents(spark), none).count() == 0
    assert dc.contained(cases.empty(spark), none).count() == 0
    assert dc.clean(cases.documents(spark), none).count() == len(cases.rows())
