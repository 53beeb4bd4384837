import hashlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import suffix_dedup as sd
from tests.llm import cases


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in data for p in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) == 1))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [400, 300])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, length):
    got = sorted(map(tuple, sd.remove_repeats(cases.documents(spark, seed), length).collect()), key=repr)
    assert got == brute(cases.rows(seed), length)
    assert any(r[2] for r in got)


def test_kept_texts(spark):
    kept = {r.doc_id: r.kept for r in sd.remove_repeats(cases.documents(spark), text=True).collect()}
    assert hashlib.sha256(bytes(kept[1])).hexdigest() == [r for r in brute(cases.rows(), 400) if r[0] == 1][0][4]


def test_difference_set():
    v, d = sd.difference_set()
    assert v == 183 and len(d) == 14 and {(a - b) % v for a in d for b in d} == set(range(v))


def test_empty_table_and_short_length(spark):
    assert sd.remove_repeats(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(cases.documents(spark), 100)
