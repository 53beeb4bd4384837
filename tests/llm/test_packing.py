import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing
from tests.llm import cases


def check_bins(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_bins(spark, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(cases.documents(spark), capacity=capacity).collect()
    want = Counter()
    for i, t in cases.rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_bins(got, capacity)
    assert n <= 1.1 * -(-sum(r.length for r in got) // capacity) + 1


def test_special_strings_and_marks():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    own = packing.WordTokens(packing.default_tokenizer(), cache=50)
    texts = ["a <|endoftext|> b <|ENDOFTEXT|>", "it's, don't!! stop...now éa, 3.5, x;y: (z) İstanbul. ÉCOLE", "a\u00a0b\u2003c \u0301d e\u0301f, ", "", "…!? “q”, a1, 1a."]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.ids([t.encode() for t in texts])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), packing.WordTokens(path)
    texts = ["A <|endoftext|> b", "it's, don't!! stop...now  two\n\nlines", " lead", "", "ÉCOLE"]
    assert not own.by_word and packing.WordTokens(packing.default_tokenizer()).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_covers_each_piece_once(counts):
    runs = packing.plan(counts, 30)
    seen, bins = Counter(), defaultdict(list)
    for length, rank, n, at, each, offset in runs:
        for k in range(n):
            seen[length, rank + k] += 1
            bins[at + k // each].append((offset + k % each * length, length))
    assert seen == Counter({(k, r): 1 for k, n in counts.items() for r in range(n)})
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 30
    assert sorted(bins) == list(range(len(bins)))


def test_large_items_pair_at_most_twice():
    for counts in ({20: 2, 10: 2}, {11: 3}):
        assert max(r[3] + -(-r[2] // r[4]) for r in packing.plan(counts, 30)) == 2


def test_empty(spark):
    assert packing.pack(cases.empty(spark)).count() == 0
