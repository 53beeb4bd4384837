import math
import random
import zlib
from collections import Counter

import pytest

from scriptorium.llm import mixing
from tests.llm import cases


def test_base_and_counts(spark):
    rows = cases.rows()
    out = {i: (t or "").encode().lower().split() for i, t in rows}
    counts, ends = Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = mixing.score(cases.documents(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = out[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0


def test_familiar_text_is_likelier_than_noise(spark):
    a, b = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    r = random.Random(99)
    noise = " ".join("".join(r.choice("qzxvjkw") for _ in range(6)) for _ in range(60))
    rows = [(k, cases.prose(random.Random(k), 60)) for k in range(60)] + [(a, cases.prose(r, 60)), (b, noise)]
    got = {x.doc_id: x.score / x.n_tokens for x in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[a] > got[b] + 1


def test_probabilities_of_short_words_sum_below_one():
    """The bit model is a distribution over byte strings that end in a blank."""
    import numpy as np

    model = mixing.Model({}, 16)
    model.open(scoring=True)
    blob = np.frombuffer(bytes(b for c in range(256) if c != 32 for b in (c, 32)) + b" ", np.uint8)
    lens = np.array([2] * 255 + [1])
    b = mixing.Batch(blob, lens, 16)
    p = np.exp(b.sum(model.log_bits(b, model.mixed(b, model.inputs(b)))))
    assert 0 < p.sum() <= 1 + 1e-6 and p[-1] == pytest.approx(1 / 256, rel=0.01)


def test_no_training_rows_and_empty(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = mixing.score(spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert got[0].base_score == pytest.approx(0.0)
    assert mixing.score(cases.empty(spark)).count() == 0


def test_large_counts_stay_skewed():
    """5000 words on one side of a bit and 50000 on the other."""
    import zlib as z

    import numpy as np

    blob = np.frombuffer(b"a ", np.uint8)
    b = mixing.Batch(blob, np.array([2]), 16)
    counts = np.zeros((1 << 16, 2), np.int32)
    counts[b.slots[0][0, 0]] = 50_000, 5000
    model = mixing.Model({0: z.compress(counts.tobytes())}, 16)
    model.open()
    first = b.slots[0][0, 0]
    assert model.inputs_without(b)[0][0, 0] == pytest.approx(np.log(5000.4 / 49_999.4), rel=1e-4)
    model.open(scoring=True)
    assert model.logits[0][first] == pytest.approx(np.log(5000.4 / 50_000.4), rel=1e-4)
    assert mixing._fitting(np.array([40, 20, 300, 3]), 100).tolist() == [40, 20, 100, 1]


def test_five_bytes_are_a_context():
    """The byte after the fifth depends on a predictor that sees all five and not the byte before them."""
    import numpy as np

    words = [b"xbcdef ", b"ybcdef ", b"xzcdef "]
    b = mixing.Batch(np.frombuffer(b"".join(words), np.uint8), np.array([7] * 3), 16)
    seen = [k[np.lexsort((np.arange(21), b.word))].reshape(3, 7, 8)[:, 6] for k in b.slots]
    assert any((k[0] == k[1]).all() and (k[0] != k[2]).any() for k in seen)


def plain_refined(tokens, p):
    """One text at a time, token by token: its words so far, then the followers of the preceding word."""
    w, worth = mixing.CACHE
    out, words, follow = [], Counter(), {}
    credit, spoken = [0.0, 0.0], [0, 0]
    for k, t in enumerate(tokens):
        now = p[t]
        led = follow.get(tokens[k - 1], Counter()) if k else Counter()
        for i, (own, all_) in enumerate([(words[t], k), (led[t], sum(led.values()))]):
            if all_:
                weight = (w * worth + credit[i]) / (worth + spoken[i])
                spoken[i] += 1
                q = own / all_
                credit[i] += w * q / (w * q + (1 - w) * now) if q else 0.0
                now = (1 - weight) * now + weight * q
        out.append(math.log10(now))
        words[t] += 1
        if k:
            follow.setdefault(tokens[k - 1], Counter())[t] += 1
    return out


def test_refinement_against_a_loop():
    import numpy as np

    r = random.Random(8)
    texts = [b" ".join(r.choice([b"a", b"b", b"c", b"dd", b"e e f"]) for _ in range(r.randrange(60))) for _ in range(12)] + [b"", b"x y x y x y x y x y"]
    lens = np.array([len(t) for t in texts])
    c = mixing.Chunk(np.frombuffer(b"".join(texts), np.uint8), lens, list(range(len(texts))), 4)
    p = np.random.default_rng(1).uniform(1e-6, 0.1, len(c.names))
    begins = np.cumsum(c.sizes) - c.sizes
    got = mixing.refined(c, np.log10(p), begins)
    for t, a, n in zip(texts, begins, c.sizes, strict=True):
        number = {w: k for k, w in enumerate(c.names)}
        assert got[a : a + n] == pytest.approx(plain_refined([number[w] for w in [*t.split(), b""]], p), rel=1e-9)


def test_word_order_matters(spark):
    """The same words, once as a repeated phrase and once shuffled."""
    words = cases.prose(random.Random(3), 12).split() * 12
    mixed = words[:]
    random.Random(4).shuffle(mixed)
    rows = [(k, cases.prose(random.Random(k), 60)) for k in range(30)] + [(100, " ".join(words)), (101, " ".join(mixed))]
    got = {x.doc_id: x.score for x in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] > got[101] + 20


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({r.doc_id: r.score for r in mixing.score(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == pytest.approx(got[1], rel=1e-9)


def test_preceding_word_is_a_context(spark):
    """Words that follow one another in the training texts, in that order and in another; no text says a word twice."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    words = list(dict.fromkeys(words))
    a, b = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = []
    for k in range(80):
        at = r.randrange(len(words))
        rows.append((k, " ".join((words[at:] + words[:at])[:30])))
    mixed = words[:30]
    r.shuffle(mixed)
    rows += [(a, " ".join(words[:30])), (b, " ".join(mixed))]
    got = {x.doc_id: x for x in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[a].base_score == pytest.approx(got[b].base_score)
    assert got[a].score > got[b].score + 5


def test_every_occurrence_is_counted():
    import numpy as np

    out = np.zeros((mixing.PREDICTORS, 2 << 16), np.int32)
    s = mixing.Stream(*mixing.coded(np.frombuffer(b"The cat the catthe", np.uint8), np.array([15, 3]), np.array([True, False])))
    assert s.blob.tobytes() == b"the cat the cat  " and s.lens.tolist() == [17]
    mixing.count(s, out, 16)
    assert (out.sum(1) == 8 * 17).all()
    one = mixing.Batch(np.frombuffer(b"the ", np.uint8), np.array([4]), 16)
    assert [out[5][p] for p in next(x for k, x in enumerate(one.pairs()) if k == 5)[0, :1]] == [5]  # five words begin, with the end


def test_weights_learn_within_a_text(monkeypatch):
    """A model without counts learns by its constants alone; a plain loop over the blocks does the same."""
    import numpy as np

    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "RATE", 0.05)
    texts = [b"abab ba  ", b"a  ", b"hello my dear hello my dear hello  "]
    s = mixing.Stream(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    model = mixing.Model({}, 16)
    model.open(scoring=True)
    want = []
    for t in texts:
        w = np.zeros((mixing.PLACES, 8))
        place = 0
        logs, token = [], 0.0
        for at in range(0, len(t), 8):
            step = np.zeros_like(w)
            for c in t[at : at + 8]:
                for j in range(8):
                    bit = c >> (7 - j) & 1
                    p = 1 / (1 + math.exp(-w[min(place, 3), j]))
                    token += math.log10(p if bit else 1 - p)
                    step[min(place, 3), j] += bit - p
                place += 1
                if c == 32:
                    logs.append(token)
                    token, place = 0.0, 0
            w += 0.05 * step
        want += logs
    assert mixing.spelled(model, s) == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(mixing, "RATE", 0.0)
    assert mixing.spelled(model, s)[-2] < want[-2] - 0.1


def short_code(texts):
    import numpy as np

    s = mixing.Stream(*mixing.coded(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])))
    words = sorted(set(s.blob.tobytes().replace(b" ", b" \0").split(b"\0")) - {b""})
    times = Counter(s.blob.tobytes().replace(b" ", b" \0").split(b"\0"))
    blob = np.frombuffer(b"".join(words), np.uint8)
    counts = mixing.pair_times(blob, np.repeat([times[w] for w in words], [len(w) for w in words]))
    assert (counts == np.bincount(s.pair, minlength=1 << 16)).all()
    return s, counts, mixing.Code.short(counts)


def test_frequent_bytes_take_few_decisions():
    """At most five a byte of prose, where its bits are eight; the paths after each byte are a whole tree."""
    import numpy as np

    _, counts, code = short_code([cases.prose(random.Random(k), 200).encode() for k in range(5)])
    assert (counts * code.length).sum() < 5 * counts.sum()
    assert (np.ldexp(1.0, -code.length.astype(int)).reshape(256, 256).sum(1) == 1).all()
    for first in (32, ord("e"), 200):
        paths = {(int(n), int(p)) for n, p in zip(code.length[first << 8 :][:256], code.path[first << 8 :][:256], strict=True)}
        assert len(paths) == 256 and not any((m, p >> (n - m)) in paths for n, p in paths for m in range(1, n))


def test_short_codes_are_counted_like_a_loop():
    import numpy as np

    s, _, code = short_code([cases.prose(random.Random(k % 3), 60).encode() for k in range(6)] + [b"", "gaß éé".encode()])
    out, want = (np.zeros((mixing.PREDICTORS, 2 << 16), np.int32) for _ in range(2))
    mixing.count(s, out, 16, code)
    for at in range(len(s.blob)):
        b = mixing.Batch.of(s, np.arange(at, at + 1), s.place[at : at + 1], 16, code)
        for x, pairs in zip(want, b.pairs(), strict=True):
            for p in pairs.tolist():
                x[p] += 1
    assert (out == want).all()


def test_short_codes_spell_a_distribution(monkeypatch):
    """Of one byte and a blank, after any counts; and sorting by weights changes nothing."""
    import numpy as np

    s, _, code = short_code([cases.prose(random.Random(k), 90).encode() for k in range(4)] + [b"a b"])
    out = np.zeros((mixing.PREDICTORS, 2 << 16), np.int32)
    mixing.count(s, out, 16, code)
    model = mixing.Model({k: zlib.compress(x.tobytes()) for k, x in enumerate(out)}, 16, code)
    model.open(scoring=True)
    short = mixing.Stream(np.frombuffer(b"".join(bytes((c, 32, 32)) for c in range(256) if c != 32) + b" ", np.uint8), np.array([3] * 255 + [1]))
    first = np.append(np.arange(255) * 3, 765)  # each byte there is, at a text's beginning
    b = mixing.Batch.of(short, first, short.place[first], 16, code)
    chance = np.bincount(b.own, model.log_bits(b, model.mixed(b, model.inputs(b))), minlength=256)
    assert np.exp(chance).sum() == pytest.approx(1, rel=1e-5)
    monkeypatch.setattr(mixing, "RATE", 0.0)
    b = mixing.Batch.of(s, np.arange(len(s.blob)), s.place, 16, code)
    assert mixing.spelled(model, s) == pytest.approx(b.sum(model.log_bits(b, model.mixed(b, model.inputs(b)))) / math.log(10), rel=1e-4)
