import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import tagging as tg


def total(model, codes, tags):
    s = model.start[tags[0]] + model.emit[tags[0], codes[0]]
    for k in range(1, len(codes)):
        s += model.after[tags[k - 1], tags[k]] + model.emit[tags[k], codes[k]]
    return s


def exhaustive(model, codes):
    """The best tags of all, of equal ones the lowest from the end."""
    every = itertools.product(range(len(tg.TAGS)), repeat=len(codes))
    return min(every, key=lambda tags: (-total(model, codes, tags), tuple(reversed(tags))))


def some_model(seed, levels=None):
    r = np.random.default_rng(seed)
    shape = len(tg.TAGS), len(tg.classes())
    draw = lambda *s: r.integers(-levels, 0, s) if levels else r.integers(-9000, 0, s)
    return tg.Model(draw(shape[0]), draw(shape[0], shape[0]), draw(*shape))


@pytest.mark.parametrize("levels", [None, 2])
def test_viterbi_is_the_best_of_all(levels):
    r = random.Random(4)
    for seed in range(6):
        model = some_model(seed, levels)
        codes = [np.array([r.randrange(len(tg.classes())) for _ in range(n)]) for n in (1, 2, 3, 4, 4, 1)]
        for c, got in zip(codes, tg.viterbi(model, codes), strict=True):
            assert tuple(got) == exhaustive(model, c)


def test_prior_on_plain_sentences():
    def tags(text):
        (s,) = tg.sentences(text)
        return [tg.TAGS[t] for t in tg.viterbi(tg.prior(), tg._codes(text))[0]]

    assert tags("The happy student quickly walked to the school.") == ["determiner", "adjective", "noun", "adverb", "verb", "preposition", "determiner", "noun", "other"]
    assert tags("She likes that book")[:3] == ["pronoun", "verb", "determiner"]
    # the same word under two tags
    assert tags("We walk in the park")[1] == "verb"
    assert tags("The walk was long")[1] == "noun"


def brute_expected(p, codes):
    start, after, emit = p
    first, pairs, seen = np.zeros(len(start)), np.zeros(after.shape), np.zeros(emit.shape)
    for c in codes:
        weights = {}
        for tags in itertools.product(range(len(start)), repeat=len(c)):
            w = start[tags[0]] * emit[tags[0], c[0]]
            for k in range(1, len(c)):
                w *= after[tags[k - 1], tags[k]] * emit[tags[k], c[k]]
            if w:
                weights[tags] = w
        z = sum(weights.values())
        for tags, w in weights.items():
            first[tags[0]] += w / z
            for k, t in enumerate(tags):
                seen[t, c[k]] += w / z
                if k:
                    pairs[tags[k - 1], t] += w / z
    return first, pairs, seen


def test_expected_counts_are_those_of_all_taggings():
    p = tg.prior_probabilities()
    texts = ["She walks.", "That old dog", "to be", "Yes", "before 3 dogs"]
    codes = [c for t in texts for c in tg._codes(t)]
    for got, want in zip(tg.expected(p, codes), brute_expected(p, codes), strict=True):
        assert np.allclose(got / tg.UNIT, want, atol=1e-3)


def likelihood(p, codes):
    out = 0.0
    for c in codes:
        a = p[0] * p[2][:, c[0]]
        for x in c[1:]:
            a = (a @ p[1]) * p[2][:, x]
        out += np.log(a.sum())
    return out


def test_learning_raises_the_likelihood_and_not_by_partitions(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("the a dogs walking quickly sees nice house to of she and big is 3 .".split()) for _ in range(r.randrange(1, 40))) for _ in range(200)] + [None, "", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    models = [tg.learn(df.repartition(n), rounds=2) for n in (1, 5)]
    assert all((x == y).all() for x, y in zip(*(m.__dict__.values() for m in models), strict=True))
    codes = [c for t in texts for c in tg._codes(t)]
    p = [np.where(x > tg.NEVER, np.exp(x / 1000), 0) for x in models[0].__dict__.values()]
    assert likelihood(p, codes) > likelihood(tg.prior_probabilities(), codes)
    assert ((models[0].emit > tg.NEVER) == (tg.prior().emit > tg.NEVER)).all()
    none = tg.learn(df.where("text is null"), rounds=1)
    assert all((x == y).all() for x, y in zip(none.__dict__.values(), tg.prior().__dict__.values(), strict=True))


def test_in_context(spark):
    rows = [(1, "walk", "We walk in the park."), (2, "Walk,", "The walk was long."), (3, "quickly", "nothing here"), (4, "12", "12 dogs"), (5, None, None), (6, "the", "The end"), (7, "élan", "élan vital")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id long, w string, s string, pos int").withColumn("a.b", F.lit(1)).drop("pos").repartition(2)
    got = {r.id: (r.pos, r.pos_confidence) for r in tg.in_context(df, F.col("w"), F.col("s")).collect()}
    assert got[1] == ("verb", 0.98) and got[2] == ("noun", 0.98) and got[6] == ("determiner", 0.85)
    assert got[3] == ("adverb", 0.75) and got[4] == ("grammar", 0.0) and got[5] == ("grammar", 0.0)
    assert got[7][1] == 0.98
    assert tg.in_context(df.limit(0), F.col("w"), F.col("s")).collect() == []


def test_tokens_of_nulls_blanks_and_long_sentences(spark):
    long = "word " * 30_000
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, long), (4, "A b. C!"), (4, "A b. C!")], "id long, text string")
    got = tg.tokens(df, ["id"]).collect()
    assert sorted({r.id for r in got}) == [3, 4]
    assert sum(r.id == 3 for r in got) == 30_000
    assert [(r.sentence, r.place, r.token) for r in got if r.id == 4] == [(1, 1, "A"), (1, 2, "b"), (1, 3, "."), (2, 1, "C"), (2, 2, "!")] * 2


def test_describe_by_the_tag_in_context(spark):
    from scriptorium.operators import vocabulary as vo

    df = spark.createDataFrame([(1, "walk", "We walk in the park."), (2, "walk", "The walk was long.")], "id long, proposed string, corrected_sentence string").withColumns({"category": F.lit("Spelling Correction"), "explanation": F.lit("")})
    senses = spark.createDataFrame([("walk", "verb", 0, "walk.verb.01", "To go on foot.", "", "", 1), ("walk", "noun", 0, "walk.noun.01", "A way on foot.", "", "", 1)], "word string, pos string, ord int, sense_id string, definition string, child_def string, example string, priority int")
    none = F.array().cast("array<string>")
    senses = senses.withColumns({"synonyms": none, "antonyms": none, "source": F.lit("x")})
    got = {r.id: r.sense for r in vo.describe(df, ["id"], senses, tagger=tg.in_context).collect()}
    assert got == {1: "walk.verb.01", 2: "walk.noun.01"}
    plain = {r.id: r.sense for r in vo.describe(df, ["id"], senses).collect()}
    assert plain == {1: "walk.noun.01", 2: "walk.noun.01"}


def test_texts_are_tagged_many_at_once(monkeypatch):
    calls, viterbi = [], tg.viterbi
    monkeypatch.setattr(tg, "viterbi", lambda model, codes: calls.append(len(codes)) or viterbi(model, codes))
    texts = [f"The {a} of the house runs. It is {b}!" for a in ("dog", "cat", "garden") for b in ("big", "in")]
    asked = {t: {"the": None, "of": None, "runs": None, "in": None, "": None, "zebra": None} for t in texts}
    tg._first_tags(tg.prior(), asked)
    assert calls == [12]
    for t in texts:
        first = {}
        for s in tg.sentences(t):
            for token, k in zip(s, viterbi(tg.prior(), [np.array([tg.class_of(x) for x in s])])[0], strict=True):
                first.setdefault(tg.letters(token), tg.TAGS[k])
        assert asked[t] == {w: first.get(w) if w else None for w in asked[t]}
