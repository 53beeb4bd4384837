import re
from collections import Counter

import numpy as np

from scriptorium.llm import quality
from tests.llm import cases


def base(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    c, hit, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit)


def test_measures(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(cases.documents(spark)).collect())
    assert got == Counter((i, *base(t)) for i, t in cases.rows())


def test_verdicts(spark):
    rows = {(r.doc_id, r.n_words): r for r in quality.judge(cases.documents(spark)).collect()}
    for r in rows.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.p_quality <= 1
    by = {r.doc_id: r for r in rows.values()}
    kept = [by[k * 3 + 1].kept for k in range(30)]
    assert all(kept)
    noisy = [k for k, t in enumerate(cases.texts()) if t and "###$$%" in t][0]
    assert not by[noisy * 3 + 1].kept and not by[noisy * 3 + 1].base_failed


def test_keep_returns_the_rows(spark):
    docs = cases.documents(spark)
    got = quality.keep(docs)
    assert got.columns == docs.columns
    kept = Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert Counter(r.doc_id for r in got.collect()) == kept


def test_estimates_follow_agreement():
    good, junk = sum(2 * 3**k for k in range(8)), sum(2 * 3**k for k in range(1, 8))
    p, accuracy = quality.estimate(np.array([good, junk]), np.array([900.0, 60.0]))
    assert p[0] > 0.9 and p[1] < 0.5 and accuracy[0] > 0.9
    assert len(quality.estimate(np.zeros(0, int), np.zeros(0))[0]) == 0


def test_a_noisy_rule_is_outvoted():
    """Two rules know junk well, a third calls every fourth good document bad: all-must-pass would lose those, the posterior keeps them."""
    def pattern(**bad):
        return sum((0 if rule in bad else 2) * 3**k for k, rule in enumerate(quality.RULES))

    good, noisy, junk = pattern(), pattern(capitals=1), pattern(symbols=1, repeats=1)
    noisy_junk = pattern(symbols=1, repeats=1, capitals=1)
    p, accuracy = quality.estimate(np.array([good, noisy, junk, noisy_junk]), np.array([6000.0, 2000.0, 900.0, 300.0]))
    assert p[0] > 0.9 and p[1] > 0.5 and p[2] < 0.5 and p[3] < 0.5
    assert accuracy[quality.RULES.index("capitals")] < min(accuracy[quality.RULES.index(r)] for r in ("symbols", "repeats"))


def test_the_start_reads_a_single_bad_vote_as_junk():
    """Kinds of junk that only one rule sees each stay junk, as the docstring says, though a majority start would call them good."""
    rows = [sum((0 if j == k else 2) * 3**j for j in range(8)) for k in range(8)]
    p, _ = quality.estimate(np.array([sum(2 * 3**j for j in range(8)), *rows]), np.array([9000.0] + [60.0] * 8))
    assert p[0] >= 0.5 and (p[1:] < 0.5).all()  # the verdicts: a good document has nothing that only good ones have


def test_a_noisy_rule_is_outvoted_by_the_query(spark):
    """The same over texts: a third of the good documents have many exclamation marks and nothing else, junk is known by symbols and sentences."""
    import random

    r = random.Random(3)
    text = lambda marks: " ".join(r.choice(cases.WORDS) + str(r.randrange(4000)) + (("!!" if k % 5 < 2 else "") if marks else "." if k % 9 == 8 else "") for k in range(80))
    junk = lambda: " ".join(["##$$ %% ab"] * 9 + [r.choice(cases.WORDS) + f"#{r.randrange(900)}" for _ in range(70)])
    rows = [(k, text(k % 3 == 0)) for k in range(7200)] + [(9000 + k, junk()) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by = {x.doc_id: x for x in quality.judge(df).collect()}
    votes = [(quality.measure(t.encode())[5] // 3 ** quality.RULES.index("marks")) % 3 for _, t in rows[:7200]]
    assert sum(v == 0 for v in votes) == 2400
    assert not any(x.base_failed for x in by.values())
    assert all(by[k].kept for k in range(7200)) and not any(by[9000 + k].kept for k in range(900))
    own = {x.rule: x.accuracy for x in quality.accuracies(df).collect()}
    assert own["marks"] < 0.8 < own["symbols"] and set(own) == set(quality.RULES)


def test_very_long_and_clashing(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "x"), (2, " ".join(f"w{k}." if k % 9 == 0 else f"w{k}" for k in range(200_000)), "y"), (None, None, "z")], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[1].base_failed and got[2].n_words == 200_000 and not got[2].base_failed and got[None].n_words == 0
    assert quality.keep(docs).columns == docs.columns


def test_empty(spark):
    assert quality.judge(cases.empty(spark)).count() == 0 and quality.keep(cases.empty(spark)).count() == 0
