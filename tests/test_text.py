"""Recovery, handwriting, rules with offsets."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import rules as rl
from scriptorium.functions import text as tx


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_recovery_joins_and_spaces(spark):
    got = one(spark, "…hand-\nwritten story.The sky is blue.", tx.recovered)
    assert "handwritten" in got and "story. The sky" in got
    row = spark.createDataFrame([("a hand-\nwritten story.The end",)], "t string").select(*(v.alias(k) for k, v in tx.repairs(F.col("t")).items())).first()
    assert row.repaired_hyphens == 1 and row.spacing_fixes == 1


def test_recovery_collapses_runs(spark):
    got = one(spark, "Is it blue?? Yes.. it is!", tx.recovered)
    assert "blue?" in got and "??" not in got and "Yes. it" in got


def test_recovery_of_blank_and_null(spark):
    assert one(spark, " \n ", tx.recovered) == ""
    assert one(spark, None, tx.recovered) == ""


def test_recovery_is_stable(spark):
    texts = ["A , b", "hand-\nmade", "\x03x  y\tz ", "a\n\n b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.recovered(F.col("t")).alias("a"))
    assert all(r.a == r.b for r in df.select("a", tx.recovered(F.col("a")).alias("b")).collect())


def test_handwriting(spark):
    assert one(spark, "The skv is YELLOV froin here", tx.handwriting) == "The sky is yellow from here"
    assert one(spark, "Ans; yes Q. 3 . why {x}", tx.handwriting) == "Ans: yes Q.3. why x"
    assert one(spark, None, tx.handwriting) == ""


def test_candidates(spark):
    got = one(spark, "the skv burns tov", tx.candidates)
    assert [(r.text, r.weight) for r in got] == [("the skv burns tov", 1.0), ("the sky burns tov", 0.92), ("the sky bums tow", 0.85)]
    assert [r.text for r in one(spark, "plain", tx.candidates)] == ["plain"]


def test_capitalized(spark):
    assert one(spark, "tHE sun", tx.capitalized) == "The sun"


def python_matches(pattern, flags, text):
    return [(m.start(), m.group(0)) for m in re.finditer(pattern, text, flags) if m.group(0)]


def test_matches_are_those_of_finditer(spark):
    texts = ["The boy road a bicycle. He road the bus.", "cannot dont über gaß isnt", "what is it\nHow now", "", "ans: yes i am i", "in sky in the sky"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [(p, re.I, "(?iU)") for p, *_ in lx.CONTEXT[:4]] + [(p, re.I, "(?iU)") for p, _ in lx.CONTRACTIONS[:6]] + [(lx.LINE_RULES[0][0], 0, "(?U)"), (lx.LINE_RULES[21][0], re.I, "(?iU)")]
    rows = df.select("t", *(rl.matches(F.col("t"), p, f).alias(f"c{k}") for k, (p, _, f) in enumerate(patterns))).collect()
    for r in rows:
        for k, (p, flag, _) in enumerate(patterns):
            assert [(m.begin, m.text) for m in r[f"c{k}"]] == python_matches(p, flag, r.t)


def sliced(text, edits):
    chars, n = list(text), len(text)
    for b, s, p in sorted(edits, key=lambda e: -e[0]):
        if 0 <= b <= s <= n:
            chars[b:s] = list(p)
    return "".join(chars)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc é", max_size=12), st.lists(st.tuples(st.integers(-1, 13), st.integers(-1, 13), st.text("XY", max_size=3)), max_size=5))
def test_applied_edits_are_slice_assignments(spark, text, edits):
    edits = list({e[0]: e for e in edits}.values())
    df = spark.createDataFrame([(text, edits)], "t string, e array<struct<begin:int,stop:int,proposed:string>>")
    assert df.select(rl.applied(F.col("t"), F.col("e"))).first()[0] == sliced(text, edits)
