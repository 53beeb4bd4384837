import pytest
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import rules as rl
from scriptorium.operators import proofreading as pr
from scriptorium.operators import profiles

CASES = [
    ("The boy road his bicycle to school.", "The boy rode his bicycle to school."),
    ("She red the book yesterday afternoon.", "She read the book yesterday afternoon."),
    ("I sea the blue sky and rainbow.", "I see the blue sky and rainbow."),
    ("Their are seven colors in the rainbow.", "There are seven colors in the rainbow."),
    ("The son is shining brightly.", "The sun is shining brightly."),
    ("I cat the paper with scissors.", "I cut the paper with scissors."),
    ("The yellov sun is peepina through clouds.", "The yellow sun is peeping through clouds."),
    ("The implomentation of froin document is ready.", "The implementation of from document is ready."),
    ("", ""),
]


@pytest.fixture(scope="module")
def analyzed(spark):
    docs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(CASES)], "doc_id long, text string, want string")
    out, found = pr.analyze(docs)
    return out.collect(), found.collect()


def test_corrected_texts(analyzed):
    for r in analyzed[0]:
        assert r.corrected_text == r.want


def test_offsets_hold_the_original(analyzed):
    texts = {r.doc_id: r.target_text for r in analyzed[0]}
    for s in analyzed[1]:
        if s.offset_space == "target":
            assert texts[s.doc_id][s.begin : s.stop] == s.original


def test_accepting_only_the_first(spark, analyzed):
    docs = spark.createDataFrame([(7, CASES[7][0])], "doc_id long, text string")
    first = [s for s in analyzed[1] if s.doc_id == 7 and s.suggestion_id == "sug_1"]
    accepted = spark.createDataFrame([(s.doc_id, s.begin, s.stop, s.proposed) for s in first], "doc_id long, begin int, stop int, proposed string")
    got = pr.apply(docs, "text", accepted).first().corrected_text
    assert "implementation" in got and "froin" in got


def test_punctuation(spark):
    docs = spark.createDataFrame([(0, "What is the color of the sky\nHowever the dont stop\nThe students book is here\nthe sky turned blue Sun is up\n# What is a heading")], "doc_id long, text string")
    got = {(s.original, s.proposed) for s in pr.punctuation(docs, "text", ["doc_id"]).collect()}
    assert {("", "?"), ("However t", "However, t"), ("dont", "don't"), ("students", "student's"), ("blue Sun is", "blue. Sun is")} == got


def test_candidates_metrics_and_sets(spark):
    c = spark.createDataFrame([(0, "cat", 4, 7, [("car", 0.92)]), (0, "a", 5, 5, [("b", 0.9)]), (0, "Dog", 8, 11, [("dog", 0.9)])], "doc_id long, original string, start_offset int, end_offset int, candidates array<struct<text:string,confidence:double>>")
    docs = spark.createDataFrame([(0, "The cat sat on the mat.")], "doc_id long, text string")
    found = pr.suggest(docs, candidates=c)
    assert [(r.proposed, r.begin) for r in found.collect()] == [("car", 4)]
    assert pr.metrics(found).first().total_suggestions == 1
    assert pr.pending(found, found.select("doc_id", "suggestion_id")).count() == 0
    assert pr.pending(found, found.limit(0).select("doc_id", "suggestion_id"), search="CAR").count() == 1
    assert pr.accept_confident(found, found.limit(0)).count() == 1
    df = spark.createDataFrame([(["a"], ["b"], ["b"], ["a"])], "acc array<string>, rej array<string>, x array<string>, y array<string>")
    a, r = pr.decide(F.col("acc"), F.col("rej"), F.col("x"), F.col("y"))
    row = df.select(a.alias("a"), r.alias("r")).first()
    assert (row.a, row.r) == (["b"], ["a"])
    scores = spark.createDataFrame([(0,), (1,), (3,), (40,)], "n int").select(pr.quality_score(F.col("n")).alias("s"))
    assert [r.s for r in scores.collect()] == [100, 97, 90, 50]


def test_spelling_needs_a_vocabulary(spark):
    docs = spark.createDataFrame([(0, "the rainbw and the Rainbw shines\nrainbow")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("rainbow", 9), ("shines", 3), ("rainbws", 1)], "word string, frequency int")
    got = pr.spelling(docs, "text", ["doc_id"], vocabulary).collect()
    assert [(r.original, r.proposed, r.begin, r.line) for r in got] == [("rainbw", "rainbow", 4, 1)]


def test_feedback_counts(spark):
    e = spark.createDataFrame([("u 1", "road", "rode"), ("u 1", " Road ", "rode"), ("u 1", "same", "same"), (None, "", "x")], "user_id string, original string, accepted string")
    s = {r.user_id: (r.documents_processed, r.corrections_accepted) for r in profiles.summary(e).collect()}
    assert s == {"u_1": (3, 2), "default_student": (1, 0)}
    w = {(r["from"], r["to"]): r.weight for r in profiles.confusions(e).collect()}
    assert w == {("a", "d"): pytest.approx(0.30), ("d", "e"): pytest.approx(0.30)}
    b = profiles.boosts(spark.createDataFrame([("u_1", "Rode"), ("u_1", "road"), ("u_1", "other")], "user_id string, text string"), profiles.errors(e), profiles.words(e))
    assert {r.text: r.boost for r in b.collect()} == {"Rode": 0.06, "road": 0.10, "other": 0.0}
    assert profiles.export(e).count() == 2


def test_stems_are_in_every_match(spark):
    """A rule's stem never hides a match, whatever letters without plain case stand in the text."""
    lines = ["we ſees a rainbow", "ı've made", "İll", "the boy road his bike", "sKv", "make sentence of own", "cannot can not dont it's its a", "what ?", "a : b"]
    tables = {"context": lx.CONTEXT, "line": lx.LINE_RULES, "contraction": lx.CONTRACTIONS}
    df = spark.createDataFrame([(x,) for x in lines], "body string")
    for rules in tables.values():
        own = [(k, r[0], r[1], "c", 0.9, "(?iU)") for k, r in enumerate(rules)]
        for r in own:
            assert df.where(F.col("body").rlike(r[5] + r[1]) & ~rl.may_match(F.col("body"), [r])).count() == 0, r
    assert rl.stem(r"\b(do)nt\b") == "dont" and rl.stem(r"\b(can|may)\s+sea\b(?=\s+a)") == "sea" and rl.stem(r"^(which|where)\b") == "" and rl.stem(r"of (?:the )?platform") == "platform"


def test_boosts_do_not_depend_on_the_order_of_rows(spark):
    def shuffled(batches):
        import random

        import pyarrow as pa

        rows = [(f"u{k % 40}", f"w{k}") for k in range(400)]
        random.SystemRandom().shuffle(rows)  # as a shuffle may deliver them, each time anew
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["user_id", "text"])

    asked = spark.range(1).coalesce(1).mapInArrow(shuffled, "user_id string, text string")
    errors = spark.createDataFrame([(f"u{k % 40}", f"w{k}", 1 + k % 4) for k in range(0, 400, 3)], "user_id string, text string, n long")
    words = spark.createDataFrame([(f"u{k % 40}", f"w{k}", 1 + k % 4) for k in range(0, 400, 5)], "user_id string, word string, n long")
    got = {r.text: r.boost for r in profiles.boosts(asked, errors, words).collect()}
    assert got == {f"w{k}": round((k % 3 == 0) * (1 + k % 4) * 0.05 + (k % 5 == 0) * min(0.12, (1 + k % 4) * 0.03), 6) if (k % 3 == 0) * (1 + k % 4) * 0.05 + (k % 5 == 0) * min(0.12, (1 + k % 4) * 0.03) < 0.25 else 0.25 for k in range(400)}
