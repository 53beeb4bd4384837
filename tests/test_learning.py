import pytest
from pyspark.sql import functions as F

from scriptorium.operators import cards as dk
from scriptorium.operators import evaluation as ev
from scriptorium.operators import structure as st
from scriptorium.operators import vocabulary as vo
from scriptorium.plans import learning

SCHEMA = "doc_id long, ord long, original string, proposed string, category string, explanation string, confidence double, begin int, stop int"


def build(spark, text, rows):
    docs = spark.createDataFrame([(0, text, "T")], "doc_id long, text string, title string")
    return dk.build_cards(docs, spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], SCHEMA), ["doc_id"])


def test_styles(spark):
    rows = [(0, 1, "road", "rode", "Contextual Substitution", ""), (0, 2, "skv", "sky", "Character Confusion", ""), (0, 3, "dont", "don't", "Punctuation Correction", "")]
    got = dk.opportunities(spark.createDataFrame(rows, "doc_id long, ord int, original string, proposed string, category string, explanation string").withColumn("confidence", F.lit(0.9)), ["doc_id"])
    assert {r.card_style for r in got.collect()} == {"vocabulary", "spelling", "punctuation_practice"}


def test_duplicates_merge_and_deck(spark):
    rows = [("write", "writes", "Grammar Correction", "verb", 0.9, 3, 8), ("Write", "writes", "grammar correction", "verb", 0.8, 20, 25), ("x", "x", "Grammar Correction", "", 0.9, 0, 1)]
    cards = build(spark, "He write well. They write much.", rows)
    c = cards.collect()
    assert len(c) == 1 and c[0].n_merged == 2 and c[0].difficulty == "Easy" and c[0].confidence == 0.9
    assert c[0].original_sentence == "He write well" and c[0].corrected_sentence == "He writes well"
    deck = dk.decks(cards, ["doc_id"]).first()
    assert deck.total_flashcards == 1 and deck.difficulties == {"Easy": 1, "Medium": 0, "Hard": 0} and deck.estimated_study_time_min == 2
    assert build(spark, "He write well. They write much.", rows).first() == c[0]


@pytest.mark.parametrize(
    ("text", "original", "proposed", "category", "style", "level"),
    [
        ("The skv is blue and bright.", "skv", "sky", "Character Confusion", "grammar_explanation", "Easy"),
        ("The sun is peepina through clouds.", "peepina", "peeping", "Character Confusion", "grammar_explanation", "Easy"),
        ("Where do you see the rainbowAns: In the sky", "In the sky", "in the sky", "Missing Word", "fill_in_blank", "Medium"),
        ("The sky is blue. Ans: Yes I see it.", "Ans: Yes", "Ans: Yes,", "Punctuation Improvement", "punctuation_practice", "Easy"),
    ],
)
def test_golden_cards(spark, text, original, proposed, category, style, level):
    b = text.index(original)
    c = build(spark, text, [(original, proposed, category, "", 0.94, b, b + len(original))]).first()
    assert (c.card_style, c.difficulty) == (style, level)
    assert 8 <= len(c.example.split()) <= 20 or not c.is_vocabulary
    if style == "fill_in_blank":
        assert "[ _____ ]" in c.front.context_sentence and c.front.hint == "Initial letter: I"


def test_function_words_get_no_definition(spark):
    c = build(spark, "They is here.", [("is", "are", "Grammar Correction", "", 0.9, 5, 7)]).first()
    assert c.child_definition == "" and c.example == "" and c.sense == "grammar_rule"


def test_progress(spark):
    cards = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "deck int, card_id string").withColumns({f: F.lit(False) for f in dk.FLAGS})
    up = spark.createDataFrame([("a", 1, False, None, None), ("a", 2, True, True, None)], "card_id string, ord int, is_mastered boolean, is_bookmarked boolean, needs_review boolean")
    out, decks = dk.progress(cards, up, ["deck"])
    d = {r.deck: (r.mastery_percentage, r.cards_mastered, r.cards_completed) for r in decks.collect()}
    assert d == {0: (50.0, 1, 2), 1: (0.0, 0, 1)}
    assert out.where("is_bookmarked").count() == 1


def test_fallback(spark):
    docs = spark.createDataFrame([(0, "The heat was here and the Heat left volume behind"), (1, "")], "doc_id long, text string")
    got = dk.fallback_words(docs, ["doc_id"], ["heat", "volume"]).orderBy("place").collect()
    assert [r.word for r in got] == ["heat", "volume", "here", "left", "behind"] and got[4].difficulty == "Medium"


def test_senses(spark):
    s = learning.senses(spark)
    w = spark.createDataFrame([(0, "the", "noun", "marks that and this in of to")], "k int, word string, pos string, sentence string")
    assert vo.rank_senses(w, s, ["k"]).first().sense_id in ("the.noun.01", "the.noun.02")
    conf, verify = vo.confidence(F.lit(0.6), F.lit(0.2), False)
    r = spark.range(1).select(conf.alias("c"), verify.alias("v")).first()
    assert r.c == pytest.approx(0.425) and r.v
    d = spark.createDataFrame([("walk", "verb"), ("walked", "verb")], "word string, pos string")
    got = vo.child_entry(spark.createDataFrame([("walking",), ("Walks",), ("run",)], "word string"), d)
    assert {r.word: r.entry.pos for r in got.collect()} == {"walking": "verb", "Walks": "verb"}


def test_benchmark_floors(spark):
    r = ev.report(ev.case_scores(learning.benchmark_cases(spark))).first()
    assert r.sentence_accuracy >= 0.65 and r.mean_character_error_rate <= 0.05 and r.proofreading_f1_score >= 0.80


def test_subject_cases(spark):
    own = spark.createDataFrame(list(learning.SUBJECT_CASES), "title string, text string, expected string")
    assert ev.accuracy(st.subject(own, "text", "title"), "expected", "subject").first().accuracy == 1.0


def test_sentence_match(spark):
    c = spark.createDataFrame([("A b c d. E f.", "A b c d. X y.")], "predicted string, truth string")
    r = ev.sentence_match(c).first()
    assert (r.matched, r.compared) == (1, 2)


def test_learning_curve_counts(spark):
    rows = [(1, 0, "skv", "sky"), (1, 1, "skv", "sky"), (1, 2, "x", "sky")]
    got = ev.learning_curve(spark.createDataFrame(rows, "user int, step int, original string, accepted string"), ["user"]).orderBy("step").collect()
    assert [(r.before, r.after) for r in got] == [(0.0, 0.03), (0.03, 0.06), (0.06, 0.09)]
    steps = spark.createDataFrame([(1, k, o, a) for k, (o, a) in enumerate(learning.FEEDBACK_STEPS)], "user int, step int, original string, accepted string")
    assert [r.corrections_accepted for r in ev.learning_curve(steps, ["user"]).orderBy("step").collect()] == [1, 2, 3, 4, 4]


def test_learning_curve_against_a_loop(spark):
    import random

    r = random.Random(1)
    words = "sky blue skv sun a".split()
    rows = [(r.randrange(3), k, " ".join(r.choices(words, k=r.randrange(3))), " ".join(r.choices(words, k=r.randrange(3)))) for k in range(80)]
    want = {}
    for u, k, _, a in rows:
        for side, past in (("before", [x for x in rows if x[0] == u and x[1] < k]), ("after", [x for x in rows if x[0] == u and x[1] <= k])):
            past = [x for x in past if x[2] != x[3]]
            s = sum(min(0.12, 0.03 * sum(x[3] == w for x in past)) for w in a.split()) + min(0.20, 0.05 * sum(x[2] == a for x in past))
            want[u, k, side] = round(min(0.25, s), 6)
    got = ev.learning_curve(spark.createDataFrame(rows, "user int, step int, original string, accepted string"), ["user"]).collect()
    assert {(x.user, x.step, s): x[s] for x in got for s in ("before", "after")} == pytest.approx(want)
