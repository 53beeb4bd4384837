"""Accuracy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import scores as sc
from scriptorium.functions import text as tx

# Proofreading cases (id, category, raw, truth).
CASES = (
    ("tc_01_homophone_road", "homophone_context", "The boy road the bicycle to school.", "The boy rode the bicycle to school."),
    ("tc_02_homophone_red", "homophone_context", "She red the book yesterday afternoon.", "She read the book yesterday afternoon."),
    ("tc_03_handwriting_confusion_sky", "handwritten", "The skv is blue and bright.", "The sky is blue and bright."),
    ("tc_04_handwriting_confusion_peeping", "handwritten", "The sun is peepina through clouds.", "The sun is peeping through clouds."),
    ("tc_05_printed_worksheet", "printed", "Answer the following question. Fix implomentation of froin platform.", "Answer the following questions. Fix implementation of from the platform."),
    ("tc_06_capitalization_and_punct", "printed", "ans: yes i have seen the rainbow ?", "Ans: Yes, I have seen the rainbow?"),
    ("tc_07_homophone_sea", "homophone_context", "I sea the bright rainbow in the sky.", "I see the bright rainbow in the sky."),
    ("tc_08_homophone_there", "homophone_context", "Their are seven colors in the rainbow.", "There are seven colors in the rainbow."),
    ("tc_09_homophone_sun", "homophone_context", "The son is shining brightly in the sky.", "The sun is shining brightly in the sky."),
    ("tc_10_homophone_cat", "homophone_context", "I cat the paper with scissors.", "I cut the paper with scissors."),
    ("tc_11_multi_word_handwriting", "handwritten", "The yellov sun is peepina through clouds.", "The yellow sun is peeping through clouds."),
    (
        "tc_12_notebook_reconstruction_matter",
        "handwritten",
        "Us is made of matte EartethaGaAEeu exists in 3 states",
        "Everything around us is made of matter. Matter exists in three states: solid, liquid and gases.",
    ),
    ("tc_13_notebook_reconstruction_activity", "handwritten", "Eil Jueket with water Take ang tempt braille", "Fill a bucket with water. Take an empty bottle with its mouth facing downwards."),
    ("tc_14_notebook_reconstruction_optics", "handwritten", "Matrials which light does pass atall thccaldbd is Opaque", "Materials through which light does not pass at all are called Opaque."),
)


def case_scores(cases: DataFrame) -> DataFrame:
    """Adds error rates before and after to cases (raw, predicted, truth, n_suggestions), and how each counts: tp, fp, fn or none."""
    raw, new, truth = F.col("raw"), F.col("predicted"), F.col("truth")
    out = cases.withColumns({"initial_cer": sc.cer(raw, truth), "final_cer": sc.cer(new, truth), "initial_wer": sc.wer(raw, truth), "final_wer": sc.wer(new, truth), "is_exact": tx.strip(new) == tx.strip(truth)})
    a, b = F.col("initial_cer"), F.col("final_cer")
    kind = F.when((b < a) | F.col("is_exact"), "tp").when((F.col("n_suggestions") > 0) & (b >= a), "fp").when((a > 0) & (b == a), "fn").otherwise("none")
    return out.withColumn("outcome", kind)


def report(scored: DataFrame) -> DataFrame:
    """One row of counts, accuracy, mean error rates, precision, recall and F1."""
    n = F.count(F.lit(1))
    out = scored.agg(
        n.alias("total_test_cases"), F.count_if("is_exact").alias("exact_sentence_matches"), F.round(F.count_if("is_exact") / F.greatest(F.lit(1), n), 4).alias("sentence_accuracy"),
        F.round(F.avg("final_cer"), 4).alias("mean_character_error_rate"), F.round(F.avg("final_wer"), 4).alias("mean_word_error_rate"),
        *(F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")),
    )
    p, r = (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col(k)) for k in ("fp", "fn"))
    out = out.withColumns({"__p": p, "__r": r})
    f1 = F.col("__p") * F.col("__r") * 2 / F.greatest(F.lit(1e-6), F.col("__p") + F.col("__r"))
    return out.withColumns({"proofreading_precision": F.round("__p", 4), "proofreading_recall": F.round("__r", 4), "proofreading_f1_score": F.round(f1, 4)}).drop("__p", "__r", "tp", "fp", "fn")


def sentence_match(cases: DataFrame) -> DataFrame:
    """Adds matched and compared: sentences (split at periods) of predicted and truth that agree at their places up to a CER of 0.10."""

    def sentences(c):
        return F.filter(F.transform(F.split(c, r"\.", -1), tx.strip), lambda s: s != "")

    a, b = sentences(F.col("predicted")), sentences(F.col("truth"))
    n = F.least(F.size(a), F.size(b))
    hits = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda p, g: (sc.cer(p, g) < 0.10).cast("int"))
    return cases.withColumn("matched", F.aggregate(hits, F.lit(0), lambda s, x: s + x)).withColumn("compared", F.greatest(F.size(a), F.size(b)))


def by_model(samples: DataFrame) -> DataFrame:
    """Mean error rates per model of samples (truth, hypotheses: map from model to text)."""
    one = samples.select("truth", F.explode("hypotheses").alias("model", "text"))
    return one.groupBy("model").agg(F.round(F.avg(sc.cer(F.col("text"), F.col("truth"))), 4).alias("mean_cer"), F.round(F.avg(sc.wer(F.col("text"), F.col("truth"))), 4).alias("mean_wer"), F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, expected: str, found: str) -> DataFrame:
    n = F.count(F.lit(1))
    ok = F.count_if(F.col(expected) == F.col(found))
    return rows.agg(n.alias("total"), ok.alias("correct"), F.round(ok / F.greatest(F.lit(1), n), 4).alias("accuracy"))


def _counted(asks: DataFrame, teaches: DataFrame, user: list[str]) -> DataFrame:
    """``asks`` (user, step, key) with before and after: how many of ``teaches`` (user, step, key) came before its step, and up to it."""
    every = asks.withColumn("teach", F.lit(0)).unionByName(teaches.withColumn("teach", F.lit(1)))
    w = Window.partitionBy(*user, "key").orderBy("step")
    n = lambda upto: F.coalesce(F.sum("teach").over(w.rangeBetween(Window.unboundedPreceding, upto)), F.lit(0))
    return every.withColumns({"before": n(-1), "after": n(0)}).where("teach = 0").select(*user, "step", "before", "after")


def learning_curve(steps: DataFrame, user: list[str]) -> DataFrame:
    """For feedback steps (user, step: a whole number, original, accepted) in order: corrections_accepted so far, and what the profile adds to the accepted
    text before and after each step.

    The boost of a text is the sum over its words of min(0.12, 0.03 n) and of min(0.20, 0.05 n) for the text as an error, up to
    0.25; n counts the earlier feedback of the user. Words meet the feedback that taught them in a window of their own, so a user's
    steps are never paired with each other.
    """
    own = steps.select(*user, F.col("step").cast("long").alias("step"), F.lower(tx.strip(F.col("original"))).alias("o"), F.lower(tx.strip(F.col("accepted"))).alias("a"))
    own = own.withColumn("c", F.col("o") != F.col("a"))
    taught = own.where("c")
    words = own.select(*user, "step", F.explode(F.transform(tx.tokens(F.col("a")), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))).alias("key"))
    by_word = _counted(words, taught.select(*user, "step", F.col("a").alias("key")), user)
    by_text = _counted(own.select(*user, "step", F.col("a").alias("key")), taught.select(*user, "step", F.col("o").alias("key")), user)
    boost = lambda most, each: [F.least(F.lit(most), F.col(k) * each).alias(f"{k}_boost") for k in ("before", "after")]
    every = by_word.select(*user, "step", *boost(0.12, 0.03)).union(by_text.select(*user, "step", *boost(0.20, 0.05)))
    boosts = every.groupBy(*user, "step").agg(*(F.round(F.least(F.lit(0.25), F.sum(f"{k}_boost")), 6).alias(k) for k in ("before", "after")))
    w = Window.partitionBy(*user).orderBy("step")
    counts = own.select(*user, "step", F.sum(F.col("c").cast("int")).over(w).alias("corrections_accepted"))
    return counts.join(boosts, [*user, "step"])


# Noisy handwriting (id, raw, what the corrected text must hold).
NOISY_CASES = (
    ("hw_noise_01_hyphen_split", "The student wrote a hand-\nwritten story about a boy who road a bicycle.", "handwritten"),
    ("hw_noise_02_missing_space", "The sky is blue.Peeping through the clouds.Ans: Yes, I see it.", "blue. Peeping"),
    ("hw_noise_03_character_confusion", "The skv is blue with yellov sun and areen grass.", "sky"),
    ("hw_noise_04_contextual_homophone", "The boy road the bicycle to school. She red the book.", "rode"),
    ("hw_noise_05_punctuation_restore", "Where do you see the rainbowAns: In the sky", "rainbow?"),
)


def _histogram(rows: DataFrame, column: str) -> DataFrame:
    """One row with a map of counts; no rows give an empty map."""
    one = rows.groupBy(column).count()
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(f"{column}_distribution"))


def flashcard_report(cases: DataFrame, corrections: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: test cases, accepted corrections, cards, cards per correction, and counts of cards by category and by style."""
    n = [x.agg(F.count(F.lit(1)).alias(name)) for x, name in ((cases, "total_test_cases"), (corrections, "total_accepted_corrections"), (cards, "total_flashcards_created"))]
    out = n[0].crossJoin(n[1]).crossJoin(n[2])  # single rows
    rate = F.round(F.col("total_flashcards_created") / F.greatest(F.lit(1), F.col("total_accepted_corrections")), 4)
    out = out.withColumn("conversion_rate", rate)
    return out.crossJoin(_histogram(cards, "category")).crossJoin(_histogram(cards, "card_style"))


def resilience_report(cases: DataFrame) -> DataFrame:
    """One row from cases (expected, corrected_text, has_deck): recoveries, whose text holds what is expected whatever the case of its
    letters, decks, and both rates."""
    n = F.count(F.lit(1))
    found = F.count_if(F.contains(F.lower("corrected_text"), F.lower("expected")))
    decks = F.count_if("has_deck")
    rate = lambda k: F.round(k / F.greatest(F.lit(1), n), 4)
    return cases.agg(
        n.alias("total_test_cases"), found.alias("successful_text_recoveries"), rate(found).alias("recovery_success_rate"), decks.alias("successful_deck_generations"), rate(decks).alias("deck_generation_rate")
    )


def pipeline_rates(samples: DataFrame, fix, verify) -> DataFrame:
    """One row of mean error rates and exact matches of samples (truth, hypotheses: map from model to text): the handwriting
    model's text, or the first, goes through ``fix`` and ``verify`` (functions from column to column)."""
    best = F.coalesce(F.col("hypotheses")["trocr"], F.element_at(F.map_values("hypotheses"), 1))
    own = samples.select("truth", best.alias("text")).select("truth", verify(fix(F.col("text"))).alias("text"))
    t, g = F.col("text"), F.col("truth")
    return own.agg(
        F.count(F.lit(1)).alias("total_benchmark_samples"), F.round(F.avg(sc.cer(t, g)), 4).alias("pipeline_mean_cer"), F.round(F.avg(sc.wer(t, g)), 4).alias("pipeline_mean_wer"),
        F.round(F.count_if(tx.strip(t) == tx.strip(g)) / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("pipeline_sentence_accuracy"),
    )
