from pyspark.sql import functions as F

from scriptorium.operators import cards as dk
from scriptorium.operators import evaluation as ev
from scriptorium.operators import kernels
from scriptorium.operators import proofreading as pr
from scriptorium.operators import recognition as rg


def test_sure_readings_stay_and_doubtful_ones_are_fused(spark):
    base = spark.createDataFrame([(1, "kept", 0.65), (2, "water heat", 0.30), (3, " ", 0.9), (4, None, 0.2)], "id int, text string, confidence double")
    more = spark.createDataFrame(
        [(1, 0, "clahe", "the heat", 0.99), (2, 0, "clahe", "the heat of water", 0.90), (2, 1, "original", "the heat", 0.99), (3, 0, "x", "", 0.9)], "id int, place int, scale string, text string, confidence double"
    )
    got = {r.id: r for r in rg.read_scales(base, more, ["id"]).collect()}
    assert (got[1].selected_text, got[1].multiscale_executed, got[1].selected_scale) == ("kept", False, "original")
    assert (got[2].selected_text, got[2].selected_scale, got[2].multiscale_executed) == ("the heat of water", "clahe", True)
    assert got[3].selected_scale == "original" and got[3].multiscale_executed and got[4].selected_text is None


def test_crops_as_markdown(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    read = spark.createDataFrame([(1, 1, "Title", " Matter ", 0.9), (1, 2, "Text", "", 0.7), (1, 3, "Section-header", "States", 0.8), (1, 4, "Text", "solid", 0.8)], "page int, region_id int, region_type string, text string, confidence double")
    regions, out = rg.crop_markdown(pages, read, ["page"])
    assert {r.page: r.markdown for r in out.collect()} == {1: "# Matter\n\n## States\n\nsolid", 2: ""}
    assert {(r.page, r.region_id): r.confidence for r in regions.collect()} == {(1, 1): 0.9, (1, 2): 0.5, (1, 3): 0.8, (1, 4): 0.8, (2, 1): 0.88}
    assert rg.average_confidence(regions, ["page"]).where("page = 2").first().average_confidence == 88.0


def test_history(spark):
    acts = [("undo", None), ("push", "a"), ("push", "b"), ("undo", None), ("undo", None), ("redo", None), ("redo", None), ("undo", None), ("push", "c"), ("redo", None)]
    rows = spark.createDataFrame([(7, k, a, t) for k, (a, t) in enumerate(acts)], "user int, ord int, action string, text string")
    got = [(r.place, r.current) for r in pr.history(rows, ["user"]).orderBy("ord").collect()]
    assert got == [(-1, None), (0, "a"), (1, "b"), (0, "a"), (0, "a"), (1, "b"), (1, "b"), (0, "a"), (1, "c"), (1, "c")]


def test_study_modes(spark):
    cards = spark.createDataFrame([(m, "", "rode", " He rode. ") for m in dk.MODES], "mode string, correct string, proposed string, sentence string")
    answer = F.when(F.col("mode") == "sentence_rewrite", " he RODE. ").otherwise(" Rode")
    own = cards.select("mode", dk.is_right(answer, dk.expected_answer(F.col("mode"), F.col("correct"), F.col("proposed"), F.col("sentence"))).alias("ok"))
    assert all(r.ok for r in own.collect())
    got = cards.select(dk.answer_options(F.array(F.lit("rode")), F.col("proposed"), F.lit("however")).alias("o")).first().o
    assert got == ["rode", "however", "which"]


def test_histories_are_searched(spark):
    items = spark.createDataFrame([("Light", "Physics", True), ("Leaves", "Biology", False)], "title string, category string, has_deck boolean")
    assert [r.title for r in dk.history_matching(items, "PHYS").collect()] == ["Light"]
    assert [r.title for r in dk.history_matching(items, kind="documents").collect()] == ["Leaves"]
    assert dk.history_matching(items, "l", "flashcards").count() == 1


def test_reports(spark):
    cards = spark.createDataFrame([("A", "x"), ("A", "y")], "category string, card_style string")
    r = ev.flashcard_report(spark.range(3), spark.range(4), cards).first()
    assert (r.total_test_cases, r.conversion_rate, r.category_distribution, r.card_style_distribution) == (3, 0.5, {"A": 2}, {"x": 1, "y": 1})
    empty = ev.flashcard_report(spark.range(0), spark.range(0), cards.limit(0)).first()
    assert (empty.conversion_rate, empty.category_distribution) == (0.0, {})
    rows = spark.createDataFrame([("b", "A B", True), ("z", "a", False)], "expected string, corrected_text string, has_deck boolean")
    r = ev.resilience_report(rows).first()
    assert (r.recovery_success_rate, r.deck_generation_rate) == (0.5, 0.5)
    samples = spark.createDataFrame([("abc", {"got": "abd", "trocr": "abc"}), ("abc", {"got": "abd"})], "truth string, hypotheses map<string,string>")
    r = ev.pipeline_rates(samples, lambda c: c, lambda c: c).first()
    assert (r.pipeline_mean_cer, r.pipeline_mean_wer, r.pipeline_sentence_accuracy) == (0.1667, 0.5, 0.5)


def test_tall_regions_are_numbered_through(spark):
    import numpy as np

    a = np.full((120, 50), 250, np.uint8)
    for y in (20, 60):
        a[y : y + 12, 5:45] = 10
    rows = [(1, 1, 0, 0, 50, 120, "Text", 0.9, a.tobytes(), 120, 50, 1), (1, 2, 0, 10, 50, 40, "Title", 0.8, a.tobytes(), 120, 50, 1)]
    df = spark.createDataFrame(rows, "page long, region_id int, xmin int, ymin int, xmax int, ymax int, region_type string, confidence double, image binary, height int, width int, channels int")
    got = [tuple(r)[1:7] for r in kernels.split_tall(df).orderBy("region_id").collect()]
    assert got == [(1, 0, 18, 50, 34, "Text"), (2, 0, 58, 50, 74, "Text"), (3, 0, 10, 50, 40, "Title")]
    assert {r.scale for r in kernels.with_variants(df).collect()} == set(kernels.VARIANTS)


def test_noisy_cases_are_recovered(spark):
    from scriptorium.plans import study

    r = ev.resilience_report(study.resilience_cases(spark).withColumn("has_deck", F.lit(True))).first()
    assert (r.total_test_cases, r.successful_text_recoveries) == (5, 4)


def test_only_the_readings_asked_for(spark):
    import numpy as np

    a = np.random.default_rng(1).integers(0, 255, (60, 90)).astype(np.uint8)
    every = dict(kernels.variants(a[10:50, 20:80], a, (20, 10, 80, 50)))
    assert list(every) == [v for v in kernels.VARIANTS if v in every] and len(every) == 8
    some = dict(kernels.variants(a[10:50, 20:80], a, (20, 10, 80, 50), ("tighter_crop", "original")))
    assert list(some) == ["original", "tighter_crop"] and all((some[k] == every[k]).all() for k in some)
    assert (every["context_expanded"] == a[0:60, 5:95]).all()


def test_filters_against_loops():
    import numpy as np

    a = np.random.default_rng(2).integers(0, 255, (9, 11)).astype(np.uint8)
    at = lambda y, x: float(a[min(max(y, 0), 8), min(max(x, 0), 10)])
    w = [np.exp(-0.5 * k * k) for k in range(-3, 4)]
    w = [x / sum(w) for x in w]
    got = kernels.blurred(a)
    for y in range(9):
        for x in range(11):
            assert abs(got[y, x] - sum(w[i + 3] * w[j + 3] * at(y + i, x + j) for i in range(-3, 4) for j in range(-3, 4))) < 1e-9
    big = kernels.resized(a, 18, 11)
    for y in range(18):
        c = (y + 0.5) / 2 - 0.5
        taps = [(k, np.sinc(c - k) * np.sinc((c - k) / 4)) for k in range(int(np.floor(c)) - 3, int(np.floor(c)) + 5) if abs(c - k) < 4]
        for x in range(11):
            v = sum(t * at(k, x) for k, t in taps) / sum(t for _, t in taps)
            assert abs(int(big[y, x]) - min(255, max(0, v))) <= 1


def test_crops_of_pages_are_read_in_all_ways(spark):
    from scriptorium.plans import catalog

    got = catalog.queries()["im_variants"](spark, "/root/testdata/sf0.001").groupBy("page").agg(F.sort_array(F.collect_list("scale")).alias("s"), F.countDistinct("digest").alias("n")).collect()
    assert got and {tuple(r.s) for r in got} == {tuple(sorted(kernels.VARIANTS))} and max(r.n for r in got) == len(kernels.VARIANTS)
