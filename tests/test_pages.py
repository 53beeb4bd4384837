import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import scores as sc
from scriptorium.operators import images, layout, recognition


def test_scale_fusion(spark):
    rows = [(0, 0, "original", "Propeties of Matier", 0.75), (0, 1, "clahe_contrast", "Properties of Matter", 0.85), (0, 2, "lanczos", "Pr0pert1es #f M@tter", 0.60)]
    c = spark.createDataFrame(rows, "k int, place int, scale string, text string, confidence double")
    words = F.array(*(F.lit(w) for w in "properties of matter volume mass".split()))
    r = recognition.fuse_scales(c, ["k"], words).first()
    assert r.selected_text == "Properties of Matter" and r.selected_scale == "clahe_contrast" and r.fused_confidence > 0.70


def test_model_aggregation(spark):
    rows = [(0, 0, "easyocr", "Propeties of Matier", 0.75), (0, 1, "trocr_handwritten", "Properties of Matter", 0.94), (0, 2, "got", " ", 0.99)]
    c = spark.createDataFrame(rows, "k int, place int, model string, text string, confidence double")
    r = recognition.aggregate_models(c, ["k"], F.array(F.lit("properties"), F.lit("matter"))).first()
    assert r.selected_text == "Properties of Matter" and r.selected_model == "trocr_handwritten" and r.aggregated_confidence > 0.75


def test_quality(spark):
    rows = [("The sky is blue.", 0.85, 0.10, 100, 20), ("||||| zzzzz", 0.90, 0.10, 100, 20), ("", 0.5, 0.0, 5, 5)]
    got = recognition.region_quality(spark.createDataFrame(rows, "text string, confidence double, ink_density double, width int, height int")).collect()
    assert [r.gibberish for r in got] == [False, True, False]
    assert got[0].language_consistency == 1.0 and got[2].language_consistency == 0.0


def test_recovery_budget_and_merge(spark):
    rows = [(0, k, "zz", 0.40 + k / 100, 0.1, 50, 20) for k in range(6)] + [(0, 9, "The sky", 0.95, 0.1, 50, 20)]
    p = recognition.recovery_plan(spark.createDataFrame(rows, "page int, region_id int, text string, confidence double, ink_density double, width int, height int"), ["page"], "region_id")
    assert [r.region_id for r in p.where("recover").orderBy("region_id").collect()] == [0, 1, 2]
    s = recognition.page_stats(p, ["page"]).first()
    assert (s.total_regions, s.high_confidence_count, s.fallback_invocations) == (7, 1, 3)
    retried = spark.createDataFrame([(0, 0, 1, "the sky", 0.9), (0, 1, 1, " ", 0.9), (0, 5, 1, "the sky", 0.99)], "page int, region_id int, tier int, text string, confidence double")
    out = {r.region_id: r for r in recognition.recover(p, retried, ["page", "region_id"]).collect()}
    assert out[0].text == "the sky" and out[0].improved and out[1].text == "zz" and out[5].text == "zz"


def test_visual_check_and_word_changes(spark):
    df = spark.createDataFrame([("Us is made of matier and opaqe substances", "a b c", "a x c"), ("", "a b", "a b c")], "t string, a string, b string")
    text, conf, changes = recognition.verified(F.col("t"))
    rows = df.select(text.alias("t"), conf.alias("c"), changes.alias("ch"), recognition.word_changes(F.col("a"), F.col("b")).alias("w")).collect()
    assert "matter" in rows[0].t and "opaque" in rows[0].t and len(rows[0].ch) == 2 and rows[1].c == 0.5
    assert [tuple(x) for x in rows[0].w] == [("b", "x")] and [tuple(x) for x in rows[1].w] == [("a b", "a b c")]


def test_recognizer_errors_are_rows(spark):
    def read(data):
        if not data:
            raise ValueError("empty")
        return data.decode(), 0.9

    got = recognition.recognize(spark.createDataFrame([(1, b"ab"), (2, b"")], "k int, image binary"), read).orderBy("k").collect()
    assert got[0].text == "ab" and got[1].text is None and "empty" in got[1].error


def test_paragraphs(spark):
    rows = [(0, 1, 20, 45), (0, 2, 52, 77), (0, 3, 150, 175)]
    df = spark.createDataFrame(rows, "page int, region_id int, ymin int, ymax int").withColumn("region_type", F.lit("Text"))
    assert [r.paragraph_id for r in layout.paragraphs(df, ["page"]).orderBy("region_id").collect()] == [1, 1, 2]


def test_markdown(spark):
    rows = [(0, 1, "Title", "Head"), (0, 2, "Section-header", "Sub"), (0, 3, "Text", " body "), (0, 4, "List-item", "- x"), (0, 5, "List-item", "y"), (0, 6, "Table", "a b"), (0, 7, "Text", " ")]
    r = layout.assemble(spark.createDataFrame(rows, "page int, reading_order int, region_type string, text string"), ["page"]).first()
    assert r.markdown == "# Head\n\n## Sub\n\nbody\n\n- x\n\n- y\n\n```table\na b\n```"


def brute_lines(boxes):
    lines = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        for line in lines:
            lo, hi = min(x[1] for x in line), max(x[3] for x in line)
            if max(0, min(b[3], hi) - max(b[1], lo)) >= 0.4 * min(max(1, b[3] - b[1]), max(1, hi - lo)):
                line.append(b)
                break
        else:
            lines.append([b])
    return sorted((min(x[0] for x in n), min(x[1] for x in n), max(x[2] for x in n), max(x[3] for x in n)) for n in lines)


def brute_pad(b, boxes, w, h):
    v, x = max(6, int(max(1, b[3] - b[1]) * 0.18)), max(6, int(max(1, b[2] - b[0]) * 0.08))
    x0, y0, x1, y1 = max(0, b[0] - x), max(0, b[1] - v), min(w, b[2] + x), min(h, b[3] + v)
    for o in boxes:
        if o != b:
            if min(b[2], o[2]) > max(b[0], o[0]):
                if o[3] <= b[1]:
                    y0 = max(y0, o[3])
                elif o[1] >= b[3]:
                    y1 = min(y1, o[1])
            if min(b[3], o[3]) > max(b[1], o[1]):
                if o[2] <= b[0]:
                    x0 = max(x0, o[2])
                elif o[0] >= b[2]:
                    x1 = min(x1, o[0])
    x0, y0 = max(0, min(w - 1, x0)), max(0, min(h - 1, y0))
    return x0, y0, max(x0 + 1, min(w, x1)), max(y0 + 1, min(h, y1))


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(3)
    out = []
    for page in range(12):
        for k in range(14):
            x, y = r.randrange(500), r.randrange(300)
            out.append((page, k, x, y, x + r.randrange(1, 120), y + r.randrange(1, 40)))
    return out


def test_lines_and_padding_against_loops(spark, boxes):
    df = spark.createDataFrame(boxes, "page int, region_id int, xmin int, ymin int, xmax int, ymax int").withColumns(
        {"region_type": F.lit("Text"), "confidence": F.lit(0.9), "page_width": F.lit(560), "page_height": F.lit(330)}
    )
    lines = layout.merge_lines(df, ["page"]).collect()
    padded = {(r.page, r.region_id): (r.pxmin, r.pymin, r.pxmax, r.pymax) for r in layout.padded(df, ["page"]).collect()}
    for p in range(12):
        own = [b[2:] for b in boxes if b[0] == p]
        assert sorted((r.xmin, r.ymin, r.xmax, r.ymax) for r in lines if r.page == p) == brute_lines(own)
        for b in (b for b in boxes if b[0] == p):
            assert padded[p, b[1]] == brute_pad(b[2:], own, 560, 330)


def test_image_metrics(spark):
    a = np.full((40, 60), 250, np.uint8)
    a[10:14] = 5
    row = images.with_metrics(spark.createDataFrame([(a.tobytes(), 40, 60, 1)], "image binary, height int, width int, channels int")).first()
    assert row.ink_density == pytest.approx(0.1) and row.noise_std == 0 and row.orientation == 0
    assert images.orientation_of(np.rot90(a)) in (90, 270)
    d = spark.createDataFrame([(60.0, 5.0, 120.0, 50.0), (40.0, 30.0, 120.0, 50.0)], "c double, n double, m double, s double")
    got = d.select(images.enhancements(F.col("c"), F.col("n"), F.col("m"), F.col("s")).alias("e")).collect()
    assert got[0].e == [] and got[1].e == ["borders", "shadows", "denoise", "contrast", "sharpen"]


def test_error_rates(spark):
    rows = [("cat", "cat", 0.0, 0.0), ("cot", "cat", 1 / 3, 1.0), ("", "", 0.0, 0.0), ("x", "", 1.0, 1.0), ("a b c", "a c", 2 / 3, 0.5)]
    df = spark.createDataFrame(rows, "h string, r string, c double, w double")
    for r in df.select("*", sc.cer(F.col("h"), F.col("r")).alias("cer"), sc.wer(F.col("h"), F.col("r")).alias("wer")).collect():
        assert r.cer == pytest.approx(r.c) and r.wer == pytest.approx(r.w)
