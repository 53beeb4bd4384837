"""Padding against a loop over all pairs of a page's boxes."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import layout


def loop(box, others, width, height):
    x0, y0, x1, y1 = box
    v, h = max(6, int(max(1, y1 - y0) * 0.18)), max(6, int(max(1, x1 - x0) * 0.08))
    a, b, c, d = max(0, x0 - h), max(0, y0 - v), min(width, x1 + h), min(height, y1 + v)
    for o in others:
        if o == box:
            continue
        if min(x1, o[2]) > max(x0, o[0]):
            if o[3] <= y0:
                b = max(b, o[3])
            elif o[1] >= y1:
                d = min(d, o[1])
        if min(y1, o[3]) > max(y0, o[1]):
            if o[2] <= x0:
                a = max(a, o[2])
            elif o[0] >= x1:
                c = min(c, o[0])
    a, b = max(0, min(width - 1, a)), max(0, min(height - 1, b))
    return a, b, max(a + 1, min(width, c)), max(b + 1, min(height, d))


def check(spark, pages, width=200, height=300):
    rows = [(p, k, *b, width, height, "x") for p, boxes in pages.items() for k, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "page long, region_id int, xmin int, ymin int, xmax int, ymax int, page_width int, page_height int, way string").withColumn("a.b", F.lit(1))
    got = {(r.page, r.region_id): (r.pxmin, r.pymin, r.pxmax, r.pymax) for r in layout.padded(df, ["page"]).collect()}
    assert len(got) == len(rows)
    for p, boxes in pages.items():
        for k, b in enumerate(boxes):
            assert got[p, k] == loop(b, boxes, width, height), (p, b)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    pages = {}
    for p in range(25):
        n, spread = r.randrange(1, 25), r.choice((10, 60, 280))
        draw = lambda m: r.randrange(0, min(m, spread))
        boxes = []
        for _ in range(n):
            x, y = draw(180), draw(280)
            # some without width or height, some equal, some at the page's edge and beyond it
            boxes.append((x - r.choice((0, 0, 5)), y, x + r.choice((0, 1, 5, 30, 150)), y + r.choice((0, 1, 4, 20))))
        pages[None if p == 0 else p] = boxes + r.sample(boxes, min(3, n))
    check(spark, pages)


def test_thin_boxes_at_one_place(spark):
    check(spark, {1: [(10, 5, 10, 20), (10, 8, 10, 9), (10, 5, 10, 20), (10, 30, 10, 40), (5, 6, 10, 12), (10, 6, 15, 12)], 2: [(5, 10, 9, 10), (7, 10, 20, 10), (20, 10, 30, 10)], 3: [(0, 0, 200, 300)]})


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, 5, 5, 9, 9, 50, 50), (1, 2, None, 5, 9, 9, 50, 50)], "page int, region_id int, xmin int, ymin int, xmax int, ymax int, page_width int, page_height int")
    got = layout.padded(df, ["page"]).collect()
    assert sorted(r.region_id for r in got) == [1, 2]
    assert layout.padded(df.limit(0), ["page"]).collect() == []


def test_a_page_of_many_boxes(spark):
    """100,000 boxes of one page: no row holds the page's boxes, and no task gets their pairs."""
    n = 100_000
    df = spark.range(n).select(
        F.lit(1).alias("page"), F.col("id").cast("int").alias("region_id"), (F.col("id") % 250 * 20).cast("int").alias("xmin"), (F.floor(F.col("id") / 250) * 20).cast("int").alias("ymin"), F.lit(5000).alias("page_width"), F.lit(8000).alias("page_height")
    )
    df = df.withColumns({"xmax": F.col("xmin") + 14, "ymax": F.col("ymin") + 14})
    got = layout.padded(df, ["page"])
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    # the gap of 6 pixels between neighbours is what bounds each box
    assert got.where("pxmin = greatest(0, xmin - 6) and pymin = greatest(0, ymin - 6) and pxmax = xmax + 6 and pymax = ymax + 6").count() == n


def test_pages_below_and_above_the_bound_alike(spark):
    r = random.Random(7)
    rows = [(p, k, x, y, x + r.choice((0, 3, 40)), y + r.choice((0, 5, 12))) for p in range(12) for k in range(3 + 4 * p) for x, y in [(r.randrange(90), r.randrange(90))]]
    df = spark.createDataFrame(rows, "page int, region_id int, xmin int, ymin int, xmax int, ymax int")
    ways = [sorted(map(tuple, layout.neighbours(df, ["page"], small=n).collect()), key=repr) for n in (0, 20, 1000)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len({r[:1] + r[2:] for r in rows})


def test_small_pages_make_no_strips(spark):
    """A box of a small page is one entry of its page's row, not some 240 rows of a shuffle."""
    df = spark.createDataFrame([(1, 1, 0, 0, 9, 9), (1, 2, 0, 20, 9, 30)], "page int, region_id int, xmin int, ymin int, xmax int, ymax int")
    assert "Window" not in layout.neighbours(df, ["page"])._jdf.queryExecution().executedPlan().toString()
