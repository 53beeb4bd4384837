import itertools
import random

import numpy as np
import pytest

from scriptorium.functions import scores as sc
from scriptorium.operators import enhancement as en
from scriptorium.operators import images as im
from scriptorium.operators import kernels as k
from scriptorium.operators import layout


def page(h=160, w=220, lines=(30, 60, 90, 120), dark=20, light=250):
    a = np.full((h, w), light, np.uint8)
    for y in lines:
        a[y : y + 12, 20 : w - 20] = dark
    return a


def test_steps_and_their_order():
    assert en.steps_of(page())[0] == [] and (en.enhanced(page()) == page()).all()
    assert en.steps_of(np.full((40, 40), 250, np.uint8))[0] == ["borders", "contrast", "sharpen"]
    noisy = np.random.default_rng(1).integers(0, 255, (60, 60)).astype(np.uint8)
    assert en.steps_of(noisy)[0] == ["borders", "shadows", "denoise", "sharpen"]
    faint = page(light=140, dark=100)
    want = k.sharpened(k.equalized(k.without_borders(faint)[0]))
    assert en.steps_of(faint)[0] == ["borders", "contrast", "sharpen"] and (en.enhanced(faint) == want).all()


def test_steps_are_those_of_the_columns(spark):
    rows = [(i, a.tobytes(), *a.shape, 1) for i, a in enumerate((page(), page(light=140, dark=100), np.random.default_rng(1).integers(0, 255, (60, 60)).astype(np.uint8)))]
    df = spark.createDataFrame(rows, "id int, image binary, height int, width int, channels int")
    own = im.with_metrics(df)
    from pyspark.sql import functions as F

    columns = {r.id: ",".join(r.steps) for r in own.select("id", im.enhancements(F.col("contrast"), F.col("noise_std"), F.col("brightness_mean"), F.col("brightness_std")).alias("steps")).collect()}
    assert {r.id: r.steps for r in en.plan(df, ["id"]).collect()} == columns
    done = {r.id: r for r in en.enhance(df, ["id"]).collect()}
    for i, a in enumerate((page(), page(light=140, dark=100))):
        assert bytes(done[i].image) == en.enhanced(a).tobytes()
    assert en.plan(df.limit(0), ["id"]).collect() == []


@pytest.mark.parametrize("degrees", [-4.0, 3.0])
def test_a_turned_page_is_straightened(spark, degrees):
    a = page(200, 300, (40, 80, 120, 160))
    tilted = k.turned(a, -degrees)
    df = spark.createDataFrame([(1, tilted.tobytes(), *tilted.shape, 1), (2, a.tobytes(), *a.shape, 1)], "id int, image binary, height int, width int, channels int")
    got = {r.id: r for r in en.straighten(df, ["id"]).collect()}
    assert got[1].skew == pytest.approx(degrees, abs=0.5) and got[2].skew == 0.0 and got[2].turn == 0
    back = np.frombuffer(bytes(got[1].image), np.uint8).reshape(got[1].height, got[1].width)
    assert abs(k.skew(back)) < 0.5


def unpacked(data):
    """Pixels of a grey PNG without filters."""
    import struct
    import zlib

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    w, h = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, w + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def test_previews(spark):
    import base64

    a, wide = page(), np.full((20, 100), 200, np.uint8)
    df = spark.createDataFrame([(1, a.tobytes(), *a.shape, 1), (2, wide.tobytes(), *wide.shape, 1), (3, None, 1, 1, 1)], "id int, image binary, height int, width int, channels int")
    got = {r.id: r for r in en.previews(df, ["id"]).collect()}
    assert sorted(got) == [1, 2] and (unpacked(bytes(got[1].png)) == a).all()
    head, _, body = got[1].data_uri.partition(",")
    assert head == "data:image/png;base64" and base64.b64decode(body) == bytes(got[1].png)
    small = {r.id: r for r in en.previews(df, ["id"], longest=50).collect()}
    assert (small[2].height, small[2].width) == (10, 50) and (unpacked(bytes(small[2].png)) == 200).all()


# -- word distance ---------------------------------------------------------


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance():
    for a, b in itertools.product(itertools.chain.from_iterable(itertools.product("xy", repeat=n) for n in range(4)), repeat=2):
        assert sc.word_distance(list(a), list(b)) == slow(a, b)
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(90))] for _ in range(2))
        assert sc.word_distance(a, b) == slow(a, b)


def test_error_rates_of_long_texts(spark):
    from pyspark.sql import functions as F

    words = [f"w{k}" for k in range(30_000)]
    rows = [(" ".join(words), " ".join(words[:100] + ["x"] + words[101:-1])), ("", ""), ("a", ""), ("", "a b"), (None, "a"), ("a b", "a c")]
    got = [r.w for r in spark.createDataFrame(rows, "h string, r string").coalesce(1).select(sc.wer(F.col("h"), F.col("r")).alias("w")).collect()]
    assert got == [2 / 29_999, 0.0, 1.0, 1.0, None, 0.5]


# -- lines -----------------------------------------------------------------


def fold(boxes):
    lines = []
    for x0, y0, x1, y1, i, kind, c in sorted(boxes, key=lambda b: (b[1], b[0], b[4])):
        for line in lines:
            shared = min(y1, line["y1"]) - max(y0, line["y0"])
            if max(0, shared) >= 0.4 * min(max(1, y1 - y0), max(1, line["y1"] - line["y0"])):
                if x0 < line["left"]:
                    line["left"], line["kind"] = x0, kind
                line.update(x0=min(line["x0"], x0), y0=min(line["y0"], y0), x1=max(line["x1"], x1), y1=max(line["y1"], y1), c=max(line["c"], c))
                break
        else:
            lines.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "left": x0, "kind": kind, "c": c})
    return [(n, d["x0"], d["y0"], d["x1"], d["y1"], d["kind"], d["c"]) for n, d in enumerate(lines, 1)]


def test_lines_equal_a_fold_over_all_lines(spark):
    r = random.Random(7)
    rows, want = [], {}
    for p in (None, 1, 2, 3):
        boxes = [(x := r.randrange(300), y := r.randrange(400), x + r.randrange(1, 60), y + r.randrange(0, 30), k, r.choice(("Text", "Title")), r.randrange(100) / 100) for k in range(150)]
        rows += [(p, *b) for b in boxes]
        want[p] = sorted(fold(boxes))
    df = spark.createDataFrame(rows, "page long, xmin int, ymin int, xmax int, ymax int, region_id int, region_type string, confidence double").repartition(5)
    got: dict = {}
    for x in layout.merge_lines(df, ["page"]).collect():
        got.setdefault(x.page, []).append(tuple(x)[1:])
    assert {p: sorted(v) for p, v in got.items()} == want
    assert layout.merge_lines(df.limit(0), ["page"]).collect() == []
