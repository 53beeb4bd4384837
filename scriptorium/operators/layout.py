"""Layout: reading order, lines, paragraphs, padding, assembly of pages. Regions are rows with xmin, ymin, xmax, ymax."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx

MIN_INK = 0.015
SMALL, PAIRS = 1000, 1_000_000  # boxes of a page, and pairs at once, that are compared each with each
NONE = -(1 << 62)
_SIDES, _WAYS = ("xmin", "ymin", "xmax", "ymax"), ("above", "below", "left", "right")


def without_empty(regions: DataFrame, least: float = MIN_INK) -> DataFrame:
    return regions.where(F.col("ink_density") >= least)


def label(width: Column, height: Column, top: Column, page_width: Column, page_height: Column) -> Column:
    """Region type from its size and place."""
    return F.when((height > 40) & (width > page_width * 0.6), "Title").when((height > 22) & (width < page_width * 0.4) & (top < page_height * 0.2), "Section-header").otherwise("Text")


def reading_order(regions: DataFrame, page: Sequence[str]) -> DataFrame:
    """Adds reading_order from 1, top to bottom and left to right."""
    return regions.withColumn("reading_order", F.row_number().over(Window.partitionBy(*page).orderBy("ymin", "xmin", "region_id")))


def paragraphs(regions: DataFrame, page: Sequence[str]) -> DataFrame:
    """Adds paragraph_id: a line goes on with a paragraph of its type when the gap is at most 1.6 times the last line's height."""
    w = Window.partitionBy(*page).orderBy("ymin", "region_id")
    gap = F.col("ymin") - F.lag("ymax").over(w)
    height = F.greatest(F.lit(1), F.lag(F.col("ymax") - F.col("ymin")).over(w))
    goes_on = (gap <= height * 1.6) & (F.col("region_type") == F.lag("region_type").over(w)) & ~F.col("region_type").isin("Title", "Section-header")
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return regions.withColumn("__new", new).withColumn("paragraph_id", F.sum("__new").over(w)).drop("__new")


def merge_lines(regions: DataFrame, page: Sequence[str]) -> DataFrame:
    """Word boxes to line boxes: page, region_id, xmin, ymin, xmax, ymax, region_type, confidence.

    A greedy fold over a page's boxes from the top: each joins the first line that it overlaps by 0.4 of the smaller height, and the line
    grows. Boxes come sorted by page and place and are read once; a line that ends above a box is met by no later one and is given out, so
    only the lines beside the current box are held, however many boxes a page has.
    """
    page = list(page)
    names = [f"k{i}" for i in range(len(page))]
    sides = ["xmin", "ymin", "xmax", "ymax"]
    own = regions.select(F.struct(*(F.col(c).alias(n) for c, n in zip(page, names, strict=True))).alias("key"), *(F.col(c).cast("int").alias(c) for c in sides), F.col("region_id").cast("long").alias("region_id"), "region_type", F.col("confidence").cast("double").alias("confidence"))
    dealt = own.repartition("key").sortWithinPartitions("key", "ymin", "xmin", "region_id")
    schema = T.StructType([dealt.schema["key"], T.StructField("region_id", T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in sides), T.StructField("region_type", T.StringType()), T.StructField("confidence", T.DoubleType())])
    kinds = [pa.int32()] * 5 + [pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = None
        lines: list[list] = []  # number, xmin, ymin, xmax, ymax, type, confidence, and the left edge that its type is from
        n, began = 0, False
        for b in batches:
            done: list[tuple] = []
            kind = b.schema.field("key").type
            for k, x0, y0, x1, y1, _, name, sure in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not began or k != key:
                    done.extend((key, *line[:7]) for line in lines)
                    key, lines, n, began = k, [], 0, True
                done.extend((key, *line[:7]) for line in lines if line[4] <= y0)
                lines = [line for line in lines if line[4] > y0]
                for line in lines:
                    shared = min(y1, line[4]) - max(y0, line[2])
                    if max(0, shared) >= 0.4 * min(max(1, y1 - y0), max(1, line[4] - line[2])):
                        if x0 < line[7]:
                            line[7], line[5] = x0, name
                        line[1], line[2], line[3], line[4], line[6] = min(line[1], x0), min(line[2], y0), max(line[3], x1), max(line[4], y1), max(line[6], sure)
                        break
                else:
                    n += 1
                    lines.append([n, x0, y0, x1, y1, name, sure, x0])
            if done:
                yield _lines_out(done, kind, kinds)
        if lines:
            yield _lines_out([(key, *line[:7]) for line in lines], kind, kinds)

    out = dealt.mapInArrow(run, schema)
    return out.select(*(F.col(f"key.{n}").alias(c) for c, n in zip(page, names, strict=True)), "region_id", *sides, "region_type", "confidence")


def _lines_out(rows: list[tuple], key: pa.DataType, kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [key, *kinds], strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "region_id", "xmin", "ymin", "xmax", "ymax", "region_type", "confidence"])


def _pieces(lo: Column, hi: Column, levels: int) -> Column:
    """Dyadic strips that make up [lo, hi), two of a size at most: numbers of (size, place)."""
    out = []
    for j in range(levels + 1):
        left, right = F.shiftright(lo + ((1 << j) - 1), j), F.shiftright(hi, j)
        out += [F.when((left < right) & (left.bitwiseAND(1) == 1), _strip(j, left)), F.when((left < right) & (right.bitwiseAND(1) == 1), _strip(j, right - 1))]
    return F.array_compact(F.array(*out))


def _around(x: Column, levels: int) -> Column:
    """The dyadic strips that hold a point, one of each size."""
    return F.array(*(_strip(j, F.shiftright(x, j)) for j in range(levels + 1)))


def _strip(size: int, place: Column) -> Column:
    return F.lit(size << 40) + place + F.lit(1 << 39)


def neighbours(regions: DataFrame, page: Sequence[str], small: int = SMALL) -> DataFrame:
    """Distinct boxes of each page with the edges that face them: the page's columns, xmin, ymin, xmax, ymax, above (the lowest lower edge
    of the boxes over it), below, left, right (null where nothing is). A box faces those others that it overlaps on the other axis; equal
    boxes are one. Boxes with a null coordinate have no row.

    A page of at most ``SMALL`` boxes is one row that holds them, and compares each with each; larger ones go by :func:`_by_strips`.
    """
    page = list(page)
    names = {c: f"p{k}" for k, c in enumerate(page)}
    key = list(names.values())
    boxes = regions.select(*(F.col(c).alias(n) for c, n in names.items()), *(F.col(c).cast("long").alias(c) for c in _SIDES)).dropna(subset=list(_SIDES)).distinct()
    # a page's boxes are gathered only if they are few: no row grows with a page
    counted = boxes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    least, most = counted.agg(F.min("n"), F.max("n")).first()
    few, out = boxes, None
    if most is not None and most > small:
        large = counted.where(F.col("n") > small).select(*(F.col(k).alias(f"l_{k}") for k in key))
        on = [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in key]
        few, out = boxes.join(large, on, "left_anti"), _by_strips(boxes.join(large, on, "left_semi"), key)
    if most is None or least <= small:
        schema = few.select(*key).schema
        schema = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in (*_SIDES, *_WAYS))])
        own = few.groupBy(*key).agg(F.collect_list(F.struct(*_SIDES)).alias("b"))
        own = own.select(*key, *(F.col(f"b.{c}").alias(c) for c in _SIDES)).mapInArrow(_facing, schema)
        out = own if out is None else own.union(out.select(own.columns))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), *_SIDES, *_WAYS)


def _facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes of pages (one a row, their sides as lists) with the edges that face them; pairs of bounded number at once."""
    for b in batches:
        n = np.diff(b.column(_SIDES[0]).offsets.to_numpy()).astype(np.int64)
        at, first = 0, np.concatenate(([0], np.cumsum(n)))
        sides = [b.column(c).flatten().to_numpy() for c in _SIDES]
        load = np.cumsum(n * n)
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + PAIRS, "right")))
            own = [s[first[at] : first[to]] for s in sides]
            found = _nearest(own, n[at:to])
            rows = pa.array(np.repeat(np.arange(at, to), n[at:to]))
            keys = [b.column(k).take(rows) for k in range(b.num_columns - len(_SIDES))]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, own), *found], names=[*b.schema.names, *_WAYS])
            at = to


def _nearest(sides: list[np.ndarray], n: np.ndarray) -> list[pa.Array]:
    """above, below, left and right of the boxes of pages with ``n`` boxes each, from all pairs of a page."""
    total, start = int(n.sum()), np.cumsum(n) - n
    mates, base = np.repeat(n, n), np.repeat(start, n)
    begin = np.cumsum(mates) - mates
    i = np.repeat(np.arange(total), mates)
    j = np.arange(int(mates.sum())) - np.repeat(begin - base, mates)
    i, j = i[i != j], j[i != j]
    x0, y0, x1, y1 = sides
    meets_x = np.minimum(x1[i], x1[j]) > np.maximum(x0[i], x0[j])
    meets_y = np.minimum(y1[i], y1[j]) > np.maximum(y0[i], y0[j])
    out = []
    for meets, facing, edge, sign in (
        (meets_x, y1[j] <= y0[i], y1, 1), (meets_x, (y0[j] >= y1[i]) & (y1[j] > y0[i]), y0, -1), (meets_y, x1[j] <= x0[i], x1, 1), (meets_y, (x0[j] >= x1[i]) & (x1[j] > x0[i]), x0, -1),
    ):
        hit = np.flatnonzero(meets & facing)
        best = np.full(total, NONE, np.int64)
        np.maximum.at(best, i[hit], edge[j[hit]] * sign)
        out.append(pa.array(best * sign, mask=best == NONE))
    return out


def _by_strips(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The same for distinct boxes (key, sides) of pages of any size.

    Two intervals overlap if one begins in the other. An interval is cut into dyadic strips, a point lies in one strip of each size;
    in each strip the edges and the boxes that look for one are sorted, and the last edge before a box is its nearest: a
    window, without pairs. Equal edges of a strip are one before they are sorted, so a strip has no more rows than the page has
    coordinates, however many boxes it has.
    """
    sides = list(_SIDES)
    most = boxes.agg(F.max(F.greatest(*(F.abs(c) for c in sides)))).first()[0] or 0
    levels = max(1, int(most).bit_length() + 1)
    x0, y0, x1, y1 = (F.col(c) for c in sides)

    def look(name: str, lo: Column, hi: Column, edge: Column, at: Column, flat: Column) -> Column:
        # a box without extent is no edge to itself: its edge comes just after the place from which it looks
        thin = flat.cast("long")
        return F.struct(F.lit(name).alias("way"), lo.alias("lo"), hi.alias("hi"), (edge * 2 + thin).alias("edge"), (at * 2 + 1 - thin).alias("at"))

    ways = F.array(look("above", x0, x1, y1, y0, y1 <= y0), look("below", x0, x1, -y0, -y1, y1 <= y0), look("left", y0, y1, x1, x0, x1 <= x0), look("right", y0, y1, -x0, -x1, x1 <= x0))
    looks = boxes.select("*", F.inline(ways)).where("hi > lo")
    group = [*key, "way", "begins", "strip"]

    def strips(begins: bool, point: bool) -> Column:
        return F.transform(_around(F.col("lo"), levels) if point else _pieces(F.col("lo"), F.col("hi"), levels), lambda s: F.struct(F.lit(begins).alias("begins"), s.alias("strip")))

    # boxes that begin in the one that looks, and boxes in which it begins
    edges = looks.select(*key, "way", "edge", F.inline(F.concat(strips(True, True), strips(False, False)))).select(*group, F.col("edge").alias("place"), F.col("edge").alias("found")).distinct()
    asked = looks.select(*key, *sides, "way", "at", F.inline(F.concat(strips(True, False), strips(False, True))))
    asks = asked.select(*group, F.col("at").alias("place"), F.lit(None).cast("long").alias("found")).distinct()
    before = F.max("found").over(Window.partitionBy(*group).orderBy("place", F.col("found").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    nearest = edges.union(asks).withColumn("best", before).where("found is null and best is not null").select(*(F.col(c).alias(f"n_{c}") for c in (*group, "place")), F.shiftright("best", 1).alias("best"))
    same = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in key] + [F.col(c) == F.col(f"n_{c}") for c in ("way", "begins", "strip")] + [F.col("at") == F.col("n_place")]
    found = asked.join(nearest, same).select(*key, *sides, "way", "best")
    # boxes without extent on one axis that overlap at the same place: each is an edge above, or to the left of, the others
    thin = looks.where("edge % 2 <> 0 and way in ('above', 'left')").withColumn("place", F.shiftright("edge", 1))
    w = Window.partitionBy(*key, "way", "place").orderBy("lo", "hi")
    touch = (F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("lo")) | (F.lead("lo").over(w) < F.col("hi"))
    found = found.union(thin.withColumn("touch", touch).where("touch").select(*key, *sides, "way", F.col("place").alias("best")))
    way = lambda n, sign: (F.max(F.when(F.col("way") == n, F.col("best"))) * sign).alias(n)
    out = found.groupBy(*key, *sides).agg(way("above", 1), way("below", -1), way("left", 1), way("right", -1))
    back = [F.col(f"b.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key] + [F.col(f"b.{c}") == F.col(f"o.{c}") for c in sides]
    out = boxes.alias("b").join(out.alias("o"), back, "left")
    return out.select(*(F.col(f"b.{c}").alias(c) for c in (*key, *sides)), *(F.col(f"o.{c}").alias(c) for c in _WAYS))


def padded(regions: DataFrame, page: Sequence[str], vertical: float = 0.18, horizontal: float = 0.08, least: int = 6) -> DataFrame:
    """Adds pxmin, pymin, pxmax, pymax: boxes grown for ascenders and descenders, up to their neighbours (the other boxes of the page, equal
    ones not) and the page (page_width, page_height)."""
    sides = ["xmin", "ymin", "xmax", "ymax"]
    near = neighbours(regions, page).select(*(F.col(f"`{c}`").alias(f"__n{k}") for k, c in enumerate([*page, *sides])), *(F.col(c).alias(f"__{c}") for c in ("above", "below", "left", "right")))
    own = regions.join(near, [F.col(f"`{c}`").eqNullSafe(F.col(f"__n{k}")) for k, c in enumerate([*page, *sides])], "left")
    v = F.greatest(F.lit(least), F.floor(F.greatest(F.lit(1), F.col("ymax") - F.col("ymin")) * vertical))
    h = F.greatest(F.lit(least), F.floor(F.greatest(F.lit(1), F.col("xmax") - F.col("xmin")) * horizontal))
    out = own.withColumns(
        {
            "__x0": F.greatest(F.lit(0), F.col("xmin") - h, F.coalesce("__left", F.lit(0))),
            "__y0": F.greatest(F.lit(0), F.col("ymin") - v, F.coalesce("__above", F.lit(0))),
            "__x1": F.least("page_width", F.col("xmax") + h, F.coalesce("__right", F.col("page_width"))),
            "__y1": F.least("page_height", F.col("ymax") + v, F.coalesce("__below", F.col("page_height"))),
        }
    )
    x0 = F.greatest(F.lit(0), F.least(F.col("page_width") - 1, "__x0"))
    y0 = F.greatest(F.lit(0), F.least(F.col("page_height") - 1, "__y0"))
    out = out.withColumns({"pxmin": x0.cast("int"), "pymin": y0.cast("int")})
    out = out.withColumns({"pxmax": F.greatest(F.col("pxmin") + 1, F.least("page_width", "__x1")).cast("int"), "pymax": F.greatest(F.col("pymin") + 1, F.least("page_height", "__y1")).cast("int")})
    return out.drop(*(f"__n{k}" for k in range(len(page) + 4)), "__above", "__below", "__left", "__right", "__x0", "__y0", "__x1", "__y1")


def cropped(width: Column, height: Column) -> dict[str, Column]:
    """Clamped crop of a region's box, a pixel at least."""
    x0, y0 = F.greatest(F.lit(0), F.least("xmin", width - 1)), F.greatest(F.lit(0), F.least("ymin", height - 1))
    return {"cxmin": x0, "cymin": y0, "cxmax": F.greatest(x0 + 1, F.least("xmax", width)), "cymax": F.greatest(y0 + 1, F.least("ymax", height))}


def overlay_label() -> Column:
    return F.format_string("#%d [%s] %d%%", F.col("region_id").cast("int"), F.col("region_type"), F.floor(F.col("confidence") * 100).cast("int"))


def markdown_of(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "Title", F.concat(F.lit("# "), text))
        .when(kind == "Section-header", F.concat(F.lit("## "), text))
        .when(kind == "Caption", F.concat(F.lit("*"), text, F.lit("*")))
        .when((kind == "List-item") & ~text.rlike(r"^(?:- |\* |\d)"), F.concat(F.lit("- "), text))
        .when((kind == "Table") & ~F.contains(text, F.lit("|")), F.concat(F.lit("```table\n"), text, F.lit("\n```")))
        .otherwise(text)
    )


def _joined(order: Column, value: Column, between: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), between)


def assemble(regions: DataFrame, page: Sequence[str]) -> DataFrame:
    """page, plain_text, markdown from regions (reading_order, region_type, text); blank ones are left out."""
    t = tx.strip(F.col("text"))
    own = regions.where(~tx.blank(F.col("text"))).select(*page, "reading_order", t.alias("t"), markdown_of(t, F.col("region_type")).alias("m"))
    return own.groupBy(*page).agg(_joined(F.col("reading_order"), F.col("t"), "\n\n").alias("plain_text"), _joined(F.col("reading_order"), F.col("m"), "\n\n").alias("markdown"))


def concat_pages(pages: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, plain_text, markdown from pages (page_number, subject, plain_text, markdown)."""
    titled = F.concat(F.lit("# Page "), F.col("page_number").cast("string"), F.lit(" ["), F.col("subject"), F.lit("]\n\n"), F.col("markdown"))
    return pages.groupBy(*doc).agg(
        _joined(F.col("page_number"), F.col("plain_text"), "\n\n=== PAGE BREAK ===\n\n").alias("plain_text"), _joined(F.col("page_number"), titled, "\n\n---\n\n").alias("markdown")
    )


def align_lines(pages: DataFrame, regions: DataFrame, page: Sequence[str]) -> DataFrame:
    """Regions (page, place from 0, text) with the i-th line that is not blank of a page's transcription (page, transcription): surplus
    regions keep their text."""
    lines = F.filter(F.split("transcription", "\n"), lambda x: ~tx.blank(x))
    own = pages.select(*page, F.posexplode(lines).alias("place", "line"))
    out = regions.join(own, [*page, "place"], "left")
    return out.withColumns({"text": F.coalesce(tx.strip(F.col("line")), "text"), "confidence": F.when(F.col("line").isNotNull(), 0.92).otherwise(0.80)}).drop("line")
