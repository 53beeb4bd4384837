"""Every operator on texts of megabytes, one word of a megabyte, nulls, blanks, repeated rows, and columns of awkward names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, line_dedup, mixing, packing, quality, ranked_search, simhash, suffix_dedup, token_counts, toxicity
from tests.llm import cases
from tests.llm.test_ranked_search import loops


def rows():
    r = random.Random(6)
    words = cases.prose(r, 300_000)
    lines = "\n".join(cases.prose(r, 20) for _ in range(2000))
    return [(1, words), (2, "x" * 1_000_000), (3, None), (4, ""), (5, " \n\t"), (6, words), (7, lines), (8, lines), (8, lines), (None, "a null id has a text too"), (9, words[: len(words) // 2]), (10, "short")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", k, "x", 1.5) for k, (i, t) in enumerate(rows())], "doc_id long, text string, lang string, h long, pattern string, row double")
    return df.withColumns({"a.b": F.lit(1), "rid": F.lit("r"), "gone": F.lit(2), "n_removed_lines": F.lit("n")}).repartition(3)


ONE_EACH = {
    "op1": lambda d: suffix_dedup.remove_repeats(d),
    "op3": lambda d: quality.judge(d),
    "op7": lambda d: simhash.near_duplicates(d),
    "op8": lambda d: mixing.score(d),
    "op9": lambda d: toxicity.score(d, d.select("doc_id", F.lit(0).alias("toxic"), F.lit(1).alias("quality"))),
    "op10": lambda d: line_dedup.deduplicate(d),
    "op11": lambda d: token_counts.count_tokens(d),
}


@pytest.mark.parametrize("name", sorted(ONE_EACH))
def test_a_row_for_each_document(docs, name):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in ONE_EACH[name](docs).select("doc_id").collect())
    assert got == sorted((i is None, i or 0) for i, _ in rows())
    assert ONE_EACH[name](docs.limit(0)).collect() == []


def test_packing(docs):
    got = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows()} and max(r.n for r in got) > 300_000


def test_rows_keep_their_columns(docs, spark):
    bench = spark.createDataFrame([(1, " ".join(rows()[6][1].split()[100:140])), (2, None), (3, "")], "item_id long, text string").withColumn("a.b", F.lit(0))
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted({r.doc_id for r in clean.collect()}, key=repr) == sorted({i for i, _ in rows()} - {7, 8}, key=repr)
    assert {r.doc_id for r in decontaminate.contained(docs, bench).collect()} == {7, 8}
    for out in (quality.keep(docs), simhash.one_of_each(docs)):
        assert out.columns == docs.columns
    lines = line_dedup.deduplicate(docs)
    assert lines.columns == [c for c in docs.columns if c != "n_removed_lines"] + ["n_removed_lines"]
    left = {(r.doc_id, r["a.b"]): r for r in lines.collect()}
    assert left[7, 1].text == rows()[6][1] and left[8, 1].text == "" and left[3, 1].text is None and left[8, 1].n_removed_lines == 2000


def test_search(docs, spark):
    asked = [(1, rows()[6][1][:300]), (2, "x" * 1_000_000), (3, None)]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("a.b", F.lit(0))
    assert Counter(map(tuple, ranked_search.search(docs, items).collect())) == Counter(loops(rows(), asked))
