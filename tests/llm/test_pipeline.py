import random

import corpus_pipeline
from scriptorium.llm import common, decontaminate, quality, simhash
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, SF)
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.stored(spark, stage(spark, kept, SF), "stage")
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
        if name == "near duplicates":
            assert ids == {r.component_id for r in simhash.near_duplicates(before, corpus_pipeline.NEAR_WORDS).collect()}
        sizes.append(len(ids))
    assert sizes[0] > sizes[1] and sizes[1] == sizes[2] and sizes[2] > sizes[3] >= sizes[4]
    assert decontaminate.contained(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_entry_points_with_the_operators(spark):
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_bear_what_tables_hold(spark):
    """Nulls, blanks, a very long text, repeated rows, ties and columns of any name; then empty tables."""
    good = [cases.prose(random.Random(k), 90) for k in range(6)]
    texts = [*good, good[0], None, "", " \n ", cases.prose(random.Random(9), 30_000), f"{good[1]}\n{good[2]}"]
    rows = [(k, t, "en", "s", len(t or ""), k, "g", 1.5) for k, t in enumerate(texts)] + [(3, good[3], "en", "s", 1, 7, "g", 1.5), (None, good[4], None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long, gone string, pattern double")
    for given in (docs, docs.limit(0)):
        n = given.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF).collect()
            if name == "packing":
                assert (not n and not out) or len({r.doc_id for r in out}) == len({r[0] for r in rows})
                continue
            assert len(out) == n if name == "line dedup" else len(out) <= n
            assert not out or list(out[0].asDict()) == docs.columns
            if n and name == "near duplicates":
                assert sorted(r.doc_id for r in out if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7, 10, 11]
            if n and name == "quality rules":
                assert {r.doc_id for r in out} == {0, 1, 2, 3, 4, 5, 6, 10, 11, None}
