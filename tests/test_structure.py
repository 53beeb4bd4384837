import pytest
from pyspark.sql import functions as F

from scriptorium.operators import structure as st


def test_line_structure(spark):
    lines = ["Chapter 4: Matter", "Definition: mass", "Activity 1: look", "Experiment: heat", "Fill a bucket with water.", "plain words", "", "  Conclusion: done"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, t string").select("k", st.structure_of(F.col("t")).alias("s")).orderBy("k")
    assert [r.s for r in df.collect()] == ["Heading", "Definition", "Activity", "Experiment", "Procedure", "Text", "Text", "Conclusion"]


def test_heading_fixes_and_pick(spark):
    df = st.structured_lines(spark.createDataFrame([("Propeties of Matier",), ("",), (None,)], "text string"))
    rows = df.collect()
    assert rows[0].fixed_text == "Properties of Matter" and rows[0].structure == "Heading" and rows[0].boost == pytest.approx(0.12)
    assert rows[1].boost == 0 and rows[2].fixed_text is None
    cand = F.array(F.struct(F.lit("propeties of matier").alias("text"), F.lit(0.75).alias("visual_confidence")), F.struct(F.lit("Properties of Matter").alias("text"), F.lit(0.85).alias("visual_confidence")))
    assert st.pick_by_structure(df.limit(1).withColumn("candidates", cand)).first().picked_text == "Properties of Matter"


@pytest.mark.parametrize(
    ("raw", "fixed", "topic"),
    [
        ("Us is made of matte EartethaGaAEeu exists in 3 states", "Everything around us is made of matter. Matter exists in three states: solid, liquid and gases.", "matter"),
        ("Eil Jueket with water Take ang tempt braille", "Fill a bucket with water. Take an empty bottle with its mouth facing downwards.", "matter"),
        ("Matrials which light does pass atall thccaldbd is Opaque", "Materials through which light does not pass at all are called Opaque.", "optics"),
    ],
)
def test_reconstruction(spark, raw, fixed, topic):
    row = st.reconstruct(spark.createDataFrame([(raw,)], "text string")).first()
    assert row.recon_text.startswith(fixed) and row.topic == topic and row.recon_confidence == 0.96
    e = row.recon_edits[0]
    assert raw[e.begin : e.stop] == e.original


def test_subjects(spark):
    rows = [("Properties of Matter", "matter exists in solid liquid and gases", "Science"), ("Algebra", "Solve the equation. The area of the triangle", "Mathematics"), ("", "nothing here", "General")]
    df = st.subject(spark.createDataFrame(rows, "title string, text string, want string"), "text", "title")
    for r in df.collect():
        assert r.subject == r.want
        assert r.subject_confidence >= (0.70 if r.want != "General" else 0.5)
    assert st.subject(df.select("text"), override="Physics").first().subject_confidence == 1.0
