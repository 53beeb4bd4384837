"""Registration of queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def replaced(expr: str, rules: Iterable[tuple[str, str]], flags: str = "gi") -> str:
    """Nested replacements; $1 becomes \\1."""
    for p, to in rules:
        expr = f"regexp_replace({expr}, {quoted(p)}, {quoted(to.replace('$', chr(92)))}, '{flags}')"
    return expr


def stripped(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def words_of(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda w: w <> '')"


def unequal(expr: str) -> str:
    return f"NOT regexp_matches({expr}, '\\S')"


#: notebook texts in which every lexicon has something to find
NOTES = (
    "Us is made of matte EartethaGaAEeu exists in 3 states",
    "Eil Jueket with water Take ang tempt braille",
    "Matrials which light does pass atall thccaldbd is Opaque",
    "Chapter 4: Propeties of Matier\nDefinition: matter is called anything with mass\nActivity 1: Fill a buoket with water\nExperiment: heat the liquid\n- measure the volume",
    "Science notes: opaqe and translucnt materials block light in a shadow experiment",
    "Solve the linear equation for x. Calculate the perimeter and area of the triangle.",
    "Force equals mass times acceleration. Velocity is displacement divided by time.",
    "An algorithm is a step by step set of instructions. Loops execute repeatedly in python code.",
    "ans: yes i have seen the rainbow ?\nwhich skv is yellov\nthere is seven colors in sky\nAns; no they is here",
    "The implomentation of froin document has a hand-\nwritten story.The sky is blue.. Is it ?? Yes,, it is !",
    "What is the color of the sky\nHowever the boy road a bicycle. He dont like the students book. The sky turned blue The sun is shining",
    "",
)
FIRST_NOTE = 1_000_000_000_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the notes: doc_id, text."""
    notes = spark.createDataFrame([(FIRST_NOTE + k, t) for k, t in enumerate(NOTES)], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").union(notes)


def sql_text(s: str) -> str:
    return " || chr(10) || ".join(quoted(x) for x in s.split("\n"))


CORPUS = "corpus AS (SELECT doc_id, text FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT CAST({FIRST_NOTE + k} AS BIGINT), {sql_text(t)}" for k, t in enumerate(NOTES)) + ")"
LINES = CORPUS + ", lines AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS body FROM corpus)"
#: document lines as regions of a page, with sizes, confidences and types that follow from place and length
REGIONS = (
    LINES
    + """, regions AS (SELECT doc_id, CAST(line AS INT) AS region_id, body AS text, CAST(20 + (line * 7) % 40 AS INT) AS xmin, CAST(line * 30 + (line % 4) * 9 AS INT) AS ymin,
    CAST(20 + (line * 7) % 40 + least(length(body) * 6, 900) AS INT) AS xmax, CAST(line * 30 + (line % 4) * 9 + 14 + (line % 3) * 6 AS INT) AS ymax,
    CASE line % 9 WHEN 1 THEN 'Title' WHEN 4 THEN 'Section-header' WHEN 7 THEN 'List-item' WHEN 8 THEN 'Table' ELSE 'Text' END AS region_type,
    round(0.35 + ((doc_id + line * 13) % 61) / 100.0::DOUBLE, 4) AS confidence, round((line % 20) / 100.0::DOUBLE, 4) AS ink_density FROM lines)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "body")).withColumn("line", F.col("line") + 1)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line")
    own = lines(spark, sf_dir)
    x, y = 20 + (n * 7) % 40, n * 30 + (n % 4) * 9
    kind = F.when(n % 9 == 1, "Title").when(n % 9 == 4, "Section-header").when(n % 9 == 7, "List-item").when(n % 9 == 8, "Table").otherwise("Text")
    return own.select(
        "doc_id", n.alias("region_id"), F.col("body").alias("text"), x.alias("xmin"), y.alias("ymin"), (x + F.least(F.length("body") * 6, F.lit(900))).alias("xmax"), (y + 14 + (n % 3) * 6).alias("ymax"),
        kind.alias("region_type"), F.round(0.35 + ((F.col("doc_id") + n * 13) % 61) / 100.0, 4).alias("confidence"), F.round((n % 20) / 100.0, 4).alias("ink_density"),
    )
