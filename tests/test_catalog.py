"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from scriptorium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    else:
        assert got


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """In a copy without the optional part, and with one whose imports fail, the other queries stay."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.json", "*.md"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tx_recover' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
