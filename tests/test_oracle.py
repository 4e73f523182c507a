"""Every query that has SQL gives the same rows as another engine on sf0.001."""

import importlib
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = {}, {}
for module in map(importlib.import_module, entry.PLANS):
    QUERIES.update(module.queries())
    SQL.update(module.oracle_sql())


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, other, name, tmp_path):
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got, expected = other.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'"), other.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert dict(zip(got.columns, map(str, got.types), strict=True)) == dict(zip(expected.columns, map(str, expected.types), strict=True))
    chosen = ", ".join(f'"{c}"' for c in columns)
    assert plain(other.sql(f"SELECT {chosen} FROM '{tmp_path}/out/*.parquet'").fetchall()) == plain(other.sql(f"SELECT {chosen} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_training_data_operators(tmp_path):
    """With those folders deleted (and the pipeline there or not) the entry still gives all other queries."""
    root = Path(entry.__file__).parent
    for n, gone in enumerate((("quantalog/llm",), ("quantalog/llm", "corpus_pipeline.py"))):
        copy = tmp_path / str(n)
        shutil.copytree(root, copy, ignore=lambda folder, names, gone=gone: {x for x in names if x.startswith(".") or str(Path(folder, x).relative_to(root)) in gone})
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert said.stdout.split() == [str(len(QUERIES)), str(sum(bool(s) for s in SQL.values()))], said.stderr
