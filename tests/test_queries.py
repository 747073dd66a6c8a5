"""Every query with SQL, side by side with DuckDB on the smallest tables; and the driver entry."""

import datetime
import decimal
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from parchment.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(r[k]) for k in at)) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The other queries are there when the subpackage and its pipeline aren't."""
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py",):
        os.symlink(os.path.join(repo, name), tmp_path / name)
    (tmp_path / "parchment").mkdir()
    for name in os.listdir(os.path.join(repo, "parchment")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(repo, "parchment", name), tmp_path / "parchment" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'batch_matrix_cells' in q and not [n for n in q if n.startswith('op')], q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
