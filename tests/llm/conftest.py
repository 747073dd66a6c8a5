import os

import duckdb
import pytest

from parchment.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def same_as_sql(spark):
    """Holds a registered query against its SQL, on the tables given or a folder's."""

    def check(name, tables=None, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}/**/*.parquet'" if os.path.isdir(f"{folder}/{f}") else f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
        df, sql = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
        columns = sorted(df.columns)
        assert sorted(sql.columns) == columns
        rows = [tuple(r[c] for c in columns) for r in df.collect()]
        at = [sql.columns.index(c) for c in columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[k] for k in at)) for r in sql.fetchall())
        return rows

    return check
