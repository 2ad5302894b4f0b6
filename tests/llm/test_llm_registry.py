"""What is registered, and the queries that SQL can express against it."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from millrace.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        frame = frame[columns].astype(object)
        return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want) and len(got)


def test_all_are_registered():
    names = entry_module.queries()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLE) <= set(entry_module.oracle_sql())
