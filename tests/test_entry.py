import importlib
import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry_and_core_queries_match_sql(spark):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["src", "tgt", "loss", "ppl"]
    con = duckdb.connect()
    for name in ("documents", "events", "embeddings"):
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    from glyphloom.plans import catalog

    sql = catalog.oracle_sql()
    for name, query in catalog.queries().items():
        if name in sql:
            got = query(spark, SMALL).toPandas()
            want = con.sql(sql[name]).df()
            columns = sorted(want.columns)
            assert columns == sorted(got.columns), name

            def rows(df, columns=columns):
                return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))

            assert rows(got) == rows(want), name
