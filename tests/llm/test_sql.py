"""Operators' queries against their SQL over whole tables."""

import duckdb

from helixgrid.llm.queries import oracle_sql, queries


def test_queries_with_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf_dir)
        rel = con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(x[i] for i in at) for x in rel.fetchall())
