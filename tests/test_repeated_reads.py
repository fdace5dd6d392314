"""Queries on tables whose reads share their names."""

import duckdb

from helixgrid.plans import catalog


def _agrees(spark, folder, name):
    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.sql(f"create view {t.stem} as select * from '{t}'")
    rel = con.sql(catalog.SQL[name])
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, str(folder)).select(*rel.columns).collect())
    assert got == sorted(repr(tuple(x)) for x in rel.fetchall())
    return got


def test_reads_without_umi_and_of_one_name_are_molecules_each(spark, tmp_path):
    # 11, 22: no UMI.
    rows = [(11, 5, 1, 1), (11, 5, 1, 1), (11, 45, 1, 1), (22, 5, 1, 2), (3, 5, 1, 1), (3, 5, 1, 1), (4, 5, 1, 1)]
    duckdb.sql(f"copy (select * from (values {', '.join(map(str, rows))}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber)) to '{tmp_path}/lineitem.parquet'")
    assert _agrees(spark, tmp_path, "umi_correct_count") == ["(1, 5, 6, 7)"]


def test_pairs_are_the_reads_of_two_lines(spark, tmp_path):
    # Two mates, one line, two first mates, two mates and a repeated one.
    rows = [(1, 3, 1, 1, 5.0), (1, 3, 1, 2, 6.0), (2, 3, 1, 1, 5.0), (3, 3, 1, 1, 5.0), (3, 3, 1, 1, 5.0), (4, 3, 1, 5, 2.0), (4, 8, 1, 6, 3.0), (4, 3, 1, 5, 2.0), (91, 3, 1, 1, 5.0), (91, 8, 1, 2, 5.0)]
    duckdb.sql(f"copy (select l_orderkey::bigint l_orderkey, l_partkey::bigint l_partkey, l_suppkey::bigint l_suppkey, l_linenumber, l_quantity::double l_quantity from (values {', '.join(map(str, rows))}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)) to '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"copy (select range p_partkey, 1 p_size from range(20)) to '{tmp_path}/part.parquet'")
    assert len(_agrees(spark, tmp_path, "gene_resolution_pairs")) == 3
    mates = catalog.QUERIES["gene_resolution_pairs"](spark, str(tmp_path))
    assert "LeftSemi" not in mates._jdf.queryExecution().executedPlan().toString()
