import duckdb
import pytest

from edgelight.llm import queries


@pytest.mark.parametrize("name", ["op3_suffix_array_dedup", "op4_odd_sketch_near_dup", "op5_suffix_tree_dedup", "op7_lattice_near_dup", "op11_filter_audit", "op12_blob_ledger", "op13_prefix_trie"])
def test_query_agrees_with_sql(spark, small, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        duck.sql(f"create view {table} as select * from '{small}/{table}.parquet'")
    relation = duck.sql(queries.ORACLE_SQL[name])
    frame = queries.QUERIES[name](spark, small)
    names = sorted(frame.columns)
    assert sorted(relation.columns) == names
    at = [relation.columns.index(n) for n in names]
    got = sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
