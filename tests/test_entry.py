"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["docs_by_format", "longest_suffix_resolution", "reference_disambiguation", "document_degrees", "bfs_hops", "narrowed_budget", "ttl_rate_limit", "snapshot_merge"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([clean(v) for v in r]) for r in df.select(*cols).collect()) == sorted(repr([clean(r[i]) for i in at]) for r in want.fetchall())
