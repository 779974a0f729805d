"""Every named query against the same in DuckDB."""

import os

import duckdb
import pytest

from foliant.plans import catalogue, reports, rules  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_the_entry_imports_and_names_every_query():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")
def test_rerunnable_files_reads_every_run(spark):
    by = {}
    for r in reports._runs(spark, DIR).collect():
        by.setdefault((r.user_id, r.k), []).append((r.ts, r.event_id, r.status))
    want = {(*key, max(own)[2], len(own)) for key, own in by.items() if all(x[2] != "succeeded" for x in own) and max(own)[2] in ("failed", "interrupted")}
    assert want and {tuple(r) for r in catalogue.QUERIES["rerunnable_files"](spark, DIR).collect()} == want
