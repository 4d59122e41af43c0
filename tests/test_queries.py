"""Every registered ledger query against its SQL."""

import os

import duckdb
import pytest

from tallyforge.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, DATA)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = ", ".join(f'"{c}"' for c in columns)
    assert norm(tuple(r) for r in got.select(*columns).collect()) == norm(db.sql(f"SELECT {text} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_lock_hints_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Lines with the same number and part, which the SQL's order leaves open, give the same in either order of the file."""
    lines = [(1, 5, 2, 1, 30.0, 0.05, "A", "O"), (1, 5, 3, 1, 10.0, 0.01, "A", "O"), (2, 5, 4, 1, 30.0, 0.05, "A", "O"), (2, 5, 7, 1, 25.0, 0.01, "A", "O"), (2, 6, 9, 1, 8.0, 0.01, "A", "O")]
    got = []
    for k, rows in enumerate((lines, lines[::-1])):
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got.append({r["lock"]: r["n"] for r in registry.queries()["lock_hints"](spark, f"{tmp_path}/{k}").collect()})
    assert got[0] == got[1] and sum(got[0].values()) == len(lines)
