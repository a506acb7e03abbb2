"""Every query of the library against its SQL, on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from netloom.plans import queries, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in views.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    made = queries.QUERIES[name](spark, SF)
    names = sorted(made.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in made.collect()), key=repr)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(row[columns.index(c)]) for c in names) for row in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("gone", [("corpus_pipeline", "netloom.llm"), ("netloom.llm",), ("corpus_pipeline",)])
def test_entry_where_they_are_gone(gone):
    """In a process of its own, in which these modules can't be found."""
    code = f"""
import sys
for name in {gone!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
from netloom.plans import queries
assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLE_SQL)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
