"""Every registered query of the image engine against its SQL, row for row."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from rasterloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events customer part orders lineitem documents embeddings pages".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return tuple(map(norm, v)) if isinstance(v, (list, tuple, np.ndarray)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(kinds) == columns
    assert all(kinds[c] == TYPES[t] for c, t in df.dtypes if t in TYPES)
    at = [list(kinds).index(c) for c in columns]
    want = Counter(repr(tuple(norm(r[i]) for i in at)) for r in cursor.fetchall())
    assert Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect()) == want


def test_entry_module_lists_every_query(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).limit(1).count() == 1
