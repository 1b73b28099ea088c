"""Every registered query against its SQL on the small tables, order aside."""

import functools
import os

import duckdb
import pytest

from evidentia import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def built_once():
    """The written tables that most queries begin with are made once for all of them."""
    with pytest.MonkeyPatch.context() as m:
        for name in ("chunk_table", "hits", "selected"):
            m.setattr(queries, name, functools.cache(getattr(queries, name)))
        yield


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sql.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(columns).collect())
    assert got == sorted(repr(tuple(map(norm, r))) for r in want.select(", ".join(columns)).fetchall())


def test_the_engine_stands_alone():
    """Nothing outside the training-data subpackage imports it."""
    root = os.path.dirname(os.path.abspath(queries.__file__))
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "evidentia.llm" not in open(os.path.join(folder, n)).read()
