"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

from tripweave.plans.oracles import oracle_sql
from tripweave.plans.queries import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    try:
        return round(float(v), 4) + 0.0
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("events", "customer", "supplier"):
        c.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    want = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    names, order = sorted(df.columns), want.columns
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(repr([plain(r[order.index(c)]) for c in names]) for r in want.fetchall())


def test_density_locations_are_numbered_stops(spark):
    """The one query without SQL: labels of a user are cluster0 on, its stops have points, and two runs give the same."""
    assert set(queries()) - set(oracle_sql()) == {"density_locations"}
    rows = queries()["density_locations"](spark, DATA).collect()
    again = queries()["density_locations"](spark, DATA).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for user in {r.user_id for r in rows}:
        own = [r for r in rows if r.user_id == user]
        assert sorted(r.label for r in own) == sorted(f"cluster{i}" for i in range(len(own))) and all(r.n_points > 0 for r in own)
