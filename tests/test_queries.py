"""Every core query that has SQL gives the same rows in both engines."""

import math

import pytest
from conftest import DATA

from tesserae.queries import core


#: Queries without SQL, and the tests that hold them against brute force or fixtures.
ELSEWHERE = {"parsed_grids": "test_operators", "diversify_exact": "test_operators", "p5_found": "test_units", "p5_values": "test_units"}


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return x


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_rows(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert name in ELSEWHERE, f"{name} has no SQL and no test that stands for it"
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_without_more(spark):
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0
