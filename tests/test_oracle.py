"""Every query with an oracle gives the same rows as DuckDB (sf0.001)."""
import math

import pytest

import __spark_entry__ as E
from tessera.plans.catalog import ORACLE, load_all

from .conftest import SF_SMALL

load_all()
SQL = dict(ORACLE)      # the training-data queries have tests of their own


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    assert _rows(got) == _rows(want)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["token", "n"]
    assert 0 < df.count() <= 10
