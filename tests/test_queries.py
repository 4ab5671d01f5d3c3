"""Every registered query of the library against its SQL twin on the smallest tables."""

import pytest
from comparing import SF, rows_of

from gaugeworks.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_cycles_close(spark):
    for row in QUERIES["gr2_cycles"](spark, SF).collect():
        assert row["cycle"][0] == row["cycle"][-1] and len(row["cycle"]) > 2


def test_flagship_has_rows(spark):
    assert FLAGSHIP(spark, SF).count() > 0
