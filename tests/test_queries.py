"""Every registered query at the smallest scale, next to its SQL where it has one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare  # noqa: E402
from checks import ORACLES, QUERIES  # noqa: E402
from conftest import SMALL  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return compare.oracle(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert compare.normal(got).equals(compare.normal(want))
    else:
        assert len(got) > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
