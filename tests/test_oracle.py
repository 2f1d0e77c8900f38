"""Every registered query against its DuckDB SQL (the driver's correctness gate)."""

import pytest

from chorus.plans.catalog import load_all
from tests.conftest import SF_CHECK
from tests.oracle import compare, duck

CAT = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(n for n, (_f, s) in CAT.items() if s))
def test_matches_oracle(spark, con, name):
    fn, sql = CAT[name]
    compare(spark, fn(spark, SF_CHECK), con, sql)


@pytest.mark.parametrize("name", sorted(n for n, (_f, s) in CAT.items() if not s))
def test_runs_rows_only(spark, name):
    fn, _ = CAT[name]
    assert fn(spark, SF_CHECK).count() > 0
