"""Every registered query against its SQL, on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict.startswith(("ok", "rows only")), verdict
