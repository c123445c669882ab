"""Every registered query against its checking SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
import check_oracles
from lumenwatch.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check_oracles.database(FOLDER)


#: Queries that have no rows on the smallest data, where no window is past its warm-up.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    problem = check_oracles.compare(spark, db, catalog.QUERIES[name], catalog.ORACLES.get(name), FOLDER)
    assert problem is None or (name in MAY_BE_EMPTY and problem in ("both empty", "no rows"))


def test_entry_has_scored_windows(spark):
    df = entry.entry(spark)
    assert {"service_name", "anomaly_score", "severity"} <= set(df.columns)
    assert df.count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
