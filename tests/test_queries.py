"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from syllabica.plans.registry import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
# Checked on fixtures instead: HTML parsing.
ROWS_ONLY = {"readable_text"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(df, ORACLES[name], con) is None
    else:
        assert name in ROWS_ONLY
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
