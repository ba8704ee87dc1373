import pytest
from oracle import compare

from millrace.plans import catalog

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(spark, name):
    compare(catalog.queries()[name](spark, ROOT), catalog.oracle_sql()[name], ROOT)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
