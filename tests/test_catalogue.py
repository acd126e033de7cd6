import os

import pytest
from oracle import DATA, same

from stanzaflow.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) ))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.count() > 0 or name == "english_topic_filter"  # all topics of the smallest tables may be foreign


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
