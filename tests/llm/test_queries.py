import os

import pytest
from oracle import DATA, same

from stanzaflow.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
FOUND = {"p1_found": ["doc_id_a", "doc_id_b"], "p2_found": ["doc_id", "first_line", "lang"], "p3_found": ["term", "mark"], "p4_found": ["doc_id"], "p5_found": ["feature_set", "doc_id_a", "doc_id_b"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_columns_and_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert df.count() == df.distinct().count()
    elif name == "p5_neighbours":  # the smallest tables may hold no id divisible by 100
        ids = {r[0] for r in queries.table(spark, DATA, "text_features").where("doc_id % 100 = 0 and features is not null").select("doc_id").collect()}
        assert {r["doc_id"] for r in df.select("doc_id").collect()} <= ids
    else:
        assert df.count() > 0
