import pytest
from oracle import of_spark, of_sql

from quarryline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    names, rows = of_spark(QUERIES[name](spark, sf_dir))
    want_names, want = of_sql(ORACLES[name], sf_dir)
    assert names == want_names
    assert rows == want
