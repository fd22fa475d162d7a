import pytest
from oracle import differences

from inkfield.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, name, QUERIES, ORACLES) == ""
