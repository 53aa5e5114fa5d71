"""The queries that SQL can express give the rows of their SQL."""

import pytest
from oracle import differences

from granella.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    assert differences(spark, queries.queries(), queries.oracle_sql(), name, sf) == ""
