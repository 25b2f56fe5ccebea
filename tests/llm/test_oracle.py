import os

import pytest

from chandas.llm import queries, sql
from tests import oracle


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_rows(spark, name):
    oracle.same_rows(spark, queries.QUERIES[name], sql.SQL[name])
