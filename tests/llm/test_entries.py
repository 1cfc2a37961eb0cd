import pytest

import __spark_entry__
from tonguemix.llm import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_queries_agree_with_sql(same_as_sql, name):
    same_as_sql(entries.QUERIES[name], entries.ORACLE_SQL[name])


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
