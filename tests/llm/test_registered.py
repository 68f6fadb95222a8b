"""The registered queries: SQL where there is some, and what the entry module lists."""

import pytest

import __spark_entry__ as entry
from burnish.llm.queries import oracle_sql, queries
from test_base_queries import SF, same_rows


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_sql(spark, name):
    same_rows(queries()[name](spark, SF), oracle_sql()[name])


def test_registered():
    listed = entry.queries()
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries()) | {"pipeline"} <= set(listed) and set(entry.oracle_sql()) <= set(listed)


def test_native_plans(spark):
    """What is to be native runs no Python on the executors."""
    for name in ("op3_chat_format", "op5_mixing", "op8_decontaminate", "op9_url_filter"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
