"""Each exact query against its SQL, and what holds for the approximate ones."""

import pytest

from nearloom.plans import catalogue
from tests.compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    assert spark_rows(catalogue.queries()[name](spark, sf_dir)) == sql_rows(duck, catalogue.oracle_sql()[name])


def test_driver_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_plans_push_down_and_take_ordered(spark, sf_dir):
    df = catalogue.queries()["knn_filtered_eq"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan
    grouped = catalogue.queries()["grouped_minby_k3"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in grouped
