"""Cases from arrays, without rows of facts, and leaves as columns."""

import datetime

import pytest

from gavel.plans import registry  # noqa: F401  (loads all plans in their order)
from gavel.operators import evaluate
from gavel.plans import cases, demo_rules, fixtures
from gavel.plans.registry import QUERIES, Tables

SF = "/root/testdata/sf0.001"
#: F15-F19, F25, F26, F29, F30
NAMES = ["rs4_apply_declared_conflicts", "ev2_evaluate_rules", "ev1_evaluate_expression", "p17_any", "p2_present"]


@pytest.mark.parametrize("name", NAMES)
def test_each_table_is_read_once_and_no_row_of_a_fact_is_made(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Window" not in plan and "explode(array_compact" not in plan


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_repeated_orders_missing_keys_and_lines_without_orders(spark, tmp_path):
    day = datetime.datetime(1995, 3, 1)
    orders = [(1, 5.0, "F", "2-HIGH", day), (1, 30.0, "O", None, day), (1, 100.0, "O", "1-URGENT", None), (2, None, "F", "x", day), (None, 7.0, "F", "x", day), (13, 250000.0, None, "é", day), (4, 1.0, "P", "x", day)]
    lines = [(1, 3, 9, 2, 4.0, 1.0, 0.05, "A", day), (1, 2, 8, 1, 1.0, 1.0, None, "R", day), (1, 2, 8, 1, 1.0, 1.0, 0.07, "R", None), (13, 5, 6, 1, 1.0, 1.0, 0.06, None, day), (13, 1, 1, 1, 1.0, 1.0, 0.06, None, day), (99, 1, 1, 1, 1.0, 1.0, 0.0, "A", day), (None, 1, 1, 1, 1.0, 1.0, 0.0, "A", day), (4, 1, 1, None, 1.0, 1.0, 0.0, "A", day)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    want = evaluate.by_case(fixtures.facts(t), fixtures.evidence(t), cases=t.orders.selectExpr("o_orderkey AS case_id"))
    got = rows_of(cases.cases(t))
    assert got == rows_of(want) and len(got) == 5


def test_leaves_as_columns_judge_as_rows_of_parameters_do(spark, monkeypatch):
    rows = cases.cases(Tables(spark, SF)).where("case_id % 4 = 0").localCheckpoint()

    def made():
        return rows_of(evaluate.evaluate_rules(rows, demo_rules.RULES)), rows_of(evaluate.evaluate_expressions(rows, demo_rules.RULES))

    columns = made()
    monkeypatch.setattr(evaluate, "OWN_LEAVES", -1)
    assert columns == made() and len(columns[0]) > 300
