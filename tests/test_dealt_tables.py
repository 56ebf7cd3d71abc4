"""Tables dealt by a key into parts of bounded size, and audits of ledgers that work part by part."""

import pytest
from pyspark.sql import functions as F

from gavel.plans import registry  # loads all plans in their order
from gavel.plans import governance
from gavel.plans.registry import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(registry, "PART", 1000, raising=False)


def test_dealt_keeps_rows_and_keys_together(spark, small_parts):
    plain = Tables(spark, SF)
    dealt = plain.dealt(lineitem="l_orderkey")
    assert dealt.lineitem.exceptAll(plain.lineitem).isEmpty() and plain.lineitem.exceptAll(dealt.lineitem).isEmpty()
    parts = dealt.lineitem.select("l_orderkey", F.spark_partition_id().alias("part"))
    assert parts.groupBy("l_orderkey").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] < 3 * registry.PART
    assert dealt.orders.count() == plain.orders.count()


def test_dealt_empty_table(spark, tmp_path):
    Tables(spark, SF).lineitem.limit(0).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert Tables(spark, str(tmp_path)).dealt(lineitem="l_orderkey").lineitem.isEmpty()


def test_no_task_takes_more_entries_than_a_part(spark, small_parts):
    found = governance.lg9(Tables(spark, SF)).where("sequence is not null").groupBy(F.spark_partition_id()).count()
    assert found.agg(F.max("count")).first()[0] < 3 * registry.PART


@pytest.mark.parametrize("query, reads", [(governance.lg9, 2), (governance.lg11, 1), (governance.lg12, 1)])
def test_lines_are_shuffled_by_their_key_alone(spark, query, reads):
    plan = query(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("REPARTITION_BY_NUM") == reads
