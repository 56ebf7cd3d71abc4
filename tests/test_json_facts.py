"""Facts from JSON documents: texts beyond ASCII, and plans that stay small."""

from pyspark.sql import functions as F

from gavel.plans import registry
from gavel.sources import facts as json_facts

SF = "/root/testdata/sf0.001"


def test_values_of_each_type(spark):
    docs = spark.createDataFrame([(1, '{"a":"ﬁ  x","n":"-0","d":"2024-02-30","x":{"0":[1,null]}}'), (2, '{"a":7,"n":1.50,"b":true,"d":"2024-02-29"}'), (3, "no JSON"), (4, None)], "case_id long, body string")
    kinds = {"a": "STRING", "n": "NUMBER", "b": "BOOLEAN", "d": "DATE", "x": "JSON"}
    got = json_facts.observations_from_json(docs, [{"key": k, "type": t, "pointers": [f"/{k}"]} for k, t in kinds.items()])
    seen = {(r.case_id, r.fact_key): (r.status, r.value, len(r.evidence)) for r in got.collect()}
    assert [seen[1, k] for k in kinds] == [("RESOLVED", "fi x", 1), ("RESOLVED", "0.0", 1), ("NOT_FOUND", None, 0), ("NOT_READABLE", None, 1), ("RESOLVED", '{"0":[1,null]}', 1)]
    assert [seen[2, k] for k in kinds] == [("NOT_READABLE", None, 1), ("RESOLVED", "1.5", 1), ("RESOLVED", "true", 1), ("RESOLVED", "2024-02-29", 1), ("NOT_FOUND", None, 0)]
    assert all(seen[c, k] == ("NOT_FOUND", None, 0) for c in (3, 4) for k in kinds)


def test_no_filter_reads_the_documents_again(spark):
    plan = registry.QUERIES["src2_materialize_observations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.split("\n") if "Filter" in line[:40]) < 1_000
    assert len(plan) < 200_000


def test_observations_are_read_once_and_stay_off_the_driver(spark):
    plan = registry.QUERIES["src2_materialize_observations"](spark, SF)._jdf.queryExecution()
    assert "orders.parquet" not in plan.toString() and "Broadcast" not in plan.executedPlan().toString()
