"""The facts of cases, without a scan for each fact."""

from gavel.plans import registry  # noqa: F401  (loads all plans in their order)
from gavel.plans import fixtures
from gavel.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_one_scan_gives_the_facts_of_the_sql(spark):
    t = Tables(spark, SF)
    rows = t.sql(fixtures.CASE_FACTS)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    want = t.sql(fixtures.FACTS).select(*rows.columns)
    assert rows.exceptAll(want).count() == 0 and want.exceptAll(rows).count() == 0 and rows.count() > 10_000
