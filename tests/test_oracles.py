"""Queries of the library against their SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["sc1_normalize_text", "sc8_compare_utc", "sc21_json_pointer", "sc23_compare_semver", "p10_between", "ev2_evaluate_rules", "lg2_state_as_of", "lg5_resolve_pack", "bm1_extraction_counts", "ca3_risk_coverage", "dq4_relationship_check", "rg4_retrieve_topk", "gr1_override_cycles", "lg4_validate_activations", "lg9_validate_card_ledger", "lg11_card_eligibility", "ev5_check_rule_binding", "rt6_check_fixtures", "src3_artifact_inventory", "src4_read_json_collection", "au2_check_run_graph", "snk4_snapshot_export", "sc17_normalize_utc", "sc19_content_hash", "lg3_validate_transitions", "lg13_validate_versions", "lg14_verify_hash_chain", "dq1_collection_counts", "sca_scan_sensitive", "snk2_append_idempotent", "au5_exportable", "rs1_check_finding_map", "p7_matches", "p15_same_visual_area", "ev1_evaluate_expression", "ev7_pack_snapshots", "ev8_evaluate_versions", "ev9_verify_findings", "rs2_validate_override_edges", "rs6_resolve_findings", "rt1_run_rule_tests", "gr1_pack_cycles", "gr2_pack_components", "gr3_pack_levels", "rg4_scoped_topk", "snk3_decision_batches", "snk2_expiring_keys", "lg7_span_overlaps", "lg8_card_state", "lg12_rule_eligibility", "st1_idempotent_ingest", "st2_chain_check"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, tmp_path, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    con.sql("create table want as " + entry.oracle_sql()[name])
    entry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    con.sql(f"create table got as select * from '{tmp_path}/out/*.parquet'")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
