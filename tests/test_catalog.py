"""Queries against their SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

from quillmark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "~"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        try:
            return f"{float(v):.5f}"
        except (TypeError, ValueError):
            return str(v).replace(" 00:00:00", "")

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["s1_results_scan", "s2_truth_scan", "s5_result_sink", "s7_rescore", "s8_graded_sink", "p1_flatten", "p2_display", "f12_diagnostics", "n15_requests", "r15_questions", "e3_segments", "g7_list_recall", "a17_finding_counts", "a19_drift", "v6_contacts", "s3_page_scan", "n4_segments", "r5_rank_fusion", "r6_field_top", "r14_selection", "e4_page_pairs", "e6_status", "e8_pooled", "g1_presence", "g2_dates", "a4_multi_grain", "a13_agreement", "a20_by_model", "n16_fold_system", "m1_incremental", "m1_chain", "n19_nested", "n6_grammar", "v2_text_conflicts", "v4_rules", "v5_text_weights", "v5_text_minimum", "a13_ratio", "a13_disagreements", "p2_typed", "q2_nested", "s9_file_drift", "p7_reasons", "a4_document_grain", "a6_latency", "a20_answers", "f13_both_bounds", "r4_vector_rank", "r5_all_fields", "r8_part_fields", "a12_run_costs", "a15_page_tiles"])
def test_query_equals_its_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(catalog.ORACLES[name]).df())
