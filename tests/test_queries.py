"""Registered queries against their SQL. ALL_QUERIES=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from biotables.operators import borders
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "fact_assembly", "table_taxa_quality", "table_expression_share", "rarefy", "bray_curtis", "pcoa_centered",
    "bh_adjust", "size_factors", "box_summary", "contig_depth", "feature_counts", "reads_trim", "scan_directory",
    "bh_adjust_filtered", "log2_ratio_pairs", "nb_wald_moments", "pcoa_check", "reads_concat", "gtf_features", "explode_pathway_lists",
    "fact_from_buckets", "gene_totals_bucketed", "row_reconcile_observed", "quality_flags_observed", "dup_count_observed",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_agrees_with_sql(spark, con, name):
    status, _, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows"), note


@pytest.mark.parametrize("name", ["rarefy", "bh_adjust_filtered", "size_factors"])
def test_small_buckets_give_the_same_rows(spark, con, name, monkeypatch):
    monkeypatch.setattr(borders.with_buckets, "__defaults__", ("__bucket", 100))
    status, _, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_every_query_is_named_and_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 130
