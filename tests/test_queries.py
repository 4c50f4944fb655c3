"""Driver queries against their reference SQL at the smallest scale.

The default set covers each group; ``ALL_QUERIES=1`` runs every one.
"""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
CORE = [
    "client_totals", "result_rows", "gate_pass_counts", "classified_carriers", "threshold_projection",
    "batch_union", "allele_frequency", "request_violations", "build_and_strand", "panel_variants",
    "region_lookup", "release_predicate", "release_check", "final_result", "identifier_scan_documents",
    "event_root", "vcf_genotypes", "identifier_scan_events", "number_texts", "broken_chain", "genotypes_read",
]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    query = entry.queries()[name]
    if sql is None:
        assert query(spark, SF_DIR).count() > 0
    else:
        assert compare(spark, con, query, sql, SF_DIR) in ("", "EMPTY on both sides")


def test_genotypes_are_read_back_whole(spark, con):
    query = entry.queries()["genotypes_read_whole"]
    assert compare(spark, con, query, entry.oracle_sql()["genotypes_read_whole"], SF_DIR) == ""
    assert query(spark, SF_DIR).select("chrom").distinct().count() > 2


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
