"""A cross-section of the registered queries against DuckDB at sf0.001 (``tests/oracle.py`` runs all of them)."""
import os

import pytest

from oracle import compare, duck

ROOT = "/root/testdata/sf0.001"
SAMPLE = ["F1_best_candidate", "F6_compare_strategies", "C3_find_overlaps", "C1_C2_assign_speakers", "E9_smooth_turns", "D6_alignment_metrics", "H20_uncertain_spans", "H24_mine_terms",
          "H26_merge_term_base", "H35_cluster_quality", "H44_apply_gates", "H48_normalize_corpus", "I1_metric_windows", "H52_lineage"]


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees(spark, name):
    from chorale.plans import QUERIES

    text, ok, _ = compare(QUERIES[name], spark, duck(ROOT), ROOT)
    assert ok, text


def test_every_query_is_listed():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150
