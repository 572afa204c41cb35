"""A sample of the registered queries against their SQL on the smallest tables.

`python tests/compare.py` runs all of them (SF_DIR chooses the tables).
"""
import pytest

import __spark_entry__ as entry
from compare import compare, duck

DIR = "/root/testdata/sf0.001"
SAMPLE = ["src_panel", "snk_pred", "chk_panel", "cal_gregord", "gap_weeks", "prep_winsor_fit", "wk_anchor", "roll_slope",
          "lag_slope", "score_lags", "asof_gap", "clim_woy_join", "scal_season", "idx_proxy7", "idx_spei_test", "split_purged",
          "split_hot", "sel_calibrate", "wt_combine", "met_bias", "met_cluster_avg", "bl_candidates", "eda_ks", "eda_lagcorr",
          "eda_transition", "ml_archetype", "split_random", "ml_kmeans_profile"]


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    ok, message = compare(spark, con, DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_query_is_named_once_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0
