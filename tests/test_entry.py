"""The driver's contract, and a sample of queries against their SQL."""
import datetime
import math
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else v


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150 and len(oracle) > 120


@pytest.mark.parametrize("name", ["ic_spearman", "factor_macd_like", "factor_high_vol_rank_corr_3d", "rank_hold_multifactor", "industry_cap", "suspension_grid", "quality_panel", "pair_half_life", "weighted_vote", "position_limit", "smooth_with_exposure", "backtest_trades", "walk_forward", "monitor_update", "pit_surprise", "detect_regime", "op_sma_slow", "select_tradable", "fundamental_filter", "ic_kendall", "state_timeline", "factor_health", "null_histogram", "full_diagnosis", "rebalanced_positions", "compare_backtests", "phase_a_single"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
