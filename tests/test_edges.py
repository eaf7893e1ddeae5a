"""Hand panels: warm-up boundaries, flat prices, zero ranges and volumes, single codes and dates, odd fundamentals."""
import datetime

import pytest
from pyspark.sql import functions as F

from panelwright.operators import cleaning, evaluation, factors, portfolio, strategies
from panelwright.sources import panels

D = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
SCHEMA = "date date, code string, open double, high double, low double, close double, volume double"


def flat(spark, n=30, price=10.0, volume=0.0, code="a"):
    return spark.createDataFrame([(D(i), code, price, price, price, price, volume) for i in range(n)], SCHEMA)


def last(df, *names):
    return df.orderBy(F.col("date").desc()).select(*names).first()


def test_flat_prices_and_no_volume(spark):
    names = ["calc_rsi", "calc_rsi_6d", "calc_mfi_14d", "calc_money_flow_6d", "calc_open_vol_corr_10d", "calc_williams_r_smoothed_6d", "calc_cci_12d", "calc_volume_ratio", "calc_vwap_deviation", "calc_amihud", "calc_hv", "calc_obv", "calc_shadow_ratio_20d", "calc_up_down_vol_ratio_26d"]
    got = last(factors.with_factors(flat(spark), names), *names).asDict()
    assert got["calc_rsi"] == 50.0 and got["calc_hv"] == 0.0 and got["calc_obv"] == 0.0
    for n in ("calc_rsi_6d", "calc_mfi_14d", "calc_money_flow_6d", "calc_open_vol_corr_10d", "calc_williams_r_smoothed_6d", "calc_cci_12d", "calc_volume_ratio", "calc_vwap_deviation", "calc_amihud", "calc_shadow_ratio_20d", "calc_up_down_vol_ratio_26d"):
        assert got[n] is None, n


@pytest.mark.parametrize("extra,known", [(-1, False), (0, True), (1, True)])
def test_warm_up_boundary(spark, extra, known):
    df = spark.createDataFrame([(D(i), "a", 1.0 + i, 2.0 + i, 1.0, 1.5 + i, 10.0 + i) for i in range(20 + extra)], SCHEMA)
    assert (last(factors.with_factors(df, ["calc_volume_vol_20d"]), "calc_volume_vol_20d")[0] is not None) == known


def test_null_gap_blocks_a_full_window(spark):
    df = spark.createDataFrame([(D(i), "a", 1.0, 2.0, 0.5, None if i == 5 else 1.0 + i, 10.0) for i in range(14)], SCHEMA)
    got = [r[0] is None for r in factors.with_factors(df, ["calc_ma_slope_6d"]).orderBy("date").select("calc_ma_slope_6d").collect()]
    assert got == [True] * 12 + [False] * 2


def test_negative_and_zero_ratios(spark):
    df = flat(spark, 1).withColumns({"pe": F.lit(-3.0), "pb": F.lit(0.0)}).unionByName(flat(spark, 1, code="b").withColumns({"pe": F.lit(4.0), "pb": F.lit(0.5)}))
    got = {r["code"]: (r["calc_ep"], r["calc_bp"]) for r in factors.with_factors(df, ["calc_ep", "calc_bp"]).collect()}
    assert got == {"a": (None, None), "b": (0.25, 2.0)}


def test_one_code_and_one_date(spark):
    one = flat(spark, 30, volume=5.0)
    made = evaluation.forward_returns(one, (1,))
    assert evaluation.ic(made, ["close"], (1,), min_obs=1).filter("ic is not null").count() == 0
    assert evaluation.quantile_returns(made, ["close"], (1,)).count() == 0
    assert strategies.get_strategy("gtja_momentum")(one).filter("signal <> 0").count() == 0
    day = spark.createDataFrame([(D(0), c, 1.0, 1.0, 1.0, float(k), 1.0) for k, c in enumerate("abcdef")], SCHEMA)
    assert factors.with_factors(day, ["calc_candle_body_vol_composite"]).filter("calc_candle_body_vol_composite is not null").count() == 0
    layers = evaluation.size_liquidity_layers(day.withColumns({"circ_mv": F.lit(1.0), "turnover_rate": F.when(F.col("code") != "a", F.col("close"))}))
    got = {r["code"]: (r["size_layer"], r["liq_layer"]) for r in layers.collect()}
    assert len({v[0] for v in got.values()}) == 1 and got["a"][1] is None and got["f"][1] == "high"


def test_missing_price_gives_no_shares(spark):
    s = spark.createDataFrame([(D(0), "a", 1, 1.0), (D(0), "b", 1, 1.0), (D(0), "c", -1, 1.0)], "date date, code string, signal int, confidence double")
    p = spark.createDataFrame([(D(0), "a", 12.5)], "date date, code string, close double")
    got = {r["code"]: (r["weight"], r["shares"]) for r in portfolio.equal_weight(s, p, 10_000).collect()}
    assert got == {"a": (0.5, 400), "b": (0.5, 0)}
    half = spark.createDataFrame([(D(0), 0.5)], "date date, exposure double")
    assert {r["shares"] for r in portfolio.equal_weight(s, p, 10_000, half).collect()} == {200, 0}


def test_duplicate_signals_and_universe(spark):
    s = spark.createDataFrame([(D(0), "a", 1, 0.9), (D(0), "a", -1, 0.8), (D(0), "b", -1, 0.7)], "date date, code string, signal int, confidence double")
    assert sorted((r["code"], r["signal"]) for r in cleaning.enforce_t1(s).collect()) == [("a", 0), ("a", 1), ("b", -1)]
    assert cleaning.resolve_universe({"source": "list", "codes": ["b", "a", "b"], "filters": {"exclude_st": True}}, st_codes=["a"]) == ["b"]
    with pytest.raises(ValueError):
        cleaning.resolve_universe({"source": "moon"})
    assert cleaning.build_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_panels_have_one_row_a_key(spark):
    for make in (panels.bars, panels.bucket_bars, panels.user_bars, panels.flows):
        df = make(spark, "/root/testdata/sf0.001")
        assert df.count() == df.select("date", "code").distinct().count() > 0
        if "low" in df.columns:
            assert df.filter("low > least(open, close) or high < greatest(open, close)").count() == 0
