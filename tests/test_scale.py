"""What crosses exchanges, and what one task or group holds."""
from __future__ import annotations

import datetime
import re

import pytest

from panelwright.operators import backtest, evaluation, factors
from panelwright.operators import timeseries as ts

D0 = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(D0 + datetime.timedelta(days=i), f"{c:06d}", 10.0 + c, 12.0 + c, 9.0, 10.0 + (i * (c + 3)) % 7, 100.0 * (1 + (i + c) % 5)) for c in range(6) for i in range(40)]
    return spark.createDataFrame(rows, "date date, code string, open double, high double, low double, close double, volume double")


def _widths(df) -> list[int]:
    """Columns that each exchange of the plan carries."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [int(n) for n in re.findall(r"Exchange\s*\nInput \[(\d+)\]", df._jdf.queryExecution().explainString(mode))]


def test_exchanges_carry_inputs_and_ranks_only(panel):
    names = [n for n in factors.list_factors(kind="single") if factors.get_spec(n).alias_of is None and set(factors.get_spec(n).needs) <= set(factors.BARS)]
    widths = _widths(factors.with_factors(panel, names).select("date", "code", *names))
    assert len(names) > 40 and len(widths) >= 5 and max(widths) <= 30, widths


def test_rank_correlations_cross_one_exchange_as_wide_rows(panel):
    """Rows are not multiplied by factors and windows before they are moved; ties, nulls and NaN rank as ``rank_pct`` ranks them."""
    from pyspark.sql import functions as F

    made = evaluation.forward_returns(factors.with_factors(panel, ["calc_momentum_5d_change", "calc_volume_ratio"]), (1, 5))
    made = made.withColumn("calc_volume_ratio", F.when(F.col("code") == "000002", float("nan")).when(F.col("code") != "000003", F.col("calc_volume_ratio")))
    names, windows, keys = ["calc_momentum_5d_change", "calc_volume_ratio"], (1, 5), ["date", "factor", "fwd_window"]
    got = evaluation.ic(made, names, windows, min_obs=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    pairs = evaluation.long_pairs(made, names, windows).withColumns({"x": ts.rank_pct("x", keys), "y": ts.rank_pct("y", keys)})
    want = {tuple(r[k] for k in keys): (r["c"], r["n"]) for r in pairs.groupBy(*keys).agg(evaluation.pearson("x", "y").alias("c"), F.count("*").alias("n")).filter("n >= 3").collect()}
    rows = {tuple(r[k] for k in keys): (r["ic"], r["n"]) for r in got.collect()}
    assert len(want) > 90 and rows.keys() == want.keys()
    for k, (c, n) in want.items():
        assert rows[k][1] == n and rows[k][0] == (None if c is None else pytest.approx(c, abs=1e-9)), k


def test_a_run_holds_prices_of_codes_with_shares_only(panel):
    """Signals may spread the capital over any number of codes; those that get no lot are in no group."""
    from pyspark.sql import functions as F

    class Counting(backtest.Engine):
        def play(self, days, targets, prices, *_, **__):
            return [], [(d, float(len(prices.get(d, {}))), float(len(targets.get(d, {}))), 0.0, 0.0) for d in days]

    positions = panel.select(F.lit("r").alias("run_id"), "date", "code", F.when(F.col("code") == "000001", 100).otherwise(0).cast("long").alias("shares"))
    equity = backtest.run_backtests(positions, panel, {"r": Counting()})[1].collect()
    assert len(equity) == 40 and {(r["equity"], r["cash"]) for r in equity} == {(1.0, 1.0)}


def test_pieces_follow_the_input(spark, monkeypatch):
    """Larger files, more pieces: in windows by code, ranks by date, layers and Kendall's tau; values are the same."""
    from panelwright.plans import catalogue
    from panelwright.sources import panels

    sf = "/root/testdata/sf0.001"
    queries, names = catalogue.queries(), ["factor_high_vol_rank_corr_3d", "ic_kendall", "ic_by_layer"]
    whole = {n: sorted(map(str, queries[n](spark, sf).collect())) for n in names}
    assert ts.pieces(panels.bars(spark, sf)) == 0
    monkeypatch.setattr(ts, "PIECE", 10_000)
    n = ts.pieces(panels.bars(spark, sf))
    assert n > 4
    for name in names:
        made = queries[name](spark, sf)
        assert f", {n})" in made._jdf.queryExecution().optimizedPlan().toString() or f", {n}" in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, made.collect())) == whole[name]


def test_pieces_of_ranks_positions_and_votes_follow_the_input(spark, monkeypatch):
    """Bars, ranks by date behind a strategy, closes and votes are dealt by the input's size; values are the same."""
    from panelwright.operators import portfolio, strategies
    from panelwright.plans import catalogue
    from panelwright.sources import panels

    sf = "/root/testdata/sf0.001"
    query = catalogue.queries()["backtest_metrics"]
    whole = sorted(map(str, query(spark, sf).collect()))
    monkeypatch.setattr(ts, "PIECE", 10_000)
    bars = panels.bars(spark, sf)
    n = ts.pieces(bars)
    momentum = strategies.get_strategy("gtja_momentum")
    made = {
        "date, code": [bars, portfolio.closes(bars), strategies.weighted_vote([momentum(bars), momentum(bars)], [1.0, 1.0])],
        "date": [strategies.weighted_score(bars, {"close": 1.0}), evaluation.combine_factor_scores(bars, {"close": 1.0}), momentum(bars)],
        "code": [strategies.get_strategy("mean_reversion")(bars)],
    }
    for keys, frames in made.items():
        by = ", ".join(k + r"#\d+" for k in keys.split(", "))
        for df in frames:
            assert re.search(rf"RepartitionByExpression \[{by}\], {n}\b", df._jdf.queryExecution().optimizedPlan().toString()), (keys, n)
    assert sorted(map(str, query(spark, sf).collect())) == whole


def test_what_is_picked_goes_to_every_task(spark):
    """The panel's rows meet dates (twice) and the few codes picked by broadcast: no exchange of the panel by period and code."""
    from panelwright.operators import strategies
    from panelwright.sources import panels

    plan = strategies.get_strategy("gtja_momentum")(panels.bars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 3, plan


def test_composites_rank_each_factor_once(panel):
    """However many composites hold a factor; and a table that has its factors is not made anew."""
    from panelwright.operators import strategies

    def ranked(runs):
        plan = strategies.composite_runs(panel, runs, panel=panel)._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(r"\brank\(close", plan))

    one = {"close": {"close": 1.0}}
    assert ranked({"both": {"close": 1.0, "high": 1.0}, **one, "high": {"high": 1.0}}) == ranked(one) > 0
    kept = factors.with_factors(panel, ["calc_rsi"])
    assert factors.with_factors(kept, ["calc_rsi"]) is kept


def test_dates_between_rebalances_are_not_ranked(spark):
    """The few ranking dates are met below the ranks by date; scores and signals are those of ranks on every date."""
    from panelwright.operators import strategies
    from panelwright.sources import panels

    bars = panels.bars(spark, "/root/testdata/sf0.001")
    made = strategies.get_strategy("gtja_momentum")(bars)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in re.split(r"\brank\(", plan)[-1], plan
    names = dict.fromkeys(strategies.RANKED["gtja_momentum"][0], 1.0)
    whole = strategies.hold_ranked(strategies.weighted_score(factors.with_factors(bars, list(names)), names), "score", 20, 5, 3, 21)
    assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect()))


def test_buys_of_composites_are_met_by_key(panel):
    """Buys alone are those of all signals; the panel is not multiplied by runs for them, and a key that it holds twice counts twice."""
    from panelwright.operators import strategies

    twice = panel.unionByName(panel.filter("code = '000005'"))
    runs = {"both": {"close": 1.0, "high": -1.0}, "close": {"close": 1.0}}
    every = strategies.composite_runs(panel, runs, 7, 2, 1, twice)
    buys = strategies.composite_runs(panel, runs, 7, 2, 1, twice, buys=True)
    assert sorted(map(str, buys.collect())) == sorted(map(str, every.filter("signal = 1").collect()))
    assert buys._jdf.queryExecution().optimizedPlan().toString().count("Generate") < every._jdf.queryExecution().optimizedPlan().toString().count("Generate")


def test_closes_of_other_codes_than_bought_are_not_dealt_out(panel):
    """Positions read closes of buys; the panel meets the written buys before the exchange by date and code."""
    from pyspark.sql import functions as F

    signals = panel.select("date", "code", F.when(F.col("code") == "000001", 1).otherwise(-1).alias("signal"), F.lit(1.0).alias("confidence"))
    made = backtest.build_positions(panel, signals)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate [date") :], plan
    assert {(r["code"], r["weight"]) for r in made.collect()} == {("000001", 1.0)} and made.count() == 40


def test_phase_b_looks_along_codes_once(spark, panel):
    """A panel with factors and forward returns is read as it lies by monitor and phase; values are the same."""
    from panelwright.operators import lifecycle

    names = ["calc_momentum_5d_change", "calc_volume_ratio"]
    made = lifecycle.ahead(panel, names)
    stored = spark.createDataFrame(made.collect(), made.schema)
    assert lifecycle.ahead(stored, names) is stored
    plan = lifecycle.rolled_ics(stored, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "code" not in plan[: plan.index("FlatMapGroupsInArrow")] and not re.search(r"(lead|lag)\(", plan), plan
    states = lifecycle.monitor(stored, names, min_sustain=5).collect()
    assert states and sorted(map(str, states)) == sorted(map(str, lifecycle.monitor(panel, names, min_sustain=5).collect()))


def test_bootstrap_draws_are_spread_over_tasks(spark):
    """Small tables of costly series are not merged into one task, and draws are those of one task."""
    from panelwright.operators import lifecycle

    ics = spark.createDataFrame([(f"f{k}", D0 + datetime.timedelta(days=i), ((i * (k + 3)) % 7 - 3) / 10) for k in range(12) for i in range(30)], "factor string, date date, ic double")
    drawn = lifecycle.bootstrap_draws(ics, ["factor"], 3, 20)
    assert len({r[0] for r in drawn.selectExpr("spark_partition_id()").collect()}) > 1
    assert sorted(map(str, drawn.collect())) == sorted(map(str, lifecycle.bootstrap_draws(ics.coalesce(1), ["factor"], 3, 20).collect()))


def test_audit_holds_no_group_of_all_rows(panel):
    """Medians come from cells, rows cross two exchanges, and windows are those of the JVM: nulls, ties and constant stretches too."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = panel.withColumn("x", F.when(F.col("code") == "000001", 50.0).when((F.col("code") != "000002") | (F.dayofmonth("date") != 9), F.col("close")))
    audit = evaluation.audit_columns(df, ["x"], 10, 2)
    assert len(_widths(audit)) == 2
    assert "percentile" not in evaluation.audit_factors(df, ["x"], 10, 2)._jdf.queryExecution().optimizedPlan().toString()
    ranked = df.withColumn("r", ts.rank_pct("x")).withColumn("l", F.lag("r", 2).over(ts.by_code()))
    day = Window.partitionBy("date")
    want = ranked.select("date", "code", ts.rolling_mean(F.col("x").isNotNull().cast("double"), 10).alias("c"), ts.corr("r", "l", 10).alias("s"), (F.stddev_samp("x").over(day) / F.avg("x").over(day)).alias("d"))
    want = {(r[0], r[1]): r[2:] for r in want.collect()}
    got = {(r[0], r[1]): r[2:] for r in audit.collect()}
    assert got.keys() == want.keys() and len({k for k, v in want.items() if v[1] is not None}) > 100
    for k, values in want.items():
        assert got[k] == tuple(None if v is None else pytest.approx(v, abs=1e-9) for v in values), k
    table = evaluation.audit_factors(df, ["x"], 10, 2).first()
    stab = sorted(v[1] for v in want.values() if v[1] is not None)
    assert table["stability"] == pytest.approx((stab[(len(stab) - 1) // 2] + stab[len(stab) // 2]) / 2, abs=1e-9)


def test_regimes_are_audited_in_one_plan(panel, monkeypatch):
    """However many regimes; each is the audit of its own rows."""
    from pyspark.sql import functions as F

    calls, whole = [], evaluation.audit_columns
    regimes = panel.select("date", F.when(F.dayofmonth("date") < 16, "a").otherwise("b").alias("regime")).distinct()
    want = {r: evaluation.audit_factors(panel.join(regimes.filter(F.col("regime") == r), "date", "left_semi"), ["close"], 8, 2).first() for r in "ab"}
    monkeypatch.setattr(evaluation, "audit_columns", lambda *a, **b: calls.append(1) or whole(*a, **b))
    got = {r["regime"]: r for r in evaluation.audit_factors_by_regime(panel, ["close"], regimes, lookback=8, lag=2).collect()}
    assert len(calls) == 1 and got.keys() == want.keys()
    for r, row in want.items():
        assert [got[r][c] for c in row.asDict()] == [pytest.approx(v) if isinstance(v, float) else v for v in row], r


def test_factors_of_a_row_alone_are_made_before_rows_move(panel):
    """Inputs that only they read stay behind."""
    df = panel.selectExpr("*", "volume / 7 as pe", "close as pb")
    made = factors.narrowed(df, ["calc_ep", "calc_hv"])
    assert set(made.columns) == {"date", "code", "close", "calc_ep"}
    whole = factors.with_factors(df, ["calc_ep"])
    assert sorted(map(str, made.select("date", "code", "calc_ep").collect())) == sorted(map(str, whole.select("date", "code", "calc_ep").collect()))
