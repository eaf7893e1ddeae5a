"""Operators against small pandas formulas and hand-made panels."""
import datetime
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import announcements, backtest, cleaning, evaluation, factors, lifecycle, pairs, portfolio, strategies
from panelwright.operators import timeseries as ts

D0 = datetime.date(2024, 1, 1)


def day(i):
    return D0 + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    rows = []
    for c in ("300001", "600001", "600002", "600003", "600004", "600005"):
        px = 20 + rng.normal(0, 0.6, 90).cumsum()
        for i, p in enumerate(px):
            if rng.random() < 0.04:
                continue
            o = p + rng.normal(0, 0.3)
            rows.append((day(i), c, o, max(o, p) + 0.2, min(o, p) - 0.2, p, float(rng.integers(1, 9) * 100)))
    return pd.DataFrame(rows, columns=["date", "code", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))


def series(df, col):
    out = df.select("date", "code", col).toPandas().sort_values(["code", "date"])
    return out[col].to_numpy(float)


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b), initial=0) < tol


def sorted_pdf(pdf):
    return pdf.sort_values(["code", "date"]).reset_index(drop=True)


def test_windows_against_pandas(panel, pdf):
    p = sorted_pdf(pdf)
    g = p.groupby("code")["close"]
    made = ts.ewm_position(panel).withColumns({"m": ts.rolling_mean("close", 5), "s": ts.rolling_std("close", 5), "e": ts.ewm("close", 6, 1), "k": ts.corr("close", "volume", 7), "d": ts.delta("close", 2)})
    same(series(made, "m"), g.transform(lambda x: x.rolling(5).mean()))
    same(series(made, "s"), g.transform(lambda x: x.rolling(5).std()))
    same(series(made, "e"), g.transform(lambda x: x.ewm(alpha=1 / 6, min_periods=6).mean()))
    same(series(made, "d"), g.diff(2))
    want = pd.concat([q["close"].rolling(7).corr(q["volume"]) for _, q in p.groupby("code")])
    same(series(made, "k"), want, 1e-7)


def test_ewm_over_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(ts, "EWM_BLOCK", 200)
    x = np.random.default_rng(1).normal(size=900)
    x[[0, 5, 6, 400]] = np.nan
    df = spark.createDataFrame([(day(i), "a", None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "date date, code string, x double")
    same(series(ts.ewm_position(df).withColumn("e", ts.ewm("x", 5, 1)), "e"), pd.Series(x).ewm(alpha=0.2, min_periods=5).mean(), 1e-9)


@pytest.mark.parametrize("n, m", [(250, 1), (3, 2), (4, 3), (100, 99), (5, 5)])
def test_ewm_at_any_rate(spark, n, m):
    x = 100 + np.random.default_rng(2).normal(size=2400).cumsum()
    df = spark.createDataFrame([(day(i), "a", float(v)) for i, v in enumerate(x)], "date date, code string, x double")
    same(series(ts.ewm_position(df).withColumn("e", ts.ewm("x", n, m)), "e"), pd.Series(x).ewm(alpha=m / n, min_periods=n).mean(), 1e-8)
    for wrong in (0, n + 1):
        with pytest.raises(ValueError):
            ts.ewm("x", n, wrong)


def test_rank_is_average_of_ties(spark):
    df = spark.createDataFrame([(D0, c, v) for c, v in zip("abcde", (3.0, 1.0, 3.0, None, 2.0))], "date date, code string, x double")
    same(series(df.withColumn("r", ts.rank_pct("x")), "r"), [0.875, 0.25, 0.875, np.nan, 0.5])


def test_streak_and_guards(spark):
    df = spark.createDataFrame([(day(i), "a", f) for i, f in enumerate([True, True, False, None, True])], "date date, code string, f boolean")
    assert [r["n"] for r in ts.streak(df, F.col("f"), "n").orderBy("date").collect()] == [1, 2, 0, 0, 1]
    with pytest.raises(ValueError):
        ts.delay("x", -1)


def test_every_factor_ignores_row_order_and_has_warm_up(panel):
    names = [n for n in factors.list_factors(kind="single") if set(factors.get_spec(n).needs) <= set(panel.columns) and factors.get_spec(n).alias_of is None]
    assert len(names) >= 40
    a = factors.with_factors(panel, names).orderBy("code", "date").toPandas()
    b = factors.with_factors(panel.repartition(3).orderBy(F.rand(1)), names).orderBy("code", "date").toPandas()
    for n in names:
        same(a[n], b[n], 1e-7)
    first = a.groupby("code").head(1)
    assert first["calc_momentum_5d_change"].isna().all() and (first["calc_obv"] == 0).all()


def test_registry(panel):
    assert len([n for n in factors.list_factors() if n.startswith("gtja_")]) == 37
    assert len([n for n in factors.list_factors(kind="single") if factors.get_spec(n).alias_of is None]) == 54
    assert len(factors.list_factors(kind="pair")) == 5
    with pytest.raises(KeyError):
        factors.with_factor(panel, "calc_turnover")
    with pytest.raises(ValueError):
        factors.with_factor(panel, "calc_spread")
    factors.register_factor("mine", lambda t, k=2: F.col("close") * k)
    assert factors.get_spec("mine").params == {"k": 2}
    same(series(factors.with_factor(panel, "mine", k=3), "mine"), series(panel.withColumn("x", F.col("close") * 3), "x"))
    a = factors.with_factors(panel, ["gtja_14", "calc_momentum_5d_change"])
    same(series(a, "gtja_14"), series(a, "calc_momentum_5d_change"))


def test_all_factors_share_few_exchanges(panel):
    names = [n for n in factors.list_factors(kind="single") if set(factors.get_spec(n).needs) <= set(panel.columns)]
    plan = factors.with_factors(panel, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


def test_information_coefficient_of_a_perfect_factor(panel):
    made = evaluation.forward_returns(panel, (1,)).withColumn("perfect", F.col("fwd_ret_1d") * 2 + 100).withColumn("inverse", -F.col("fwd_ret_1d"))
    for method in ("spearman", "pearson", "kendall"):
        got = {r["factor"]: r["m"] for r in evaluation.ic(made, ["perfect", "inverse"], (1,), method, min_obs=3).groupBy("factor").agg(F.avg("ic").alias("m")).collect()}
        assert abs(got["perfect"] - 1) < 1e-9 and abs(got["inverse"] + 1) < 1e-9


@pytest.mark.parametrize("q", [2, 3, 4, 5])
def test_quantile_buckets_as_qcut(spark, q):
    for n in (q, q + 1, 13, 31):
        df = spark.createDataFrame([(D0, f"{i:03d}", float(i)) for i in range(n)], "date date, code string, x double")
        got = [r["b"] for r in df.withColumn("b", evaluation.quantile_bucket("x", ["date"], q)).orderBy("x").collect()]
        assert got == [k + 1 for k in pd.qcut(np.arange(n), q, labels=False)]


def test_clusters_and_representatives(spark):
    corr = {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): -0.05, ("c", "d"): -0.9, ("a", "d"): 0.0, ("b", "d"): None}
    for linkage in ("average", "complete", "single", "ward"):
        assert evaluation.cluster_redundant(list("abcd"), corr, 0.7, linkage) == {"a": 1, "b": 1, "c": 2, "d": 2}
    rows = spark.createDataFrame([("a", 1, 2.0, 0.1), ("b", 1, -3.0, 0.2), ("c", 2, None, 0.3), ("d", 2, 1.0, 0.1)], "factor string, cluster int, t_stat double, ir double")
    assert {r["cluster"]: r["representative"] for r in evaluation.select_representative(rows).collect()} == {1: "b", 2: "d"}


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_merge_table_against_all_pairs(linkage):
    """Heights and members are those of merging the nearest pair over and over, with distances taken anew from the members."""
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 15):
        names = [f"f{i:02d}" for i in range(n)]
        corr = {(a, b): float(rng.uniform(-1, 1)) for i, a in enumerate(names) for b in names[i + 1 :]}
        d = evaluation.distances(names, corr)
        merges = evaluation.merge_table(names, corr, linkage)
        inside = {i: frozenset([i]) for i in range(n)}
        groups, dist = [frozenset([i]) for i in range(n)], {}

        def between(x, y):
            if linkage == "ward":  # from squared distances alone
                sq = lambda p, q: sum(d[i, j] ** 2 for i in p for j in q)
                k = len(x) * len(y) / (len(x) + len(y))
                return np.sqrt(max(0.0, 2 * k * (sq(x, y) / (len(x) * len(y)) - sq(x, x) / (2 * len(x) ** 2) - sq(y, y) / (2 * len(y) ** 2))))
            steps = [d[i, j] for i in x for j in y]
            return {"single": min, "complete": max, "average": np.mean}[linkage](steps)

        want = []
        while len(groups) > 1:
            at, i, j = min((between(x, y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            want.append((at, groups[i] | groups[j]))
            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] | groups[j]]
        for k, (left, right, height, size) in enumerate(merges):
            inside[n + k] = inside[left] | inside[right]
            assert size == len(inside[n + k])
        assert [h for _, _, h, _ in merges] == pytest.approx([h for h, _ in want])
        assert [inside[n + k] for k in range(len(merges))] == [g for _, g in want]
    with pytest.raises(ValueError):
        evaluation.merge_table(["a"], {}, "odd")


def test_demeaned_groups_sum_to_zero(panel):
    made = panel.withColumn("industry", F.when(F.col("code") < "600003", "x").otherwise("y"))
    out = evaluation.demean_by_industry(made, ["close"], 2)
    worst = out.groupBy("date").agg(F.abs(F.sum("close")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-9


def test_limits_and_suspension(spark):
    rows = [(day(i), "600001", p, 100.0) for i, p in enumerate((10.03, 11.03, 9.93, 9.93))] + [(day(i), "300001", p, v) for i, p, v in ((1, 10.0, 5.0), (2, 11.0, 0.0), (3, 13.2, 5.0))]
    df = spark.createDataFrame(rows, "date date, code string, close double, volume double").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    out = {(r["code"], r["date"]): r for r in cleaning.detect_limit_price(df).collect()}
    assert out["600001", day(1)]["limit_up"] and out["600001", day(2)]["limit_down"] and not out["600001", day(0)]["limit_up"]
    assert not out["300001", day(2)]["limit_up"] and out["300001", day(3)]["limit_up"]
    grid = cleaning.detect_suspension(df.filter("code <> '600001' or volume > 0"), spark.createDataFrame([(day(i),) for i in range(6)], "cal_date date"))
    got = {(r["code"], r["date"]): r["is_suspended"] for r in grid.collect()}
    assert got["300001", day(2)] and ("300001", day(0)) not in got and ("600001", day(4)) not in got


def test_rank_hold_and_votes(panel):
    s = strategies.get_strategy("gtja_momentum")(panel, rebalance=10, top_n=2, bottom_n=1)
    per = s.groupBy("date").agg(F.count_if(F.col("signal") == 1).alias("b"), F.count_if(F.col("signal") == -1).alias("s")).toPandas().sort_values("date")
    assert per["b"].head(21).sum() == 0 and per["b"].max() == 2 and per["s"].max() == 1
    assert strategies.weighted_vote([s, strategies.reverse(s)], [1, 1]).filter("signal <> 0").count() == 0
    same_ = strategies.filter_combine(s, [s])
    assert same_.exceptAll(s).count() == 0
    with pytest.raises(Exception):
        strategies.weighted_vote([s, s.limit(3)], [1, 1]).collect()


def test_every_strategy_runs(spark, panel):
    extra = panel.withColumns({"earnings_surprise": F.col("close"), "earnings_acceleration": F.col("volume"), "roe_stability": F.col("open")})
    n = panel.count()
    assert len(strategies.list_strategies()) == 16
    for name in strategies.list_strategies():
        params = {"pairs": [("600001", "600002")], "lookback": 20} if name == "pair_trading" else {}
        out = strategies.get_strategy(name)(extra, **params)
        assert out.columns == ["date", "code", "signal", "confidence"] and out.count() == n


def test_persistence_and_confirmation():
    assert strategies.route_params("odd") == strategies.ROUTES["range"]


def test_smoothing_matches_hand_values():
    out = portfolio.smooth_series([{"a": 0.5, "b": 0.5}, {"a": 0.505, "b": 0.495}, {"a": 1.0}], {}, 0.01)
    assert out[1] == {"a": 0.5, "b": 0.5} and out[2] == {"a": 1.0}


def test_position_limit_and_caps(spark):
    p = spark.createDataFrame([(D0, c, w, int(w * 10000)) for c, w in zip("abcd", (0.6, 0.2, 0.1, 0.1))], "date date, code string, weight double, shares long")
    out = {r["code"]: r["weight"] for r in portfolio.apply_position_limit(p, 0.3).collect()}
    assert max(out.values()) <= 0.3 + 1e-9 and abs(sum(out.values()) - 1) < 1e-9
    ind = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "code string, industry string")
    got = portfolio.apply_industry_cap(p, ind, 0.5).toPandas().set_index("code")["weight"]
    assert abs(got.sum() - 1) < 1e-9 and abs(got["a"] + got["b"] - 0.5) < 1e-9


def test_position_limit_against_repeated_clipping(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for d in range(40):
        n = int(rng.integers(1, 9))
        w = rng.dirichlet(np.full(n, 0.5)) * rng.choice([1.0, 0.7])
        w = np.round(w, 3) if d % 2 else w
        rows += [(day(d), f"c{k}", float(v), 10_000) for k, v in enumerate(w)]
        for _ in range(60):
            over = np.clip(w - 0.3, 0, None).sum()
            w = np.minimum(w, 0.3)
            free = w < 0.3 - 1e-12
            if over < 1e-14 or not free.any():
                break
            w = w + free * over / free.sum()
        want |= {(day(d), f"c{k}"): v for k, v in enumerate(w)}
    got = portfolio.apply_position_limit(spark.createDataFrame(rows, "date date, code string, weight double, shares long"), 0.3).collect()
    assert len(got) == len(rows) and all(abs(r["weight"] - want[r["date"], r["code"]]) < 1e-9 for r in got)
    none = portfolio.apply_position_limit(spark.createDataFrame(rows[:2], "date date, code string, weight double, shares long"), 0.0).collect()
    assert all(r["weight"] == 0 and r["shares"] == 0 for r in none)


def test_dead_zone_keeps_exposure(spark):
    signals = spark.createDataFrame([(day(i), c, 1, 1.0) for i in range(3) for c in "ab"], "date date, code string, signal int, confidence double")
    data = spark.createDataFrame([(day(i), c, 10.0) for i in range(3) for c in "ab"], "date date, code string, close double")
    half = spark.createDataFrame([(day(i), 0.5) for i in range(3)], "date date, exposure double")
    for zone in (0.0, 0.01):
        assert {r["shares"] for r in backtest.build_positions(data, signals, exposure=half, dead_zone=zone).collect()} == {25_000}


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n in (1, 2, 5, 40, 200):
        for high in (3, 1000):
            x, y = rng.integers(0, high, n).astype(float), rng.integers(0, high, n).astype(float)
            a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            scale = np.sqrt((a != 0).sum() * (b != 0).sum())
            want[f"{n}|{high}"] = (None if scale == 0 else (a * b).sum() / scale, n)
            rows += [(f"{n}|{high}", float(u), float(v)) for u, v in zip(x, y)]
    made = evaluation.kendall(spark.createDataFrame(rows, "k string, x double, y double"), ["k"])
    assert "Pandas" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r for r in made.collect()}
    assert set(got) == set(want)
    for k, (tau, n) in want.items():
        assert got[k]["n"] == n and (got[k]["ic"] is None if tau is None else abs(got[k]["ic"] - tau) < 1e-12)
    assert evaluation.kendall(spark.createDataFrame([], "k string, x double, y double"), ["k"]).count() == 0


def test_daily_correlations_with_gaps(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("xyz"))
    pdf.loc[::4, "y"] = np.nan
    pdf["k"] = 1.0
    df = spark.createDataFrame([(day(i % 2), f"{i:02d}", *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(pdf[["x", "y", "z", "k"]].to_numpy())], "date date, code string, x double, y double, z double, k double")
    got = {(r["date"], r["factor_a"], r["factor_b"]): r["c"] for r in evaluation.daily_correlations(df, ["x", "y", "z", "k"], 5).collect()}
    for d in (0, 1):
        want = pdf.iloc[d::2].corr(method="spearman")
        for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
            assert abs(got[day(d), a, b] - want.loc[a, b]) < 1e-12
        assert got[day(d), "x", "k"] is None


def test_circuit_breaker():
    b = portfolio.CircuitBreaker()
    assert b.exposure_at(-0.01) == 1 and b.exposure_at(-0.2) == 0.1 and 0.1 < b.exposure_at(-0.1) < 1
    assert b.series([100, 100, 80, 99]) == [1, 1, 0.1, 1] and b.recovers_fast([1, 1, 1, 1.2])
    with pytest.raises(ValueError):
        portfolio.CircuitBreaker(threshold=0.1)


def test_engine_accounting():
    cost = backtest.TradingCost()
    prices = {day(i): {"a": p, "b": 5.0} for i, p in enumerate((10.0, 11.0, 8.0, 9.0))}
    held = {day(i): {"a": 1000, "b": 200} for i in range(4)}
    trades, equity = backtest.Engine(capital=20000, cost=cost).play(sorted(prices), held, prices)
    assert [t[2] for t in trades] == ["buy", "buy"]
    buy = trades[0]
    assert buy[3] == 10.01 and buy[6] == pytest.approx(5 + 10010 * 1e-5)
    cash = 20000 - sum(t[3] * t[4] + t[6] for t in trades)
    assert equity[-1][1] == pytest.approx(cash + 1000 * 9 + 200 * 5)
    stopped, _ = backtest.Engine(capital=20000, stop_loss=-0.1).play(sorted(prices), held, prices)
    assert [(t[2], t[1]) for t in stopped] == [("buy", "a"), ("buy", "b"), ("stop_loss", "a"), ("buy", "a")]
    sold, _ = backtest.Engine(capital=20000).play(sorted(prices), {day(0): {"a": 500}}, prices)
    assert [t[2] for t in sold] == ["buy", "sell"] and sold[1][5] == pytest.approx(500)


def test_backtests_run_together(panel):
    signals = strategies.get_strategy("gtja_momentum")(panel, rebalance=10)
    trades, equity, figures = backtest.run_pipeline(panel, {"a": signals, "b": strategies.reverse(signals)}, backtest.Engine(cost=backtest.TradingCost()))
    got = {r["run_id"]: r for r in figures.collect()}
    assert set(got) == {"a", "b"} and got["a"]["trade_count"] == trades.filter("run_id = 'a'").count()
    assert equity.filter(F.abs(F.col("equity") - F.col("cash") - F.col("position_value")) > 1e-6).count() == 0
    assert equity.filter("cash < -0.01").count() == 0 and all(0 <= r["max_drawdown"] <= 1 for r in got.values())


def test_windows_of_months():
    w = backtest.generate_windows(datetime.date(2020, 1, 31), datetime.date(2021, 6, 30), 12, 2)
    assert w[0] == (datetime.date(2020, 1, 31), datetime.date(2021, 1, 31), datetime.date(2021, 2, 1), datetime.date(2021, 4, 1)) and len(w) == 2
    assert all(train_end < test_start for _, train_end, test_start, _ in w)


def dickey_fuller(x):
    """(tau, lags) by least squares, order by order."""
    n, d = len(x), np.diff(x)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def fit(lags, first):
        m = np.column_stack([x[first:-1], *(d[first - k : len(d) - k] for k in range(1, lags + 1)), np.ones(len(d) - first)])
        b = np.linalg.lstsq(m, d[first:], rcond=None)[0]
        return m, b, float(((d[first:] - m @ b) ** 2).sum())

    k = len(d) - top
    lags = min(range(top + 1), key=lambda p: k * np.log(fit(p, top)[2] / k) + 2 * (p + 2))
    m, b, ssr = fit(lags, lags)
    return b[0] / np.sqrt(ssr / (len(m) - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0]), lags


def test_unit_roots_against_least_squares(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}

    def put(pair, a, b):
        rows.extend((pair, day(i), float(u), float(v)) for i, (u, v) in enumerate(zip(a, b)))

    for pair in range(8):
        n = (60, 100, 237, 400)[pair % 4]
        b, noise = rng.normal(size=n).cumsum() * 0.01 + 3, np.zeros(n)
        for i in range(2, n):
            noise[i] = (0.5, 0.95)[pair // 4] * noise[i - 1] + 0.3 * (noise[i - 1] - noise[i - 2]) + rng.normal() * 0.01
        put(pair, 1.5 * b + noise, b)
        m = np.column_stack([b, np.ones(n)])
        want[pair] = dickey_fuller(1.5 * b + noise - m @ np.linalg.lstsq(m, 1.5 * b + noise, rcond=None)[0])
    put(50, b[:59], b[:59][::-1])
    put(51, 2 * b, b)
    put(52, np.sin(np.arange(80.0)), np.ones(80))  # no slope
    for pair in range(100, 140):
        put(pair, rng.normal(size=200).cumsum(), rng.normal(size=200).cumsum())
    rows.append((0, day(1000), None, 1.0))
    got = {r["pair"]: r for r in pairs.cointegration(spark.createDataFrame(rows, "pair int, date date, log_a double, log_b double")).collect()}
    for pair, (tau, lags) in want.items():
        assert got[pair]["lags"] == lags and abs(got[pair]["tau"] - tau) < 1e-8
    assert got[3]["pvalue"] < 0.01 and got[0]["n_obs"] == 60
    assert got[50]["pvalue"] == 1.0 and got[50]["tau"] is None and got[51]["pvalue"] == 0.0 and 0 <= got[52]["pvalue"] <= 1
    assert sum(got[p]["pvalue"] < 0.05 for p in range(100, 140)) <= 12  # residuals of two walks: nominal levels are exceeded
    taus = spark.createDataFrame([(-2.86,), (-3.43,), (3.0,), (-20.0,), (None,)], "t double")
    p = [r["p"] for r in taus.select(pairs.unit_root_pvalue(F.col("t")).alias("p")).collect()]
    assert abs(p[0] - 0.05) < 0.003 and abs(p[1] - 0.01) < 0.001 and p[2:] == [1.0, 0.0, None]
    assert pairs.cointegration(spark.createDataFrame([], "pair int, date date, log_a double, log_b double")).count() == 0
    assert abs(pairs.kalman(1.5 * b, b)[-1] - 1.5) < 1e-3


def test_normal_shares(spark):
    z = [-9.0, -3.0, -0.5, 0.0, 1e-9, 1.7, 8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", pairs.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-14 for r in got)


def test_as_of_takes_the_last_event_even_if_null(spark):
    e = spark.createDataFrame([("a", day(1), "20231231", 1.0), ("a", day(3), "20230930", 2.0), ("a", day(3), "20231231", 3.0), ("a", day(5), "20240331", None)], "code string, ann_date date, end_date string, v double")
    grid = spark.createDataFrame([(day(i), c) for i in range(7) for c in "ab"], "date date, code string")
    got = [r["v"] for r in announcements.as_of(grid, e, ["v"]).filter("code = 'a'").orderBy("date").collect()]
    assert got == [None, 1.0, 1.0, 3.0, 3.0, None, None]


def test_surprise_pool(spark):
    rows = [("a", 1, "forecast", 5.0, None, "预增"), ("a", 4, "express", None, 9.0, None), ("b", 2, "express", 4.0, 2.0, None), ("c", 5, "express", 1.0, 3.0, None)]
    e = spark.createDataFrame([(c, day(d), "20231231", k, p, a, t) for c, d, k, p, a, t in rows], "code string, ann_date date, end_date string, event_type string, predicted_profit double, actual_profit double, forecast_type string")
    got = {(r["code"], r["event_type"]): r["raw_surprise"] for r in announcements.pit_surprise(e).collect()}
    assert got["a", "forecast"] == 0.5 and got["a", "express"] == 0.5 and got["b", "express"] == 0.0
    assert got["c", "express"] == pytest.approx(2 / 3 - 1 / 3)


@pytest.mark.parametrize("block_rows", [2, 30, None])
def test_ranks_among_what_stands(spark, block_rows):
    """Against counting, with a value that a third has, over many blocks and stretches."""
    rng, rows, asked, standing = np.random.default_rng(5), [], {}, {}
    for key in "uv":
        for o in range(240):
            code, v = int(rng.integers(0, 25)), float(rng.choice([7.0, rng.integers(0, 40), rng.normal() * 9]))
            now = standing.setdefault(key, {})
            stamp = (ord(key) << 20) + o
            if code in now:
                rows.append((key, "a", stamp, o // 17, now[code], -1))
            now[code] = v
            rows.append((key, "a", stamp, o // 17, v, 1))
            if o % 3:
                rows.append((key, "a", stamp, o // 17, v, 0))
                asked[stamp] = (len(now), sum(x < v for x in now.values()) + sum(x == v for x in now.values()) / 2)
    df = spark.createDataFrame(rows, "key string, side string, o long, part int, value double, w int")
    assert {r["o"]: (r["n"], r["rank"]) for r in announcements.standing_ranks(df, block_rows).collect()} == asked
    assert announcements.standing_ranks(df.limit(0), block_rows).count() == 0


def test_surprise_in_small_blocks(spark):
    rng = np.random.default_rng(6)
    kinds = list(announcements.FORECAST_SCORE)
    rows = [(f"{int(rng.integers(0, 30))}", day(int(rng.integers(0, 90))), str(rng.choice(["20231231", "20240331"])), str(rng.choice(["forecast", "express"])), None if rng.random() < 0.2 else float(rng.integers(0, 9)), None if rng.random() < 0.2 else float(rng.integers(0, 9)), str(rng.choice(kinds)) if rng.random() < 0.7 else None) for _ in range(500)]
    e = spark.createDataFrame(list({r[:4]: r for r in rows}.values()), "code string, ann_date date, end_date string, event_type string, predicted_profit double, actual_profit double, forecast_type string")
    cols = ["code", "ann_date", "end_date", "event_type", "raw_surprise"]
    sides = [sorted((tuple(r) for r in announcements.pit_surprise(e, b).select(*cols).collect()), key=str) for b in (3, None)]
    assert sides[0] == sides[1] and len(sides[0]) == e.count()


def test_bootstrap(spark):
    x = np.random.default_rng(0).normal(size=200)
    rows = [("f", day(i), float(v)) for i, v in enumerate(x)] + [("short", day(i), float(v)) for i, v in enumerate(x[:10])] + [("flat", day(i), 0.5) for i in range(100)] + [("f", day(900), None), ("f", day(901), float("nan"))]
    ics = spark.createDataFrame(rows, "factor string, date date, ic double")
    draws = lifecycle.bootstrap_draws(ics, ["factor"], 80, 60, 7)
    got = {(r["factor"], r["iter"]): r["t"] for r in draws.collect()}
    assert set(got) == {("f", i) for i in range(80)}
    past, now = x[:-1] - x[:-1].mean(), x[1:] - x[1:].mean()
    phi = (past * now).sum() / (past**2).sum()
    for i in range(80):
        rest = [e for _, e in sorted((hashlib.md5(f"7|f|{i}|{k}".encode()).hexdigest(), e) for k, e in enumerate(now - phi * past))]
        out = [0.0]
        for e in rest:
            out.append(phi * out[-1] + e)
        tail = np.array(out[-60:])
        assert abs(got["f", i] - tail.mean() / tail.std(ddof=1) * np.sqrt(60)) < 1e-9
    assert abs(np.mean(list(got.values()))) < 0.5
    q = lifecycle.bootstrap_null(ics, ["factor"], 80, 60, 7).collect()
    assert len(q) == 1 and abs(q[0]["null_q"] - np.quantile(np.abs(list(got.values())), 0.95)) < 1e-9
    assert lifecycle.bootstrap_draws(ics.limit(0), ["factor"]).count() == 0
    # a window as long as the series holds the start as well
    assert lifecycle.bootstrap_draws(ics.filter("factor = 'short'"), ["factor"], 3, 10).count() == 3


def test_null_histograms_add_up(spark):
    t = [-9.0, -4.0, -0.1, 0.0, 0.24, 0.25, 3.99, 4.0, float("inf")]
    draws = spark.createDataFrame([("f", k, v) for k, v in enumerate(t)] + [("f", 99, None)], "factor string, iter int, t double")
    whole = sorted(map(tuple, lifecycle.null_histogram(draws, ["factor"]).collect()))
    parts = [lifecycle.null_histogram(draws.filter(f"iter % 2 = {k}"), ["factor"]) for k in (0, 1)]
    assert whole == sorted(map(tuple, lifecycle.merge_histograms(parts, ["factor"]).collect())) and sum(r[3] for r in whole) == 9
    assert {r[1]: r[3] for r in whole} == {0: 2, 15: 1, 16: 2, 17: 1, 31: 3} and whole[0][2] == -4.0
    with pytest.raises(ValueError):
        lifecycle.null_histogram(draws, ["factor"], 0)


def test_spans_and_health(spark):
    rows = [(day(i), f, 5, s, t, t) for f in "ab" for i, (s, t) in enumerate([("dead", None), ("dead", 0.5), ("active", 2.5), ("dead", -0.5), ("dead", 0.0)])]
    states = spark.createDataFrame(rows, "date date, factor string, fwd_window int, state string, rolling_ir double, t_stat double")
    spans = sorted(tuple(r) for r in lifecycle.state_spans(states).filter("factor = 'a'").select("start", "end", "state", "days", "mean_t").collect())
    assert spans == [(day(0), day(1), "dead", 2, 0.5), (day(2), day(2), "active", 1, 2.5), (day(3), day(4), "dead", 2, -0.25)]
    health = {r["date"]: r for r in lifecycle.factor_health(states).filter("factor = 'b'").collect()}
    assert health[day(0)]["shade"] is None and health[day(2)]["shade"] == 1.0 and -1 < health[day(3)]["shade"] < 0 and health[day(4)]["shade"] == 0.0
    flat = lifecycle.factor_health(states.withColumn("rolling_ir", F.lit(0.0)))
    assert {r["shade"] for r in flat.collect()} == {0.0} and lifecycle.factor_health(states.limit(0)).count() == 0


@pytest.fixture(scope="module")
def long_panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        px = 30 + rng.normal(0, 0.4, 420).cumsum() + c
        rows += [(day(i), f"60{c:04d}", p, p + 0.2, p - 0.2, p, float(rng.integers(1, 9) * 100)) for i, p in enumerate(np.maximum(px, 2.0).tolist())]
    return spark.createDataFrame(rows, "date date, code string, open double, high double, low double, close double, volume double")


NAMES = ["calc_momentum_5d_change", "calc_momentum_6d_return", "calc_volume_ratio", "calc_rsi"]


#: One for each way of looking back: sums, exponential means of each other, last values, ranks of ranks, windows of windows.  The query has all.
BAR_FACTORS = ["calc_obv", "calc_macd_like", "calc_vwap_deviation", "calc_rsi_6d", "calc_amihud", "calc_high_vol_rank_corr_3d", "calc_cci_12d", "calc_ma_slope_20d"]


def stamped(states):
    return {(r["date"], r["factor"], r["fwd_window"]): (r["state"], r["sustain_days"], r["old_state"], None if r["t_stat"] is None else round(r["t_stat"], 7)) for r in states.collect()}


@pytest.fixture(scope="module")
def gapped(long_panel):
    """Codes 3 and 7 are away for 130 dates and come back after the old run; 9 trades on one date in five; 11 is new."""
    i = F.datediff("date", F.lit(D0))
    away = (F.col("code").isin("600003", "600007") & i.between(270, 400)) | ((F.col("code") == "600009") & (i % 5 != 0)) | ((F.col("code") == "600011") & (i < 403))
    flags = {"is_suspended": (F.col("code") == "600002") & (i % 11 == 0), "limit_up": F.lit(None).cast("boolean")}
    return long_panel.filter(~away).withColumns(flags).cache()


def test_incremental_monitor_agrees_with_a_full_run(spark, gapped, tmp_path):
    """Two forward windows, codes with gaps; in two steps through the store."""
    from panelwright.sources import dated, io

    ask = dict(names=[*BAR_FACTORS, "calc_turnover"], windows=(5, 2), min_sustain=4)
    root = f"file://{tmp_path}/monitor"
    untouched = None
    for end in (400, 403, 419):
        changes, skipped = lifecycle.run_monitor(gapped.filter(F.col("date") <= F.lit(day(end))), root, **ask)
        assert len(skipped) == 1 and "total_mv" in skipped[0]
        paths = {s[0] for s in dated.manifest(spark, root)["states"]}
        assert untouched is None or untouched in paths  # the first run's files stay
        untouched = untouched or min(paths)
    full = lifecycle.monitor(gapped, BAR_FACTORS, (5, 2), min_sustain=4)
    want, got = stamped(full), stamped(io.load_state(spark, root))
    assert set(got) == set(want) and len(want) > 5_000
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k] and not (got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-6)}
    assert not wrong
    first = stamped(dated.read(spark, root, "states", 0))
    assert max(k[0] for k in first) <= day(400)
    # the last step's rows begin where a code's last forward returns were completed, before the gap
    segments = dated.manifest(spark, root)["states"]
    assert min(s[1] for s in segments if s[1]) < day(272).isoformat()


def test_update_from_nothing_new_and_other_factors(spark, gapped):
    data = gapped.filter(F.col("date") <= F.lit(day(350)))
    states, changes, _, carry = lifecycle.update_monitor(data, None, None, NAMES, min_sustain=4)
    assert changes.count() == 0
    new, changes, _, again = lifecycle.update_monitor(data, states, carry, NAMES, min_sustain=4)
    assert new.count() == 0 and changes.count() == 0 and again.codes.count() == carry.codes.count()
    assert not carry.serves([*NAMES, "calc_obv"], (5,)) and not carry.serves(NAMES, (3,))
    other = states.withColumn("state", F.lit("odd"))
    assert lifecycle.diff_states(states, other).count() == states.count()
    assert lifecycle.render_changes(lifecycle.diff_states(states)).count(" -> ") == lifecycle.diff_states(states).count()


def labels_of(spark, seqs):
    rows = [(k, day(i), x) for k, seq in enumerate(seqs) for i, x in enumerate(seq)]
    return spark.createDataFrame(rows, "factor int, date date, label string").withColumn("fwd_window", F.lit(5))


def read_off(df, name):
    out = {}
    for r in df.orderBy("factor", "date").collect():
        out.setdefault(r["factor"], []).append(r[name])
    return out


def odd_labels(n=60):
    rng = np.random.default_rng(11)
    return ["".join(rng.choice(list("abc")) * int(rng.integers(1, 6)) for _ in range(int(rng.integers(1, 12)))) for _ in range(n)] + ["a", "aaabaaaccc", "aabbbbab"]


def test_sustained_labels(spark):
    """The label in force changes on the k-th day in a row of another one."""
    from panelwright.operators.timeseries import sustained

    seqs = odd_labels()
    for k in (1, 2, 3):
        got = read_off(sustained(labels_of(spark, seqs), "label", k, "now", ["factor"]), "now")
        for j, seq in enumerate(seqs):
            now, want = seq[0], []
            for i, x in enumerate(seq):
                if seq[max(0, i - k + 1) : i + 1] == x * k:
                    now = x
                want.append(now)
            assert got[j] == want


def test_state_machine_by_hand(spark):
    t = [[3, 3, 0, 0, 0, 3], [None, -3, -3], [1.5, 1.2, float("nan"), 2.0, 2.0]]
    rows = [(str(k), 5, day(i), 0.0, 0.0, 0.0, x) for k, seq in enumerate(t) for i, x in enumerate(map(lambda v: None if v is None else float(v), seq))]
    df = spark.createDataFrame(rows, "factor string, fwd_window int, date date, ic double, rolling_ic double, rolling_ir double, t_stat double")
    got = lifecycle.state_machine(df, min_sustain=2)
    assert read_off(got, "state") == {"0": ["active"] * 3 + ["dead"] * 3, "1": ["dead", "dead", "reverse"], "2": ["decaying"] * 4 + ["active"]}
    assert read_off(got, "sustain_days")["0"] == [1, 2, 3, 1, 2, 3] and read_off(got, "old_state")["1"] == [None, None, "dead"]
    assert lifecycle.state_machine(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lifecycle.state_machine(df, active=1, decay=2)


def test_short_islands_are_taken_in(spark):
    """Against its meaning, read from left to right: the first days wait for enough of them, then only long islands speak."""
    for j, seq in enumerate(odd_labels(7)):
        for least in (1, 4):
            got = strategies.persistent(labels_of(spark, [seq]).drop("factor", "fwd_window"), "label", least, "kept")
            runs, at = [], 0
            for x in seq:
                if runs and runs[-1][0] == x:
                    runs[-1][1] += 1
                else:
                    runs.append([x, 1])
            ends = np.cumsum([n for _, n in runs])
            first = next((i for i, e in enumerate(ends) if e >= least), len(runs) - 1)
            names = [runs[first][0]] * (first + 1)
            for x, n in runs[first + 1 :]:
                names.append(x if n >= least else names[-1])
            want = [name for name, (_, n) in zip(names, runs) for _ in range(n)]
            assert [r["kept"] for r in got.orderBy("date").collect()] == want


def test_pair_trading_by_hand(spark, monkeypatch):
    z = [None, 0.1, 2.5, 3.0, 1.0, -2.5, 0.4, -2.1, None, -0.6, 0.2, 1.9]
    held = [0, 0, -1, -1, -1, -1, 0, 1, 0, 1, 0, 0]
    scored = spark.createDataFrame([(0, "a", "b", day(i), v) for i, v in enumerate(z)], "pair int, code_a string, code_b string, date date, z double")
    monkeypatch.setattr(strategies, "pair_zscores", lambda *a: scored)
    data = spark.createDataFrame([(day(i), c, 1.0) for i in range(len(z)) for c in "abx"], "date date, code string, close double")
    got = {c: [r["signal"] for r in strategies.get_strategy("pair_trading")(data, [("a", "b")]).filter(F.col("code") == c).orderBy("date").collect()] for c in "abx"}
    assert got == {"a": held, "b": [-h for h in held], "x": [0] * len(z)}
    with pytest.raises(ValueError):
        strategies.get_strategy("pair_trading")(data, [], entry_zscore=1.0, exit_zscore=2.0)


def test_first_pair_has_the_code(spark):
    named = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "e"), ("a", "f"), ("g", "h")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(named)], "pair int, code_a string, code_b string")
    assert sorted(r["pair"] for r in strategies.own_pairs(df).collect()) == [0, 2, 4, 6]
    assert strategies.own_pairs(df.limit(0)).count() == 0


def test_changes_are_appended(spark, tmp_path):
    from panelwright.sources import io

    root = f"file://{tmp_path}/m"
    row = spark.createDataFrame([(D0, "f", 5, "dead", "active")], "date date, factor string, fwd_window int, old_state string, new_state string")
    assert io.load_changes(spark, root) is None
    io.save_changes(row, root)
    io.save_changes(row, root)
    assert io.load_changes(spark, root).count() == 2


def test_phase_b_by_hand(spark, long_panel, monkeypatch):
    """A factor that knows the future is picked and wins; one that knows it turned round in training and right in testing loses."""
    ahead = evaluation.forward_returns(long_panel, (5,)).fillna(0.0, ["fwd_ret_5d"])
    flip = F.when(F.col("date") < F.lit(day(250)), -F.col("fwd_ret_5d")).otherwise(F.col("fwd_ret_5d"))
    noise = (F.pmod(F.xxhash64("date", "code"), F.lit(1000)) / 1000 - 0.5) * 0.1
    data = ahead.withColumns({"volume": F.col("fwd_ret_5d") + noise, "open": flip + noise})
    factors.register_factor("seer", lambda t: F.col("volume"))
    factors.register_factor("turncoat", lambda t: F.col("open"))
    states = lifecycle.monitor(data, ["seer"], min_sustain=2).unionByName(lifecycle.monitor(data, ["turncoat"], min_sustain=2).withColumn("state", F.lit("active")))
    windows = lifecycle.oos_windows(D0, day(419), 8, 2)
    monkeypatch.setattr(lifecycle, "with_factors", lambda df, names, *a: df.withColumns({n: F.col({"seer": "volume", "turncoat": "open"}[n]) for n in names}))
    periods, summary = lifecycle.phase_b(data, states, windows, t_window=40, n_iters=50, threshold=0.9999, min_obs=5)
    got = {(r["period"], r["factor"]): r for r in periods.collect()}
    assert got[0, "seer"]["win"] and not got[0, "turncoat"]["win"] and got[0, "turncoat"]["train_t"] < 0
    s = summary.first()
    assert s["periods_total"] == len(windows) and s["picks"] == len(got) and 0 < s["win_rate"] < 1
    with pytest.raises(ValueError):
        lifecycle.phase_b(data, states, [], t_window=40)


def test_representatives():
    rows = [("a", 2.0, 0.1), ("b", -3.0, 0.2), ("c", None, 0.3), ("d", 1.0, 0.1)]
    ids = {"a": 1, "b": 1, "c": 2, "d": 2}
    assert lifecycle.representatives(rows, ids) == {"b", "d"} and lifecycle.representatives(rows, ids, "ir") == {"b", "c"}


def test_composites_weights_and_summary(spark, long_panel):
    states = lifecycle.monitor(long_panel, NAMES[:2], min_sustain=4)
    w = lifecycle.synth_weights(states, NAMES[:2], day(419), "ic_weighted")
    assert set(w) == set(NAMES[:2]) and abs(sum(map(abs, w.values())) - 1) < 1e-9
    compare = lifecycle.phase_c(long_panel, lifecycle.synth_weights(None, NAMES[:2], None), top_n=3, bottom_n=1)
    rows = {r["run_id"]: r for r in compare.collect()}
    one = lifecycle.phase_c_summary(compare).first()
    assert set(rows) == {"composite", *NAMES[:2]} and one["best_single_sharpe"] == max(rows[n]["sharpe_ratio"] for n in NAMES[:2])
    alone = lifecycle.phase_c(long_panel, {NAMES[0]: 1.0}, top_n=3, bottom_n=1).filter("run_id = 'composite'").first()
    assert abs(alone["total_return"] - rows[NAMES[0]]["total_return"]) < 1e-12
    with pytest.raises(ValueError):
        lifecycle.synth_weights(states, NAMES, day(1), "odd")


def test_runs_are_replayed_once(panel):
    signals = strategies.get_strategy("gtja_momentum")(panel, rebalance=10)
    figures = backtest.run_pipeline(panel, {"a": signals, "b": strategies.reverse(signals)}, backtest.Engine())[2]
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    assert evaluation.best_result(figures, "total_return").count() == 1


def shape(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("FlatMapGroupsInPandas"), plan.count("Window")


def test_sweep_is_one_plan(panel):
    """Sets of parameters are rows: each run is that of the strategy alone, and the plan does not grow with them."""
    grid = [{"rebalance": r, "top_n": n, "min_window": 5} for r in (3, 7, 10) for n in (1, 2, 3)]
    signals, failed = strategies.grid_signals(panel, "gtja_momentum", [*grid, {"top_n": 0, "bottom_n": 0}, {"odd": 1}])
    assert failed == [9, 10]
    for k in (0, 5):
        alone = strategies.get_strategy("gtja_momentum")(panel, **grid[k])
        assert sorted(map(tuple, signals.filter(F.col("run_id") == f"{k:04d}").drop("run_id").collect())) == sorted(map(tuple, alone.collect()))
    few, many = (strategies.grid_signals(panel, "gtja_momentum", g)[0] for g in (grid[:2], grid))
    assert shape(few) == shape(many)
    made = backtest.run_sweep(panel, "gtja_momentum", [*grid[:2], {"odd": 1}])
    rows = {r["run_id"]: r for r in made.collect()}
    alone = backtest.run_pipeline(panel, {"x": strategies.get_strategy("gtja_momentum")(panel, **grid[1])})[2].first()
    assert set(rows) == {"0000", "0001", "0002"} and rows["0001"]["total_return"] == pytest.approx(alone["total_return"]) and rows["0002"]["trade_count"] == 0


def test_pools_are_rows(panel):
    codes = sorted(r["code"] for r in panel.select("code").distinct().collect())
    spark = panel.sparkSession
    pools = spark.createDataFrame([("x", c) for c in codes[:4]] + [("y", c) for c in codes[2:]] + [("x", codes[0])], "pool string, code string")
    for name in ("gtja_momentum", "rsi_reversal", "multifactor"):
        got = strategies.pool_signals(panel, pools, name)
        for pool in "xy":
            inside = panel.join(pools.filter(F.col("pool") == pool).select("code"), "code", "left_semi")
            assert sorted(map(tuple, got.filter(F.col("run_id") == pool).select("date", "code", "signal", "confidence").collect())) == sorted(map(tuple, strategies.get_strategy(name)(inside).collect()))
    one = pools.filter("pool = 'x'")
    assert shape(strategies.pool_signals(panel, one, "gtja_momentum")) == shape(strategies.pool_signals(panel, pools, "gtja_momentum"))


def test_walk_forward_chains_capital(panel):
    signals = strategies.get_strategy("gtja_momentum")(panel, rebalance=5, min_window=5)
    windows = [(day(0), day(29), day(30), day(50)), (day(20), day(49), day(50), day(70))]
    curve, periods = backtest.walk_forward(panel, signals, windows, backtest.Engine(capital=50_000))
    rows = curve.orderBy("period", "date").collect()
    assert [r["period"] for r in periods.orderBy("period").collect()] == [0, 1] and rows[0]["date"] == day(30)
    assert min(r["date"] for r in rows if r["period"] == 1) > day(50) and len({r["date"] for r in rows}) == len(rows)
    none = backtest.walk_forward(panel, signals, windows, pool=panel.limit(0))
    assert none[0].count() == 0 and [r["trade_count"] for r in none[1].collect()] == [0, 0]
    half = panel.select("date").distinct().withColumn("exposure", F.lit(0.1))
    low = backtest.walk_forward(panel, signals, windows, backtest.Engine(capital=50_000), exposure=half)[0]
    assert low.agg(F.max("position_value")).first()[0] < curve.agg(F.max("position_value")).first()[0]


def test_walk_is_replayed_once(panel):
    signals = strategies.get_strategy("gtja_momentum")(panel, rebalance=5, min_window=5)
    windows = [(day(0), day(29), day(30), day(50)), (day(20), day(49), day(50), day(70))]
    walk = backtest.walked(panel, signals, windows, backtest.Engine(capital=50_000))
    out = backtest.overall_metrics(walk, 50_000)
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 1
    curve, periods = (df.toPandas() for df in backtest.curve_and_periods(walk))
    value, got = curve.sort_values("date")["equity"], out.first()
    back = value.pct_change().dropna() - 0.03 / 252
    assert abs(got["total_return"] - (value.iloc[-1] / 50_000 - 1)) < 1e-12 and abs(got["sharpe_ratio"] - back.mean() / back.std(ddof=0) * math.sqrt(252)) < 1e-9
    assert abs(got["max_drawdown"] - (1 - value / value.cummax()).max()) < 1e-12
    assert abs(got["per_period_sharpe_mean"] - periods["sharpe_ratio"].mean()) < 1e-12 and abs(got["per_period_sharpe_std"] - periods["sharpe_ratio"].std()) < 1e-12
    assert backtest.overall_metrics(backtest.walked(panel, signals, windows, pool=panel.limit(0))).count() == 0


def test_mining_screen_columns(panel):
    made = panel.withColumns({"circ_mv": F.col("close") * 100, "turnover_rate": F.col("volume") / 100})
    out = lifecycle.mining_screen(made, ["calc_momentum_5d_change"], min_obs=1, min_days=1)
    assert {"all_mean_ic", "small_low_t_stat", "large_high_n_days", "domain", "sign"} <= set(out.columns) and out.count() == 1


def test_empty_panels(spark, panel):
    empty = panel.limit(0)
    assert factors.with_factors(empty, ["calc_rsi", "calc_macd_like"]).count() == 0
    assert evaluation.ic(evaluation.forward_returns(empty, (5,)), ["close"]).count() == 0
    assert cleaning.detect_limit_price(empty).count() == 0 and math.isfinite(0.0)


def test_walk_forward_windows_cover_the_panel(spark):
    from panelwright.plans.queries_portfolio import panel_windows

    first, last = datetime.date(1995, 1, 2), datetime.date(2001, 11, 26)
    w = panel_windows(spark.createDataFrame([(first,), (last,)], "date date"))
    assert len(w) == 12 and w[0][0] == first and w[-1][3] == last
    assert all(a[3] == b[2] for a, b in zip(w, w[1:]))
    assert panel_windows(spark.createDataFrame([], "date date")) == []


def test_median_of_forward_returns_holds_no_group(spark):
    from panelwright.operators import evaluation

    values = [0.5, -0.25, 0.0, 0.0, 3.0, -7.0, 1e-9, 0.125, float("inf"), -0.0]
    rows = [(1, v) for v in values] + [(2, v) for v in values[:7]] + [(3, 2.0), (4, -1.0), (4, 1.0)]
    df = spark.createDataFrame(rows, "k int, r double")
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("r", F.lit(0.5)).alias("m")).collect()}
    assert {r["k"]: r["median"] for r in evaluation.medians(evaluation.value_counts(df, ["k"], "r"), ["k"], "r").collect()} == want
    prices = spark.createDataFrame([(datetime.date(2020, 1, d), c, float(d * d + k)) for d in range(1, 9) for k, c in enumerate("ab")], "date date, code string, close double")
    made = evaluation.forward_return_analysis(prices.select("date", "code", F.lit(1).alias("signal")), prices, (1,))
    assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString()
