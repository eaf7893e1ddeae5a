"""Signals: rank-and-hold strategies, threshold strategies, pair trading, combinators, regimes."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from .cleaning import run_keys
from .evaluation import combine_factor_scores, combined_ranks, with_ranks
from .factors import scored as factor_terms
from .factors import with_factors
from .timeseries import by_code, change, ewm, ewm_position, islands, pieces, rank_pct, rolling_mean, rolling_quantile, rolling_std, rows, spread, sustained

_STRATEGIES: dict[str, Callable] = {}
#: Strategies whose signals of a code come from that code's rows alone.
_OWN_ROWS: set[str] = set()


def register_strategy(name: str, func: Callable | None = None, own_rows: bool = False):
    """func(data, **params) -> date, code, signal, confidence.  own_rows: a code's signals come from its own rows alone."""

    def put(f):
        _STRATEGIES[name] = f
        (_OWN_ROWS.add if own_rows else _OWN_ROWS.discard)(name)
        return f

    return put if func is None else put(func)


def get_strategy(name: str) -> Callable:
    if name not in _STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(_STRATEGIES)}")
    return _STRATEGIES[name]


def list_strategies() -> list[str]:
    return sorted(_STRATEGIES)


def date_index(df: DataFrame, run: list[str] = ()) -> DataFrame:
    """date, i (and run): position of each date.  Dates are few whatever the panel's width; only they are ordered as a whole."""
    return df.select(*run, "date").distinct().withColumn("i", F.row_number().over((Window.partitionBy(*run) if run else Window).orderBy("date")) - 1)


def hold_ranked(df: DataFrame, score: str, rebalance: int, top_n: int, bottom_n: int, min_window: int = 0, ascending: bool = False, drop_unscored: bool = False, sell_exited: bool = False, min_rows: int = 2, panel: DataFrame | None = None, scored: Callable | None = None, buys: bool = False) -> DataFrame:
    """Rank codes by score every rebalance dates from min_window on; hold the first top_n as buys and the last bottom_n as sells until the next.

    Unscored codes rank last (or not at all with drop_unscored); ties go by code.  A code held in the period before and not bought again is
    sold on the rebalance date with sell_exited.  Confidence is the score (or one less it when ascending) for buys, 0.5 for sells.
    Runs side by side (run_id) are ranked each on its own, on the same dates.  panel, scored, buys: as ``held_ranks``.
    """
    if top_n <= 0 and bottom_n <= 0:
        raise ValueError("top_n or bottom_n must be positive")
    dates = date_index(df if panel is None else panel).withColumns({"rebalance": F.lit(rebalance), "top_n": F.lit(top_n), "bottom_n": F.lit(bottom_n), "min_window": F.lit(min_window)})
    return held_ranks(df, score, F.broadcast(dates), ascending, drop_unscored, sell_exited, min_rows, panel, scored, buys)


def held_ranks(df: DataFrame, score: str, dates: DataFrame, ascending: bool = False, drop_unscored: bool = False, sell_exited: bool = False, min_rows: int = 2, panel: DataFrame | None = None, scored: Callable | None = None, buys: bool = False) -> DataFrame:
    """``hold_ranked`` with its parameters as columns of dates: date, i, rebalance, top_n, bottom_n, min_window - and run_id, where dates has it.

    Any number of runs is one join with the scored panel; runs that df has itself keep theirs.  panel: a table with df's rows that is read
    for their keys, so that scores are made for the ranking alone.  What is picked, a few codes a period, goes to every task.

    scored: makes the score from df's rows, date by date; it is given the rows of ranking dates alone, so that no other date is ranked (dates
    have no run_id then, but it may add one).  buys: rows with signal 1 alone, met with the panel's by date and code; the panel has no run_id then.
    """
    by_run = [c for c in ("run_id",) if c in dates.columns]
    place = F.col("i") - F.col("min_window")
    dates = dates.withColumns({"period": F.when(place >= 0, F.floor(place / F.col("rebalance"))), "start": place % F.col("rebalance") == 0}).drop("i", "rebalance", "min_window")
    starts = dates.filter("period is not null and start")
    if scored is not None:
        df = scored(df.join(starts, "date"))
    mine = run_keys(df)
    run, on = mine or by_run, ["date", *[c for c in by_run if c in mine]]
    day = df if scored is not None else df.select(*mine, "date", "code", score).join(starts, on)
    if drop_unscored:
        day = day.filter(F.col(score).isNotNull())
    by = Window.partitionBy(*run, "period")
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    day = day.withColumns({"rn": F.row_number().over(by.orderBy(first, "code")), "n": F.count("*").over(by)}).filter(F.col("n") >= min_rows)
    bought = F.col("rn") <= F.col("top_n")
    picked = day.filter(bought | (F.col("rn") > F.col("n") - F.col("bottom_n")))
    worth = F.coalesce(1 - F.col(score) if ascending else F.col(score), F.lit(0.5))
    picked = picked.select(*run, "period", "code", F.when(bought, 1).otherwise(-1).alias("s"), F.when(bought, worth).otherwise(0.5).alias("c"))
    if buys:
        held = picked.filter("s = 1").join(dates.select(*by_run, "date", "period"), [*by_run, "period"]).select(*run, "date", "code", "c")
        return panel.select("date", "code").join(F.broadcast(held), ["date", "code"]).select(*run, "date", "code", F.lit(1).alias("signal"), F.col("c").alias("confidence"))
    out = (df if panel is None else panel).select(*mine, "date", "code").join(dates.drop("top_n", "bottom_n"), on).join(F.broadcast(picked), [*run, "period", "code"], "left")
    signal, confidence = F.coalesce("s", F.lit(0)), F.coalesce("c", F.lit(0.0))
    if sell_exited:
        held = picked.filter("s = 1").select(*run, (F.col("period") + 1).alias("period"), "code", F.lit(True).alias("held"))
        out = out.join(F.broadcast(held), [*run, "period", "code"], "left")
        gone = F.col("start") & F.coalesce("held", F.lit(False)) & (signal != 1)
        signal, confidence = F.when(gone, -1).otherwise(signal), F.when(gone, 0.5).otherwise(confidence)
    return out.select(*run, "date", "code", signal.cast("int").alias("signal"), confidence.alias("confidence"))


def weighted_score(df: DataFrame, weights: dict[str, float], within=("date",)) -> DataFrame:
    """score: weighted mean of percentile ranks among rows alike in ``within``; null if any factor is null."""
    ranked = spread(df, pieces(df), *within).withColumns({f"__r_{f}": rank_pct(f, within) for f in weights})
    total = sum((F.col(f"__r_{f}") * w for f, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return ranked.withColumn("score", F.round(total, 12)).drop(*[f"__r_{f}" for f in weights])


def rank_hold(df: DataFrame, weights: dict[str, float], rebalance=20, top_n=5, bottom_n=3, min_window=21, ascending=False, computed=()) -> DataFrame:
    """Rank-and-hold over registry factors (and columns already in df, named in computed)."""
    weights = {f: w for f, w in weights.items() if w > 0}
    made = with_factors(df, [f for f in weights if f not in computed]).select(*run_keys(df), "date", "code", *weights)
    return hold_ranked(made, "score", rebalance, top_n, bottom_n, min_window, ascending, panel=df, scored=lambda rows: weighted_score(rows, weights))


#: Factor weights and first usable row of the rank-and-hold family.
RANKED = {
    "gtja_momentum": (("calc_momentum_5d_change", "calc_momentum_5d_ratio", "calc_momentum_6d_return", "calc_momentum_20d_return", "calc_momentum_20d_change"), 21, False),
    "gtja_volatility": (("calc_cci_12d", "calc_volume_vol_20d", "calc_atr_12d"), 21, False),
    "gtja_trend": (("calc_ma_slope_20d", "calc_macd_like"), 28, False),
    "gtja_vwap": (("calc_vwap_close_ratio", "calc_vwap_deviation"), 21, False),
    "gtja_mean_reversion": (("calc_rsi_6d", "calc_rsi_12d", "calc_directional_balance_12d", "calc_mfi_14d"), 21, True),
    "gtja_volume_price": (("calc_money_flow_6d", "calc_up_down_vol_ratio_26d", "calc_obv_6d", "calc_shadow_ratio_20d", "calc_return_1d_times_vol"), 27, False),
    "gtja_earnings_surprise": (("calc_earnings_surprise", "calc_earnings_acceleration"), 21, False),
}


def _ranked(name: str):
    factors, least, ascending = RANKED[name]

    def run(data: DataFrame, weights: dict | None = None, rebalance=20, top_n=5, bottom_n=3, min_window=least) -> DataFrame:
        return rank_hold(data, weights or {f: 1.0 for f in factors}, rebalance, top_n, bottom_n, min_window, ascending)

    return run


for _name in RANKED:
    register_strategy(_name, _ranked(_name))


#: Parameters of the rank-and-hold family that can be rows.
ROW_PARAMS = {"rebalance": 20, "top_n": 5, "bottom_n": 3, "min_window": None}


def grid_signals(data: DataFrame, name: str, grid: list[dict]) -> tuple[DataFrame | None, list[int]]:
    """(signals by run_id - the place in the grid - and the places that the strategy does not take).

    In the rank-and-hold family, sets of parameters that share weights share the scored panel and are rows that it is joined with, so that the
    plan is one whatever the grid.  Other strategies add a plan for each set.
    """
    parts, failed, alike = [], [], {}
    for k, params in enumerate(grid):
        rest = {p: v for p, v in params.items() if p not in ROW_PARAMS}
        if name in RANKED and set(rest) <= {"weights"}:
            row = {p: params.get(p, RANKED[name][1] if v is None else v) for p, v in ROW_PARAMS.items()}
            if (row["top_n"] <= 0 and row["bottom_n"] <= 0) or row["rebalance"] <= 0:
                failed.append(k)
            else:
                alike.setdefault(repr(sorted((rest.get("weights") or {}).items())), (rest.get("weights"), []))[1].append((f"{k:04d}", row))
            continue
        try:
            parts.append(get_strategy(name)(data, **params).withColumn("run_id", F.lit(f"{k:04d}")))
        except (TypeError, ValueError, KeyError):
            failed.append(k)
    for weights, rows_ in alike.values():
        weights = {f: w for f, w in (weights or dict.fromkeys(RANKED[name][0], 1.0)).items() if w > 0}
        scored = weighted_score(with_factors(data, list(weights)), weights)
        sets = data.sparkSession.createDataFrame([(r, *(int(row[p]) for p in ROW_PARAMS)) for r, row in rows_], "run_id string, " + ", ".join(f"{p} int" for p in ROW_PARAMS))
        dates = date_index(data).crossJoin(F.broadcast(sets))  # dates and sets of parameters, both few
        parts.append(held_ranks(scored.select("date", "code", "score"), "score", dates, RANKED[name][2], panel=data))
    return (reduce(DataFrame.unionByName, parts) if parts else None), failed


def pool_signals(data: DataFrame, pools: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """Signals of a strategy in each pool alone, by run_id (the pool's name).  pools: pool, code; a code may be in several.

    Where a code's signals come from its own rows, they are made once; the rank-and-hold family makes factors once and ranks within each
    pool; both are one plan whatever the pools.  Other strategies add a plan for each pool.
    """
    params = params or {}
    member = pools.select(F.col("pool").alias("run_id"), "code").distinct()
    if name in _OWN_ROWS:
        return get_strategy(name)(data, **params).join(member, "code")
    if name in RANKED and set(params) <= {*ROW_PARAMS, "weights"}:
        weights = {f: w for f, w in (params.get("weights") or dict.fromkeys(RANKED[name][0], 1.0)).items() if w > 0}
        made, terms = factor_terms(data, list(weights))
        if not terms.ranks:  # no factor ranks codes against each other
            made = made.select("date", "code", *weights).join(member, "code")
            dates = date_index(made, ["run_id"]).withColumns({p: F.lit(params.get(p, RANKED[name][1] if v is None else v)) for p, v in ROW_PARAMS.items()})
            return held_ranks(weighted_score(made, weights, ("date", "run_id")).select("run_id", "date", "code", "score"), "score", dates, RANKED[name][2])
    parts = []
    for pool in sorted(r["run_id"] for r in member.select("run_id").distinct().collect()):  # a handful of named pools
        inside = data.join(member.filter(F.col("run_id") == pool).select("code"), "code", "left_semi")
        parts.append(get_strategy(name)(inside, **params).withColumn("run_id", F.lit(pool)))
    return reduce(DataFrame.unionByName, parts)


@register_strategy("reversed_gtja_vwap")
def reversed_gtja_vwap(data: DataFrame, **params) -> DataFrame:
    return reverse(get_strategy("gtja_vwap")(data, **params))


@register_strategy("fundamental_diversified")
def fundamental_diversified(data: DataFrame, weights: dict | None = None, rebalance=15, top_n=10, bottom_n=5, min_window=21) -> DataFrame:
    """Surprise, illiquidity and stability of returns on equity; factors whose inputs are absent are left out."""
    from .factors import get_spec

    weights = weights or {"calc_earnings_surprise": 1.0, "calc_amihud": 0.8, "calc_roe_stability": 0.6}
    usable = {f: w for f, w in weights.items() if set(get_spec(f).needs) <= set(data.columns)}
    return rank_hold(data, usable, rebalance, top_n, bottom_n, min_window)


@register_strategy("multifactor")
def multifactor(data: DataFrame, momentum_window=20, rsi_window=14, hv_window=20, vol_window=20, weights: dict | None = None, rebalance=20, top_n=5, bottom_n=3) -> DataFrame:
    """Momentum, reversed RSI, low volatility and half-weighted volume ratio; holdings not bought again are sold."""
    weights = weights or {"momentum": 1.0, "rsi": 1.0, "volatility": 1.0, "volume": 0.5}
    made = with_factors(data.withColumn("__f", F.last("close", ignorenulls=True).over(by_code())), ["calc_rsi", "calc_hv", "calc_volume_ratio"], {"calc_rsi": {"window": rsi_window}, "calc_hv": {"window": hv_window}, "calc_volume_ratio": {"window": vol_window}})
    made = made.withColumns({"momentum": change("__f", momentum_window), "rsi": (100 - F.col("calc_rsi")) / 100, "volatility": -F.col("calc_hv"), "volume": F.col("calc_volume_ratio")})
    least = max(momentum_window, rsi_window, hv_window, vol_window) + 1
    return hold_ranked(made.select(*run_keys(data), "date", "code", *weights), "score", rebalance, top_n, bottom_n, least, sell_exited=True, panel=data, scored=lambda rows: weighted_score(rows, weights))


def scores_to_signals(df: DataFrame, score: str = "score", rebalance=20, top_n=10, bottom_n=5, panel: DataFrame | None = None, **how) -> DataFrame:
    return hold_ranked(df, score, rebalance, top_n, bottom_n, drop_unscored=True, sell_exited=True, min_rows=0, panel=panel, **how)


def composite_signals(df: DataFrame, weights: dict[str, float], **params) -> DataFrame:
    return scores_to_signals(combine_factor_scores(df, weights), "score", **params)


def composite_runs(df: DataFrame, runs: dict[str, dict[str, float]], rebalance=20, top_n=10, bottom_n=5, panel: DataFrame | None = None, buys: bool = False) -> DataFrame:
    """Signals of several composites (run_id: weights) side by side: factors are ranked once, and one plan holds all runs.  panel, buys: as ``held_ranks``."""
    names = list(dict.fromkeys(f for weights in runs.values() for f in weights))
    each = F.array(*[F.struct(F.lit(r).alias("run_id"), combined_ranks(weights).alias("score")) for r, weights in runs.items()])

    def scored(rows_):
        return with_ranks(rows_, names).withColumn("x", F.explode(each)).select("x.*", *[c for c in rows_.columns if c not in names])

    panel = df if panel is None else panel
    panel = panel if buys else panel.select(F.explode(F.array(*map(F.lit, runs))).alias("run_id"), "date", "code")
    return scores_to_signals(df.select("date", "code", *names), "score", rebalance, top_n, bottom_n, panel, scored=scored, buys=buys)


def _threshold(df: DataFrame, buy, sell, confidence, valid=None) -> DataFrame:
    """1, -1 or 0 by two conditions, sells before buys, where valid; confidence is clipped at 1 and missing counts as 0."""
    ok = F.lit(True) if valid is None else valid
    signal = F.when(ok & sell, -1).when(ok & buy, 1).otherwise(0)
    c = F.coalesce(F.least(confidence, F.lit(1.0)), F.lit(0.0))
    return df.select("date", "code", signal.cast("int").alias("signal"), F.when(confidence.isNotNull() & ok, c).otherwise(0.0).alias("confidence"))


@register_strategy("mean_reversion", own_rows=True)
def mean_reversion(data: DataFrame, window=20, num_std=2.0) -> DataFrame:
    """Buy under the lower Bollinger band, sell over the upper one."""
    made = spread(data, pieces(data), "code").withColumns({"__m": rolling_mean("close", window), "__s": rolling_std("close", window)})
    off = F.col("close") - F.col("__m")
    return _threshold(made, off < -num_std * F.col("__s"), off > num_std * F.col("__s"), F.abs(ratio(off, num_std * F.col("__s"))), F.col("__m").isNotNull())


@register_strategy("rsi_reversal", own_rows=True)
def rsi_reversal(data: DataFrame, window=14, oversold=30, overbought=70) -> DataFrame:
    made = data if "rsi" in data.columns else with_factors(data, ["calc_rsi"], {"calc_rsi": {"window": window}}).withColumnRenamed("calc_rsi", "rsi")
    return _threshold(made, F.col("rsi") < oversold, F.col("rsi") > overbought, F.abs(F.col("rsi") - 50) / 50)


def _volume_flags(data: DataFrame, vol_window: int, obv_window: int) -> DataFrame:
    made = with_factors(data, ["calc_volume_ratio", "calc_obv"], {"calc_volume_ratio": {"window": vol_window}})
    return made.withColumn("__rising", F.coalesce(F.avg("calc_obv").over(rows(obv_window)) > F.col("calc_obv"), F.lit(False)))


@register_strategy("momentum_breakout", own_rows=True)
def momentum_breakout(data: DataFrame, vol_window=20, vol_threshold=1.5, obv_window=10) -> DataFrame:
    """On a volume spike: buy unless the flow's mean lies above it, else sell.  The flag is as in the source of the rule."""
    made = _volume_flags(data, vol_window, obv_window)
    spike = F.col("calc_volume_ratio") > vol_threshold
    return _threshold(made, spike & ~F.col("__rising"), spike & F.col("__rising"), F.col("calc_volume_ratio") / vol_threshold)


@register_strategy("momentum_trend", own_rows=True)
def momentum_trend(data: DataFrame, vol_window=20, vol_threshold=1.5, obv_window=10, trend_window=60) -> DataFrame:
    made = _volume_flags(data, vol_window, obv_window).withColumn("__ma", rolling_mean("close", trend_window))
    spike = F.col("calc_volume_ratio") > vol_threshold
    up, down = F.col("close") > F.col("__ma"), F.col("close") < F.col("__ma")
    return _threshold(made, spike & F.col("__rising") & up, spike & ~F.col("__rising") & down, F.col("calc_volume_ratio") / vol_threshold, F.col("__ma").isNotNull())


# pair trading


def pair_zscores(data: DataFrame, pairs: DataFrame, lookback: int = 60, beta_method: str = "ols") -> DataFrame:
    """pair, code_a, code_b, date, log_a, log_b, z.  pairs: pair, code_a, code_b.

    The spread's mean and deviation over the window use that row's beta, so they follow from window moments of both legs.
    """
    if beta_method not in ("ols", "kalman", "fixed"):
        raise ValueError(f"unknown beta method {beta_method!r}")
    close = data.dropDuplicates(["date", "code"]).filter("close is not null").select("date", "code", F.log("close").alias("l"))
    legs = pairs.join(close.select("date", F.col("code").alias("code_a"), F.col("l").alias("log_a")), "code_a").join(close.select("date", F.col("code").alias("code_b"), F.col("l").alias("log_b")), ["code_b", "date"])
    by = Window.partitionBy("pair").orderBy("date")
    w = by.rowsBetween(-lookback, 0)
    if beta_method == "kalman":
        from .pairs import kalman_betas

        legs = legs.join(kalman_betas(legs), ["pair", "date"])
        beta = F.col("beta")
    else:
        beta = ratio(F.covar_pop("log_a", "log_b").over(w), F.var_pop("log_b").over(w)) if beta_method == "ols" else F.lit(1.0)
    moments = {"__b": beta, "__ma": F.avg("log_a").over(w), "__mb": F.avg("log_b").over(w), "__va": F.var_pop("log_a").over(w), "__vb": F.var_pop("log_b").over(w), "__c": F.covar_pop("log_a", "log_b").over(w), "__n": F.count("*").over(w)}
    out = legs.withColumns(moments)
    b = F.col("__b")
    sd = F.sqrt(F.greatest(F.col("__va") - 2 * b * F.col("__c") + b * b * F.col("__vb"), F.lit(0.0)))
    off = (F.col("log_a") - b * F.col("log_b")) - (F.col("__ma") - b * F.col("__mb"))
    z = F.when(F.col("__n") > lookback, F.when(sd > 1e-10, off / sd).otherwise(0.0))
    return out.select("pair", "code_a", "code_b", "date", "log_a", "log_b", z.alias("z"))


def own_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs without those that name a code which an earlier one has taken.  pairs: pair (their order), code_a, code_b.

    A pair stays if no earlier pair that stays shares a code with it.  Round by round, pairs that come first for both of their codes stay and
    those that share a code with them go; most lists are done in one round.
    """
    left, kept = pairs.select("pair", "code_a", "code_b"), []
    while True:
        codes = left.select("pair", F.explode(F.array("code_a", "code_b")).alias("code"))
        first = codes.groupBy("code").agg(F.min("pair").alias("first"))
        judged = codes.join(first, "code").groupBy("pair").agg(F.min(F.col("first") == F.col("pair")).alias("stays"))
        stay = left.join(judged.filter("stays"), "pair", "left_semi")
        kept.append(stay)
        taken = stay.select(F.explode(F.array("code_a", "code_b")).alias("code"))
        free = left.join(taken.withColumnRenamed("code", "code_a"), "code_a", "left_anti").join(taken.withColumnRenamed("code", "code_b"), "code_b", "left_anti")
        left = free.select("pair", "code_a", "code_b")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, kept)


@register_strategy("pair_trading")
def pair_trading(data: DataFrame, pairs: list[tuple[str, str]] | DataFrame = (), lookback=60, entry_zscore=2.0, exit_zscore=0.5, beta_method="ols") -> DataFrame:
    """Enter against a wide spread, leave at a narrow one; the first pair to name a code has it.

    pairs: a table (pair, code_a, code_b), or a list of codes two by two.  After a narrow spread the first wide one gives the side, until the
    next narrow one: rows between two narrow ones are one stretch, so no state is carried from row to row.
    """
    if exit_zscore > entry_zscore:
        raise ValueError("exit_zscore must not lie above entry_zscore")
    if not isinstance(pairs, DataFrame):
        pairs = data.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, code_a string, code_b string")
    scored = pair_zscores(data, own_pairs(pairs), lookback, beta_method)
    by = Window.partitionBy("pair").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    z = F.col("z")
    wide = F.when(z < -entry_zscore, 1).when(z > entry_zscore, -1)
    stretches = scored.withColumn("__stretch", F.count(F.when(F.abs(z) < exit_zscore, 1)).over(by))
    held = F.first(wide, ignorenulls=True).over(Window.partitionBy("pair", "__stretch").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    sure = F.least(F.abs(z) / entry_zscore, F.lit(1.0))
    sides = stretches.withColumn("__held", held).filter("z is not null and __held is not null").select("date", "code_a", "code_b", "__held", sure.alias("confidence"))
    legs = sides.select("date", F.explode(F.array(F.struct(F.col("code_a").alias("code"), F.col("__held").alias("signal")), F.struct(F.col("code_b").alias("code"), (-F.col("__held")).alias("signal")))).alias("l"), "confidence")
    legs = legs.select("date", "l.*", "confidence").filter("confidence > 0")
    return data.select("date", "code").join(legs, ["date", "code"], "left").select("date", "code", F.coalesce("signal", F.lit(0)).alias("signal"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


# combinators


def reverse(signals: DataFrame) -> DataFrame:
    return signals.withColumn("signal", -F.col("signal"))


def weighted_vote(signals: list[DataFrame], weights: list[float], threshold: float = 0.0) -> DataFrame:
    """Sign of the weighted mean signal beyond the threshold, with the weighted mean confidence.  A key that one of them lacks is an error."""
    total = float(sum(weights))
    tagged = [s.select("date", "code", (F.col("signal") * w).alias("v"), (F.col("confidence") * w).alias("c")) for s, w in zip(signals, weights)]
    every = reduce(DataFrame.unionByName, tagged)
    votes = spread(every, pieces(every), "date", "code").groupBy("date", "code").agg(F.sum("v").alias("v"), F.sum("c").alias("c"), F.count("*").alias("n"))
    v = F.when(F.col("n") == len(signals), F.col("v") / total).otherwise(F.raise_error(F.lit("signals do not have the same rows")).cast("double"))
    return votes.withColumn("v", v).select("date", "code", F.when(F.col("v") > threshold, 1).when(F.col("v") < -threshold, -1).otherwise(0).alias("signal"), (F.col("c") / total).alias("confidence"))


def filter_combine(main: DataFrame, filters: list[DataFrame]) -> DataFrame:
    """The main signal where every filter has one."""
    out, keep = main, F.lit(True)
    for k, f in enumerate(filters):
        out = out.join(f.select("date", "code", F.col("signal").alias(f"__f{k}")), ["date", "code"], "left")
        keep = keep & (F.coalesce(F.col(f"__f{k}"), F.lit(0)) != 0)
    return out.withColumns({"signal": F.when(keep, F.col("signal")).otherwise(0), "confidence": F.when(keep, F.col("confidence")).otherwise(0.0)}).select(*main.columns)


@register_strategy("multi_category")
def multi_category(data: DataFrame, strategies: dict[str, float] | None = None, threshold: float = 0.3) -> DataFrame:
    strategies = strategies or {"gtja_momentum": 1.0, "gtja_volatility": 1.0, "gtja_trend": 1.0}
    return weighted_vote([get_strategy(n)(data) for n in strategies], list(strategies.values()), threshold)


# regimes


def market_exposure(index: DataFrame, ma_short: int = 50, ma_long: int = 200, exposure: dict | None = None) -> DataFrame:
    """date, exposure from an index's close against its means: 1, 0.6, 0.4 or 0.2; 0.6 until both are known."""
    w = Window.orderBy("date")  # one index, one row a day
    mean = lambda n: F.when(F.count("close").over(w.rowsBetween(-(n - 1), 0)) == n, F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
    s, l = mean(ma_short), mean(ma_long)
    e = exposure or {1.0: 1.0, 0.6: 0.6, 0.4: 0.4, 0.2: 0.2}
    level = F.when(s.isNull() | l.isNull(), e[0.6]).when((F.col("close") > l) & (s > l), e[1.0]).when(F.col("close") > l, e[0.6]).when(s > l, e[0.4]).otherwise(e[0.2])
    return index.select("date", level.alias("exposure"))


def regime_inputs(data: DataFrame, trend_window: int = 20) -> DataFrame:
    """date, breadth (share above the mean, less a half), median_return, realized_vol: one row a day."""
    n = pieces(data)
    filled = spread(data.select("date", "code", "close"), n, "code").withColumn("__f", F.last("close", ignorenulls=True).over(by_code())).withColumn("__m", rolling_mean("close", trend_window))
    made = filled.withColumns({"__up": F.when(F.col("close") > F.col("__m"), 1.0).otherwise(0.0), "__r": change("__f", trend_window), "__d": change("__f", 1)})
    # a date's values lie together before they are counted: no map of values is written for each piece and date
    return spread(made.select("date", "__up", "__r", "__d"), n, "date").groupBy("date").agg((F.avg("__up") - 0.5).alias("breadth"), F.percentile("__r", F.lit(0.5)).alias("median_return"), F.stddev_samp("__d").alias("realized_vol"))


def persistent(days: DataFrame, label: str, least: int, name: str) -> DataFrame:
    """Adds name: the label with its short islands (runs of equal labels under ``least`` days) taken in.  days: one row a date.

    Up to the first island with which ``least`` days are over, all days bear that island's label (the last island's, if there are too few
    days).  From then on a day bears the label of the last island of ``least`` days or more, its own included; that first one's until there is one.
    """
    cut = islands(days.withColumn("__all", F.lit(1)), label, ["__all"])  # dates are few: one row a day
    each = cut.groupBy("__island").agg(F.first(label).alias("l"), F.count("*").alias("n"))
    by = Window.orderBy("__island")
    each = each.withColumn("over", F.sum("n").over(by) >= least)
    start = each.agg(F.min(F.when(F.col("over"), F.col("__island"))).alias("at"), F.max("__island").alias("end"))
    base = each.join(F.broadcast(start), F.col("__island") == F.coalesce("at", "end")).select(F.col("__island").alias("at"), F.col("l").alias("base"))
    named = each.join(F.broadcast(base))
    long = F.when((F.col("n") >= least) & (F.col("__island") > F.col("at")), F.col("l"))
    named = named.withColumn(name, F.coalesce(F.last(long, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("base")))
    return cut.join(F.broadcast(named.select("__island", name)), "__island").drop("__island", "__place", "__all")


def index_trend(index: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """date, bull and bear: an index's close beyond its short mean, and that beyond the long one; days without a close are passed over."""
    w = Window.orderBy("date")  # one index, one row a day

    def mean(n):
        rows_ = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(rows_) == n, F.avg("close").over(rows_))

    s, l = mean(short), mean(long)
    c = F.col("close")
    made = index.filter("close is not null").select("date", ((c > s) & (s > l)).alias("bull"), ((c < s) & (s < l)).alias("bear"))
    return made.select("date", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("bull", "bear")])


def detect_regime(data: DataFrame, trend_window=20, vol_lookback=60, vol_high_pct=75.0, vol_low_pct=25.0, strong=0.2, weak=0.15, ema_span=5, min_persistence=7, index: DataFrame | None = None) -> DataFrame:
    """date, regime: trend_up, trend_down, volatile or range.  Thresholds of the first days are those of the whole sample (a look-ahead, kept)."""
    from ..sources.dated import materialised

    inputs = materialised(regime_inputs(data, trend_window), "regime-inputs")  # one row a day, read by several steps below
    days = ewm_position(inputs.withColumn("code", F.lit("all")))
    inputs = ("breadth", "median_return", "realized_vol")
    if ema_span > 1:
        days = days.select("date", "code", *[ewm(c, ema_span + 1, 2, 1).alias(c) for c in inputs])
    whole = Window.partitionBy("code")
    limits = {n: F.coalesce(rolling_quantile("realized_vol", q / 100, vol_lookback, 20), F.percentile("realized_vol", F.lit(q / 100)).over(whole)) for n, q in (("high", vol_high_pct), ("low", vol_low_pct))}
    days = days.withColumns(limits)

    def holds(x):
        return F.coalesce(x, F.lit(False))

    b, m, v = (F.col(c) for c in inputs)
    hot, cold, up, down = holds(v > F.col("high")), holds(v < F.col("low")), holds(b > 0) | holds(m > 0), holds(b < 0) | holds(m < 0)
    wide, mild = holds(F.abs(b) > strong), ~hot & ~cold & holds(F.abs(b) > weak)
    label = F.when(mild & down, "trend_down").when(mild & up, "trend_up").when(hot & ~wide, "volatile").when(hot & down, "trend_down").when(hot & up, "trend_up").otherwise("range")
    days = days.select("date", label.alias("label"))
    if index is not None:
        days = days.join(F.broadcast(index_trend(index)), "date", "left")
        against = ((F.col("label") == "trend_up") & holds(F.col("bear"))) | ((F.col("label") == "trend_down") & holds(F.col("bull")))
        days = days.select("date", F.when(against, "range").otherwise(F.col("label")).alias("label"))
    return persistent(days, "label", min_persistence, "regime").select("date", "regime")


def regime_switch(data: DataFrame, regimes: DataFrame, strategies: dict[str, str], confirmation_lag: int = 10) -> DataFrame:
    """Signals of the confirmed regime's strategy.  Strategies look back only, so each runs once and rows are picked by date; other regimes give 0."""
    sure = sustained(regimes.select("date", "regime", F.lit(1).alias("__all")), "regime", confirmation_lag + 1, "sure", ["__all"]).select("date", F.col("sure").alias("regime"))
    parts = [get_strategy(s)(data).withColumn("__regime", F.lit(r)) for r, s in strategies.items()]
    chosen = reduce(DataFrame.unionByName, parts).join(F.broadcast(sure), "date").filter(F.col("__regime") == F.col("regime"))
    out = data.select("date", "code").join(chosen.select("date", "code", "signal", "confidence"), ["date", "code"], "left")
    return out.select("date", "code", F.coalesce("signal", F.lit(0)).alias("signal"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


#: Rebalance parameters by regime; unknown regimes use those of range.
ROUTES = {"trend_up": {"rebalance": 10, "top_n": 5, "bottom_n": 3}, "trend_down": {"rebalance": 20, "top_n": 3, "bottom_n": 5}, "range": {"rebalance": 20, "top_n": 5, "bottom_n": 3}, "volatile": {"rebalance": 5, "top_n": 3, "bottom_n": 3}}


def route_params(regime: str, routes: dict | None = None) -> dict:
    routes = routes or ROUTES
    return dict(routes.get(regime, routes.get("range", {})))
