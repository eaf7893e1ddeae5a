"""Event-ordered backtests.  A run is sequential in its cash, so each run is one group; many runs go in parallel by run_id."""
from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date as Day
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..sources.dated import materialised
from . import cleaning, portfolio

EXITS = ("sell", "stop_loss", "take_profit", "atr_stop_loss")
RISK_FREE, YEAR = 0.03 / 252, 252


@dataclass(frozen=True)
class TradingCost:
    """Commission with a least fee, stamp tax on sales, transfer fee, slippage in ticks of a cent."""

    commission: float = 1e-4
    stamp_tax: float = 5e-4
    transfer_fee: float = 1e-5
    slippage_ticks: int = 1
    least: float = 5.0

    def fees(self, amount: float, sell: bool) -> float:
        if amount <= 0:
            return 0.0
        out = max(amount * self.commission, self.least) if self.commission > 0 else 0.0
        return out + (amount * self.stamp_tax if sell else 0.0) + amount * self.transfer_fee


@dataclass(frozen=True)
class Engine:
    capital: float = 1_000_000
    stop_loss: float | None = None
    take_profit: float | None = None
    atr_multiplier: float | None = None
    cost: TradingCost | None = None
    breaker: portfolio.CircuitBreaker | None = None

    def _fill(self, price: float, sell: bool, limits: tuple) -> float:
        if self.cost is None or not self.cost.slippage_ticks:
            return price
        step = self.cost.slippage_ticks * 0.01
        if sell:
            return max(price - step, limits[1]) if limits[1] is not None else price - step
        return min(price + step, limits[0]) if limits[0] is not None else price + step

    def _fees(self, amount: float, sell: bool) -> float:
        return self.cost.fees(amount, sell) if self.cost else 0.0

    def _affordable(self, cash: float, price: float) -> int:
        """Whole lots that cash pays for, under either fee regime."""
        room = cash
        if self.cost is not None:
            room = min((cash - self.cost.least) / (1 + self.cost.transfer_fee), cash / (1 + self.cost.commission + self.cost.transfer_fee))
        return int(room / price / portfolio.LOT) * portfolio.LOT if room > 0 and price > 0 else 0

    def play(self, days: list, targets: dict, prices: dict, atr: dict | None = None, limits: dict | None = None, capital: float | None = None) -> tuple[list, list]:
        """(trades, equity rows) of one run.

        targets: {day: {code: shares}}; prices: {day: {code: close}}.  On a day without targets everything held is sold.  Order of a day: the
        breaker scales targets by yesterday's drawdown; stops (ATR, fixed, profit); sales of what exceeds the target; purchases of
        codes not held, in order of code, as cash allows; equity, to which a code without a price adds nothing.
        """
        cash = start = self.capital if capital is None else capital
        held, paid, trades, equity, history = {}, {}, [], [], [start]
        peak, active = 0.0, 1.0
        for day in days:
            quotes = {c: p for c, p in prices.get(day, {}).items() if p is not None and not math.isnan(p)}
            bounds = (limits or {}).get(day, {})
            target = {c: s for c, s in sorted(targets.get(day, {}).items()) if s > 0}
            if self.breaker is not None and history[-1] > 0:
                peak = max(peak, history[-1])
                wanted = 1.0 if self.breaker.recovers_fast(history) else self.breaker.exposure_at((history[-1] - peak) / peak)
                active = wanted if abs(wanted - active) > self.breaker.dead_zone else active
                if active < 1:
                    target = {c: int(s * active) for c, s in target.items()}
            stopped = set()

            def sell(code, shares, action):
                nonlocal cash
                price = self._fill(quotes[code], True, bounds.get(code, (None, None)))
                fees = self._fees(shares * price, True)
                cash += shares * price - fees
                trades.append((day, code, action, price, shares, shares * (price - paid.get(code, quotes[code])) - fees, fees))

            for code in [c for c in held if c in quotes]:
                entry, price = paid.get(code, quotes[code]), quotes[code]
                gain = (price - entry) / entry if entry > 0 else 0.0
                swing = (atr or {}).get(day, {}).get(code) if self.atr_multiplier is not None else None
                if swing is not None and not math.isnan(swing) and entry > 0 and price < entry - self.atr_multiplier * swing:
                    action = "atr_stop_loss"
                elif self.stop_loss is not None and gain < self.stop_loss:
                    action = "stop_loss"
                elif self.take_profit is not None and gain > self.take_profit:
                    action = "take_profit"
                else:
                    continue
                sell(code, held.pop(code), action)
                paid.pop(code, None)
                stopped.add(code)
            for code in [c for c in held if c in quotes]:
                want = target.get(code, 0)
                if held[code] > want:
                    sell(code, held[code] - want, "sell" if want == 0 else "cb_compress")
                    held[code] = want
                    if want == 0:
                        held.pop(code)
                        paid.pop(code, None)
            for code, want in target.items():
                if code in held or code in stopped or code not in quotes:
                    continue
                price = self._fill(quotes[code], False, bounds.get(code, (None, None)))
                shares = min(self._affordable(cash, price), want)
                fees = self._fees(shares * price, False)
                if shares > 0 and shares * price + fees <= cash + 0.01:
                    cash -= shares * price + fees
                    held[code], paid[code] = shares, (shares * price + fees) / shares
                    trades.append((day, code, "buy", price, shares, 0.0, fees))
            value = sum(s * quotes.get(c, 0.0) for c, s in held.items())
            before = equity[-1][1] if equity else None
            equity.append((day, cash + value, cash, value, (cash + value) / before - 1 if before else 0.0))
            history.append(cash + value)
        return trades, equity


def played_runs(positions: DataFrame, prices: DataFrame, engines: dict[str, Engine], market: DataFrame | None = None, atr_window: int = 14, capital: float | None = None, limits: DataFrame | None = None) -> DataFrame:
    """One row a run: run_id, its trades and its equity.  positions: run_id, date, code, shares; prices: date, code, close, the same for each run.

    limits: date, code, limit_up, limit_down as prices.  A run's group holds the prices of the codes that it ever targets with shares: whole lots
    within the capital, so their number does not follow that of the codes.
    """
    import pandas as pd

    spark = positions.sparkSession
    # read twice, and few beside the panel that they are made from
    positions = materialised(positions.filter("shares > 0").select("run_id", "date", "code", "shares"), "positions")
    # only days and the codes that a run ever holds are needed for its trades
    wanted = positions.select("run_id", "code").distinct()
    quotes = prices.select("date", "code", "close").join(wanted.select("code").distinct(), "code", "left_semi").dropDuplicates(["date", "code"])
    if any(e.atr_multiplier is not None for e in engines.values()):
        if market is None:
            raise ValueError("stops by true range need market data")
        from .factors import with_factors

        swings = with_factors(market, ["calc_atr"], {"calc_atr": {"window": atr_window}}).select("date", "code", F.col("calc_atr").alias("atr"))
        quotes = quotes.join(swings, ["date", "code"], "left")
    else:
        quotes = quotes.withColumn("atr", F.lit(None).cast("double"))
    if limits is not None:
        quotes = quotes.join(limits.select("date", "code", F.col("limit_up").cast("double").alias("up"), F.col("limit_down").cast("double").alias("down")), ["date", "code"], "left")
    else:
        quotes = quotes.withColumns({"up": F.lit(None).cast("double"), "down": F.lit(None).cast("double")})
    runs = F.broadcast(spark.createDataFrame([(r,) for r in engines], "run_id string"))
    days = prices.select("date").distinct().crossJoin(runs).select("run_id", "date", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("double").alias(c) for c in ("close", "atr", "up", "down")], F.lit(None).cast("long").alias("shares"))
    priced = quotes.join(wanted, "code").select("run_id", "date", "code", "close", "atr", "up", "down", F.lit(None).cast("long").alias("shares"))
    held = positions.select("run_id", "date", "code", *[F.lit(None).cast("double").alias(c) for c in ("close", "atr", "up", "down")], F.col("shares").cast("long").alias("shares"))
    rows = days.unionByName(priced).unionByName(held)

    def play(key, pdf):
        engine = engines[key[0]]
        days = sorted(pdf.loc[pdf["code"].isna(), "date"].unique())
        targets, prices_, atr, bounds = {}, {}, {}, {}
        for d, c, close, a, up, down, shares in pdf[["date", "code", "close", "atr", "up", "down", "shares"]].itertuples(index=False):
            if not isinstance(c, str):
                continue
            if shares == shares and shares is not None:
                targets.setdefault(d, {})[c] = int(shares)
            else:
                prices_.setdefault(d, {})[c] = close
                atr.setdefault(d, {})[c] = a
                bounds.setdefault(d, {})[c] = tuple(None if x is None or math.isnan(x) else x for x in (up, down))
        trades, equity = engine.play(days, targets, prices_, atr, bounds, capital)
        named = [[dict(zip(names, row)) for row in rows] for names, rows in ((("date", "code", "action", "price", "shares", "pnl", "cost"), trades), (("date", "equity", "cash", "position_value", "returns"), equity))]
        return pd.DataFrame({"run_id": [key[0]], "trades": [named[0]], "equity": [named[1]]})

    return rows.groupBy("run_id").applyInPandas(play, PLAYED)


PLAYED = "run_id string, trades array<struct<date:date,code:string,action:string,price:double,shares:bigint,pnl:double,cost:double>>, equity array<struct<date:date,equity:double,cash:double,position_value:double,returns:double>>"


def exploded(played: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, equity) from one row a run."""
    trades = played.select("run_id", F.explode("trades").alias("t")).select("run_id", "t.*")
    return trades, played.select("run_id", F.explode("equity").alias("e")).select("run_id", "e.*")


def run_backtests(positions: DataFrame, prices: DataFrame, engines: dict[str, Engine], market: DataFrame | None = None, atr_window: int = 14, capital: float | None = None, limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trades, equity) of all runs; as played_runs."""
    return exploded(played_runs(positions, prices, engines, market, atr_window, capital, limits))


def played_metrics(played: DataFrame, capital: float = 1_000_000) -> DataFrame:
    """The figures of ``metrics`` from one row a run, so that each run is replayed once."""
    exit_, t = lambda x: x["action"].isin(*EXITS), F.col("trades")
    total = lambda f: F.aggregate(t, F.lit(0.0), lambda s, x: s + f(x))
    exits = F.size(F.filter(t, exit_))
    stats = played.select(
        "run_id",
        F.coalesce(ratio(F.size(F.filter(t, lambda x: exit_(x) & (x["pnl"] > 0))), exits), F.lit(0.0)).alias("win_rate"),
        F.size(t).cast("long").alias("trade_count"),
        total(lambda x: x["cost"]).alias("total_cost"),
        F.coalesce(ratio(total(lambda x: x["cost"]), total(lambda x: x["shares"] * x["price"])), F.lit(0.0)).alias("cost_ratio"),
        F.explode("equity").alias("e"),
    ).select("*", F.col("e.date").alias("date"), F.col("e.equity").alias("equity"), F.col("e.returns").alias("returns"))
    peak = F.max("equity").over(Window.partitionBy("run_id").orderBy("date"))
    off = stats.withColumn("drawdown", F.abs(F.when(peak > 0, (F.col("equity") - peak) / peak).otherwise(F.col("equity") - peak)))
    x = F.col("returns") - RISK_FREE
    once = [F.max(c).alias(c) for c in ("win_rate", "trade_count", "total_cost", "cost_ratio")]
    e = off.groupBy("run_id").agg(F.max_by("equity", "date").alias("final"), F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.max("drawdown").alias("max_drawdown"), *once)
    return _figures(e, capital, F.col("s") > 0).select("run_id", "total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "trade_count", "total_cost", "cost_ratio")


def _figures(e: DataFrame, capital: float, enough) -> DataFrame:
    """Adds total_return, annual_return and sharpe_ratio from final, n, m and s."""
    total = F.col("final") / capital - 1
    annual = F.when((F.col("n") > 1) & (total > -1), F.pow(1 + total, F.lit(float(YEAR)) / F.col("n")) - 1).otherwise(0.0)
    return e.withColumns({"total_return": total, "annual_return": annual, "sharpe_ratio": F.when(enough, F.col("m") / F.col("s") * math.sqrt(YEAR)).otherwise(0.0)})


def metrics(trades: DataFrame, equity: DataFrame, capital: float = 1_000_000) -> DataFrame:
    """One row per run: total and annual return, Sharpe ratio, greatest drawdown, win rate, trades, cost and cost ratio."""
    t = trades.groupBy("run_id").agg(F.collect_list(F.struct("date", "code", "action", "price", "shares", "pnl", "cost")).alias("trades"))
    e = equity.groupBy("run_id").agg(F.collect_list(F.struct("date", "equity", "cash", "position_value", "returns")).alias("equity"))
    both = e.join(t, "run_id", "left").withColumn("trades", F.coalesce("trades", F.array().cast(t.schema["trades"].dataType)))
    return played_metrics(both, capital)


def equity_metrics(equity: DataFrame, capital: float = 1_000_000) -> DataFrame:
    """The continuous figures of an equity curve per run: its own returns, without the first day."""
    by = Window.partitionBy("run_id").orderBy("date")
    return metrics_of_returns(equity.withColumn("r", F.col("equity") / F.lag("equity").over(by) - 1), portfolio.drawdowns(equity), capital)


def metrics_of_returns(rows: DataFrame, dd: DataFrame, capital: float) -> DataFrame:
    x = F.col("r") - RISK_FREE
    e = rows.groupBy("run_id").agg(F.max_by("equity", "date").alias("final"), F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    e = _figures(e, capital, (F.col("n") > 2) & (F.col("s") > 1e-10)).select("run_id", "total_return", "annual_return", "sharpe_ratio")
    return e.join(dd.groupBy("run_id").agg(F.max(F.abs("drawdown")).alias("max_drawdown")), "run_id")


def build_positions(data: DataFrame, signals: DataFrame, capital: float = 1_000_000, rebalance_days: int | None = None, dead_zone: float = 0.0, exposure: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Tradable signals, every rebalance_days-th signal date, equal weights, smoothed where a dead zone is given; runs (run_id) each on its own."""
    signals = cleaning.filter_tradable(data, signals)
    if rebalance_days is not None:
        run = cleaning.run_keys(signals)
        by = Window.partitionBy(*run).orderBy("date") if run else Window.orderBy("date")  # one row a date
        days = signals.select(*run, "date").distinct().withColumn("i", F.row_number().over(by) - 1).filter(F.col("i") % rebalance_days == 0)
        signals = signals.join(F.broadcast(days.select(*run, "date")), [*run, "date"], "left_semi")
    buys = materialised(signals.filter("signal = 1"), "buys")  # all of which ``enforce_t1`` lets stand; read twice
    priced = data.join(buys.select("date", "code"), ["date", "code"], "left_semi")  # no other close crosses an exchange
    out = portfolio.equal_weight(buys, priced, capital, exposure)
    return portfolio.smooth_positions(out, data, capital, dead_zone, before, exposure=exposure) if dead_zone > 0 else out


def run_pipeline(data: DataFrame, runs: dict[str, DataFrame] | DataFrame, engine: Engine | dict[str, Engine] = Engine(), industries: DataFrame | None = None, industry_cap: float | None = None, max_weight: float | None = None, **build) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, equity, metrics) of named signal tables (or one with run_id), all in one plan: positions, caps, engine.

    Runs of equal capital are built side by side, so that a step is one exchange however many runs there are.
    """
    if isinstance(runs, dict):
        names = list(runs)
        signals = {name: s.withColumn("run_id", F.lit(name)) for name, s in runs.items()}
    else:
        names = [r["run_id"] for r in runs.select("run_id").distinct().orderBy("run_id").collect()]  # a handful of runs
        signals = {name: runs.filter(F.col("run_id") == name) for name in names}
    engines = engine if isinstance(engine, dict) else {name: engine for name in names}
    parts = []
    for capital in dict.fromkeys(engines[n].capital for n in names):
        mine = [n for n in names if engines[n].capital == capital]
        alike = runs if len(mine) == len(names) and not isinstance(runs, dict) else reduce(DataFrame.unionByName, (signals[n] for n in mine))
        p = build_positions(data, alike, capital, **build)
        if industries is not None and industry_cap is not None:
            p = portfolio.apply_industry_cap(p, industries, industry_cap)
        if max_weight is not None:
            p = portfolio.apply_position_limit(p, max_weight)
        parts.append(p)
    played = played_runs(reduce(DataFrame.unionByName, parts), data, engines, data)
    return *exploded(played), played_metrics(played, engines[names[0]].capital)


def add_months(d: Day, n: int) -> Day:
    k = d.year * 12 + d.month - 1 + n
    last = (Day(k // 12 + (k % 12 == 11), (k + 1) % 12 + 1, 1) - Day(k // 12, k % 12 + 1, 1)).days
    return Day(k // 12, k % 12 + 1, min(d.day, last))


def generate_windows(first: Day, last: Day, train_months: int = 12, test_months: int = 3, step_months: int | None = None) -> list[tuple[Day, Day, Day, Day]]:
    """(train start, train end, test start, test end), ends inclusive; the test begins the day after training ends, and windows that do
    not end by last are left out.
    """
    out, start = [], first
    while True:
        mid = add_months(start, train_months)
        end = add_months(mid + timedelta(days=1), test_months)
        if end > last:
            return out
        out.append((start, mid, mid + timedelta(days=1), end))
        start = add_months(start, step_months or test_months)


#: A day's targets of a walk-forward run: the period, and each code's weight after each step that cuts whole lots.
TARGETS = "period int, date date, code string, weights array<double>, close double, exposure double"


def play_periods(engine: Engine, periods: list[tuple[Day, Day]], days: list, targets: dict, prices: dict) -> tuple[list, list]:
    """(equity rows, figures) of periods in turn, each with the capital that the one before ended with.

    targets: {period: {day: {code: (weights, close, exposure)}}}.  Shares follow from the capital, in whole lots after each step.
    A period without targets keeps its capital and has figures of 0; later periods drop their first row, the day that the one before ended on.
    """
    capital, curve, figures = engine.capital, [], []
    for k, (start, stop) in enumerate(periods):
        inside = [d for d in days if start <= d <= stop]
        if not inside:
            continue
        if k not in targets:
            figures.append((k, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0))
            continue
        shares = {}
        for day, held in targets[k].items():
            for code, (weights, close, exposure) in held.items():
                if close is None or close != close or close == 0:
                    continue
                n = math.floor(capital * exposure * weights[0] / close / portfolio.LOT) * portfolio.LOT
                for old, new in zip(weights, weights[1:]):
                    n = math.floor(n * new / old / portfolio.LOT + 1e-9) * portfolio.LOT if old else 0
                shares.setdefault(day, {})[code] = n
        trades, equity = engine.play(inside, shares, prices, capital=capital)
        figures.append((k, *run_figures(trades, equity, capital)))
        curve += [(k, *row) for row in (equity if not curve else equity[1:])]
        capital = curve[-1][2] if curve else capital
    return curve, figures


def run_figures(trades: list, equity: list, capital: float) -> tuple:
    """The figures of ``metrics`` of one played run."""
    import numpy as np

    value, back = np.array([e[1] for e in equity]), np.array([e[4] for e in equity]) - RISK_FREE
    total, peak = value[-1] / capital - 1, np.maximum.accumulate(value)
    annual = (1 + total) ** (YEAR / len(value)) - 1 if len(value) > 1 and total > -1 else 0.0
    sharpe = back.mean() / back.std() * math.sqrt(YEAR) if back.std() > 0 else 0.0
    exits = [t for t in trades if t[2] in EXITS]
    cost, turned = sum(t[6] for t in trades), sum(t[4] * t[3] for t in trades)
    drawdown = np.abs(np.where(peak > 0, (value - peak) / np.where(peak > 0, peak, 1), value - peak)).max()
    return float(total), float(annual), float(sharpe), float(drawdown), sum(t[5] > 0 for t in exits) / len(exits) if exits else 0.0, len(trades), float(cost), cost / turned if turned else 0.0


def walk_forward_targets(data: DataFrame, positions: DataFrame, windows: list, exposure: DataFrame | None = None) -> DataFrame:
    """period, date, code, weights, close, exposure: the positions of each period.  positions: date, code, weights."""
    spans = F.broadcast(data.sparkSession.createDataFrame([(k, w[2], w[3]) for k, w in enumerate(windows)], "period int, start date, stop date"))
    priced = positions.join(data.select("date", "code", "close").dropDuplicates(["date", "code"]), ["date", "code"], "left")
    priced = priced.withColumn("exposure", F.lit(1.0)) if exposure is None else priced.join(F.broadcast(exposure.select("date", "exposure")), "date", "left").withColumn("exposure", F.coalesce("exposure", F.lit(1.0)))
    return priced.join(spans, F.col("date").between(F.col("start"), F.col("stop"))).select("period", "date", "code", "weights", "close", "exposure")


def walk_periods(data: DataFrame, targets: DataFrame, windows: list, engine: Engine) -> DataFrame:
    """equity, figures: one row with the curve and the periods' figures, of all periods in one group, for one period's capital depends on the one before."""
    import pandas as pd

    spans = [(w[2], w[3]) for w in windows]
    empty = {"period": "int", "weights": "array<double>", "exposure": "double"}
    days = data.select("date").distinct().select("date", F.lit(None).cast("string").alias("code"), F.lit(None).cast("double").alias("close"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    quotes = data.select("date", "code", "close").dropDuplicates(["date", "code"]).join(targets.select("code").distinct(), "code").select("date", "code", "close", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    rows = days.unionByName(quotes).unionByName(targets.select("date", "code", "close", *empty))

    def run(pdf):
        known, targets_, prices = [], {}, {}
        for d, c, close, k, weights, share in pdf[["date", "code", "close", *empty]].itertuples(index=False):
            if not isinstance(c, str):
                known.append(d)
            elif k == k and k is not None:
                targets_.setdefault(int(k), {}).setdefault(d, {})[c] = (list(weights), close, share)
            else:
                prices.setdefault(d, {})[c] = close
        curve, figures = play_periods(engine, spans, sorted(known), targets_, prices)
        names = ("period", "date", "equity", "cash", "position_value", "returns"), ("period", *FIGURES)
        return pd.DataFrame({"equity": [[dict(zip(names[0], r)) for r in curve]], "figures": [[dict(zip(names[1], r)) for r in figures]]})

    return rows.groupBy(F.lit(1).alias("walk")).applyInPandas(run, "equity array<struct<period:int,date:date,equity:double,cash:double,position_value:double,returns:double>>, figures array<struct<period:int,total_return:double,annual_return:double,sharpe_ratio:double,max_drawdown:double,win_rate:double,trade_count:bigint,total_cost:double,cost_ratio:double>>")


def curve_and_periods(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(equity with period, per-period metrics) of a walk; each read replays it, ``overall_metrics`` reads both at once."""
    return walked.select(F.explode("equity").alias("e")).select("e.*"), walked.select(F.explode("figures").alias("f")).select("f.*")


FIGURES = ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "trade_count", "total_cost", "cost_ratio")


def walked(data: DataFrame, signals: DataFrame, windows: list, engine: Engine = Engine(), exposure: DataFrame | None = None, pool: DataFrame | None = None, industries: DataFrame | None = None, industry_cap: float | None = None, max_weight: float | None = None, dead_zone: float = 0.0) -> DataFrame:
    """The walk as one row (``walk_periods``).  Capital goes from one period to the next.

    exposure: date, exposure - the share of capital invested.  pool: date, code - what may be bought.  dead_zone smooths weights over the
    periods as one series, so that each period starts from the weights that the one before ended with.
    """
    signals = signals if pool is None else signals.join(pool.select("date", "code").distinct(), ["date", "code"], "left_semi")
    tradable = cleaning.enforce_t1(cleaning.filter_tradable(data, signals)).filter("signal = 1")
    held = tradable.select("date", "code", ratio(F.lit(1.0), F.count("*").over(Window.partitionBy("date"))).alias("weight"))
    if dead_zone > 0:
        held = portfolio.smooth_positions(held, data, engine.capital, dead_zone).select("date", "code", "weight")
    return walk_periods(data, walk_forward_targets(data, _capped(held, industries, industry_cap, max_weight), windows, exposure), windows, engine)


def walk_forward(data: DataFrame, signals: DataFrame, windows: list, engine: Engine = Engine(), **options) -> tuple[DataFrame, DataFrame]:
    """(equity with period, per-period metrics) of ``walked``."""
    return curve_and_periods(walked(data, signals, windows, engine, **options))


def _capped(held: DataFrame, industries: DataFrame | None, industry_cap: float | None, max_weight: float | None) -> DataFrame:
    """date, code, weights: the weight before and after each cap that applies."""
    steps, out = ["w0"], held.select("date", "code", "weight", F.lit(0).cast("long").alias("shares"), F.col("weight").alias("w0"))
    caps = [] if industries is None or industry_cap is None else [lambda p: portfolio.apply_industry_cap(p, industries, industry_cap)]
    caps += [] if max_weight is None else [lambda p: portfolio.apply_position_limit(p, max_weight)]
    for k, cap in enumerate(caps, 1):
        out = cap(out).withColumn(f"w{k}", F.col("weight"))
        steps.append(f"w{k}")
    return out.select("date", "code", F.array(*steps).alias("weights"))


def overall_metrics(walked: DataFrame, capital: float = 1_000_000) -> DataFrame:
    """Figures of the chained curve, with mean, deviation and ratio of the periods' Sharpe ratios, from the one row of a walk: it is replayed once."""
    def total(x, f):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))

    row = walked.select("equity", F.transform("figures", lambda f: f["sharpe_ratio"]).alias("each")).withColumn("mean", F.coalesce(ratio(total(F.col("each"), lambda v: v), F.size("each")), F.lit(0.0)))
    spread = F.coalesce(F.sqrt(ratio(total(F.col("each"), lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.size("each") - 1)), F.lit(0.0))
    points = row.select("mean", spread.alias("std"), F.lit(1).alias("walk"), F.explode("equity").alias("e")).select("walk", "mean", "std", "e.date", "e.equity")
    by = Window.partitionBy("walk").orderBy("date")  # one row a date
    peak = F.max("equity").over(by)
    points = points.withColumns({"x": ratio(F.col("equity"), F.lag("equity").over(by)) - 1 - RISK_FREE, "drawdown": F.abs(ratio(F.col("equity") - peak, peak))})
    e = points.groupBy("walk").agg(F.max_by("equity", "date").alias("final"), F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("drawdown").alias("max_drawdown"), F.max("mean").alias("per_period_sharpe_mean"), F.max("std").alias("per_period_sharpe_std"))
    out = _figures(e, capital, (F.col("n") > 2) & (F.col("s") > 1e-10)).select("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "per_period_sharpe_mean", "per_period_sharpe_std")
    return out.withColumn("per_period_ir", F.when(F.col("per_period_sharpe_std") > 1e-10, F.col("per_period_sharpe_mean") / F.col("per_period_sharpe_std")).otherwise(0.0))


def merge_silos(silos: list[tuple[DataFrame, float]], prices: DataFrame, capital: float = 1_000_000) -> DataFrame:
    """Weighted positions of several silos summed, renormalised per date, shares from the total capital."""
    parts = [p.select("date", "code", (F.col("weight") * w).alias("weight")) for p, w in silos]
    total = reduce(DataFrame.unionByName, parts).groupBy("date", "code").agg(F.sum("weight").alias("weight"))
    day = F.sum("weight").over(Window.partitionBy("date"))
    out = total.withColumn("weight", F.col("weight") / F.when(day == 0, 1.0).otherwise(day)).join(prices.select("date", "code", "close").dropDuplicates(["date", "code"]), ["date", "code"], "left")
    return out.select("date", "code", "weight", F.greatest(portfolio.lots(ratio(capital * F.col("weight"), F.col("close"))), F.lit(0)).alias("shares"))


def run_sweep(data: DataFrame, strategy: str, grid: list[dict], engine: Engine = Engine(), **build) -> DataFrame:
    """Metrics of a strategy for each set of parameters (run_id: its place); a set that the strategy does not take gives a row of zeros.

    Sets of a rank-and-hold strategy are rows (``strategies.grid_signals``): scans and exchanges do not grow with the grid.
    """
    from .strategies import grid_signals

    runs, failed = grid_signals(data, strategy, grid)
    out = run_pipeline(data, runs, engine, **build)[2] if runs is not None else None
    if failed:
        zero = data.sparkSession.createDataFrame([(f"{k:04d}", 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0) for k in failed], "run_id string, total_return double, annual_return double, sharpe_ratio double, max_drawdown double, win_rate double, trade_count long, total_cost double, cost_ratio double")
        out = zero if out is None else out.unionByName(zero)
    return out


def continuous_backtest(data: DataFrame, signals: DataFrame, engine: Engine = Engine(), **build) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, equity, figures of the curve) over the whole range without re-training."""
    trades, equity, _ = run_pipeline(data, {"continuous": signals}, engine, **build)
    return trades, equity, equity_metrics(equity, engine.capital)


def run_matrix(data: DataFrame, pools: DataFrame, names: list[str], engine: Engine = Engine(), params: dict[str, dict] | None = None, **build) -> DataFrame:
    """pool, strategy and metrics: every strategy in every pool, as runs of one plan.  pools: pool, code."""
    from .strategies import pool_signals

    parts = [pool_signals(data, pools, name, (params or {}).get(name)).withColumn("run_id", F.concat("run_id", F.lit(f"|{name}"))) for name in names]
    out = run_pipeline(data, reduce(DataFrame.unionByName, parts), engine, **build)[2]
    return out.withColumns({"pool": F.substring_index("run_id", "|", 1), "strategy": F.substring_index("run_id", "|", -1)}).drop("run_id")


def walked_silos(data: DataFrame, silos: list[tuple[DataFrame, float]], windows: list, engine: Engine = Engine(), industries: DataFrame | None = None, industry_cap: float | None = None, max_weight: float | None = None, exposure: DataFrame | None = None) -> DataFrame:
    """Walk-forward over several silos of signals whose weights add up per date; caps apply to the sum.  As walked otherwise."""
    parts = []
    for signals, share in silos:
        buys = cleaning.enforce_t1(cleaning.filter_tradable(data, signals)).filter("signal = 1")
        parts.append(buys.select("date", "code", (ratio(F.lit(1.0), F.count("*").over(Window.partitionBy("date"))) * share).alias("weight")))
    total = reduce(DataFrame.unionByName, parts).groupBy("date", "code").agg(F.sum("weight").alias("weight"))
    day = F.sum("weight").over(Window.partitionBy("date"))
    held = total.withColumn("weight", F.col("weight") / F.when(day == 0, 1.0).otherwise(day))
    return walk_periods(data, walk_forward_targets(data, _capped(held, industries, industry_cap, max_weight), windows, exposure), windows, engine)


def walk_forward_silos(data: DataFrame, silos: list[tuple[DataFrame, float]], windows: list, engine: Engine = Engine(), **options) -> tuple[DataFrame, DataFrame]:
    """(equity with period, per-period metrics) of ``walked_silos``."""
    return curve_and_periods(walked_silos(data, silos, windows, engine, **options))
