"""Factor library and registry.

A factor is written as terms on levels.  Levels alternate between windows within a code and ranks within a date,
and all factors asked for at once share them: 54 factors cost five exchanges, not five each.  Equal terms are computed once.
"""
from __future__ import annotations

import hashlib
import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import div0, positive, ratio
from .timeseries import corr, delay, delta, ewm_position, pieces, rank_pct, rolling_cov, rolling_mean, rolling_std, rolling_sum, running_ewm, running_last, running_max, running_sum, spread, ts_max, ts_min

#: c: windows within a code, d: ranks within a date.
LEVELS = ("c0", "c1", "c2", "c3", "d0", "c4", "c5", "d1", "c6")


class Terms:
    """Collects the terms of several factors, by level.

    Resumed, the rows are the last ones before and all new ones (__new).  Ranks of old dates are then those of the run that saw the whole date
    (columns that end in _was), and operators that look back on all rows go on from their states (columns that end in _at)
    over the rows that these do not hold yet (__fresh).
    """

    def __init__(self, resumed: bool = False):
        self.by_level: dict[str, dict[str, Column]] = {k: {} for k in LEVELS}
        self.resumed, self.states = resumed, []

    def __call__(self, level: str, term: Column) -> Column:
        name = "__" + level + hashlib.md5(f"{term}".encode()).hexdigest()[:16]
        self.by_level[level][name] = F.when(F.col("__new"), term).otherwise(F.col(f"{name}_was")) if self.resumed and level[0] == "d" else term
        return F.col(name)

    def running(self, level: str, op: Callable, x, *args) -> Column:
        """A term of an operator that looks back on all rows; its state is the column of the same name that ends in _now."""
        x = F.col(x) if isinstance(x, str) else x
        name = "__" + level + hashlib.md5(f"{op.__name__} {x} {args}".encode()).hexdigest()[:16]
        value, state = op(F.when(F.col("__fresh"), x), *args, carry=F.col(f"{name}_at")) if self.resumed else op(x, *args)
        self.by_level[level] |= {name: value, f"{name}_now": state}
        self.states = sorted({*self.states, name})
        return F.col(name)

    @property
    def ranks(self) -> list[str]:
        return sorted(n for level in LEVELS if level[0] == "d" for n in self.by_level[level])

    def applied(self, df: DataFrame, n: int = 0) -> DataFrame:
        """df, which lies by code, with all terms; exchanges deal into n pieces.  Only df's columns and ranks cross an exchange: terms within a code are wide and cheap, and are made again behind it."""
        for k, level in enumerate(LEVELS):
            if level[0] == "d" and self.by_level[level]:
                made = spread(self._within(df, LEVELS[:k]), n, "date").select(*df.columns, *[c.alias(name) for name, c in self.by_level[level].items()])
                df = spread(made, n, "code")
        return self._within(df, LEVELS)

    def _within(self, df: DataFrame, levels) -> DataFrame:
        for level in levels:
            if level[0] == "c" and self.by_level[level]:
                df = df.select("*", *[c.alias(n) for n, c in self.by_level[level].items()])
        return df


@dataclass(frozen=True)
class FactorSpec:
    name: str
    func: Callable
    tags: tuple = ()
    kind: str = "single"
    needs: tuple = ()
    params: dict = field(default_factory=dict)
    alias_of: str | None = None


_REGISTRY: dict[str, FactorSpec] = {}
BARS = ("open", "high", "low", "close", "volume")


def default_params(func: Callable) -> dict:
    return {k: p.default for k, p in inspect.signature(func).parameters.items() if p.default is not inspect.Parameter.empty}


def register_factor(name: str, func: Callable, tags=(), kind: str = "single", params: dict | None = None, needs=(), alias_of: str | None = None) -> None:
    """A later registration of a name takes its place.  A single factor is called with (terms, **params) and returns a column."""
    if kind not in ("single", "pair"):
        raise ValueError(f"unknown kind {kind!r}")
    _REGISTRY[name] = FactorSpec(name, func, tuple(tags), kind, tuple(needs), params if params is not None else default_params(func), alias_of)


def get_spec(name: str) -> FactorSpec:
    if name not in _REGISTRY:
        raise KeyError(f"unknown factor {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def get_factor(name: str) -> Callable:
    return get_spec(name).func


def list_factors(tag: str | None = None, kind: str | None = None) -> list[str]:
    return sorted(n for n, s in _REGISTRY.items() if (tag is None or tag in s.tags) and (kind is None or s.kind == kind))


def scored(df: DataFrame, names: list[str], params: dict[str, dict] | None = None, resumed: bool = False) -> tuple[DataFrame, Terms]:
    """The panel with a column for each factor, all terms' columns still there.  A missing input raises KeyError before any plan is built."""
    terms, outs = Terms(resumed), {}
    for name in names:
        spec = get_spec(name)
        if spec.kind != "single":
            raise ValueError(f"{name} works on pairs; use the pair operators")
        if missing := [c for c in spec.needs if c not in df.columns]:
            raise KeyError(f"{name} needs {missing}")
        outs[name] = spec.func(terms, **{**spec.params, **(params or {}).get(name, {})})
    n = pieces(df)
    return terms.applied(ewm_position(spread(df, n, "code")), n).select("*", *[c.cast("double").alias(n) for n, c in outs.items() if n not in df.columns]), terms


def with_factors(df: DataFrame, names: list[str], params: dict[str, dict] | None = None) -> DataFrame:
    """The panel with a column for each factor; those that it has stay as they are.  Aliases share the primary's terms."""
    if set(names) <= set(df.columns):
        return spread(df, pieces(df), "code")
    return scored(df, names, params)[0].select(*df.columns, *[n for n in names if n not in df.columns])


def narrowed(df: DataFrame, names: list[str]) -> DataFrame:
    """date, code, the factors that a row alone gives, and the inputs of the others: what ``with_factors`` has to move for these names."""
    given, needs = {}, set()
    for name in names:
        spec, terms = get_spec(name), Terms()
        made = spec.func(terms, **spec.params)
        if any(terms.by_level.values()):
            needs |= set(spec.needs)
        elif name not in df.columns:
            given[name] = made.cast("double")
    return df.select(*[c for c in df.columns if c in {"date", "code", *names, *needs}], *[c.alias(n) for n, c in given.items()])


def with_factor(df: DataFrame, name: str, **params) -> DataFrame:
    return with_factors(df, [name], {name: params})


def _add(name: str, number: int | None, tags, needs, func) -> None:
    register_factor(name, func, tags, needs=needs)
    if number is not None:
        register_factor(f"gtja_{number}", func, tags, needs=needs, alias_of=name)


def single(number: int | None, *tags: str, needs=BARS):
    def put(func):
        _add(func.__name__, number, (*tags, "gtja") if number is not None else tags, needs, func)
        return func

    return put


C, O, H, L, V = (lambda: F.col("close")), (lambda: F.col("open")), (lambda: F.col("high")), (lambda: F.col("low")), (lambda: F.col("volume").cast("double"))


def _typical() -> Column:
    return (H() + L() + C()) / 3


def _move(t) -> Column:
    return t("c0", delta("close", 1))


def _true_range(t) -> Column:
    before = t("c0", delay("close", 1))
    return t("c1", F.greatest(H() - L(), F.abs(H() - before), F.abs(L() - before)))


# momentum


@single(14, "momentum")
def calc_momentum_5d_change(t):
    return t("c0", delta("close", 5))


@single(18, "momentum")
def calc_momentum_5d_ratio(t):
    return ratio(C(), t("c0", delay("close", 5)))


@single(20, "momentum")
def calc_momentum_6d_return(t):
    return ratio(t("c0", delta("close", 6)), t("c0", delay("close", 6))) * 100


@single(88, "momentum")
def calc_momentum_20d_return(t):
    return ratio(t("c0", delta("close", 20)), t("c0", delay("close", 20))) * 100


@single(106, "momentum")
def calc_momentum_20d_change(t):
    return t("c0", delta("close", 20))


# volume and price


@single(11, "volume_price")
def calc_money_flow_6d(t):
    place = t("c0", ratio((C() - L()) - (H() - C()), H() - L()) * V())
    return t("c1", rolling_sum(place, 6))


@single(40, "volume_price")
def calc_up_down_vol_ratio_26d(t):
    d = _move(t)
    up, down = t("c1", F.when(d > 0, V()).otherwise(0.0)), t("c1", F.when(d < 0, V()).otherwise(0.0))
    return div0(t("c2", rolling_sum(up, 26)), t("c2", rolling_sum(down, 26))) * 100


@single(43, "volume_price")
def calc_obv_6d(t):
    signed = t("c1", F.coalesce(F.signum(_move(t)) * V(), F.lit(0.0)))
    return t("c2", rolling_sum(signed, 6))


@single(80, "volume_price")
def calc_vol_change_pct_5d(t):
    return ratio(t("c0", delta("volume", 5)), t("c0", delay("volume", 5))) * 100


@single(29, "volume_price")
def calc_return_6d_times_vol(t):
    return ratio(t("c0", delta("close", 6)), t("c0", delay("close", 6))) * V()


@single(178, "volume_price")
def calc_return_1d_times_vol(t):
    return ratio(_move(t), t("c0", delay("close", 1))) * V()


@single(139, "volume_price")
def calc_open_vol_corr_10d(t):
    return -t("c0", corr("open", "volume", 10))


@single(32, "volume_price")
def calc_high_vol_rank_corr_3d(t):
    both = t("c4", corr(t("d0", rank_pct("high")), t("d0", rank_pct("volume")), 3))
    return -t("c6", rolling_sum(t("d1", rank_pct(_settled(both))), 3))


def _settled(x: Column) -> Column:
    """Ranks of computed values: differences below 1e-9 are rounding of equal values, not order."""
    return F.round(x, 9)


@single(99, "volume_price")
def calc_close_vol_rank_cov_5d(t):
    both = t("c4", rolling_cov(t("d0", rank_pct("close")), t("d0", rank_pct("volume")), 5))
    return -t("d1", rank_pct(_settled(both)))


@single(90, "volume_price")
def calc_vwap_vol_rank_corr_5d(t):
    typical = t("d0", rank_pct(t("c0", _typical())))
    both = t("c4", corr(typical, t("d0", rank_pct("volume")), 5))
    return -t("d1", rank_pct(_settled(both)))


@single(1, "volume_price")
def calc_vol_rank_intraday_corr_6d(t):
    logs = t("c0", F.log(F.greatest(V(), F.lit(1.0))))
    moved = t("d0", rank_pct(t("c1", _settled(delta(logs, 1)))))
    intraday = t("d0", rank_pct(t("c0", ratio(C() - O(), O()))))
    return -t("c4", corr(moved, intraday, 6))


@single(47, "volume_price")
def calc_williams_r_smoothed_6d(t):
    top, low = t("c0", ts_max("high", 6)), t("c0", ts_min("low", 6))
    return t.running("c2", running_ewm, t("c1", ratio(top - C(), top - low) * 100), 9, 1)


@single(118, "volume_price")
def calc_shadow_ratio_20d(t):
    above, below = t("c0", H() - O()), t("c0", O() - L())
    return div0(t("c1", rolling_sum(above, 20)), t("c1", rolling_sum(below, 20))) * 100


@single(54, "volume_price")
def calc_candle_body_vol_composite(t):
    body = t("c0", F.abs(C() - O()))
    mixed = t("c2", t("c1", rolling_std(body, 10)) + (C() - O()) + t("c0", corr("close", "open", 10)))
    return -t("d0", rank_pct(_settled(mixed)))


@single(12, "volume_price")
def calc_open_vwap_close_vwap(t):
    typical = t("c0", _typical())
    gap = t("c2", O() - t("c1", rolling_sum(typical, 10)) / 10)
    return -t("d0", rank_pct(_settled(gap))) * t("d0", rank_pct(_settled(t("c1", F.abs(C() - typical)))))


@single(70, "volume_price")
def calc_dollar_vol_std_6d(t):
    return t("c1", rolling_std(t("c0", V() * _typical()), 6))


@single(145, "volume_price")
def calc_vol_macd_9_26_12(t):
    fast, slow, base = (t("c0", rolling_mean("volume", n)) for n in (9, 26, 12))
    return div0(fast - slow, base) * 100


@single(102, "volume_price")
def calc_vol_rsi_6d(t):
    return _ewm_rsi(t, "volume", 6)


def _ewm_rsi(t, column: str, n: int) -> Column:
    d = t("c0", delta(column, 1))
    gain, size = t("c1", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))), t("c1", F.abs(d))
    return div0(t.running("c2", running_ewm, gain, n, 1), t.running("c2", running_ewm, size, n, 1)) * 100


# volatility


@single(78, "volatility")
def calc_cci_12d(t):
    typical = t("c0", _typical())
    off = t("c2", typical - t("c1", rolling_mean(typical, 12)))
    return div0(off, 0.015 * t("c3", rolling_mean(F.abs(off), 12)))


@single(97, "volatility")
def calc_volume_vol_10d(t):
    return t("c0", rolling_std("volume", 10))


@single(100, "volatility")
def calc_volume_vol_20d(t):
    return t("c0", rolling_std("volume", 20))


@single(161, "volatility")
def calc_atr_12d(t):
    return t("c2", rolling_mean(_true_range(t), 12))


@single(175, "volatility")
def calc_atr_6d(t):
    return t("c2", rolling_mean(_true_range(t), 6))


@single(None, "volatility", needs=("close",))
def calc_hv(t, window=20):
    logs = t("c1", F.log(positive(ratio(C(), t("c0", delay("close", 1))))))
    return t("c2", rolling_std(logs, window)) * math.sqrt(252)


# mean reversion


@single(63, "mean_reversion")
def calc_rsi_6d(t):
    return _ewm_rsi(t, "close", 6)


@single(79, "mean_reversion")
def calc_rsi_12d(t):
    return _ewm_rsi(t, "close", 12)


@single(112, "mean_reversion")
def calc_directional_balance_12d(t):
    d = _move(t)
    up = t("c2", rolling_sum(t("c1", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))), 12))
    down = t("c2", rolling_sum(t("c1", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))), 12))
    return div0(up - down, up + down) * 100


@single(128, "mean_reversion")
def calc_mfi_14d(t):
    amount, d = _typical() * V(), _move(t)
    up = t("c2", rolling_sum(t("c1", F.when(d > 0, amount).otherwise(0.0)), 14))
    down = t("c2", rolling_sum(t("c1", F.when(d < 0, amount).otherwise(0.0)), 14))
    return F.when((down == 0) & (up == 0), None).when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down)))


# trend


@single(21, "trend")
def calc_ma_slope_6d(t):
    return t("c1", delta(t("c0", rolling_mean("close", 6)), 1))


@single(116, "trend")
def calc_ma_slope_20d(t):
    return t("c1", delta(t("c0", rolling_mean("close", 20)), 1))


@single(89, "trend")
def calc_macd_like(t):
    d = t("c1", t.running("c0", running_ewm, "close", 13, 2) - t.running("c0", running_ewm, "close", 27, 2))
    return (d - t.running("c2", running_ewm, d, 10, 2)) * 2


# volume-weighted price


def _vwap(t) -> Column:
    money, volume = t.running("c1", running_sum, t("c0", _typical() * V())), t.running("c1", running_sum, "volume")
    return t("c2", ratio(money, volume))


@single(120, "vwap")
def calc_vwap_close_ratio(t):
    v = _vwap(t)
    return ratio(v - C(), v + C())


@single(124, "vwap")
def calc_vwap_deviation(t):
    return ratio(C() - _vwap(t), C())


# general, with a window


@single(None, "volume_price")
def calc_rsi(t, window=14):
    d = _move(t)
    gain = t("c2", rolling_mean(t("c1", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))), window))
    loss = t("c2", rolling_mean(t("c1", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))), window))
    some = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).when(gain == 0, 0.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    return F.when(gain.isNotNull() & loss.isNotNull(), some)


@single(None, "volume_price")
def calc_obv(t):
    signed = t("c1", F.coalesce(F.signum(_move(t)), F.lit(0.0)) * V())
    return t.running("c2", running_sum, signed)


@single(None, "volume_price")
def calc_volume_ratio(t, window=20):
    return ratio(V(), t("c0", rolling_mean("volume", window)))


@single(None, "volume_price")
def calc_atr(t, window=14):
    return t("c2", rolling_mean(_true_range(t), window))


@single(None, "liquidity", needs=("close", "volume"))
def calc_amihud(t, window=20):
    filled = t.running("c0", running_last, "close")
    back = F.abs(ratio(t("c1", delta(filled, 1)), t("c1", delay(filled, 1))))
    traded = V() * C()
    return t("c3", rolling_mean(t("c2", F.when(traded > 0, ratio(back, traded))), window))


@single(None, "liquidity", needs=("close", "volume", "total_mv"))
def calc_turnover(t, window=20):
    return t("c1", rolling_mean(t("c0", ratio(V() * C(), F.col("total_mv") * 1e8)), window))


@single(None, "fundamental", "value", needs=("pe",))
def calc_ep(t):
    return ratio(F.lit(1.0), positive(F.col("pe")))


@single(None, "fundamental", "value", needs=("pb",))
def calc_bp(t):
    return ratio(F.lit(1.0), positive(F.col("pb")))


def _passed(name: str, column: str, *tags: str) -> None:
    def func(t):
        return F.col(column)

    _add(name, None, tags, (column,), func)


_passed("calc_earnings_surprise", "earnings_surprise", "fundamental", "earnings")
_passed("calc_earnings_acceleration", "earnings_acceleration", "fundamental", "earnings")
_passed("calc_roe_level", "roe", "fundamental", "quality")
_passed("calc_roe_stability", "roe_stability", "fundamental", "quality")
_passed("calc_cashflow_quality", "ocfps", "fundamental", "quality")


# money flow


@single(None, "moneyflow", "mining", needs=("net_mf_amount", "circ_mv"))
def calc_moneyflow_net_ratio(t):
    return ratio(F.col("net_mf_amount"), F.col("circ_mv"))


@single(None, "moneyflow", "mining", needs=("net_mf_amount",))
def calc_moneyflow_streak(t):
    inflow = F.coalesce(F.col("net_mf_amount") > 0, F.lit(False))
    ended = t.running("c0", running_max, F.when(~inflow, F.col("__t")))
    return F.when(inflow, F.col("__t") - F.coalesce(ended, F.lit(-1))).otherwise(0)


@single(None, "moneyflow", "mining", needs=tuple(f"{s}_{b}_amount" for s in ("buy", "sell") for b in ("sm", "md", "lg", "elg")))
def calc_moneyflow_big_net_ratio(t):
    big = F.col("buy_lg_amount") + F.col("buy_elg_amount") - (F.col("sell_lg_amount") + F.col("sell_elg_amount"))
    total = sum((F.col(f"{s}_{b}_amount") for s in ("buy", "sell") for b in ("sm", "md", "lg", "elg")), F.lit(0.0))
    return ratio(big, total)
