"""Configuration: dictionaries (from YAML or JSON) checked and turned into the engine's objects."""
from __future__ import annotations

import json
from dataclasses import dataclass, fields

from .operators import backtest, portfolio, strategies

REQUIRED = ("strategies", "risk")


@dataclass(frozen=True)
class LifecycleConfig:
    """Defaults of the three life-cycle phases."""

    fwd_window: int = 5
    window: int = 60
    min_periods: int = 20
    t_active: float = 2.0
    t_decay: float = 1.0
    min_sustain: int = 20
    corr_window: int = 60
    corr_method: str = "spearman"
    corr_agg: str = "mean"
    min_obs: int = 20
    threshold: float = 0.7
    linkage: str = "ward"
    representative: str = "t_stat"
    train_months: int = 12
    test_months: int = 1
    n_iters: int = 200
    seed: int = 0
    top_k: int = 5
    rebalance: int = 20
    top_n: int = 10
    bottom_n: int = 5

    def __post_init__(self):
        if self.t_decay >= self.t_active:
            raise ValueError("t_decay must be below t_active")
        if not 0 < self.threshold < 1:
            raise ValueError("threshold must lie in (0, 1)")
        if min(self.window, self.min_periods, self.min_sustain, self.n_iters, self.top_k, self.train_months, self.test_months) < 1:
            raise ValueError("windows and counts must be positive")


def load_config(path: str) -> dict:
    """A dictionary from a JSON file, or YAML where a parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML parser here: use JSON") from e
        config = yaml.safe_load(text)
    return check_config(config)


def check_config(config: dict) -> dict:
    if missing := [k for k in REQUIRED if k not in (config or {})]:
        raise ValueError(f"missing sections: {missing}")
    return config


def lifecycle_config(config: dict) -> LifecycleConfig:
    known = {f.name for f in fields(LifecycleConfig)}
    if odd := set(config) - known:
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return LifecycleConfig(**config)


def build_strategies(config: dict) -> list:
    """(name, weight, callable of the data) for each enabled strategy."""
    out = []
    for name, c in config["strategies"].items():
        c = c or {}
        if c.get("enabled", True):
            func, params = strategies.get_strategy(c.get("type", name)), dict(c.get("params", {}))
            call = lambda data, func=func, params=params: func(data, **params)
            out.append((name, float(c.get("weight", 1.0)), (lambda data, call=call: strategies.reverse(call(data))) if c.get("reversed") else call))
    if not out:
        raise ValueError("no strategy is enabled")
    return out


def build_combined_strategy(config: dict):
    """One callable: the weighted vote of all enabled strategies."""
    parts, threshold = build_strategies(config), config.get("combiner", {}).get("threshold", 0.0)
    if len(parts) == 1:
        return parts[0][2]
    return lambda data: strategies.weighted_vote([call(data) for _, _, call in parts], [w for _, w, _ in parts], threshold)


def build_engine(config: dict) -> backtest.Engine:
    b = config.get("backtest", {})
    cost = b.get("trading_cost")
    breaker = b.get("circuit_breaker")
    stop = b.get("atr_stop_loss") or {}
    return backtest.Engine(
        capital=b.get("capital", 1_000_000),
        stop_loss=b.get("stop_loss"),
        take_profit=b.get("take_profit"),
        atr_multiplier=stop.get("atr_multiplier", 3.0) if stop else None,
        cost=None if cost is None else backtest.TradingCost(**cost),
        breaker=None if breaker is None else portfolio.CircuitBreaker(**breaker),
    )


def build_risk_rules(config: dict) -> list[portfolio.Rule]:
    return [portfolio.get_risk_rule(name)(**(params or {})) for name, params in config["risk"].items()]


def build_selector(config: dict) -> dict:
    """Parameters of evaluation.select_tradable."""
    known = ("top_n", "min_stocks", "min_pass_count", "lookback", "lag", "min_coverage", "min_stability", "min_dispersion")
    return {k: v for k, v in config.get("selector", {}).items() if k in known}


def build_regime_switch(config: dict):
    """A callable of the data: signals of the detected, confirmed regime's strategy."""
    c = config["regime"]
    return lambda data: strategies.regime_switch(data, strategies.detect_regime(data, **c.get("detect", {})), c["strategies"], c.get("confirmation_lag", 10))


def build_industry_map(spark, config: dict):
    rows = [(c, i) for i, codes in config.get("industries", {}).items() for c in codes]
    return spark.createDataFrame(rows, "code string, industry string")
