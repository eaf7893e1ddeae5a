"""Cleaning: price limits, suspension grid, universes, tradability."""
from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import half_even
from .timeseries import by_code

OHLCV = ("date", "code", "open", "high", "low", "close", "volume")
#: Code prefixes of boards with a 20 % limit.
WIDE_LIMIT_PREFIXES = ("300", "301", "302", "688", "689")


def validate_ohlcv(df: DataFrame) -> DataFrame:
    if missing := [c for c in OHLCV if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def detect_limit_price(df: DataFrame, limit_pct: float = 0.10) -> DataFrame:
    """limit_up, limit_down: close at yesterday's close times 1 +- limit, rounded to cents, within a tenth of a cent."""
    before = F.col("pre_close") if "pre_close" in df.columns else F.lag("close").over(by_code())
    wide = F.substring("code", 1, 3).isin(*WIDE_LIMIT_PREFIXES)
    pct = F.when(wide, F.lit(0.20)).otherwise(F.lit(limit_pct))
    out = df.withColumn("__before", before).withColumn("__pct", pct)
    up, down = half_even(F.col("__before") * (1 + F.col("__pct")), 2), half_even(F.col("__before") * (1 - F.col("__pct")), 2)
    known = F.col("__before").isNotNull() & F.col("close").isNotNull()
    return out.withColumns({"limit_up": F.coalesce(known & (F.col("close") >= up - 0.001), F.lit(False)), "limit_down": F.coalesce(known & (F.col("close") <= down + 0.001), F.lit(False))}).drop("__before", "__pct")


def detect_suspension(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """is_suspended where nothing was traded.  With a calendar (cal_date) every code gets a row for each open day from its first
    day to the last day of both: added rows have null prices, volume 0, and are suspended; rows off the calendar go."""
    flagged = df.withColumn("is_suspended", F.coalesce(F.col("volume") == 0, F.lit(False)))
    if calendar is None:
        return flagged
    last = F.broadcast(df.agg(F.max("date").alias("__last")))
    span = df.groupBy("code").agg(F.min("date").alias("__first"))
    days = calendar.select(F.col("cal_date").alias("date")).distinct().crossJoin(last).filter("date <= __last").select("date")
    # one row for each code and day is the result itself; days are few and go to every task
    grid = span.crossJoin(F.broadcast(days)).filter("date >= __first").select("date", "code")
    out = grid.join(flagged, ["date", "code"], "left")
    fill = {"is_suspended": F.coalesce("is_suspended", F.lit(True)), "volume": F.coalesce(F.col("volume").cast("double"), F.lit(0.0))}
    fill |= {c: F.coalesce(c, F.lit(False)) for c in ("limit_up", "limit_down") if c in df.columns}
    return out.withColumns(fill)


def clean_market_data(df: DataFrame, calendar: DataFrame | None = None, limit_pct: float = 0.10) -> DataFrame:
    return detect_limit_price(detect_suspension(validate_ohlcv(df), calendar), limit_pct)


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def run_keys(df: DataFrame) -> list[str]:
    """run_id where a table holds several runs side by side."""
    return ["run_id"] if "run_id" in df.columns else []


def filter_tradable(market: DataFrame, signals: DataFrame) -> DataFrame:
    """Buys at the upper limit or in suspension and sells at the lower limit or in suspension become signal 0 with confidence 0."""
    flags = [c for c in ("limit_up", "limit_down", "is_suspended") if c in market.columns]
    if not flags:
        return signals
    out = signals.join(market.select("date", "code", *[F.col(c).alias("__" + c) for c in flags]), ["date", "code"], "left")
    has = lambda c: _flag("__" + c) if c in flags else F.lit(False)
    stop = ((F.col("signal") == 1) & (has("limit_up") | has("is_suspended"))) | ((F.col("signal") == -1) & (has("limit_down") | has("is_suspended")))
    return out.withColumns({"signal": F.when(stop, 0).otherwise(F.col("signal")), "confidence": F.when(stop, 0.0).otherwise(F.col("confidence"))}).select(*signals.columns)


def enforce_t1(signals: DataFrame) -> DataFrame:
    """Of several signals for a code on a day (and of a run, where signals have run_id) only buys stay."""
    many = F.count("*").over(Window.partitionBy(*run_keys(signals), "date", "code")) > 1
    marked = signals.withColumn("__many", many & (F.col("signal") != 1))
    return marked.withColumns({"signal": F.when(F.col("__many"), 0).otherwise(F.col("signal")), "confidence": F.when(F.col("__many"), 0.0).otherwise(F.col("confidence"))}).drop("__many")


def resolve_universe(config: dict, constituents=(), listed=(), st_codes=()) -> list[str]:
    """Ordered distinct codes: source index, all or list; special-treatment codes go where the filter asks so."""
    source = config.get("source", "list")
    codes = {"index": constituents, "all": listed, "list": config.get("codes", ())}.get(source)
    if codes is None:
        raise ValueError(f"unknown universe source {source!r}")
    drop = set(st_codes) if config.get("filters", {}).get("exclude_st", False) else set()
    return [c for c in dict.fromkeys(codes) if c not in drop]


def resolve_universe_groups(spark, pools: dict[str, list[str]]) -> DataFrame:
    """(pool, code) rows of named pools."""
    rows = [(p, c) for p, codes in pools.items() for c in dict.fromkeys(codes)]
    return spark.createDataFrame(rows, "pool string, code string")


def apply_data_filters(df: DataFrame, min_volume: float | None = None, min_turnover: float | None = None) -> DataFrame:
    """Rows of codes whose mean volume and mean traded value reach the bounds."""
    means = df.groupBy("code").agg(F.avg("volume").alias("v"), F.avg(F.col("volume") * F.col("close")).alias("t"))
    if min_volume is not None:
        means = means.filter(F.col("v") >= min_volume)
    if min_turnover is not None:
        means = means.filter(F.col("t") >= min_turnover)
    return df.join(means.select("code"), "code", "left_semi")


def apply_fundamental_filters(df: DataFrame, figures: DataFrame, min_market_cap=None, min_pe=None, max_pe=None) -> DataFrame:
    for bound, cond in ((min_market_cap, F.col("total_mv") >= (min_market_cap or 0)), (min_pe, F.col("pe") >= (min_pe or 0)), (max_pe, F.col("pe") <= (max_pe or 0))):
        if bound is not None:
            figures = figures.filter(cond)
    return df.join(figures.select("code").distinct(), "code", "left_semi")


def build_grid(params: dict[str, list]) -> list[dict]:
    return [dict(zip(params, values)) for values in product(*params.values())]
