"""Typed tables from the raw files that a data vendor delivers: bars, announcements, quarterly indicators, money flow, daily figures.

Each function takes a raw table as it was delivered (codes with an exchange suffix, days as yyyyMMdd) - one file, or all files of a
folder read at once - and projects it to the engine's columns, types and units.  Numbers that cannot be read are null.
"""
from __future__ import annotations

from datetime import date as Day

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import io

#: Order sizes of the money-flow table.
SIZES = ("sm", "md", "lg", "elg")
FLOW_COLUMNS = [f"{side}_{size}_{unit}" for size in SIZES for side in ("buy", "sell") for unit in ("vol", "amount")] + ["net_mf_vol", "net_mf_amount"]
BAR_COLUMNS = ["open", "high", "low", "close", "pre_close", "volume"]
FIGURE_COLUMNS = ["pe", "pb", "total_mv", "circ_mv", "turnover_rate"]


def _code() -> Column:
    return F.substring_index("ts_code", ".", 1).alias("code")


def _day(column: str) -> Column:
    """yyyyMMdd (text or number) or a date; else null."""
    return F.coalesce(F.try_to_timestamp(F.col(column).cast("string"), F.lit("yyyyMMdd")), F.try_to_timestamp(F.col(column).cast("string"))).cast("date")


def _number(df: DataFrame, column: str) -> Column:
    return F.expr(f"try_cast(`{column}` AS double)") if column in df.columns else F.lit(None).cast("double")


def daily(raw: DataFrame, codes: list[str] | None = None, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """date, code, open, high, low, close, pre_close, volume of stocks or indices; of the codes and days asked for."""
    out = raw.withColumnRenamed("vol", "volume")
    out = out.select(_day("trade_date").alias("date"), _code(), *[_number(out, c).alias(c) for c in BAR_COLUMNS])
    out = out if codes is None else out.filter(F.col("code").isin([c.split(".")[0] for c in codes]))
    out = out if start is None else out.filter(F.col("date") >= F.lit(start))
    return out if end is None else out.filter(F.col("date") <= F.lit(end))


def forecasts(raw: DataFrame) -> DataFrame:
    """code, ann_date, end_date, forecast_type, predicted_profit: the middle of the forecast range, or the one end that is known."""
    low, high = _number(raw, "net_profit_min"), _number(raw, "net_profit_max")
    middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(low, high))
    return raw.select(_code(), _day("ann_date").alias("ann_date"), F.col("end_date").cast("string").alias("end_date"), F.col("type").alias("forecast_type"), middle.alias("predicted_profit"))


def express_reports(raw: DataFrame) -> DataFrame:
    """code, ann_date, end_date, actual_profit, increase_rate: profit of the parent's owners, or total profit where a table lacks it."""
    profit = "n_income_attr_p" if "n_income_attr_p" in raw.columns else "total_profit"
    return raw.select(_code(), _day("ann_date").alias("ann_date"), F.col("end_date").cast("string").alias("end_date"), _number(raw, profit).alias("actual_profit"), _number(raw, "increase_rate").alias("increase_rate"))


def earnings_events(forecast: DataFrame | None, express: DataFrame | None) -> DataFrame:
    """Raw forecasts and express reports as rows of one table: code, ann_date, end_date, event_type, predicted_profit, actual_profit, forecast_type."""
    parts = []
    if forecast is not None:
        parts.append(forecasts(forecast).withColumns({"event_type": F.lit("forecast"), "actual_profit": F.lit(None).cast("double")}))
    if express is not None:
        parts.append(express_reports(express).withColumns({"event_type": F.lit("express"), "predicted_profit": F.lit(None).cast("double"), "forecast_type": F.lit(None).cast("string")}))
    if not parts:
        raise ValueError("neither forecasts nor express reports")
    return io.union_days([p.select("code", "ann_date", "end_date", "event_type", "predicted_profit", "actual_profit", "forecast_type") for p in parts])


def quarterly_indicators(raw: DataFrame) -> DataFrame:
    """code, ann_date, end_date, roe, ocfps."""
    return raw.select(_code(), _day("ann_date").alias("ann_date"), F.col("end_date").cast("string").alias("end_date"), _number(raw, "roe").alias("roe"), _number(raw, "ocfps").alias("ocfps"))


def money_flow(raw: DataFrame) -> DataFrame:
    """date, code and the 18 volumes and amounts by order size; amounts in ten thousands, as delivered."""
    return raw.select(_day("trade_date").alias("date"), _code(), *[_number(raw, c).alias(c) for c in FLOW_COLUMNS])


def daily_figures(raw: DataFrame) -> DataFrame:
    """date, code, pe, pb, total_mv, circ_mv (hundred millions), turnover_rate."""
    return io.fundamentals(raw.select(_day("trade_date").alias("date"), _code(), *[_number(raw, c).alias(c) for c in FIGURE_COLUMNS]))


def over_days(typed: DataFrame, calendar: DataFrame, start: Day, end: Day) -> DataFrame:
    """The rows of a typed table on the open days of a range: figures or money flow of many days at once.  Days are few."""
    days = io.trading_days(calendar, start, end).select(F.col("cal_date").alias("date"))
    return typed.join(F.broadcast(days), "date", "left_semi")


def read_folder(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All parquet files of a folder - one a code or day - as one typed table.  kind: a key of KINDS."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(KINDS)}")
    return KINDS[kind](io.load_parquet(spark, path))


KINDS = {"daily": daily, "index_daily": daily, "forecast": forecasts, "express": express_reports, "indicators": quarterly_indicators, "moneyflow": money_flow, "figures": daily_figures}
