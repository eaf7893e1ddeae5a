"""Panels derived from the star-schema tables: bars, money flow, company figures, industries, announcements."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.timeseries import by_code, pieces, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _week(c: str):
    return F.to_date(F.date_trunc("week", F.col(c)))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier: date, code, open, high, low, close (unit prices), volume (quantity)."""
    return _bars(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), few=True)


def bucket_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per part bucket: denser rows, fifty codes."""
    return _bars(table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 50)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag: long series, three codes."""
    return _bars(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), lambda c: F.to_date(c))


def _bars(items: DataFrame, code, day=_week, few: bool = False) -> DataFrame:
    """few: a bar has few rows, so that summing up before the exchange would sort them all and save nothing."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    rows = items.select(day("l_shipdate").alias("date"), code.cast("string").alias("code"), price.alias("px"), order.alias("o"), "l_quantity")
    rows = spread(rows, pieces(items), "date", "code") if few else rows
    return rows.groupBy("date", "code").agg(F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("l_quantity").alias("volume"))


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per user of the events table."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("code"), "value", F.struct("ts", "event_id").alias("o"))
    return e.groupBy("date", "code").agg(F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").cast("double").alias("volume"))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, industry: the supplier's region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").cast("string").alias("code"), F.col("r_name").alias("industry"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, code_a, code_b: the suppliers of each nation, two by two in order of key; an odd one out stays alone."""
    by = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.lead("s_suppkey").over(by).alias("other"), F.row_number().over(by).alias("k"))
    return s.filter("k % 2 = 1 and other is not null").select(F.col("s_suppkey").cast("int").alias("pair"), F.col("s_suppkey").cast("string").alias("code_a"), F.col("other").cast("string").alias("code_b"))


def figures(panel: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with company figures: circ_mv, total_mv, turnover_rate, pe, pb, and per-report columns."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_acctbal").alias("bal"))
    out = panel.join(s, "code")
    v = F.col("volume")
    return out.select(
        *panel.columns,
        (F.col("bal") * (1 + F.dayofyear("date") / 1000)).alias("circ_mv"),
        (F.abs("bal") / 100 + 1).alias("total_mv"),
        (v / (F.abs("bal") + 100)).alias("turnover_rate"),
        (F.col("bal") / v).alias("pe"),
        (F.col("bal") / 1000).alias("pb"),
        (v - 100).alias("earnings_surprise"),
        (v % 7).alias("earnings_acceleration"),
        (F.col("bal") / (v + 1000)).alias("roe"),
        (-(v % 5)).alias("roe_stability"),
        (F.col("close") / 100).alias("ocfps"),
    )


BANDS = (("sm", 0, 12), ("md", 12, 25), ("lg", 25, 38), ("elg", 38, 1000))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly money flow per supplier: bought and sold amounts by order size, and their net."""
    rows = table(spark, sf_dir, "lineitem").select(_week("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("code"), "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag")
    bought = F.col("l_returnflag") != "R"
    aggs = []
    for side, cond in (("buy", bought), ("sell", ~bought)):
        for band, lo, hi in BANDS:
            inside = cond & (F.col("l_quantity") > lo) & (F.col("l_quantity") <= hi)
            aggs.append(F.sum(F.when(inside, F.col("l_extendedprice")).otherwise(0.0)).alias(f"{side}_{band}_amount"))
    out = rows.groupBy("date", "code").agg(*aggs)
    net = sum((F.col(f"buy_{b}_amount") - F.col(f"sell_{b}_amount") for b, *_ in BANDS[1:]), F.col("buy_sm_amount") - F.col("sell_sm_amount"))
    return out.withColumn("net_mf_amount", net)


def calendar(panel: DataFrame) -> DataFrame:
    """Open days: every date that any code traded on."""
    return panel.select(F.col("date").alias("cal_date")).distinct()


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcement events per nation, of all orders: code, ann_date, end_date (season end), roe, ocfps; one per code, day and season."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("string").alias("code"), F.to_date("o_orderdate").alias("ann_date"), "o_totalprice", "c_acctbal")
    quarter = F.date_trunc("quarter", F.col("ann_date"))
    season = F.date_format(F.date_sub(quarter.cast("date"), 1), "yyyyMMdd")
    return rows.withColumn("end_date", season).groupBy("code", "ann_date", "end_date").agg((F.avg("o_totalprice") / 1000).alias("roe"), (F.avg("c_acctbal") / 100).alias("ocfps"), F.sum("o_totalprice").alias("actual_profit"), (F.sum("c_acctbal") * 20).alias("predicted_profit"))


def with_previous_close(panel: DataFrame) -> DataFrame:
    return panel.withColumn("pre_close", F.lag("close").over(by_code()))
