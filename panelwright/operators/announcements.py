"""Point-in-time panels from announcement events: surprise pools, acceleration, as-of joins, standardisation."""
from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..sources.dated import materialised
from .timeseries import rolling

#: Score of a forecast by its kind (labels of the exchange's forecast types).
FORECAST_SCORE = {"预增": 0.5, "略增": 0.25, "扭亏": 0.35, "续盈": 0.05, "略减": -0.25, "预减": -0.5, "首亏": -0.5, "续亏": -0.35}


def previous_season(end_date: Column) -> Column:
    """Season end before a season end, both as yyyyMMdd."""
    y, md = F.substring(end_date, 1, 4).cast("int"), F.substring(end_date, 5, 4)
    year = y.cast("string")
    return F.when(md == "0331", F.concat((y - 1).cast("string"), F.lit("1231"))).when(md == "0630", F.concat(year, F.lit("0331"))).when(md == "0930", F.concat(year, F.lit("0630"))).when(md == "1231", F.concat(year, F.lit("0930")))


#: Values of a season that one block holds, at most but for what the quantiles are off.
BLOCK_ROWS = 50_000
#: Rows of a stretch of time that are counted at a time.
CHUNK = 8192


def standing_ranks(moves: DataFrame, block_rows: int | None = None) -> DataFrame:
    """key, side, o, n, rank of each question: how many values stand at that time, and the average rank of its own value among them.

    moves: key, side, o (time, unique order across all keys), part (stretch of time that o lies in; parts follow each other), value, w (+1 comes,
    -1 goes, 0 asks); what comes and goes at the time of a question counts.

    Values of a key and side are cut into blocks at quantiles: each edge is a block of its own (so that a value that a third of the rows have
    is one), and what lies between two edges is another.  A rank is the sum of three parts: of stretches before, from the grid of sums by stretch and block, as
    prefix sums; of lower blocks within the stretch, one task a stretch; of lower values within an open block, one task a block.  No task holds a key.
    """
    import pandas as pd

    keys = ["key", "side"]
    most = moves.filter("w = 1").groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    cuts = max(1, -(-most // (block_rows or BLOCK_ROWS)))
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    edges = moves.filter("w = 1").groupBy(*keys).agg(F.array_distinct(F.percentile_approx("value", shares, 50 * cuts)).alias("edges"))
    blocks = 2 * cuts + 1
    lower = F.size(F.filter("edges", lambda e: e < F.col("value")))
    moves = moves.join(F.broadcast(edges), keys).withColumn("block", 2 * lower + F.array_contains("edges", F.col("value")).cast("int")).drop("edges")
    # the grid: by key, side and stretch all blocks
    cells = moves.groupBy(*keys, "part", "block").agg(F.sum("w").alias("w"))
    dense = cells.select(*keys, "part").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(cells, [*keys, "part", "block"], "left")
    dense = dense.withColumn("same", F.coalesce(F.sum("w").over(Window.partitionBy(*keys, "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy(*keys, "part")
    grid = dense.withColumns({"less": F.coalesce(F.sum("same").over(within.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("same").over(within)}).drop("w")

    def stretch(pdf):
        """Sums of each block so far, at the questions of one stretch."""
        pdf = pdf.sort_values(["o", "ask"])
        so_far, out = np.zeros(blocks, np.int64), []
        for lo in range(0, len(pdf), CHUNK):
            part = pdf.iloc[lo : lo + CHUNK]
            one = np.zeros((len(part), blocks), np.int64)
            one[np.arange(len(part)), part["block"]] = part["w"]
            sums = so_far + one.cumsum(axis=0)
            so_far, ask = sums[-1], part["ask"].to_numpy(bool)
            up, b = sums[ask].cumsum(axis=1), part["block"].to_numpy()[ask]
            at, own = np.arange(len(b)), sums[ask][np.arange(len(b)), b]
            out.append(part.loc[ask, [*keys, "part", "o", "block"]].assign(less1=up[at, b] - own, same1=own, n1=up[:, -1] if len(up) else own))
        return pd.concat(out)

    def inside(pdf):
        """Lower and equal values that stand, at the questions of one open block."""
        standing, less, equal = [], [], []
        pdf = pdf.sort_values(["o", "ask"])
        for v, w in zip(pdf["value"], pdf["w"]):
            if w > 0:
                insort(standing, v)
            elif w < 0:
                standing.pop(bisect_left(standing, v))
            left = bisect_left(standing, v)
            less.append(left)
            equal.append(bisect_right(standing, v) - left)
        out = pdf[[*keys, "o"]].assign(less2=less, equal2=equal)
        return out[pdf["ask"]]

    moves = moves.withColumn("ask", F.col("w") == 0)
    kinds = dict(moves.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in keys)
    timed = moves.select(*keys, "part", "o", "block", "w", "ask").groupBy(*keys, "part").applyInPandas(stretch, f"{named}, part {kinds['part']}, o {kinds['o']}, block int, less1 long, same1 long, n1 long")
    opened = moves.filter("block % 2 = 0").select(*keys, "block", "o", "value", "w", "ask").groupBy(*keys, "block").applyInPandas(inside, f"{named}, o {kinds['o']}, less2 long, equal2 long")
    got = timed.join(grid, [*keys, "part", "block"]).join(opened, [*keys, "o"], "left")
    equal = F.when(F.col("block") % 2 == 1, F.col("same") + F.col("same1")).otherwise(F.col("equal2"))
    rank = F.col("less") + F.col("less1") + F.coalesce("less2", F.lit(0)) + equal / 2
    return got.select(*keys, "o", (F.col("n") + F.col("n1")).alias("n"), rank.alias("rank"))


def pit_surprise(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Adds raw_surprise.  A forecast scores by its kind.  An express report scores its rank by actual less its rank by predicted profit
    among the codes of its season that have reported both so far, three at least; else by its kind, the code's last forecast's first.

    Order within a season: announcement, code, event type.  What a code has reported (its last forecast's prediction or one that
    an express report brings, its last actual, its last kind) comes from windows; a pair stands until the code's next event.  Events are
    range-partitioned in that order, and ranks among what stands come from ``standing_ranks``: no task holds a season.
    """
    forecast, express = F.col("event_type") == "forecast", F.col("event_type") == "express"
    past = Window.partitionBy("end_date", "code").orderBy("ann_date", "event_type").rowsBetween(Window.unboundedPreceding, 0)

    def latest(told, value):
        return F.last(F.when(told, F.struct(value)), ignorenulls=True).over(past)[value]

    known = events.withColumns({"__p": latest(forecast | (express & F.col("predicted_profit").isNotNull()), "predicted_profit"), "__a": latest(express, "actual_profit"), "__t": latest(forecast, "forecast_type")})
    score = F.create_map(*[F.lit(x) for kv in FORECAST_SCORE.items() for x in kv])
    kind = F.when(forecast, F.col("forecast_type")).otherwise(F.coalesce("__t", "forecast_type"))
    known = known.withColumn("__k", F.when(forecast | express, F.coalesce(F.try_element_at(score, kind), F.lit(0.0))))
    order = ["end_date", "ann_date", "code", "event_type"]
    known = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__o": F.monotonically_increasing_id()})
    known = materialised(known, "announcements")
    by_code_ = Window.partitionBy("end_date", "code").orderBy("__o")
    both = F.col("__a").isNotNull() & F.col("__p").isNotNull()
    ends = known.withColumns({"__next": F.lead("__o").over(by_code_), "__next_part": F.lead("__part").over(by_code_)}).filter(both)

    def move(o, part, w):
        return F.struct(F.col(o).alias("o"), F.col(part).alias("part"), F.lit(w).alias("w"))

    at = F.array(move("__o", "__part", 1), F.when(F.col("__next").isNotNull(), move("__next", "__next_part", -1)), F.when(express, move("__o", "__part", 0)))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("value")) for s, c in (("a", "__a"), ("p", "__p"))])
    moves = ends.select(F.col("end_date").alias("key"), F.explode(F.array_compact(at)).alias("m"), sides.alias("s")).select("key", "m.*", F.explode("s").alias("s")).select("key", "o", "part", "w", "s.*")
    ranks = standing_ranks(moves, block_rows)
    wide = ranks.groupBy(F.col("key").alias("end_date"), F.col("o").alias("__o")).agg(F.max("n").alias("__n"), F.sum(F.when(F.col("side") == "a", F.col("rank")).otherwise(-F.col("rank"))).alias("__d"))
    out = known.join(wide, ["end_date", "__o"], "left")
    surprise = F.when(express & (F.col("__n") >= 3), F.col("__d") / F.col("__n"))
    return out.withColumn("raw_surprise", F.coalesce(surprise, F.col("__k"))).drop("__p", "__a", "__t", "__k", "__o", "__part", "__n", "__d")


def acceleration(events: DataFrame, value: str = "raw_surprise") -> DataFrame:
    """Adds raw_acceleration: the value less the code's last one of the season before; 0 where there is none."""
    newest = F.row_number().over(Window.partitionBy("code", "end_date").orderBy(F.col("ann_date").desc(), F.col(value).desc()))
    before = events.withColumn("__k", newest).filter("__k = 1").select("code", F.col("end_date").alias("__prev"), F.col(value).alias("__v"))
    out = events.withColumn("__prev", previous_season(F.col("end_date"))).join(before, ["code", "__prev"], "left")
    return out.withColumn("raw_acceleration", F.coalesce(F.col(value) - F.col("__v"), F.lit(0.0))).drop("__prev", "__v")


def as_of(grid: DataFrame, events: DataFrame, values: list[str]) -> DataFrame:
    """grid (date, code) with the values of each code's last event row up to the date; on one day the newest season wins, null values included.

    One union and one window: events sort before grid rows of their day.
    """
    payload = F.struct(*values)
    e = events.select("code", F.col("ann_date").alias("date"), F.lit(0).alias("__g"), F.col("end_date").alias("__end"), payload.alias("__v"))
    g = grid.select("code", "date", F.lit(1).alias("__g"), F.lit(None).cast("string").alias("__end"), F.lit(None).cast(e.schema["__v"].dataType).alias("__v"))
    w = Window.partitionBy("code").orderBy("date", "__g", F.col("__end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__g") == 0, F.col("__v")), ignorenulls=True).over(w)
    return e.unionByName(g).withColumn("__l", last).filter("__g = 1").select("date", "code", *[F.col(f"__l.{v}").alias(v) for v in values])


def standardised(panel: DataFrame, columns: list[str], fill: float | None) -> DataFrame:
    """Per-date z-scores within +-3 where a date has two values that differ; other values stay; nulls become fill."""
    by = Window.partitionBy("date")
    out = {}
    for c in columns:
        sd = F.stddev_samp(c).over(by)
        z = F.greatest(F.least(ratio(F.col(c) - F.avg(c).over(by), sd), F.lit(3.0)), F.lit(-3.0))
        x = F.when(F.col(c).isNotNull() & (F.count(c).over(by) >= 2) & (sd > 0), z).otherwise(F.col(c))
        out[c] = x if fill is None else F.coalesce(x, F.lit(fill))
    return panel.withColumns(out)


def grid_of(dates: DataFrame, codes: DataFrame) -> DataFrame:
    """Every date with every code: the panel itself.  Dates are few."""
    return codes.select("code").distinct().crossJoin(F.broadcast(dates.select("date").distinct()))


def earnings_panel(events: DataFrame, dates: DataFrame, codes: DataFrame) -> DataFrame:
    """date, code, earnings_surprise, earnings_acceleration."""
    made = acceleration(pit_surprise(events)).withColumnsRenamed({"raw_surprise": "earnings_surprise", "raw_acceleration": "earnings_acceleration"})
    return standardised(as_of(grid_of(dates, codes), made, ["earnings_surprise", "earnings_acceleration"]), ["earnings_surprise", "earnings_acceleration"], 0.0)


def quality_panel(events: DataFrame, dates: DataFrame, codes: DataFrame) -> DataFrame:
    """date, code, roe_level, roe_stability, cashflow_quality; nulls before the first event stay."""
    order = Window.partitionBy("code").orderBy("ann_date", "end_date")
    made = events.withColumn("roe_stability", -rolling(F.stddev_samp, "roe", 8, 2, order)).withColumnsRenamed({"roe": "roe_level", "ocfps": "cashflow_quality"})
    names = ["roe_level", "roe_stability", "cashflow_quality"]
    return standardised(as_of(grid_of(dates, codes), made, names), names, None)
