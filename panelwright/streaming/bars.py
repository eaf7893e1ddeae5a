"""Our own extension: panels and per-code running values over streams.

Bars come from a tumbling event-time window with a watermark; running values keep one small state per code.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """window start as date, code, open, high, low, close, volume.  ticks: ts, code, value.  Late ticks beyond delay are left out."""
    o = F.struct("ts", "value")
    out = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "code").agg(F.min(o).alias("first"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(o).alias("last"), F.count("*").cast("double").alias("volume"))
    return out.select(F.col("w.start").cast("date").alias("date"), "code", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "volume")


def running_obv(bars: DataFrame) -> DataFrame:
    """code, date, obv, streak for bars that arrive in order within a code: state is the last close, the sum and the run of rises."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, run = state.get if state.exists else (None, 0.0, 0)
        for pdf in batches:
            rows = []
            for r in pdf.sort_values("date").itertuples(index=False):
                up = last is not None and r.close > last
                total += 0.0 if last is None else float((r.close > last) - (r.close < last)) * r.volume
                run = run + 1 if up else 0
                last = float(r.close)
                rows.append((key[0], r.date, total, run))
            yield pd.DataFrame(rows, columns=["code", "date", "obv", "streak"])
        state.update((last, total, run))

    return bars.select("code", "date", "close", "volume").groupBy("code").applyInPandasWithState(step, "code string, date date, obv double, streak long", "last double, total double, run long", "append", GroupStateTimeout.NoTimeout)
