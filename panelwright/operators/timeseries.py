"""Base operators: windows of rows within a code, ranks within a date.

All take and return columns, so any number of them shares one exchange and sort per partitioning.
A window of n rows gives a value only where it holds n values.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio


#: Bytes of input files whose rows are dealt into one piece at most.
PIECE = 4 * 2**20


def pieces(df: DataFrame) -> int:
    """Pieces for the rows that come from df's files, so that a task's sorts do not grow with the tables; 0 where shuffles make as many anyway."""
    from ..sources.dated import folder

    spark, size = df.sparkSession, 0
    for path in df.inputFiles():
        fs, at = folder(spark, path)
        size += fs.getFileStatus(at).getLen()
    n = math.ceil(size / PIECE)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys into n pieces (0: as it is).  Windows and groups by these keys, or more, need no other exchange."""
    return df.repartition(n, *keys) if n else df


def by_code():
    """Rows of a code by date (made when used: windows need a session)."""
    return Window.partitionBy("code").orderBy("date")


#: Blocks of the exponential mean have a power of so many rows (one size serves the usual rates, and so one sort).
EWM_BLOCK = 8


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(n: int, by=None):
    if n < 1:
        raise ValueError("a window holds at least one row")
    return (by or by_code()).rowsBetween(-(n - 1), 0)


def delay(x, n: int, by=None) -> Column:
    if n < 0:
        raise ValueError("n must not be negative")
    return F.lag(_col(x), n).over(by or by_code())


def delta(x, n: int, by=None) -> Column:
    return _col(x) - delay(x, n, by)


def change(x, n: int, by=None) -> Column:
    """Relative change over n rows."""
    return ratio(delta(x, n, by), delay(x, n, by))


def rolling(f, x, n: int, least: int | None = None, by=None) -> Column:
    w = rows(n, by)
    return F.when(F.count(_col(x)).over(w) >= (least or n), f(_col(x)).over(w))


def rolling_mean(x, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, x, n, least)


def rolling_std(x, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, least)


def rolling_sum(x, n: int, least: int | None = None) -> Column:
    return rolling(F.sum, x, n, least)


def ts_max(x, n: int) -> Column:
    return rolling(F.max, x, n)


def ts_min(x, n: int) -> Column:
    return rolling(F.min, x, n)


def _pairs(x, y):
    both = _col(x).isNotNull() & _col(y).isNotNull()
    return F.when(both, _col(x)), F.when(both, _col(y))


def corr(x, y, n: int, by=None) -> Column:
    """Rolling Pearson correlation over n complete pairs; null where either side is constant."""
    a, b = _pairs(x, y)
    w = rows(n, by)
    c = ratio(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))
    return F.when(F.count(a).over(w) == n, c)


def rolling_cov(x, y, n: int) -> Column:
    a, b = _pairs(x, y)
    w = rows(n)
    return F.when(F.count(a).over(w) == n, F.covar_samp(a, b).over(w))


def rank_pct(x, within=("date",)) -> Column:
    """Average rank of ties over the count of values, among rows alike in ``within``; nulls have no rank."""
    x = _col(x)
    w = Window.partitionBy(*[_col(k) for k in within]).orderBy(x.asc_nulls_last())  # one sort serves all three
    ties = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    total = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / total)


def _so_far():
    return by_code().rowsBetween(Window.unboundedPreceding, 0)


# Operators that look back on all rows give their value and the state that a later run goes on from.  ``carry`` is the state of
# the rows before the first one (null: there are none).


def running_sum(x, carry: Column | None = None) -> tuple[Column, Column]:
    total = F.sum(_col(x)).over(_so_far())
    total = total if carry is None else F.coalesce(total + carry["v"], total, carry["v"])
    return total, F.struct(total.cast("double").alias("v"))


def running_last(x, carry: Column | None = None) -> tuple[Column, Column]:
    last = F.last(_col(x), ignorenulls=True).over(_so_far())
    last = last if carry is None else F.coalesce(last, carry["v"])
    return last, F.struct(last.cast("double").alias("v"))


def running_max(x, carry: Column | None = None) -> tuple[Column, Column]:
    most = F.max(_col(x)).over(_so_far())
    most = most if carry is None else F.greatest(most, carry["v"])
    return most, F.struct(most.cast("double").alias("v"))


def cumulative_sum(x) -> Column:
    return running_sum(x)[0]


def forward_fill(x) -> Column:
    return running_last(x)[0]


def rolling_quantile(x, q: float, n: int, least: int) -> Column:
    w = rows(n)
    return F.when(F.count(_col(x)).over(w) >= least, F.percentile(_col(x), F.lit(q)).over(w))


def streak(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Length so far of the run of rows whose flag is true; 0 elsewhere."""
    flag = F.coalesce(flag, F.lit(False))
    marked = df.withColumn("__flag", flag)
    before = F.lag("__flag").over(by_code())
    run = marked.withColumn("__run", F.sum(F.when(before.isNull() | (before != F.col("__flag")), 1).otherwise(0)).over(by_code()))
    place = F.row_number().over(Window.partitionBy("code", "__run").orderBy("date"))
    return run.withColumn(name, F.when(F.col("__flag"), place).otherwise(0)).drop("__flag", "__run")


def ewm_position(df: DataFrame) -> DataFrame:
    """Adds __t, the row's place within its code, which exponential means need."""
    return df if "__t" in df.columns else df.withColumn("__t", F.row_number().over(by_code()) - 1)


def ewm_block(keep: float) -> int:
    """Rows in a block: over a block the weights fall below double precision (e^-40) but stay within double range (e^690)."""
    rate, rows_ = -math.log(keep), 1
    while rows_ * rate < 40:
        rows_ *= EWM_BLOCK
    return min(rows_, max(1, int(690 / rate)))


def ewm(x, n: int, m: int, least: int | None = None) -> Column:
    """Exponential mean with weight m/n, adjusted, nulls keeping their place; null until ``least`` (n) values have been seen.

    Needs ``ewm_position``.  Weights are powers relative to a block of rows; a row sums its own block so far and the block
    before.  What lies before that weighs less than double precision, whatever the rate, since the block's length follows it.
    """
    return running_ewm(x, n, m, least)[0]


def running_ewm(x, n: int, m: int, least: int | None = None, carry: Column | None = None) -> tuple[Column, Column]:
    """``ewm`` and its state: both sums as they stand at the row ``at``, and the values seen."""
    if not 0 < m <= n:
        raise ValueError("the weight m / n must lie above 0 and not above 1")
    x, keep, least = _col(x), 1 - m / n, n if least is None else least
    nothing = F.lit(0.0)
    seen = F.count(x).over(_so_far()) + (0 if carry is None else F.coalesce(carry["seen"], F.lit(0)))
    if keep == 0:  # only the last value counts
        last_value, state = running_last(x, None if carry is None else F.struct(carry["num"].alias("v")))
        return F.when(seen >= least, last_value), F.struct(last_value.cast("double").alias("num"), F.lit(1.0).alias("den"), seen.alias("seen"), F.col("__t").cast("long").alias("at"))
    size = ewm_block(keep)
    block, inner = F.floor(F.col("__t") / size), F.col("__t") % size
    lift = F.pow(F.lit(1 / keep), inner)
    here = Window.partitionBy("code", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("code").orderBy(block).rangeBetween(-1, -1)
    fade = F.pow(F.lit(keep), F.lit(float(size)))

    def total(v, part):
        # the carry, as it weighs at the first row of the block
        before = nothing if carry is None else F.coalesce(carry[part] * F.pow(F.lit(keep), (block * size - carry["at"]).cast("double")), nothing)
        return F.coalesce(F.sum(v).over(here), nothing) + F.coalesce(F.sum(v).over(last), nothing) * fade + before

    num, den = total(x * lift, "num"), total(F.when(x.isNotNull(), lift), "den")
    return F.when(seen >= least, ratio(num, den)), F.struct((num / lift).alias("num"), (den / lift).alias("den"), seen.alias("seen"), F.col("__t").cast("long").alias("at"))


def islands(df: DataFrame, label: str, keys: list[str], order: str = "date") -> DataFrame:
    """Adds __island, the number of the row's run of equal labels among rows alike in keys, and __place, its place in it from 1 on."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__turn", F.when(F.lag(label).over(by).eqNullSafe(F.col(label)) & (F.row_number().over(by) > 1), 0).otherwise(1))
    numbered = marked.withColumn("__island", F.sum("__turn").over(by)).drop("__turn")
    return numbered.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(order)))


def sustained(df: DataFrame, label: str, days: int, name: str, keys: list[str], order: str = "date") -> DataFrame:
    """Adds name: the last label that has stood for ``days`` rows in a row, from the row on that completes them; the first row's until then."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stood = F.last(F.when(F.col("__place") >= days, F.col(label)), ignorenulls=True).over(by)
    return islands(df, label, keys, order).withColumn(name, F.coalesce(stood, F.first(label).over(by))).drop("__island", "__place")
