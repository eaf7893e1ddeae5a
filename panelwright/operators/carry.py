"""What the monitor carries from run to run, so that a run reads new dates only and still agrees with a full one."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation
from .factors import get_spec, scored
from .timeseries import by_code

#: Rows that the longest chain of windows looks back on, and the longest forward window, at most.
LOOKBACK = 60


@dataclass(frozen=True)
class Carry:
    """codes: one row a code - n rows so far, its last rows (tail) and, LOOKBACK rows before the end, the states of running terms.
    scored: date, code and factors of all rows; returns: date, code, fwd_window, y as far as known.  Both only grow; all three can be
    written as they are (``sources.dated``) and read back.
    """

    codes: DataFrame
    scored: DataFrame
    returns: DataFrame
    #: What the last step added to scored and returns; None after a full run.
    added: tuple[DataFrame, DataFrame] | None = None

    def serves(self, names: list[str], windows) -> bool:
        # windows: a code's tail completes any forward window, but returns of old dates are there for those that were asked for
        return set(names) <= set(self.scored.columns) and max(windows) <= LOOKBACK and {r["fwd_window"] for r in self.returns.select("fwd_window").distinct().collect()} >= set(windows)

    def ics(self, names: list[str], windows, min_obs: int, dates: list | None = None) -> DataFrame:
        """Correlations of the dates (default: all)."""
        x, y = self.scored, self.returns
        if dates is not None:
            x, y = (df.filter(F.col("date").isin(dates)) for df in (x, y))
        wide = y.groupBy("date", "code").agg(*[F.max(F.when(F.col("fwd_window") == w, F.col("y"))).alias(f"fwd_ret_{w}d") for w in windows])
        return evaluation.ic(x.join(wide, ["date", "code"]), names, windows, min_obs=min_obs)

    def advanced(self, data: DataFrame, names: list[str], windows, exclude_untradable: bool) -> tuple["Carry", DataFrame]:
        """(the carry with the dates of data after the last one, the returns that these completed)."""
        last = self.codes.agg(F.max("last")).first()[0]
        new = data.filter(F.col("date") > F.lit(last))
        mine = self.codes.join(new.select("code").distinct(), "code", "left_semi")
        held = mine.select("code", F.col("n").alias("__n"), *[c for c in mine.columns if c.endswith("_at")])
        before = mine.select("code", F.inline("tail")).withColumn("__new", F.lit(False))
        raw = [c for c in before.columns if c not in ("code", "__t", "__new") and not c.endswith("_was")]
        came = new.select("code", *raw).join(held.select("code", "__n"), "code", "left")
        came = came.withColumn("__t", F.coalesce("__n", F.lit(0)) + F.row_number().over(by_code()) - 1).drop("__n").withColumn("__new", F.lit(True))
        rows = before.unionByName(came, allowMissingColumns=True).join(held, "code", "left")
        # states hold all rows up to this one
        rows = rows.withColumn("__fresh", F.col("__t") > F.coalesce(F.col("__n") - 1 - LOOKBACK, F.lit(-1)))
        made, terms = scored(rows, names, resumed=True)
        done = known_returns(made, windows, exclude_untradable).filter((F.col("__t") + F.col("fwd_window") >= F.coalesce("__n", F.lit(0)))).select("date", "code", "fwd_window", "y")
        codes = self.codes.join(held.select("code"), "code", "left_anti").unionByName(summed(made, terms, raw))
        came_scored = made.filter("__new").select("date", "code", *names)
        return Carry(codes, self.scored.select("date", "code", *names).unionByName(came_scored), self.returns.unionByName(done), (came_scored, done)), done


def known_returns(made: DataFrame, windows, exclude_untradable: bool) -> DataFrame:
    """date, code, __t, __n (if made has it), fwd_window, y of rows whose forward return is known."""
    back = evaluation.forward_returns(made, windows, exclude_untradable)
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("fwd_window"), F.col(f"fwd_ret_{w}d").alias("y")) for w in windows]))
    return back.select("date", "code", "__t", *[c for c in ("__n",) if c in made.columns], each.alias("r")).select("*", "r.*").drop("r").filter("y is not null")


def summed(made: DataFrame, terms, raw: list[str]) -> DataFrame:
    """One row a code: n, last (date), tail (its last 2 LOOKBACK rows with raw columns and ranks) and states as they were LOOKBACK rows before the end."""
    end = F.max("__t").over(Window.partitionBy("code"))
    made = made.withColumn("__end", end)
    row = F.struct("__t", *raw, *[F.col(r).alias(f"{r}_was") for r in terms.ranks])
    tail = F.array_sort(F.collect_list(F.when(F.col("__t") > F.col("__end") - 2 * LOOKBACK, row)))
    states = [F.max(F.when(F.col("__t") == F.col("__end") - LOOKBACK, F.col(f"{s}_now"))).alias(f"{s}_at") for s in terms.states]
    return made.groupBy("code").agg((F.max("__t") + 1).cast("long").alias("n"), F.max("date").alias("last"), tail.alias("tail"), *states)


def started(data: DataFrame, names: list[str], windows, exclude_untradable: bool = True) -> Carry:
    """The carry after a full run over data."""
    made, terms = scored(data, names)
    made = made.withColumn("__t", F.col("__t").cast("long"))
    needs = reduce(set.union, (set(get_spec(n).needs) for n in names), {"close"})
    raw = ["date", *[c for c in data.columns if c in needs or c in evaluation.FLAGS]]
    return Carry(summed(made, terms, raw), made.select("date", "code", *names), known_returns(made, windows, exclude_untradable).drop("__t"))
