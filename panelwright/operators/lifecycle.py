"""Factor life cycle: states, monitor, redundancy phase, out-of-sample phase, composite phase, mining screen."""
from __future__ import annotations

from datetime import date as Day
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from . import backtest, evaluation, strategies
from .carry import Carry, started
from .factors import get_spec, list_factors, with_factors
from .timeseries import islands, sustained

KEYS = ["factor", "fwd_window"]


def candidate(t: str = "t_stat", active: float = 2.0, decay: float = 1.0) -> Column:
    """The state that a t statistic stands for; a missing one is dead."""
    t = F.nanvl(F.col(t), F.lit(None).cast("double"))
    return F.when(t <= -active, "reverse").when(t >= active, "active").when(t >= decay, "decaying").otherwise("dead")


def state_machine(rolled: DataFrame, active: float = 2.0, decay: float = 1.0, min_sustain: int = 20) -> DataFrame:
    """date, factor, fwd_window, ic, rolling_ic, rolling_ir, t_stat, state, sustain_days, old_state (null but where the state changes).

    The state is the last candidate that stood for min_sustain days in a row; the first day's candidate until there is one.
    """
    if min_sustain < 1 or decay >= active:
        raise ValueError("need min_sustain >= 1 and decay < active")
    cols = ["date", *KEYS, "ic", "rolling_ic", "rolling_ir", "t_stat"]
    out = sustained(rolled.select(*cols, candidate("t_stat", active, decay).alias("__c")), "__c", min_sustain, "state", KEYS)
    before = F.lag("state").over(Window.partitionBy(*KEYS).orderBy("date"))
    return islands(out.withColumn("__b", before), "state", KEYS).select(*cols, "state", F.col("__place").cast("long").alias("sustain_days"), F.when(F.col("__b") != F.col("state"), F.col("__b")).alias("old_state"))


def diff_states(states: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """date, factor, fwd_window, old_state, new_state: where the state changes from one day to the next - or, given the old table, where
    a row's state is another than the old table's row of the same key has.
    """
    if old is None:
        changed = states.filter("old_state is not null")
    else:
        before = old.select("date", *KEYS, F.col("state").alias("__old"))
        changed = states.join(before, ["date", *KEYS]).filter("__old <> state").withColumn("old_state", F.col("__old"))
    return changed.select("date", *KEYS, "old_state", F.col("state").alias("new_state"))


def render_changes(changes: DataFrame) -> str:
    """One line a change, by date; the changes of a monitor run are few."""
    rows = changes.orderBy("date", *KEYS).collect()
    return "\n".join([f"{len(rows)} changes of state" if rows else "no change of state", *(f"{r['date']}  {r['factor']}  fwd={r['fwd_window']}  {r['old_state']} -> {r['new_state']}" for r in rows)])


def usable_factors(df: DataFrame, names: list[str] | None = None) -> list[str]:
    """Primary single factors whose inputs df has."""
    names = names or [n for n in list_factors(kind="single") if get_spec(n).alias_of is None]
    return [n for n in names if set(get_spec(n).needs) <= set(df.columns)]


def skipped_factors(df: DataFrame, names: list[str]) -> list[str]:
    """Factors that df lacks inputs for, with what is missing."""
    return [f"{n} (missing: {', '.join(sorted(set(get_spec(n).needs) - set(df.columns)))})" for n in names if not set(get_spec(n).needs) <= set(df.columns)]


def ahead(data: DataFrame, names: list[str], windows=(5,), exclude_untradable: bool = True) -> DataFrame:
    """The panel with factors, forward returns and __end_{w}, the date that a forward return ends on.  A panel that has all of them, and so was
    made here, stays as it is and lies as it is: nothing in it looks along a code any more.
    """
    if {*names, *(f"{c}{w}{d}" for w in windows for c, d in (("fwd_ret_", "d"), ("__end_", "")))} <= set(data.columns):
        return data
    made = evaluation.forward_returns(with_factors(data, names), windows, exclude_untradable)
    return made.withColumns({f"__end_{w}": F.lead("date", w).over(evaluation.by_code()) for w in windows})


def rolled_ics(data: DataFrame, names: list[str], windows=(5,), window: int = 60, min_periods: int = 20, min_obs: int = 5, exclude_untradable: bool = True) -> DataFrame:
    made = ahead(data, names, windows, exclude_untradable)
    return evaluation.rolling_ic(evaluation.ic(made, names, windows, min_obs=min_obs), window, min_periods)


def monitor(data: DataFrame, names: list[str] | None = None, windows=(5,), window: int = 60, min_periods: int = 20, since=None, min_obs: int = 5, exclude_untradable: bool = True, **states) -> DataFrame:
    """States of all factors that data has the inputs of.  Days on which a code cannot be traded (flags in data) do not count unless
    exclude_untradable is off.  Everything comes from the whole history; since restricts the dates that are given back.
    """
    names = usable_factors(data, names)
    out = state_machine(rolled_ics(data, names, windows, window, min_periods, min_obs, exclude_untradable), **states)
    return out if since is None else out.filter(F.col("date") >= F.lit(since))


def update_monitor(data: DataFrame, old: DataFrame | None, carry: Carry | None, names: list[str] | None = None, windows=(5,), window: int = 60, min_periods: int = 20, min_obs: int = 5, exclude_untradable: bool = True, **states) -> tuple[DataFrame, DataFrame, list[str], Carry]:
    """(new rows, changes against the old table, factors left out, carry for the next run).  old and carry: of the run before; without them
    (or with other factors or windows) everything is read.

    Of data only the dates after the last run are read.  The carry holds, for each code, its last rows and the states of all terms that
    look back further, so that factors of new rows are those of a full run however long a code was away.  New rows also complete
    forward returns of each code's last rows before; the correlations of those dates are made anew over their whole cross-section,
    however old they are.  States run over all correlations, one row a date and factor.  New rows: all from the first such date on.
    """
    every = names or [n for n in list_factors(kind="single") if get_spec(n).alias_of is None]
    usable, skipped = usable_factors(data, every), skipped_factors(data, every)
    if old is None or carry is None or not carry.serves(usable, windows):
        carry = started(data, usable, windows, exclude_untradable)
        ics = carry.ics(usable, windows, min_obs)
        new = state_machine(evaluation.rolling_ic(ics, window, min_periods), **states)
        return new, diff_states(new, old) if old is not None else diff_states(new).limit(0), skipped, carry
    carry, done = carry.advanced(data, usable, windows, exclude_untradable)
    dates = sorted(r["date"] for r in done.select("date").distinct().collect())  # one row a date
    kept = old.select("date", *KEYS, "ic").filter(F.col("factor").isin(usable) & ~F.col("date").isin(dates))
    ics = kept.unionByName(carry.ics(usable, windows, min_obs, dates).select("date", *KEYS, "ic"))
    new = state_machine(evaluation.rolling_ic(ics, window, min_periods), **states)
    new = new.filter(F.col("date") >= F.lit(dates[0])) if dates else new.limit(0)
    return new, diff_states(new, old), skipped, carry


def run_monitor(data: DataFrame, root: str, names: list[str] | None = None, windows=(5,), window: int = 60, min_periods: int = 20, min_obs: int = 5, exclude_untradable: bool = True, full: bool = False, **states) -> tuple[DataFrame, list[str]]:
    """The monitor over a store (``sources.dated``): (changes, factors left out).

    The first run, a full one, or one with other factors reads all of data; any other reads the dates after the last run, and writes new rows, what the
    carry gained, and one row for each code.  States and carry of a version belong together.
    """
    from ..sources import dated, io

    spark = data.sparkSession
    every = names or [n for n in list_factors(kind="single") if get_spec(n).alias_of is None]
    usable, skipped = usable_factors(data, every), skipped_factors(data, every)
    version = (dated.versions(spark, root) or [None])[-1]
    old = None if version is None else dated.read(spark, root, "states", version)
    carry = None if old is None or full else io.load_carry(spark, root, version)
    if carry is None or not carry.serves(usable, windows):
        made = started(data, usable, windows, exclude_untradable)
        segments = [dated.put(spark, root, t, getattr(made, t)) for t in ("codes", "scored", "returns")]
        stored = Carry(*[spark.read.parquet(s.path) for s in segments])
        new = state_machine(evaluation.rolling_ic(stored.ics(usable, windows, min_obs), window, min_periods), **states)
        segments.append(dated.put(spark, root, "states", new))
    else:
        new, _, _, next_ = update_monitor(data, old, carry, names, windows, window, min_periods, min_obs, exclude_untradable, **states)
        scored, returns = next_.added
        put = dated.put(spark, root, "states", new, dated.APPEND)
        since = spark.read.parquet(put.path).agg(F.min("date")).first()[0]
        segments = [] if since is None else [dated.Segment("states", put.path, since)]
        segments += [dated.put(spark, root, "codes", next_.codes), dated.put(spark, root, "scored", scored, dated.APPEND), dated.put(spark, root, "returns", returns, dated.APPEND)]
    wrote = [s for s in segments if s.table == "states"]
    written = spark.read.parquet(wrote[0].path) if wrote else new.limit(0)
    dated.commit(spark, root, segments)
    return diff_states(written).limit(0) if old is None else diff_states(written, old), skipped


def status_table(states: DataFrame) -> DataFrame:
    """Latest state of each factor with the date of its last change."""
    changed = F.max(F.when(F.col("old_state").isNotNull(), F.col("date"))).alias("last_change")
    last = states.groupBy(*KEYS).agg(F.max_by(F.struct("date", "state", "t_stat", "sustain_days"), "date").alias("l"), changed)
    return last.select(*KEYS, "l.*", "last_change")


def phase_a(data: DataFrame, states: DataFrame, window: int = 60, threshold: float = 0.7, linkage: str = "ward", by: str = "t_stat", fwd_window: int = 5) -> DataFrame:
    """cluster, representative, members of the factors whose latest state is active or decaying."""
    latest = states.filter(F.col("fwd_window") == fwd_window).groupBy("factor").agg(F.max_by(F.struct("state", "t_stat", "rolling_ir"), "date").alias("l")).select("factor", "l.*").filter(F.col("state").isin("active", "decaying")).collect()  # one row a factor
    spark, names = data.sparkSession, sorted(r["factor"] for r in latest)
    if not names:
        return spark.createDataFrame([], "cluster int, representative string, members array<string>")
    rows = evaluation.corr_matrix(with_factors(data, names), names, window, min_obs=5).collect() if len(names) > 1 else []
    ids = evaluation.cluster_redundant(names, {(r["factor_a"], r["factor_b"]): r["corr"] for r in rows}, threshold, linkage)
    table = spark.createDataFrame([(r["factor"], ids[r["factor"]], r["t_stat"], r["rolling_ir"]) for r in latest], "factor string, cluster int, t_stat double, ir double")
    return evaluation.select_representative(table, by)


def oos_windows(first: Day, last: Day, train_months: int = 12, test_months: int = 1) -> list[tuple[Day, Day, Day, Day]]:
    return backtest.generate_windows(first, last, train_months, test_months)


def select_top_factors(stats: DataFrame, top_k: int, min_t: float | None = None) -> DataFrame:
    out = stats.filter("t_stat is not null").dropDuplicates(["factor"])
    out = out if min_t is None else out.filter(F.abs("t_stat") >= min_t)
    return out.orderBy(F.abs("t_stat").desc(), "factor").limit(top_k)


def test_stats(ics: DataFrame, min_days: int = 5, by=("factor",)) -> DataFrame:
    """ic_mean, ic_t, ic_n, sig: the t is infinite for a constant series and null under min_days."""
    s = ics.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("ic_n"), F.countDistinct("ic").alias("d"))
    t = F.when(F.col("ic_n") < min_days, None).when((F.col("s") == 0) | (F.col("d") <= 1), float("inf")).otherwise(F.col("ic_mean") / F.nullif("s", F.lit(0.0)) * F.sqrt("ic_n"))
    return s.withColumn("ic_t", t).select(*by, "ic_mean", "ic_t", "ic_n", F.coalesce(F.abs("ic_t") > 2, F.lit(False)).alias("sig"))


def bootstrap_draws(ics: DataFrame, by: list[str], n_iters: int = 200, window: int = 60, seed: int = 0) -> DataFrame:
    """by, iter, t: t statistics of first-order autoregressions rebuilt from shuffled residuals, the null of no information.

    Residuals stand in the order of the MD5 of seed, keys, iteration and place, so that any engine draws the same.  A series (one value a date) is one
    row; its iterations run within it, each a pass that keeps the last window's moments only.  Series with fewer values than a window, or without
    variation, have no rows; an iteration without variation has an infinite t.
    """
    at, whole = Window.partitionBy(*by).orderBy("date"), Window.partitionBy(*by)
    # few rows and much work a series: as many pieces as shuffles make, which are not merged for being small
    rows = ics.repartition(int(ics.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).select(*by, "date", F.nanvl(F.col("ic").cast("double"), F.lit(None).cast("double")).alias("v")).filter("v is not null").withColumns({"m": F.count("*").over(whole), "x": F.lag("v").over(at)})
    rows = rows.filter("x is not null").withColumns({"phi": ratio(F.covar_pop("x", "v").over(whole), F.var_pop("x").over(whole)), "mx": F.avg("x").over(whole), "my": F.avg("v").over(whole)})
    rest = F.col("v") - F.col("my") - F.col("phi") * (F.col("x") - F.col("mx"))
    series = rows.withColumn("rest", rest).groupBy(*by).agg(F.first("m").alias("m"), F.first("phi").alias("phi"), F.array_sort(F.collect_list(F.struct("date", "rest"))).alias("rests")).filter((F.col("m") >= max(window, 3)) & F.col("phi").isNotNull())
    drawn = series.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iters - 1))))
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("iter").cast("string"))
    shuffled = F.transform(F.array_sort(F.transform("rests", lambda r, k: F.struct(F.md5(F.concat_ws("|", name, k.cast("string"))).alias("h"), r["rest"].alias("rest")))), lambda r: r["rest"])
    start = F.struct(F.lit(1).alias("j"), F.lit(0.0).alias("last"), F.when(F.col("m") <= window, 1).otherwise(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s, e):
        last, n = F.col("phi") * s["last"] + e, s["n"] + 1
        off = last - s["mean"]
        mean, inside = s["mean"] + off / n, s["j"] >= F.col("m") - window
        return F.struct((s["j"] + 1).alias("j"), last.alias("last"), F.when(inside, n).otherwise(s["n"]).alias("n"), F.when(inside, mean).otherwise(s["mean"]).alias("mean"), F.when(inside, s["m2"] + off * (last - mean)).otherwise(s["m2"]).alias("m2"))

    t = F.aggregate(shuffled, start, step, lambda s: F.when(s["m2"] == 0, F.lit(float("inf"))).otherwise(ratio(s["mean"], F.sqrt(ratio(s["m2"], s["n"] - 1))) * F.sqrt(s["n"].cast("double"))))
    return drawn.select(*by, "iter", t.alias("t"))


def bootstrap_null(ics: DataFrame, by: list[str], n_iters: int = 200, window: int = 60, seed: int = 0, q: float = 0.95) -> DataFrame:
    """by, null_q: quantile of the absolute null t of each series."""
    return bootstrap_draws(ics, by, n_iters, window, seed).groupBy(*by).agg(F.percentile(F.abs("t"), F.lit(q)).alias("null_q"))


def null_histogram(draws: DataFrame, by: list[str], bins: int = 32, low: float = -4.0, high: float = 4.0) -> DataFrame:
    """by, bin, lower, n: draws by fixed bins of t (the first and last also hold what lies beyond; null counts nowhere; empty bins are absent).

    Bins do not depend on the draws, so histograms of parts add up (``merge_histograms``).
    """
    if bins < 1 or low >= high:
        raise ValueError("need a bin and low < high")
    width = (high - low) / bins
    at = F.greatest(F.least(F.floor((F.greatest(F.least("t", F.lit(high)), F.lit(low)) - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return draws.filter("t is not null").groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n")).select(*by, "bin", (F.col("bin") * width + low).alias("lower"), "n")


def merge_histograms(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """The histogram of all parts' draws; parts: ``null_histogram`` with the same bins."""
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "bin", "lower").agg(F.sum("n").alias("n"))


def state_spans(states: DataFrame) -> DataFrame:
    """factor, fwd_window, state, start, end, days, mean_ir, mean_t: the life of a factor as stretches of dates in one state."""
    runs = islands(states, "state", KEYS).groupBy(*KEYS, "__island", "state")
    return runs.agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), F.avg("rolling_ir").alias("mean_ir"), F.avg("t_stat").alias("mean_t")).drop("__island")


def factor_health(states: DataFrame, value: str = "rolling_ir") -> DataFrame:
    """factor, fwd_window, date, value, shade: value over the greater of the absolute 5th and 95th percentiles of all values (1 if that is 0), kept
    within -1 and 1; rows without a value have neither.
    """
    known = states.select(*KEYS, "date", F.nanvl(F.col(value), F.lit(None).cast("double")).alias("value"))
    ends = known.agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("e")).select(F.greatest(F.abs(F.col("e")[0]), F.abs(F.col("e")[1])).alias("s"))
    scaled = known.crossJoin(F.broadcast(ends.select(F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))))  # one row
    return scaled.select(*KEYS, "date", "value", F.when(F.col("value").isNotNull(), F.greatest(F.least(F.col("value") / F.col("s"), F.lit(1.0)), F.lit(-1.0))).alias("shade"))


def representatives(rows: list[tuple], ids: dict[str, int], by: str = "t_stat") -> set[str]:
    """The best factor of each cluster by global rank of |t|, |ir| or the mean of both (missing last, ties by name).  rows: factor, t, ir."""
    def ranks(k):
        size = {r[0]: -1.0 if r[k] is None or r[k] != r[k] else abs(r[k]) for r in rows}
        return {f: 1 + sum(o > v for o in size.values()) for f, v in size.items()}

    t, ir = ranks(1), ranks(2)
    score = {"t_stat": t, "ir": ir, "combined": {f: (t[f] + ir[f]) / 2 for f in t}}[by]
    return {min((f for f in ids if ids[f] == c), key=lambda f: (score[f], f)) for c in set(ids.values())}


def phase_b(data: DataFrame, states: DataFrame, windows: list, top_k: int = 5, t_window: int = 60, n_iters: int = 200, fwd_window: int = 5, corr_window: int = 60, threshold: float = 0.7, linkage: str = "ward", by: str = "t_stat", exclude_untradable: bool = True, min_obs: int = 20) -> tuple[DataFrame, DataFrame]:
    """(periods, summary) of out-of-sample validation, all windows in one plan.

    At the end of each training window: the factors in state active or decaying; one of each cluster of alike ones (correlations of
    the last corr_window training days); those whose t passes 1 and the null quantile of their own training ICs; the
    top_k by |t|.  A pick wins if its IC within the test window alone has t beyond 2 in the direction of training.
    data: a panel, or what ``ahead`` made of it (with exclude_untradable as there).
    """
    import pandas as pd

    spark = data.sparkSession
    w = F.broadcast(spark.createDataFrame([(k, *x) for k, x in enumerate(windows)], "period int, tr0 date, tr1 date, te0 date, te1 date"))
    days = data.select("date").distinct()
    if not windows or days.join(w.filter("period = 0"), F.col("date").between(F.col("te0"), F.col("te1"))).count() <= fwd_window + 5:
        raise ValueError("the data hold no test window, or one too short for the forward window")
    mine = states.filter(F.col("fwd_window") == fwd_window)
    ends = days.join(w, F.col("date").between(F.col("tr0"), F.col("tr1"))).groupBy("period").agg(F.max("date").alias("date"))
    open_ = mine.join(F.broadcast(ends), "date").filter(F.col("state").isin("active", "decaying")).select("period", "factor", F.col("t_stat").alias("train_t"), F.col("rolling_ir").alias("ir"))
    names = sorted(r["factor"] for r in mine.select("factor").distinct().collect())  # the registry's at most
    made = ahead(data, names, (fwd_window,), exclude_untradable)
    recent = days.join(w, F.col("date") <= F.col("tr1")).withColumn("k", F.row_number().over(Window.partitionBy("period").orderBy(F.col("date").desc()))).filter(F.col("k") <= corr_window).select("period", "date")
    met = recent.select("date").distinct()  # a date's correlations are those of every period that looks back on it
    daily = evaluation.daily_correlations(made.select("date", "code", *names).join(F.broadcast(met), "date", "left_semi"), names, min_obs)
    alike = daily.join(F.broadcast(recent), "date").groupBy("period", "factor_a", "factor_b").agg(F.avg("c").alias("corr"))

    def cluster(left, right):
        rows = [(f, t, i) for f, t, i in zip(left["factor"], left["train_t"], left["ir"])]
        found = {(a, b): c for a, b, c in zip(right["factor_a"], right["factor_b"], right["corr"])} if len(right) else {}
        ids = evaluation.cluster_redundant(sorted(r[0] for r in rows), found, threshold, linkage) if rows else {}
        best = representatives(rows, ids, by)
        return pd.DataFrame([(left["period"].iloc[0], f, ids[f], t) for f, t, _ in rows if f in best], columns=["period", "factor", "cluster", "train_t"])

    reps = open_.groupBy("period").cogroup(alike.groupBy("period")).applyInPandas(cluster, "period int, factor string, cluster int, train_t double")
    train = mine.filter("ic is not null").select("date", "factor", "ic").join(w, F.col("date").between(F.col("tr0"), F.col("tr1")))
    passed = reps.join(bootstrap_null(train, ["period", "factor"], n_iters, t_window), ["period", "factor"]).filter(F.abs("train_t") > F.greatest(F.lit(1.0), F.col("null_q")))
    best = F.row_number().over(Window.partitionBy("period").orderBy(F.abs("train_t").desc(), "factor"))
    chosen = passed.withColumn("rank", best).filter(F.col("rank") <= top_k)
    # forward returns that end inside the test window
    test = made.join(w.select("period", "te0", "te1"), F.col("date").between(F.col("te0"), F.col("te1")) & (F.col(f"__end_{fwd_window}") <= F.col("te1")))
    stats = test_stats(evaluation.ic(test, names, (fwd_window,), by=("period",)), by=("period", "factor"))
    win = ((F.col("train_t") > 0) & (F.col("ic_t") > 2)) | ((F.col("train_t") < 0) & (F.col("ic_t") < -2))
    periods = chosen.join(stats, ["period", "factor"], "left").withColumns({"win": F.coalesce(win, F.lit(False)), "sig": F.coalesce("sig", F.lit(False))})
    return periods, oos_summary(periods, len(windows))


def oos_summary(periods: DataFrame, total: int) -> DataFrame:
    return periods.agg(F.lit(total).alias("periods_total"), F.countDistinct("period").alias("periods_with_selection"), F.count("*").alias("picks"), F.count_if("win").alias("wins"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg(F.col("sig").cast("double")).alias("sig_rate"), F.avg("null_q").alias("null_mean"))


def synth_weights(states: DataFrame, names: list[str], as_of, weighting: str = "equal", fwd_window: int = 5, lookback: int = 60) -> dict[str, float]:
    """Weights of a composite: 1 each, or by mean recent IC (a negative one turns the rank round)."""
    if weighting == "equal":
        return {n: 1.0 for n in names}
    if weighting != "ic_weighted":
        raise ValueError(f"unknown weighting {weighting!r}")
    ics = states.filter((F.col("fwd_window") == fwd_window) & F.col("factor").isin(names)).select("date", "factor", "ic")
    return {r["factor"]: r["weight"] for r in evaluation.ic_weights(ics, as_of, lookback).orderBy("factor").collect()}  # one row a factor


def phase_c_summary(compare: DataFrame) -> DataFrame:
    """best_single, its and the composite's Sharpe ratio, and whether the composite beats it.  compare: run_id and metrics."""
    single = compare.filter("run_id <> 'composite'").agg(F.max_by("run_id", F.struct("sharpe_ratio", "run_id")).alias("best_single"), F.max("sharpe_ratio").alias("best_single_sharpe"))
    both = single.crossJoin(compare.filter("run_id = 'composite'").select(F.col("sharpe_ratio").alias("synth_sharpe")))  # one row each
    return both.withColumn("synth_beats_best_single", F.col("synth_sharpe") > F.col("best_single_sharpe"))


def compare_backtests(data: DataFrame, signals: dict[str, DataFrame], engine=None, max_weight: float | None = 0.3, dead_zone: float = 0.015) -> tuple[DataFrame, DataFrame]:
    """(metrics by run_id, equity curves by run_id) of several signal tables."""
    _, equity, figures = backtest.run_pipeline(data, signals, engine or backtest.Engine(), max_weight=max_weight, dead_zone=dead_zone)
    return figures, equity


def phase_c(data: DataFrame, weights: dict[str, float], rebalance: int = 20, top_n: int = 10, bottom_n: int = 5, engine=None, **build) -> DataFrame:
    """Metrics of the composite of factors and of each alone, as runs of one plan; weights as from ``synth_weights``."""
    runs = {"composite": weights, **{f: {f: w} for f, w in weights.items()}}
    # of signals that are not thinned out by their dates only buys count
    signals = strategies.composite_runs(with_factors(data, list(weights)), runs, rebalance, top_n, bottom_n, data, buys=build.get("rebalance_days") is None)
    engines = {r: engine or backtest.Engine() for r in runs}
    played = backtest.played_runs(backtest.build_positions(data, signals, engines["composite"].capital, **build), data, engines, data)
    return backtest.played_metrics(played, engines["composite"].capital)


#: Layers of the screen: all codes, and each cell of size and liquidity.
LAYERS = ("all", *(f"{s}_{l}" for s in ("small", "mid", "large") for l in ("low", "mid", "high")))


def mining_screen(data: DataFrame, names: list[str], windows=(5,), t_active: float = 2.0, layer_t: float = 2.81, min_days: int = 10, min_obs: int = 5) -> DataFrame:
    """factor, fwd_window, mean_ic, t_stat and n_days of all codes and of each layer, domain (universal, the layers beyond layer_t, or none) and sign."""
    made = evaluation.size_liquidity_layers(evaluation.forward_returns(with_factors(data, names), windows))
    t = evaluation.ic_by_layer(made, names, windows, min_obs, min_days)
    values = ("mean_ic", "t_stat", "n_days")
    wide = t.groupBy(*KEYS).agg(*[F.max(F.when(F.col("layer") == layer, F.col(v))).alias(f"{layer}_{v}") for layer in LAYERS for v in values])
    strong = F.array_compact(F.array(*[F.when(F.abs(f"{layer}_t_stat") >= layer_t, F.lit(layer)) for layer in LAYERS[1:]]))
    domain = F.when(F.abs("all_t_stat") >= t_active, "universal").when(F.size(strong) > 0, F.array_join(F.sort_array(strong), ",")).otherwise("none")
    return wide.withColumn("domain", domain).withColumn("sign", F.when(F.col("domain") == "none", 0).when(F.col("all_t_stat") > 0, 1).otherwise(-1))
