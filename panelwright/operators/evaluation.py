"""Factor evaluation: forward returns, information coefficients, quantiles, layers, redundancy, audits.

Factors are unpivoted to long rows first, so any number of factors and windows costs one plan.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from .timeseries import by_code, pieces, rank_pct, rolling, rows, spread

FLAGS = ("limit_up", "limit_down", "is_suspended")


def forward_returns(df: DataFrame, windows=(1, 5, 20), exclude_untradable: bool = False) -> DataFrame:
    """fwd_ret_{w}d: close w rows ahead over today's, less one; masked on days with a true flag if asked."""
    stop = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in FLAGS if c in df.columns], F.lit(False)) if exclude_untradable else F.lit(False)
    ahead = {f"fwd_ret_{w}d": ratio(F.lead("close", w).over(by_code()), F.col("close")) - 1 for w in windows}
    return df.withColumns({n: F.when(~stop, c) for n, c in ahead.items()})


def long_pairs(df: DataFrame, factors: list[str], windows=(5,), by: tuple = ()) -> DataFrame:
    """date, code, factor, fwd_window, x, y - and the columns named in by - for complete pairs."""
    both = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(w).alias("fwd_window"), F.col(f).cast("double").alias("x"), F.col(f"fwd_ret_{w}d").alias("y")) for f in factors for w in windows])
    return df.select("date", "code", *by, F.explode(both).alias("p")).select("date", "code", *by, "p.*").filter("x is not null and y is not null")


def pearson(x: str, y: str) -> Column:
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def kendall(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ic (tau-b; null for a constant side), n of the rows x, y alike in keys.

    Discordant pairs are those whose ranks of y come in falling order when rows stand by x.  Two ranks differ first in one bit: so they are counted
    bit by bit, among rows alike in the bits above, as the ones that stand before each zero.
    """
    def others(*columns):
        return F.count("*").over(Window.partitionBy(*keys, *columns)) - 1

    whole = Window.partitionBy(*keys)
    placed = spread(pairs.select(*keys, "x", "y"), 4 * pieces(pairs), *keys).withColumns({"n": F.count("*").over(whole), "at": F.row_number().over(whole.orderBy("x", "y")), "r": F.dense_rank().over(whole.orderBy("y")) - 1})
    placed = placed.withColumns({"tx": others("x"), "ty": others("y"), "both": others("x", "y")})
    bits = placed.withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin("n")) - 1))).withColumns({"one": F.expr("shiftright(r, bit) & 1"), "above": F.expr("shiftright(r, bit + 1)")})
    ones = F.sum("one").over(Window.partitionBy(*keys, "bit", "above").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))

    def ties(c):  # each row meets each pair that it is in
        return (F.sum(F.when(F.col("bit") == 0, F.col(c)).otherwise(0)) / 2).alias(c)

    sums = bits.withColumn("falls", F.when(F.col("one") == 0, F.coalesce(ones, F.lit(0))).otherwise(0)).groupBy(*keys).agg(F.max("n").alias("n"), ties("tx"), ties("ty"), ties("both"), F.sum("falls").alias("falls"))
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return sums.select(*keys, ratio(every - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("falls"), F.sqrt((every - F.col("tx")) * (every - F.col("ty")))).alias("ic"), "n")


def ic(df: DataFrame, factors: list[str], windows=(5,), method: str = "spearman", min_obs: int = 5, by: tuple = ()) -> DataFrame:
    """date, factor, fwd_window, ic, n (and the columns named in by).  Dates with fewer than min_obs pairs are absent; a constant side gives null."""
    keys = ["date", "factor", "fwd_window", *by]
    if method == "spearman":
        return rank_ics(df, factors, windows, min_obs, by)
    pairs = long_pairs(df, factors, windows, by)
    if method == "kendall":
        return kendall(pairs, keys).filter(F.col("n") >= min_obs)
    if method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    return pairs.groupBy(*keys).agg(pearson("x", "y").alias("ic"), F.count("*").alias("n")).filter(F.col("n") >= min_obs)


def doubled_ranks(v: np.ndarray) -> np.ndarray:
    """Twice the average rank of ties less its mean, whole numbers; NaN, the greatest value, ties with itself."""
    at = np.argsort(v, kind="stable")
    s = v[at]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])
    size = np.diff(np.r_[first, len(v)])
    out = np.empty(len(v))
    out[at] = np.repeat(2.0 * first + size - len(v), size)
    return out


def rank_ics(df: DataFrame, factors: list[str], windows, min_obs: int, by: tuple = ()) -> DataFrame:
    """Rank correlations as ``ic``.  A date's cross-section is one group of wide rows, ranked factor by factor: a row crosses one exchange once,
    not once for each factor and window."""
    import pyarrow as pa

    keys, kinds = ["date", *by], dict(df.dtypes)

    def read(column):
        column = column.combine_chunks()
        return np.asarray(column.is_valid()), np.asarray(column.fill_null(0.0))

    def run(key, rows):
        ys, out = [read(rows[f"__y{k}"]) for k in range(len(windows))], []
        met = {}  # factors mostly lack the same rows, for which y is ranked once
        for i, f in enumerate(factors):
            known, x = read(rows[f"__x{i}"])
            for k, w in enumerate(windows):
                both = known & ys[k][0]
                n = int(both.sum())
                if n < max(min_obs, 1):
                    continue
                mask = (k, np.packbits(both).tobytes())
                if mask not in met:
                    met[mask] = doubled_ranks(ys[k][1][both])
                a, b = doubled_ranks(x[both]), met[mask]
                scale = np.sqrt(a @ a) * np.sqrt(b @ b)
                out.append((f, w, float(a @ b / scale) if scale > 0 else None, n))
        f, w, c, n = zip(*out) if out else ((), (), (), ())
        alike = [pa.array([v.as_py()] * len(out), v.type) for v in key]
        return pa.Table.from_arrays([alike[0], pa.array(f, pa.string()), pa.array(w, pa.int32()), *alike[1:], pa.array(c, pa.float64()), pa.array(n, pa.int64())], names=["date", "factor", "fwd_window", *by, "ic", "n"])

    wide = df.select(*keys, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(factors)], *[F.col(f"fwd_ret_{w}d").cast("double").alias(f"__y{k}") for k, w in enumerate(windows)])
    schema = f"date {kinds['date']}, factor string, fwd_window int" + "".join(f", `{c}` {kinds[c]}" for c in by) + ", ic double, n bigint"
    return spread(wide, pieces(df), *keys).groupBy(*keys).applyInArrow(run, schema)


def information_ratio(mean: Column, std: Column, n: Column) -> Column:
    """mean / std; null under two values, infinite for a constant series."""
    return F.when(n < 2, None).when(std == 0, F.lit(float("inf"))).otherwise(ratio(mean, std))


def ic_summary(ics: DataFrame, by=("factor", "fwd_window")) -> DataFrame:
    out = ics.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_ic"), F.count("*").alias("n_days"), F.count_if(F.col("ic") > 1e-12).alias("pos"))
    return out.select(*by, "ic_mean", "ic_std", information_ratio(F.col("ic_mean"), F.col("ic_std"), F.col("n_ic")).alias("ic_ir"), ratio(F.col("pos"), F.col("n_days")).alias("ic_positive_ratio"), "n_days")


def rolling_ic(ics: DataFrame, window: int = 60, min_periods: int = 20) -> DataFrame:
    """rolling_ic, rolling_ir and t_stat per factor and window."""
    if window < 2 or not 1 <= min_periods <= window:
        raise ValueError("need window >= 2 and 1 <= min_periods <= window")
    by = Window.partitionBy("factor", "fwd_window").orderBy("date")
    w = rows(window, by)
    n, mean, std = F.count("ic").over(w), F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    enough = n >= min_periods
    return ics.withColumns({"rolling_ic": F.when(enough, mean), "rolling_ir": F.when(enough, ratio(mean, std)), "t_stat": F.when(enough, ratio(mean, std) * F.sqrt(n))})


def quantile_bucket(x: str, keys: list[str], q: int) -> Column:
    """1..q by rank, ties by code: bucket edges lie at equal shares of the ranks."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(x, "code"))
    n = F.count("*").over(Window.partitionBy(*keys))
    if q == 3:
        return F.least(F.floor((r - 1) * 3 / F.greatest(n - 1, F.lit(1))).cast("int") + 1, F.lit(3))
    return F.greatest(F.ceil((r - 1) * q / F.greatest(n - 1, F.lit(1))).cast("int"), F.lit(1))


def quantile_returns(df: DataFrame, factors: list[str], windows=(5,), n_quantiles: int = 5, rebalance_days: int = 1) -> DataFrame:
    """date, factor, fwd_window, bucket, ret: mean forward return; only dates with n_quantiles codes, every rebalance_days-th of them."""
    keys = ["date", "factor", "fwd_window"]
    pairs = long_pairs(df, factors, windows)
    series = Window.partitionBy("factor", "fwd_window")
    pairs = pairs.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("n") >= n_quantiles)
    if rebalance_days > 1:
        dates = pairs.select(*keys).distinct().withColumn("k", F.row_number().over(series.orderBy("date")) - 1).filter(F.col("k") % rebalance_days == 0).drop("k")
        pairs = pairs.join(dates, keys, "left_semi")
    return pairs.withColumn("bucket", quantile_bucket("x", keys, n_quantiles)).groupBy(*keys, "bucket").agg(F.avg("y").alias("ret"))


def quantile_summary(returns: DataFrame, n_quantiles: int = 5) -> DataFrame:
    """Per bucket and for long_short (top less bottom): mean, std, hit rate, dates."""
    keys = ["date", "factor", "fwd_window"]
    ends = returns.filter(F.col("bucket").isin(1, n_quantiles)).groupBy(*keys).agg(F.max(F.when(F.col("bucket") == n_quantiles, F.col("ret"))).alias("t"), F.max(F.when(F.col("bucket") == 1, F.col("ret"))).alias("b"))
    spread = ends.select(*keys, F.lit("long_short").alias("bucket"), (F.col("t") - F.col("b")).alias("ret"))
    both = returns.select(*keys, F.concat(F.lit("q"), F.col("bucket").cast("string")).alias("bucket"), "ret").unionByName(spread)
    return both.groupBy("factor", "fwd_window", "bucket").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), ratio(F.count_if(F.col("ret") > 0), F.count("ret")).alias("hit"), F.count("ret").alias("n_dates"))


def evaluate_factors(df: DataFrame, factors: list[str], windows=(1, 5, 20), n_quantiles: int = 5) -> DataFrame:
    """factor, fwd_window, ic_mean, ic_std, ic_ir, ic_positive_ratio, ls_mean, ls_ir.  Adds forward returns where they are missing."""
    if any(f"fwd_ret_{w}d" not in df.columns for w in windows):
        df = forward_returns(df, windows)
    spread = quantile_summary(quantile_returns(df, factors, windows, n_quantiles), n_quantiles).filter("bucket = 'long_short'")
    ls = spread.select("factor", "fwd_window", F.col("mean").alias("ls_mean"), information_ratio(F.col("mean"), F.col("std"), F.col("n_dates")).alias("ls_ir"))
    return ic_summary(ic(df, factors, windows)).drop("n_days").join(ls, ["factor", "fwd_window"], "left")


def size_liquidity_layers(df: DataFrame, bins: int = 3) -> DataFrame:
    """size_layer (small, mid, large by circ_mv) and liq_layer (low, mid, high by turnover_rate) within each date.

    Edges are interpolated quantiles, and a value on an edge goes below it.  Where edges and extremes are not distinct, percentile ranks are cut instead.
    """
    if bins not in (2, 3):
        raise ValueError("bins must be 2 or 3")
    out = spread(df, pieces(df), "date")
    for col, name, labels in (("circ_mv", "size_layer", ("small", "mid", "large")), ("turnover_rate", "liq_layer", ("low", "mid", "high"))):
        labels = labels if bins == 3 else (labels[0], labels[2])
        by = Window.partitionBy("date")
        at = F.percentile(col, F.array(*[F.lit(k / bins) for k in range(1, bins)])).over(by)
        out = out.withColumns({"__e": at, "__lo": F.min(col).over(by), "__hi": F.max(col).over(by), "__p": rank_pct(col)})
        edges = [F.col("__lo"), *[F.col("__e")[k] for k in range(bins - 1)], F.col("__hi")]
        plain = reduce(lambda a, b: a & b, [a < b for a, b in zip(edges, edges[1:])])

        def cut(value, marks):
            c = F.when(value <= marks[0], labels[0])
            for m, label in zip(marks[1:], labels[1:]):
                c = c.when(value <= m, label)
            return c.otherwise(labels[-1])

        by_edge, by_rank = cut(F.col(col), edges[1:-1]), cut(F.col("__p"), [F.lit(k / bins) for k in range(1, bins)])
        out = out.withColumn(name, F.when(F.col(col).isNull(), None).when(plain, by_edge).otherwise(by_rank)).drop("__e", "__lo", "__hi", "__p")
    return out


def ic_by_layer(df: DataFrame, factors: list[str], windows=(5,), min_obs: int = 5, min_days: int = 20) -> DataFrame:
    """factor, fwd_window, layer, mean_ic, t_stat, n_days: all rows, and each size-liquidity cell."""
    cell = F.when(F.col("size_layer").isNotNull() & F.col("liq_layer").isNotNull(), F.concat_ws("_", "size_layer", "liq_layer"))
    both = df.withColumn("layer", F.explode(F.array_compact(F.array(F.lit("all"), cell))))
    out = ic(both, factors, windows, min_obs=min_obs, by=("layer",))
    stats = out.groupBy("factor", "fwd_window", "layer").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("n_days"))
    return stats.select("factor", "fwd_window", "layer", "mean_ic", F.when(F.col("n_days") >= min_days, ratio(F.col("mean_ic"), F.col("s")) * F.sqrt("n_days")).alias("t_stat"), "n_days")


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last n dates.  The dates are few; they are ranked alone."""
    dates = df.select("date").distinct().orderBy(F.col("date").desc()).limit(n)
    return df.join(F.broadcast(dates), "date", "left_semi")


def daily_correlations(df: DataFrame, factors: list[str], min_obs: int = 20, method: str = "spearman", by: tuple = ()) -> DataFrame:
    """by, date, factor_a, factor_b, c: correlations of complete pairs on each date with min_obs of them; null for a constant side.

    A date's cross-section is one group: each factor is ranked once, and again only for pairs where values are missing.
    """
    import pandas as pd

    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")
    keys = [*by, "date"]
    at = [(i, j) for i in range(len(factors)) for j in range(i + 1, len(factors))]

    def ranks(x):
        return pd.DataFrame(x).rank().to_numpy() if method == "spearman" else x

    def run(key, pdf):
        x = pdf[factors].to_numpy(float)
        known = ~np.isnan(x)
        whole = known.all(axis=0)
        r = np.where(whole, ranks(x), 0.0)
        r = r - r.mean(axis=0)
        dot, n = r.T @ r, known.T.astype(np.int64) @ known.astype(np.int64)
        out = []
        for i, j in at:
            if n[i, j] < min_obs:
                continue
            if whole[i] and whole[j]:
                xy, xx, yy = dot[i, j], dot[i, i], dot[j, j]
            else:
                pair = ranks(x[known[:, i] & known[:, j]][:, [i, j]])
                pair = pair - pair.mean(axis=0)
                (xx, xy), (_, yy) = pair.T @ pair
            scale = np.sqrt(xx * yy)
            out.append((*key, factors[i], factors[j], xy / scale if scale > 1e-12 else None))
        return pd.DataFrame(out, columns=[*keys, "factor_a", "factor_b", "c"]).astype({"c": "float64"})

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", factor_a string, factor_b string, c double"
    values = [F.col(f).cast("double").alias(f) for f in factors]
    return spread(df.select(*keys, *values), pieces(df), *keys).groupBy(*keys).applyInPandas(run, schema).withColumn("c", F.nanvl("c", F.lit(None).cast("double")))


def corr_matrix(df: DataFrame, factors: list[str], window: int = 60, agg: str = "mean", min_obs: int = 20, method: str = "spearman") -> DataFrame:
    """factor_a, factor_b, corr, n_dates: per-date correlations of complete pairs over the last dates, averaged (or their median)."""
    daily = daily_correlations(last_dates(df.select("date", "code", *factors), window), factors, min_obs, method)
    over = F.avg("c") if agg == "mean" else F.percentile("c", F.lit(0.5))
    return daily.groupBy("factor_a", "factor_b").agg(over.alias("corr"), F.count("c").alias("n_dates"))


LINKAGES = {
    "single": lambda x, y, at, a, b, c: np.minimum(x, y),
    "complete": lambda x, y, at, a, b, c: np.maximum(x, y),
    "average": lambda x, y, at, a, b, c: (a * x + b * y) / (a + b),
    "ward": lambda x, y, at, a, b, c: np.sqrt(np.maximum(0.0, ((a + c) * x**2 + (b + c) * y**2 - c * at**2) / (a + b + c))),
}


def distances(factors: list[str], correlations: dict[tuple[str, str], float | None]) -> np.ndarray:
    """1 - |correlation| of each pair; 1 where it is missing."""
    at, d = {f: i for i, f in enumerate(factors)}, np.ones((len(factors), len(factors)))
    np.fill_diagonal(d, 0.0)
    for (a, b), c in correlations.items():
        if a in at and b in at and a != b and c is not None and not np.isnan(c):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - abs(c)
    return d


def merge_table(factors: list[str], correlations: dict[tuple[str, str], float | None], linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """The dendrogram: (left, right, height, size) by rising height.  Factors are 0 to n - 1; the k-th merge makes node n + k.

    Nearest-neighbour chain: each node is followed to its nearest neighbour until two are each other's nearest, which are merged; the rest of the
    chain still holds, since these linkages never bring a merged node nearer.  Quadratic in time, a row of distances a step.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}")
    n, update = len(factors), LINKAGES[linkage]
    d = distances(factors, correlations)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        j = int(np.argmin(d[i]))
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            at = float(d[i, j])
            merges.append((at, len(merges), i, j))
            others = alive.copy()
            others[[i, j]] = False
            new = update(d[i, others], d[j, others], at, size[i], size[j], size[others])
            d[i, others] = d[others, i] = new
            d[j, :] = d[:, j] = np.inf
            size[i] += size[j]
            alive[j] = False
        else:
            chain.append(j)
    # chains find merges in another order than that of heights
    node, weight, out = {i: i for i in range(n)}, {i: 1 for i in range(n)}, []
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at, _, i, j in sorted(merges):
        a, b = top(i), top(j)
        left, right = sorted((node[a], node[b]))
        root[b] = a
        weight[a] += weight[b]
        out.append((left, right, at, weight[a]))
        node[a] = n + len(out) - 1
    return out


def cluster_redundant(factors: list[str], correlations: dict[tuple[str, str], float | None], threshold: float = 0.7, linkage: str = "average") -> dict[str, int]:
    """Cluster number of each factor, by first appearance: the dendrogram on 1 - |corr| cut at 1 - threshold."""
    n, inside = len(factors), {i: [i] for i in range(len(factors))}
    for k, (left, right, height, _) in enumerate(merge_table(factors, correlations, linkage)):
        if height > 1 - threshold:
            break
        inside[n + k] = inside.pop(left) + inside.pop(right)
    label = {m: g for g, members in inside.items() for m in members}
    seen: dict[int, int] = {}
    return {f: seen.setdefault(label[i], len(seen) + 1) for i, f in enumerate(factors)}


def dendrogram(df: DataFrame, factors: list[str], window: int = 60, linkage: str = "average", min_obs: int = 20) -> DataFrame:
    """node, left, right, height, size, members: the merges of factors by their correlations; factors are a few hundred at most."""
    rows = corr_matrix(df, factors, window, min_obs=min_obs).collect()  # one row a pair of factors
    merges = merge_table(factors, {(r["factor_a"], r["factor_b"]): r["corr"] for r in rows}, linkage)
    inside = {i: [f] for i, f in enumerate(factors)}
    out = []
    for k, (left, right, height, size) in enumerate(merges):
        inside[len(factors) + k] = sorted(inside[left] + inside[right])
        out.append((len(factors) + k, left, right, height, size, inside[len(factors) + k]))
    return df.sparkSession.createDataFrame(out, "node int, left int, right int, height double, size int, members array<string>")


def cophenetic(merged: DataFrame) -> DataFrame:
    """factor_a, factor_b, height: where two factors first are in one node."""
    a = merged.select("height", F.explode("members").alias("factor_a"), "members")
    return a.select("height", "factor_a", F.explode("members").alias("factor_b")).filter("factor_a < factor_b").groupBy("factor_a", "factor_b").agg(F.min("height").alias("height"))


def select_representative(clusters: DataFrame, by: str = "t_stat") -> DataFrame:
    """cluster, representative, members: the best global rank of a cluster; nulls last, ties by name.

    clusters: factor, cluster, t_stat, ir.  by: t_stat, ir, or combined (the mean of both ranks).
    """
    whole = Window.partitionBy(F.lit(1))  # factors are at most a few hundred
    rank = {c: F.rank().over(whole.orderBy(F.abs(c).desc_nulls_last())) for c in ("t_stat", "ir")}
    score = {"t_stat": rank["t_stat"], "ir": rank["ir"], "combined": (rank["t_stat"] + rank["ir"]) / 2}[by]
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("__r", "factor"))
    ranked = clusters.withColumn("__r", score).withColumn("__k", first)
    return ranked.groupBy("cluster").agg(F.max(F.when(F.col("__k") == 1, F.col("factor"))).alias("representative"), F.sort_array(F.collect_list("factor")).alias("members"))


def demean_by_industry(df: DataFrame, columns: list[str], min_peers: int = 3) -> DataFrame:
    """Each column less its mean among the date's rows of the industry; industries with too few values form one."""
    if min_peers < 1:
        raise ValueError("min_peers must be at least 1")
    out = df
    for c in columns:
        known = F.coalesce("industry", F.lit("__unknown__"))
        peers = F.count(c).over(Window.partitionBy("date", known))
        out = out.withColumn("__g", F.when(peers >= min_peers, known).otherwise(F.lit("__unknown__")))
        out = out.withColumn(c, F.col(c) - F.avg(c).over(Window.partitionBy("date", "__g"))).drop("__g")
    return out


def neutralize_factors(df: DataFrame, industries: DataFrame, columns: list[str], min_peers: int = 3) -> DataFrame:
    return demean_by_industry(df.drop("industry").join(industries, "code", "left"), columns, min_peers).drop("industry")


def combine_factor_scores(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted mean of percentile ranks over the factors present; a negative weight turns the rank round."""
    return with_ranks(df, list(weights)).withColumn(name, combined_ranks(weights)).drop(*[f"__r_{f}" for f in weights])


def with_ranks(df: DataFrame, factors: list[str] | None = None) -> DataFrame:
    """Adds __r_{factor}, the percentile rank within the date, of each factor (default: all columns but date and code)."""
    factors = [c for c in df.columns if c not in ("date", "code")] if factors is None else factors
    return spread(df, pieces(df), "date").withColumns({f"__r_{f}": rank_pct(f) for f in factors})


def combined_ranks(weights: dict[str, float]) -> Column:
    """The score of ``combine_factor_scores`` from ``with_ranks``."""
    turned = {f: F.col(f"__r_{f}") if w >= 0 else 1 - F.col(f"__r_{f}") for f, w in weights.items()}
    top = sum((F.coalesce(turned[f] * abs(w), F.lit(0.0)) for f, w in weights.items()), F.lit(0.0))
    total = sum((F.when(turned[f].isNotNull(), F.lit(float(abs(w)))).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, ratio(top, total))


def ic_weights(ics: DataFrame, as_of, lookback: int = 60) -> DataFrame:
    """factor, weight: mean of the last lookback ICs up to as_of, over the sum of absolute means; all zero: equal weights."""
    recent = ics.filter((F.col("date") <= F.lit(as_of)) & F.col("ic").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("factor").orderBy(F.col("date").desc()))).filter(F.col("k") <= lookback)
    means = recent.groupBy("factor").agg(F.avg("ic").alias("m"))
    whole = Window.partitionBy(F.lit(1))
    total, n = F.sum(F.abs("m")).over(whole), F.count("*").over(whole)
    return means.select("factor", F.when(total == 0, 1 / n).otherwise(ratio(F.col("m"), total)).alias("weight"))


# factor audit


#: Frames of audited rows that are summed at a time.
FRAMES = 4096


def audit_columns(df: DataFrame, factors: list[str], lookback: int = 60, lag: int = 5, by: tuple = (), once: bool = False) -> DataFrame:
    """date, code (and by), and of each factor cov_, stab_ and disp_: rolling share of values, rolling correlation of rank and lagged rank, dispersion
    of the date.  Rows alike in by are a panel of their own.  once: the dispersion stands at the date's first code alone.

    Rows cross two exchanges, by date for ranks and dispersion and by code.  Some codes' rows are one group, whose windows numpy sums: a frame of
    the JVM's would be gone through anew for each row and each moment.
    """
    import pyarrow as pa

    n, kinds, keys = pieces(df), dict(df.dtypes), ["code", *by]
    day = Window.partitionBy("date", *by)
    values = spread(df.select("date", *keys, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(factors)]), n, "date")
    first = F.row_number().over(day.orderBy("code")) == 1 if once else F.lit(True)
    disp = {f"__d{i}": F.when(first, ratio(F.stddev_samp(f"__x{i}").over(day), F.avg(F.abs(f"__x{i}")).over(day))) for i in range(len(factors))}
    ranked = values.select("date", *keys, *[rank_pct(f"__x{i}", ("date", *by)).alias(f"__r{i}") for i in range(len(factors))], *[c.alias(k) for k, c in disp.items()])

    def run(rows):
        rows = rows.sort_by([(k, "ascending") for k in (*keys, "date")])
        size, out = len(rows), [rows[k] for k in ("date", *keys)]
        codes = [np.asarray(rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices) for k in keys]
        every = np.arange(size)
        begins = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]
        place = every - np.maximum.accumulate(np.where(begins, every, 0))
        held, reach = np.flatnonzero(place >= lookback - 1), np.flatnonzero(place >= lookback - 1 + lag)
        for i in range(len(factors)):
            column = rows[f"__r{i}"].combine_chunks()
            known, x = np.asarray(column.is_valid()), np.asarray(column.fill_null(0.0))
            cov, stab, none, some = np.zeros(size), np.zeros(size), np.ones(size, bool), np.zeros(size, bool)
            so_far = np.r_[0, np.cumsum(known)]
            cov[held], none[held] = (so_far[held + 1] - so_far[held + 1 - lookback]) / lookback, False
            # pairs of a row and the one lag rows before
            both = np.r_[0, np.cumsum(known & np.r_[np.zeros(min(lag, size), bool), known[: max(size - lag, 0)]])]
            whole = reach[both[reach + 1] - both[reach + 1 - lookback] == lookback]
            for k in range(0, len(whole), FRAMES):
                at = whole[k : k + FRAMES]
                frames = np.lib.stride_tricks.sliding_window_view(x, lookback)
                a, b = (v - v.mean(axis=1, keepdims=True) for v in (frames[at + 1 - lookback], frames[at + 1 - lookback - lag]))
                scale = np.sqrt((a * a).mean(axis=1)) * np.sqrt((b * b).mean(axis=1))
                sure = scale > 1e-12
                stab[at[sure]], some[at[sure]] = np.clip((a * b).mean(axis=1)[sure] / scale[sure], -1.0, 1.0), True
            out += [pa.array(cov, mask=none), pa.array(stab, mask=~some), rows[f"__d{i}"]]
        return pa.Table.from_arrays(out, names=names)

    names = ["date", *keys, *[f"{a}_{f}" for f in factors for a in ("cov", "stab", "disp")]]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names[: 1 + len(keys)]) + "".join(f", `{c}` double" for c in names[1 + len(keys) :])
    groups = 4 * (n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # codes of a group: a quarter of a piece
    return spread(ranked.withColumn("__g", F.pmod(F.hash("code"), F.lit(groups))), n, "__g").groupBy("__g").applyInArrow(run, schema)


def audit_factors(df: DataFrame, factors: list[str], lookback: int = 60, lag: int = 5, min_coverage: float = 0.8, min_stability: float = 0.3, min_dispersion: float = 0.10, by: tuple = ()) -> DataFrame:
    """factor (and by), coverage (mean), stability and dispersion (medians; dispersion over dates), active.  Rows alike in by are audited by themselves.

    What the audit measured is written once, and read for the mean, for counts by cell and for the few values of the middle cells.
    """
    from ..sources.dated import materialised

    made = audit_columns(df, factors, lookback, lag, by, once=True)
    made = materialised(made.select(*by, *[f"{a}_{f}" for f in factors for a in ("cov", "stab", "disp")]), "audit")
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"cov_{f}").alias("c"), F.col(f"stab_{f}").alias("s"), F.col(f"disp_{f}").alias("d")) for f in factors])
    made, keys = made.select(*by, F.explode(each).alias("x")).select(*by, "x.*"), ["factor", *by]
    out = made.groupBy(*keys).agg(F.avg("c").alias("coverage"))
    for x, name in (("s", "stability"), ("d", "dispersion")):
        middle = medians(made.filter(F.col(x).isNotNull()).select(*keys, value_cell(x).alias("cell"), x, F.lit(1).alias("m")), keys, x)
        out = out.join(F.broadcast(middle.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("median").alias(name))), alike(keys), "left").drop(*[f"__{c}" for c in keys])  # one row a factor
    active = (F.col("coverage") >= min_coverage) & (F.col("stability") >= min_stability) & (F.col("dispersion") >= min_dispersion)
    return out.withColumn("active", F.coalesce(active, F.lit(False)))


def audit_factors_by_regime(df: DataFrame, factors: list[str], regimes: DataFrame, **params) -> DataFrame:
    """The audit within each regime, all in one plan: rows of other regimes are in none of its windows."""
    days = F.broadcast(regimes.filter("regime is not null").select("date", "regime").distinct())  # one row a date
    made = audit_factors(df.join(days, "date"), factors, by=("regime",), **params)
    return made.select(*[c for c in made.columns if c != "regime"], "regime")


def select_tradable(df: DataFrame, factors: list[str], top_n: int | None = None, min_stocks: int = 5, min_pass_count: int = 1, lookback: int = 60, lag: int = 5, min_coverage: float = 0.8, min_stability: float = 0.3, min_dispersion: float = 0.10) -> DataFrame:
    """date, code, pass_count, rank: codes by the number of factors that they pass; dates with too few are absent."""
    made = audit_columns(df, factors, lookback, lag)
    passed = sum((F.coalesce(((F.col(f"cov_{f}") >= min_coverage) & (F.col(f"stab_{f}") >= min_stability) & (F.col(f"disp_{f}") >= min_dispersion)).cast("int"), F.lit(0)) for f in factors), F.lit(0))
    hit = made.select("date", "code", passed.alias("pass_count")).filter(F.col("pass_count") >= min_pass_count)
    by = Window.partitionBy("date")
    hit = hit.withColumns({"__n": F.count("*").over(by), "rank": F.row_number().over(by.orderBy(F.col("pass_count").desc(), "code"))}).filter(F.col("__n") >= min_stocks).drop("__n")
    return hit if top_n is None else hit.filter(F.col("rank") <= top_n)


def industry_momentum(df: DataFrame, lookback: int = 20) -> DataFrame:
    """date, industry, momentum: mean over codes of the rolling mean return.  Needs an industry column."""
    filled = df.withColumn("__f", F.last("close", ignorenulls=True).over(by_code()))
    back = filled.withColumn("__ret", ratio(F.col("__f"), F.lag("__f").over(by_code())) - 1)
    return back.withColumn("__m", rolling(F.avg, "__ret", lookback)).groupBy("date", "industry").agg(F.avg("__m").alias("momentum"))


# pipeline diagnostics


def signal_stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, total, buy, sell, hold for each named signal table."""
    parts = [df.agg(F.count("*").alias("total"), F.count_if(F.col("signal") == 1).alias("buy"), F.count_if(F.col("signal") == -1).alias("sell"), F.count_if(F.col("signal") == 0).alias("hold")).select(F.lit(n).alias("stage"), "*") for n, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def forward_return_analysis(signals: DataFrame, prices: DataFrame, windows=(1, 5, 20)) -> DataFrame:
    """window, signal, count, mean, median, hit_rate of forward returns."""
    ahead = forward_returns(prices.select("date", "code", "close"), windows)
    each = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"fwd_ret_{w}d").alias("r")) for w in windows])
    rows_ = signals.select("date", "code", "signal").join(ahead, ["date", "code"]).select("signal", F.explode(each).alias("x")).select("signal", "x.*").filter("r is not null")
    by = ["window", "signal"]
    values = value_counts(rows_, by, "r")
    stats = values.groupBy(*by).agg(F.sum("m").alias("count"), ratio(F.sum(F.col("r") * F.col("m")), F.sum("m")).alias("mean"), ratio(F.sum(F.when(F.col("r") > 0, F.col("m")).otherwise(0)), F.sum("m")).alias("hit_rate"))
    return stats.join(medians(values, by, "r").select(*[F.col(c).alias(f"__{c}") for c in by], "median"), alike(by)).select(*by, "count", "mean", "median", "hit_rate")


def alike(by: list[str]) -> Column:
    """Equal keys, missing ones too: such a join adds no filter to its sides, so that they can share an exchange."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))


#: Cells of values for each doubling of their size.
OCTAVE = 256


def value_cell(x: str) -> Column:
    size = F.floor(F.least(F.greatest(F.log2(F.abs(x)), F.lit(-1100.0)), F.lit(1100.0)) * OCTAVE) + 1101 * OCTAVE
    return F.when(F.col(x) > 0, size).when(F.col(x) < 0, -size).otherwise(F.lit(0).cast("long"))


def value_counts(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, cell, x, m: how often each value occurs.  Cells follow the order of values; there are at most OCTAVE for each sign and doubling."""
    return df.select(*by, value_cell(x).alias("cell"), x).groupBy(*by, "cell", x).agg(F.count("*").alias("m"))


def medians(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, median: exact, from ``value_counts`` or rows of its columns with m = 1.  Cells are counted first, and only values of those that the middle falls into are put in order,
    so that no task holds a group."""
    order = Window.partitionBy(*by).orderBy("cell")
    cells = values.groupBy(*by, "cell").agg(F.sum("m").alias("m")).withColumns({"__upto": F.sum("m").over(order), "__n": F.sum("m").over(Window.partitionBy(*by))})
    lower, upper = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    before = F.col("__upto") - F.col("m")
    middle = cells.withColumns({"__before": before, "__lower": lower, "__upper": upper}).filter(((F.col("__lower") >= F.col("__before")) & (F.col("__lower") < F.col("__upto"))) | ((F.col("__upper") >= F.col("__before")) & (F.col("__upper") < F.col("__upto"))))
    middle = middle.select(*[F.col(c).alias(f"__{c}") for c in (*by, "cell")], "__before", "__lower", "__upper")
    found = values.join(F.broadcast(middle), alike([*by, "cell"]))  # two rows a group at most
    found = found.groupBy(*by, "cell", x, "__before", "__lower", "__upper").agg(F.sum("m").alias("m"))
    upto = F.col("__before") + F.sum("m").over(Window.partitionBy(*by, "cell").orderBy(x))
    found = found.withColumn("__upto", upto)
    low, high = (F.min(F.when(F.col("__upto") > F.col(k), F.col(x))) for k in ("__lower", "__upper"))
    return found.groupBy(*by).agg(((low + high) / 2).alias("median"))


def signal_spread(analysis: DataFrame) -> DataFrame:
    """window, spread (buy mean less sell mean), quality."""
    buy, sell = F.col("signal") == 1, F.col("signal") == -1
    s = analysis.groupBy("window").agg(F.max(F.when(buy, F.col("mean"))).alias("b"), F.max(F.when(sell, F.col("mean"))).alias("s"), F.max(F.when(buy, F.col("hit_rate"))).alias("h"))
    spread = F.col("b") - F.col("s")
    quality = F.when(spread.isNull(), "insufficient_data").when((spread > 0.001) & (F.col("h") > 0.5), "good").when(spread > 0, "weak_but_directional").when(spread > -0.001, "no_signal").otherwise("inverted")
    return s.select("window", spread.alias("spread"), quality.alias("quality"))


def full_diagnosis(stages: dict[str, DataFrame], prices: DataFrame) -> dict[str, DataFrame]:
    """stage_counts, forward_returns (of the first stage's signals) and spread, which are read from one run over the panel."""
    made = forward_return_analysis(next(iter(stages.values())), prices)
    forward = prices.sparkSession.createDataFrame(made.collect(), made.schema)  # one row a window and signal
    return {"stage_counts": signal_stage_counts(stages), "forward_returns": forward, "spread": signal_spread(forward)}


def pivot_matrix(results: DataFrame, index: str, column: str, value: str, columns: list[str]) -> DataFrame:
    return results.groupBy(index).pivot(column, columns).agg(F.max(value))


def best_result(results: DataFrame, metric: str = "sharpe_ratio") -> DataFrame:
    """The row with the greatest metric; ties by the remaining columns; none of an empty table."""
    rest = [c for c in results.columns if c != metric]
    return results.orderBy(F.col(metric).desc_nulls_last(), *rest).limit(1)


def best_per_pool(results: DataFrame, metric: str, pool: str = "pool") -> DataFrame:
    """The row with the greatest metric of each pool; ties by the remaining columns."""
    rest = [c for c in results.columns if c not in (pool, metric)]
    best = F.row_number().over(Window.partitionBy(pool).orderBy(F.col(metric).desc_nulls_last(), *rest))
    return results.withColumn("__k", best).filter("__k = 1").drop("__k")
