"""Queries over base operators, cleaning and evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import div0
from ..operators import cleaning, evaluation, factors, timeseries as ts
from ..sources import panels
from . import oracle_sql as sql
from .catalogue import full_panel, query, rounded

# base operators


def _simple(name: str, build, expr: str, digits: int = 6, stages: list[dict] | None = None):
    ctes, last = sql.staged(sql.P, stages or [], "p")
    oracle = f"WITH {ctes}\nSELECT date, code, {sql.rounded(expr, digits, 'value')} FROM {last}"

    @query(name, oracle)
    def run(spark, sf_dir):
        made = build(ts.ewm_position(panels.bars(spark, sf_dir)))
        return made.select("date", "code", rounded("value", digits).alias("value")) if hasattr(made, "select") else made


def _col(make):
    return lambda df: df.withColumn("value", make().cast("double"))


_simple("op_delay", _col(lambda: ts.delay("close", 3)), sql.lag("close", 3))
_simple("op_delta", _col(lambda: ts.delta("close", 3)), sql.delta("close", 3))
_simple("op_rolling_mean", _col(lambda: ts.rolling_mean("close", 10)), sql.roll("avg", "close", 10))
_simple("op_rolling_std", _col(lambda: ts.rolling_std("close", 10)), sql.roll("stddev_samp", "close", 10))
_simple("op_rolling_sum", _col(lambda: ts.rolling_sum("volume", 10)), sql.roll("sum", "volume", 10), 2)
_simple("op_ts_max", _col(lambda: ts.ts_max("high", 10)), sql.roll("max", "high", 10))
_simple("op_ts_min", _col(lambda: ts.ts_min("low", 10)), sql.roll("min", "low", 10))
_simple("op_sma", _col(lambda: ts.ewm("close", 12, 2)), sql.ewm("close", 12, 2))


def _long_ewm(name: str, n: int, m: int) -> None:
    """The exponential mean on daily bars by return flag, some 2,500 rows a code, by its recursion.  Values lie in the thousands: four decimals."""
    keep = repr(1 - m / n)
    ctes = f"d AS MATERIALIZED (SELECT *, row_number() OVER ({sql.BC}) AS i FROM ({sql.bars('l_returnflag').replace(chr(39) + 'week' + chr(39), chr(39) + 'day' + chr(39))})), e AS (SELECT code, i, close AS a, 1.0::DOUBLE AS b FROM d WHERE i = 1 UNION ALL SELECT d.code, d.i, d.close + a * {keep}, 1 + b * {keep} FROM e JOIN d ON d.code = e.code AND d.i = e.i + 1)"

    @query(name, f"WITH RECURSIVE {ctes} SELECT date, code, {sql.rounded(f'CASE WHEN i >= {n} THEN a / b END', 4, 'value')} FROM d JOIN e USING (code, i)")
    def run(spark, sf_dir):
        made = ts.ewm_position(panels.daily_bars(spark, sf_dir)).withColumn("value", ts.ewm("close", n, m))
        return made.select("date", "code", rounded("value", 4).alias("value"))


_long_ewm("op_sma_slow", 250, 1)
_long_ewm("op_sma_fast", 3, 2)
_simple("op_corr", _col(lambda: ts.corr("close", "volume", 10)), sql.cor("close", "volume", 10))
_simple("op_rolling_cov", _col(lambda: ts.rolling_cov("close", "volume", 10)), sql.cov("close", "volume", 10), 3)
_simple("op_rank", _col(lambda: ts.rank_pct("close")), sql.prank("close"))
_simple("op_cumulative_sum", _col(lambda: ts.cumulative_sum("volume")), f"sum(volume) OVER ({sql.BC})", 2)
_simple("op_forward_fill", lambda df: df.withColumn("value", ts.forward_fill(F.when(F.col("volume") > 100, F.col("close")))), f"last_value(CASE WHEN volume > 100 THEN close END IGNORE NULLS) OVER ({sql.BC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_simple("op_rolling_quantile", _col(lambda: ts.rolling_quantile("close", 0.75, 60, 20)), sql.roll("quantile_cont", "close", 60, 20).replace("quantile_cont(close)", "quantile_cont(close, 0.75)"))
_simple("op_streak", lambda df: ts.streak(df, F.col("close") > F.col("open"), "value"), "CASE WHEN f THEN row_number() OVER (PARTITION BY code, g ORDER BY date) ELSE 0 END", 0, [{"f": "close > open"}, {"c": f"CASE WHEN f IS DISTINCT FROM lag(f) OVER ({sql.BC}) THEN 1 ELSE 0 END"}, {"g": f"sum(c) OVER ({sql.BC})"}])
_simple("op_div0", _col(lambda: div0(F.col("close") - F.col("open"), F.col("high") - F.col("low"))), sql.div0("close - open", "high - low"))


def _table_sql() -> str:
    """All factors side by side, from the panel with company figures and money flow."""
    ctes, names = [f"{sql.FIGURES}, {sql.FLOWS}, wf AS MATERIALIZED (SELECT * FROM f JOIN w USING (date, code))"], list(sql.FACTORS)
    for k, n in enumerate(names):
        stages, final, digits, *_ = sql.FACTORS[n]
        last = "wf"
        for j, cols in enumerate([{"t": f"row_number() OVER ({sql.BC}) - 1"}, *stages]):
            ctes.append(f"x{k}_{j} AS (SELECT *, {', '.join(f'{v} AS {c}' for c, v in cols.items())} FROM {last})")
            last = f"x{k}_{j}"
        ctes.append(f"v{k} AS (SELECT date, code, {sql.rounded(final, digits, n)} FROM {last})")
    return f"WITH {', '.join(ctes)} SELECT * FROM v0" + "".join(f" JOIN v{k} USING (date, code)" for k in range(1, len(names)))


@query("factor_table", _table_sql())
def factor_table(spark, sf_dir):
    """All single factors in one plan."""
    names = [n for n in factors.list_factors(kind="single") if factors.get_spec(n).alias_of is None]
    panel = factors.narrowed(full_panel(spark, sf_dir), names)
    made = factors.with_factors(panel, [n for n in names if n not in panel.columns])
    return made.select("date", "code", *[rounded(n, sql.factor_digits(n)).alias(n) for n in names])


# forward returns and information coefficients

_FWD = f"""{sql.P}, a AS (SELECT *, {sql.ratio('close', sql.lag('close', 20))} - 1 AS mom, volume / nullif(avg(volume) {sql.frame(20)}, 0) AS vr0, count(*) {sql.frame(20)} AS n20,
 lead(close, 1) OVER ({sql.BC}) / close - 1 AS f1, lead(close, 5) OVER ({sql.BC}) / close - 1 AS f5, lead(close, 20) OVER ({sql.BC}) / close - 1 AS f20 FROM p),
 b AS (SELECT date, code, close, volume, mom * 100 AS mom, CASE WHEN n20 = 20 THEN vr0 END AS vr, f1, f5, f20 FROM a),
 l AS (SELECT date, code, factor, x, 5 AS fwd_window, f5 AS y FROM (SELECT date, code, f5, unnest(['calc_momentum_20d_return', 'calc_volume_ratio']) AS factor, unnest([mom, vr]) AS x FROM b) WHERE x IS NOT NULL AND f5 IS NOT NULL)"""
_RANKED = _FWD + f""", r AS (SELECT *, {sql.prank('x', 'date, factor')} AS rx, {sql.prank('y', 'date, factor')} AS ry FROM l)"""


def _corr_agg(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-14 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


_IC = _RANKED + f", ic AS (SELECT date, factor, fwd_window, {_corr_agg('rx', 'ry')} AS ic, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5)"
FACTORS = ["calc_momentum_20d_return", "calc_volume_ratio"]


def two_factors(spark, sf_dir, windows=(5,)):
    return evaluation.forward_returns(factors.with_factors(panels.bars(spark, sf_dir), FACTORS), windows)


@query("fwd_returns", f"WITH {_FWD} SELECT date, code, {sql.rounded('f1', 6, 'fwd_1')}, {sql.rounded('f5', 6, 'fwd_5')}, {sql.rounded('f20', 6, 'fwd_20')} FROM b")
def fwd_returns(spark, sf_dir):
    made = evaluation.forward_returns(panels.bars(spark, sf_dir))
    return made.select("date", "code", *[rounded(f"fwd_ret_{w}d", 6).alias(f"fwd_{w}") for w in (1, 5, 20)])


@query("ic_spearman", f"WITH {_IC} SELECT date, factor, fwd_window, n, {sql.rounded('ic', 6, 'ic')} FROM ic")
def ic_spearman(spark, sf_dir):
    return evaluation.ic(two_factors(spark, sf_dir), FACTORS).select("date", "factor", "fwd_window", "n", rounded("ic", 6).alias("ic"))


@query("ic_pearson", f"WITH {_FWD} SELECT date, factor, fwd_window, count(*) AS n, {sql.rounded(_corr_agg('x', 'y'), 6, 'ic')} FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def ic_pearson(spark, sf_dir):
    return evaluation.ic(two_factors(spark, sf_dir), FACTORS, method="pearson").select("date", "factor", "fwd_window", "n", rounded("ic", 6).alias("ic"))


_KENDALL = _FWD + """ SELECT a.date, a.factor, a.fwd_window, any_value(k.n) AS n, """ + sql.rounded("CASE WHEN sum(abs(sign(a.x - b.x))) > 0 AND sum(abs(sign(a.y - b.y))) > 0 THEN sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) END", 6, "ic") + """
 FROM l a JOIN l b ON a.date = b.date AND a.factor = b.factor AND a.code < b.code JOIN (SELECT date, factor, count(*) AS n FROM l GROUP BY 1, 2) k ON k.date = a.date AND k.factor = a.factor WHERE k.n >= 5 GROUP BY 1, 2, 3"""


@query("ic_kendall", f"WITH {_KENDALL}")
def ic_kendall(spark, sf_dir):
    return evaluation.ic(two_factors(spark, sf_dir), FACTORS, method="kendall").select("date", "factor", "fwd_window", "n", rounded("ic", 6).alias("ic"))


@query("ir_table", f"WITH {_IC} SELECT factor, fwd_window, {sql.rounded('avg(ic)', 6, 'ic_mean')}, {sql.rounded('stddev_samp(ic)', 6, 'ic_std')}, {sql.rounded('avg(ic) / nullif(stddev_samp(ic), 0)', 6, 'ic_ir')}, {sql.rounded('count(*) FILTER (ic > 1e-12) * 1.0 / count(*)', 6, 'ic_positive_ratio')}, count(*) AS n_days FROM ic GROUP BY 1, 2")
def ir_table(spark, sf_dir):
    s = evaluation.ic_summary(evaluation.ic(two_factors(spark, sf_dir), FACTORS))
    return s.select("factor", "fwd_window", *[rounded(c, 6).alias(c) for c in ("ic_mean", "ic_std", "ic_ir", "ic_positive_ratio")], "n_days")


_W60 = "OVER (PARTITION BY factor, fwd_window ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_ROLLED = f"{_IC}, ro AS (SELECT *, count(ic) {_W60} AS k, avg(ic) {_W60} AS m, stddev_samp(ic) {_W60} AS s FROM ic)"


@query("rolling_tstat", f"WITH {_ROLLED} SELECT date, factor, fwd_window, {sql.rounded('CASE WHEN k >= 20 THEN m END', 6, 'rolling_ic')}, {sql.rounded('CASE WHEN k >= 20 THEN m / nullif(s, 0) END', 6, 'rolling_ir')}, {sql.rounded('CASE WHEN k >= 20 THEN m / nullif(s, 0) * sqrt(k) END', 6, 't_stat')} FROM ro")
def rolling_tstat(spark, sf_dir):
    r = evaluation.rolling_ic(evaluation.ic(two_factors(spark, sf_dir), FACTORS))
    return r.select("date", "factor", "fwd_window", *[rounded(c, 6).alias(c) for c in ("rolling_ic", "rolling_ir", "t_stat")])


_BUCKET = _FWD + """, q AS (SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY x, code) AS rn, count(*) OVER (PARTITION BY date, factor) AS n FROM l),
 qb AS (SELECT *, greatest(CAST(ceil((rn - 1) * 5 / greatest(n - 1, 1)::DOUBLE) AS INTEGER), 1) AS bucket FROM q WHERE n >= 5),
 qr AS (SELECT date, factor, fwd_window, bucket, avg(y) AS ret FROM qb GROUP BY 1, 2, 3, 4)"""


@query("quantile_returns", f"WITH {_BUCKET} SELECT date, factor, fwd_window, bucket, {sql.rounded('ret', 6, 'ret')} FROM qr")
def quantile_returns(spark, sf_dir):
    return evaluation.quantile_returns(two_factors(spark, sf_dir), FACTORS).withColumn("ret", rounded("ret", 6))


_QSUM = _BUCKET + """, ls AS (SELECT date, factor, fwd_window, 'long_short' AS bucket, max(ret) FILTER (bucket = 5) - max(ret) FILTER (bucket = 1) AS ret FROM qr GROUP BY 1, 2, 3),
 al AS (SELECT date, factor, fwd_window, 'q' || bucket AS bucket, ret FROM qr UNION ALL SELECT * FROM ls)"""


@query("quantile_summary", f"WITH {_QSUM} SELECT factor, fwd_window, bucket, {sql.rounded('avg(ret)', 6, 'mean')}, {sql.rounded('stddev_samp(ret)', 6, 'std')}, {sql.rounded('count(*) FILTER (ret > 0) * 1.0 / count(ret)', 6, 'hit')}, count(ret) AS n_dates FROM al GROUP BY 1, 2, 3")
def quantile_summary(spark, sf_dir):
    s = evaluation.quantile_summary(evaluation.quantile_returns(two_factors(spark, sf_dir), FACTORS))
    return s.select("factor", "fwd_window", "bucket", *[rounded(c, 6).alias(c) for c in ("mean", "std", "hit")], "n_dates")


@query("evaluate_factors", f"WITH {_QSUM}, r AS (SELECT *, {sql.prank('x', 'date, factor')} AS rx, {sql.prank('y', 'date, factor')} AS ry FROM l), ic AS (SELECT date, factor, fwd_window, {_corr_agg('rx', 'ry')} AS ic FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5), s AS (SELECT factor, fwd_window, avg(ret) AS m, stddev_samp(ret) AS sd FROM ls GROUP BY 1, 2) SELECT factor, fwd_window, {sql.rounded('avg(ic)', 6, 'ic_mean')}, {sql.rounded('avg(ic) / nullif(stddev_samp(ic), 0)', 6, 'ic_ir')}, {sql.rounded('any_value(m)', 6, 'ls_mean')}, {sql.rounded('any_value(m / nullif(sd, 0))', 6, 'ls_ir')} FROM ic JOIN s USING (factor, fwd_window) GROUP BY 1, 2")
def evaluate(spark, sf_dir):
    e = evaluation.evaluate_factors(two_factors(spark, sf_dir), FACTORS, (5,))
    return e.select("factor", "fwd_window", *[rounded(c, 6).alias(c) for c in ("ic_mean", "ic_ir", "ls_mean", "ls_ir")])


# layers

_LAYERS = """, e AS (SELECT *, quantile_cont(circ_mv, 1/3.0) OVER d AS c1, quantile_cont(circ_mv, 2/3.0) OVER d AS c2, quantile_cont(turnover_rate, 1/3.0) OVER d AS t1, quantile_cont(turnover_rate, 2/3.0) OVER d AS t2,
 min(circ_mv) OVER d AS c0, max(circ_mv) OVER d AS c3, min(turnover_rate) OVER d AS t0, max(turnover_rate) OVER d AS t3, """ + f"{sql.prank('circ_mv')} AS cp, {sql.prank('turnover_rate')} AS tp" + """ FROM f WINDOW d AS (PARTITION BY date)),
 ly AS (SELECT *, CASE WHEN c0 < c1 AND c1 < c2 AND c2 < c3 THEN CASE WHEN circ_mv <= c1 THEN 'small' WHEN circ_mv <= c2 THEN 'mid' ELSE 'large' END ELSE CASE WHEN cp <= 1/3.0 THEN 'small' WHEN cp <= 2/3.0 THEN 'mid' ELSE 'large' END END AS size_layer,
 CASE WHEN t0 < t1 AND t1 < t2 AND t2 < t3 THEN CASE WHEN turnover_rate <= t1 THEN 'low' WHEN turnover_rate <= t2 THEN 'mid' ELSE 'high' END ELSE CASE WHEN tp <= 1/3.0 THEN 'low' WHEN tp <= 2/3.0 THEN 'mid' ELSE 'high' END END AS liq_layer FROM e)"""


@query("size_liq_layers", f"WITH {sql.FIGURES}{_LAYERS} SELECT date, code, size_layer, liq_layer FROM ly")
def size_liq_layers(spark, sf_dir):
    f = panels.figures(panels.bars(spark, sf_dir), spark, sf_dir)
    return evaluation.size_liquidity_layers(f).select("date", "code", "size_layer", "liq_layer")


@query("ic_by_layer", f"WITH {sql.FIGURES}{_LAYERS}, a AS (SELECT date, code, size_layer || '_' || liq_layer AS layer, (close / nullif({sql.lag('close', 20)}, 0) - 1) * 100 AS x, lead(close, 5) OVER ({sql.BC}) / close - 1 AS y FROM ly), b AS (SELECT date, 'all' AS layer, code, x, y FROM a WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT date, layer, code, x, y FROM a WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT *, {sql.prank('x', 'date, layer')} AS rx, {sql.prank('y', 'date, layer')} AS ry FROM b), ic AS (SELECT date, layer, {_corr_agg('rx', 'ry')} AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 5) SELECT layer, {sql.rounded('avg(ic)', 6, 'mean_ic')}, {sql.rounded('CASE WHEN count(ic) >= 20 THEN avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) END', 6, 't_stat')}, count(ic) AS n_days FROM ic GROUP BY 1")
def ic_by_layer(spark, sf_dir):
    f = panels.figures(panels.bars(spark, sf_dir), spark, sf_dir)
    made = evaluation.size_liquidity_layers(evaluation.forward_returns(factors.with_factors(f, FACTORS[:1]), (5,)))
    return evaluation.ic_by_layer(made, FACTORS[:1]).select("layer", rounded("mean_ic", 6).alias("mean_ic"), rounded("t_stat", 6).alias("t_stat"), "n_days")


_CM = f"""{sql.P}, a AS (SELECT date, code, {sql.delta('close', 5)} AS calc_momentum_5d_change, {sql.ratio(sql.delta('close', 20), sql.lag('close', 20))} AS calc_momentum_20d_return, CASE WHEN count(*) {sql.frame(20)} = 20 THEN volume / avg(volume) {sql.frame(20)} END AS calc_volume_ratio FROM p),
 d AS (SELECT DISTINCT date FROM p ORDER BY date DESC LIMIT 60),
 l AS (SELECT date, code, unnest(['calc_momentum_20d_return', 'calc_momentum_20d_return', 'calc_momentum_5d_change']) AS factor_a, unnest(['calc_momentum_5d_change', 'calc_volume_ratio', 'calc_volume_ratio']) AS factor_b, unnest([calc_momentum_20d_return, calc_momentum_20d_return, calc_momentum_5d_change]) AS x, unnest([calc_momentum_5d_change, calc_volume_ratio, calc_volume_ratio]) AS y FROM a WHERE date IN (SELECT date FROM d)),
 m AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT *, {sql.prank('x', 'date, factor_a, factor_b')} AS rx, {sql.prank('y', 'date, factor_a, factor_b')} AS ry FROM m),
 c AS (SELECT date, factor_a, factor_b, {_corr_agg('rx', 'ry')} AS c FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


@query("corr_matrix", f"WITH {_CM} SELECT factor_a, factor_b, {sql.rounded('avg(c)', 6, 'corr')}, count(c) AS n_dates FROM c GROUP BY 1, 2")
def corr_matrix(spark, sf_dir):
    names = ["calc_momentum_20d_return", "calc_momentum_5d_change", "calc_volume_ratio"]
    return evaluation.corr_matrix(factors.with_factors(panels.bars(spark, sf_dir), names), names, min_obs=5).withColumn("corr", rounded("corr", 6))


@query("corr_matrix_median", f"""WITH {_CM}, z AS (SELECT date, factor_a, factor_b, {_corr_agg('x', 'y')} AS c FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT factor_a, factor_b, {sql.rounded('quantile_cont(c, 0.5)', 6, 'corr')}, count(c) AS n_dates FROM z GROUP BY 1, 2""")
def corr_matrix_median(spark, sf_dir):
    names = ["calc_momentum_20d_return", "calc_momentum_5d_change", "calc_volume_ratio"]
    return evaluation.corr_matrix(factors.with_factors(panels.bars(spark, sf_dir), names), names, agg="median", min_obs=5, method="pearson").withColumn("corr", rounded("corr", 6))


@query("demean_industry", f"WITH {sql.P}, {sql.INDUSTRY}, j AS (SELECT p.*, industry FROM p LEFT JOIN i USING (code)), a AS (SELECT *, count(close) OVER (PARTITION BY date, coalesce(industry, '__unknown__')) AS k FROM j), b AS (SELECT *, CASE WHEN k >= 3 THEN industry ELSE '__unknown__' END AS g FROM a) SELECT date, code, {sql.rounded('close - avg(close) OVER (PARTITION BY date, g)', 6, 'close')} FROM b")
def demean_industry(spark, sf_dir):
    made = evaluation.neutralize_factors(panels.bars(spark, sf_dir), panels.industries(spark, sf_dir), ["close"])
    return made.select("date", "code", rounded("close", 6).alias("close"))


@query("combine_scores", f"WITH {_FWD}, c AS (SELECT date, code, {sql.prank('mom')} AS a, 1 - {sql.prank('vr')} AS b FROM b) SELECT date, code, {sql.rounded('(coalesce(a * 1.0, 0) + coalesce(b * 0.5, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 1.0 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.5 END), 0)', 6, 'score')} FROM c")
def combine_scores(spark, sf_dir):
    made = evaluation.combine_factor_scores(two_factors(spark, sf_dir), {FACTORS[0]: 1.0, FACTORS[1]: -0.5})
    return made.select("date", "code", rounded("score", 6).alias("score"))


@query("ic_weights", f"WITH {_IC}, k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS rn FROM ic WHERE ic IS NOT NULL AND date <= DATE '2001-01-01'), m AS (SELECT factor, avg(ic) AS m FROM k WHERE rn <= 60 GROUP BY 1) SELECT factor, {sql.rounded('m / (SELECT sum(abs(m)) FROM m)', 6, 'weight')} FROM m")
def ic_weights(spark, sf_dir):
    import datetime

    w = evaluation.ic_weights(evaluation.ic(two_factors(spark, sf_dir), FACTORS), datetime.date(2001, 1, 1))
    return w.select("factor", rounded("weight", 6).alias("weight"))


_AUDIT = f"""{_FWD}, k AS (SELECT date, code, mom, {sql.prank('mom')} AS r FROM b), k1 AS (SELECT *, {sql.lag('r', 5)} AS lr FROM k),
 k2 AS (SELECT date, code, CASE WHEN count(*) {sql.frame(60)} = 60 THEN avg(CASE WHEN mom IS NULL THEN 0.0 ELSE 1.0 END) {sql.frame(60)} END AS cov, {sql.cor('r', 'lr', 60)} AS stab, stddev_samp(mom) OVER (PARTITION BY date) / nullif(avg(abs(mom)) OVER (PARTITION BY date), 0) AS disp, row_number() OVER (PARTITION BY date ORDER BY code) AS rn FROM k1)"""


@query("factor_audit", f"WITH {_AUDIT} SELECT {sql.rounded('avg(cov)', 6, 'coverage')}, {sql.rounded('quantile_cont(CASE WHEN stab IS NOT NULL THEN least(greatest(stab, -1), 1) END, 0.5)', 6, 'stability')}, {sql.rounded('quantile_cont(disp, 0.5) FILTER (rn = 1)', 6, 'dispersion')}, coalesce(avg(cov) >= 0.8 AND quantile_cont(stab, 0.5) >= 0.3 AND quantile_cont(disp, 0.5) FILTER (rn = 1) >= 0.1, false) AS active FROM k2")
def factor_audit(spark, sf_dir):
    a = evaluation.audit_factors(two_factors(spark, sf_dir), FACTORS[:1])
    return a.select(*[rounded(c, 6).alias(c) for c in ("coverage", "stability", "dispersion")], "active")


@query("select_tradable", f"WITH {_AUDIT}, z AS (SELECT date, code, CASE WHEN cov >= 0.5 AND stab >= -0.1 AND disp >= 0.1 THEN 1 ELSE 0 END AS pass_count FROM k2), y AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pass_count DESC, code) AS rank FROM z WHERE pass_count >= 1) SELECT date, code, pass_count, rank FROM y WHERE n >= 5 AND rank <= 10")
def select_tradable(spark, sf_dir):
    return evaluation.select_tradable(two_factors(spark, sf_dir), FACTORS[:1], top_n=10, min_coverage=0.5, min_stability=-0.1)


@query("industry_momentum", f"WITH {sql.P}, {sql.INDUSTRY}, a AS (SELECT p.*, industry, close / {sql.lag('close', 1)} - 1 AS ret FROM p JOIN i USING (code)), b AS (SELECT *, {sql.roll('avg', 'ret', 20)} AS m FROM a) SELECT date, industry, {sql.rounded('avg(m)', 6, 'momentum')} FROM b GROUP BY 1, 2")
def industry_momentum(spark, sf_dir):
    made = panels.bars(spark, sf_dir).join(panels.industries(spark, sf_dir), "code")
    return evaluation.industry_momentum(made).select("date", "industry", rounded("momentum", 6).alias("momentum"))


# cleaning

_LIMITS = f"{sql.P}, a AS (SELECT *, {sql.lag('close', 1)} AS b FROM p), lim AS (SELECT *, coalesce(b IS NOT NULL AND close >= round_even(b * (1 + {sql.LIMIT}) * 100, 0) / 100 - 0.001, false) AS limit_up, coalesce(b IS NOT NULL AND close <= round_even(b * (1 - {sql.LIMIT}) * 100, 0) / 100 + 0.001, false) AS limit_down FROM a)"


@query("limit_price", f"WITH {_LIMITS} SELECT date, code, limit_up, limit_down FROM lim")
def limit_price(spark, sf_dir):
    return cleaning.detect_limit_price(panels.bars(spark, sf_dir)).select("date", "code", "limit_up", "limit_down")


_GRID = f"{_LIMITS}, s AS (SELECT code, min(date) AS f FROM lim GROUP BY 1), c AS (SELECT DISTINCT date FROM lim), g AS (SELECT c.date, s.code FROM s, c WHERE c.date >= s.f), sus AS (SELECT g.date, g.code, close, coalesce(volume, 0) AS volume, coalesce(volume = 0, true) AS is_suspended FROM g LEFT JOIN lim USING (date, code))"


@query("suspension_grid", f"WITH {_GRID} SELECT date, code, {sql.rounded('close', 6, 'close')}, volume, is_suspended FROM sus")
def suspension_grid(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return cleaning.detect_suspension(p, panels.calendar(p)).select("date", "code", rounded("close", 6).alias("close"), "volume", "is_suspended")


@query("clean_market", f"WITH {_GRID}, b AS (SELECT *, lag(close) OVER ({sql.BC}) AS pc FROM sus) SELECT date, code, volume, is_suspended, coalesce(close >= round_even(pc * (1 + {sql.LIMIT}) * 100, 0) / 100 - 0.001, false) AS limit_up, coalesce(close <= round_even(pc * (1 - {sql.LIMIT}) * 100, 0) / 100 + 0.001, false) AS limit_down FROM b")
def clean_market(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return cleaning.clean_market_data(p, panels.calendar(p)).select("date", "code", "volume", "is_suspended", "limit_up", "limit_down")


@query("universe_filter", f"WITH {sql.P}, k AS (SELECT code FROM p GROUP BY 1 HAVING avg(volume) >= 50 AND avg(volume * close) >= 80000) SELECT date, code, {sql.rounded('close', 6, 'close')} FROM p WHERE code IN (SELECT code FROM k)")
def universe_filter(spark, sf_dir):
    return cleaning.apply_data_filters(panels.bars(spark, sf_dir), 50, 80000).select("date", "code", rounded("close", 6).alias("close"))


@query("fundamental_filter", f"WITH {sql.FIGURES}, k AS (SELECT DISTINCT code FROM f WHERE total_mv >= 20 AND pe >= 1 AND pe <= 200) SELECT date, code, volume FROM p WHERE code IN (SELECT code FROM k)")
def fundamental_filter(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return cleaning.apply_fundamental_filters(p, panels.figures(p, spark, sf_dir), 20, 1, 200).select("date", "code", "volume")
