"""Queries over strategies, portfolio, backtests, pairs, announcements and the life cycle."""
from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import announcements, backtest, cleaning, evaluation, factors, lifecycle, pairs, portfolio, strategies
from ..sources import dated, io, panels
from . import oracle_engine as eng
from . import oracle_sql as sql
from .catalogue import full_panel, query, rounded
from .queries_evaluation import _FWD, _IC, _LAYERS, _ROLLED, FACTORS, two_factors


def _signals(df):
    return df.select("date", "code", F.col("signal").cast("int").alias("signal"), rounded("confidence", 6).alias("confidence"))


# strategies by rank


def hold_sql(scored: str, rebalance: int, top: int, bottom: int, least: int, ascending: bool = False, drop: bool = False, exited: bool = False, min_rows: int = 2) -> str:
    """CTEs from ``scored`` (date, code, score) to ``sig`` (date, code, signal, confidence)."""
    way = "score ASC NULLS LAST" if ascending else "score DESC NULLS LAST"
    worth = "1 - score" if ascending else "score"
    gone = "AND st AND held AND coalesce(s, 0) <> 1" if exited else "AND false"
    return f"""dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {scored})),
 dp AS (SELECT date, CASE WHEN i >= {least} THEN (i - {least}) // {rebalance} END AS period, i >= {least} AND (i - {least}) % {rebalance} = 0 AS st FROM dt),
 rk AS (SELECT period, code, score, row_number() OVER (PARTITION BY period ORDER BY {way}, code) AS rn, count(*) OVER (PARTITION BY period) AS n FROM {scored} JOIN dp USING (date) WHERE st {'AND score IS NOT NULL' if drop else ''}),
 pk AS (SELECT period, code, CASE WHEN rn <= {top} THEN 1 ELSE -1 END AS s, CASE WHEN rn <= {top} THEN coalesce({worth}, 0.5) ELSE 0.5 END AS c FROM rk WHERE n >= {min_rows} AND (rn <= {top} OR rn > n - {bottom})),
 hd AS (SELECT period + 1 AS period, code, true AS held FROM pk WHERE s = 1),
 mg AS (SELECT a.date, a.code, s, c, coalesce(held, false) AS held, st FROM {scored} a JOIN dp USING (date) LEFT JOIN pk ON pk.period = dp.period AND pk.code = a.code LEFT JOIN hd ON hd.period = dp.period AND hd.code = a.code),
 sig AS (SELECT date, code, CASE WHEN true {gone} THEN -1 ELSE coalesce(s, 0) END AS signal, CASE WHEN true {gone} THEN 0.5 ELSE coalesce(c, 0.0) END AS confidence FROM mg)"""


_SIG = f"SELECT date, code, signal, {sql.rounded('confidence', 6, 'confidence')} FROM sig"


def _factor_ctes(names: list[str]) -> tuple[str, str]:
    """CTEs that compute several factors side by side: (text, name of the last)."""
    sources = {sql.FACTORS[n][3] if len(sql.FACTORS[n]) > 3 else "p" for n in names}
    base = "f" if "f" in sources else "p"
    out = [sql.FIGURES if base == "f" else sql.P]
    ends = []
    for k, n in enumerate(names):
        stages, final, *_ = sql.FACTORS[n]
        last = base
        for j, cols in enumerate([{"t": f"row_number() OVER ({sql.BC}) - 1"}, *stages]):
            out.append(f"x{k}_{j} AS (SELECT *, {', '.join(f'{v} AS {c}' for c, v in cols.items())} FROM {last})")
            last = f"x{k}_{j}"
        out.append(f"v{k} AS (SELECT date, code, {final} AS v{k} FROM {last})")
        ends.append(f"v{k}")
    joined = ends[0] + "".join(f" JOIN {e} USING (date, code)" for e in ends[1:])
    out.append(f"fx AS (SELECT * FROM {joined})")
    return ", ".join(out), "fx"


def _score_sql(names: list[str], weights: list[float]) -> str:
    ctes, last = _factor_ctes(names)
    ranks = " + ".join(f"{sql.prank(f'v{k}')} * {w}" for k, w in enumerate(weights))
    return f"{ctes}, sc AS (SELECT date, code, round(({ranks}) / {sum(weights)}, 12) AS score FROM {last})"


def _ranked_query(name: str, names, least: int, ascending: bool, weights=None, rebalance=20, top=5, bottom=3):
    oracle = f"WITH {_score_sql(list(names), weights or [1.0] * len(names))}, {hold_sql('sc', rebalance, top, bottom, least, ascending)} {_SIG}"

    @query(f"rank_hold_{name}", oracle)
    def run(spark, sf_dir):
        return _signals(strategies.get_strategy(name)(full_panel(spark, sf_dir)))


for _name, (_names, _least, _asc) in strategies.RANKED.items():
    if _name != "gtja_momentum":
        _ranked_query(_name, _names, _least, _asc)
_ranked_query("fundamental_diversified", ("calc_earnings_surprise", "calc_amihud", "calc_roe_stability"), 21, False, [1.0, 0.8, 0.6], 15, 10, 5)
_MOM_SCORE = _score_sql(list(strategies.RANKED["gtja_momentum"][0]), [1.0] * 5)
_MOM = f"{_MOM_SCORE}, {hold_sql('sc', 20, 5, 3, 21)}"


@query("rank_hold_gtja_momentum", f"WITH {_MOM} {_SIG}")
def rank_hold_gtja_momentum(spark, sf_dir):
    return _signals(momentum_signals(spark, sf_dir))


def momentum_signals(spark, sf_dir):
    return strategies.get_strategy("gtja_momentum")(panels.bars(spark, sf_dir))


@query("rank_hold_reversed_gtja_vwap", f"WITH {_score_sql(['calc_vwap_close_ratio', 'calc_vwap_deviation'], [1.0, 1.0])}, {hold_sql('sc', 20, 5, 3, 21)} SELECT date, code, -signal AS signal, {sql.rounded('confidence', 6, 'confidence')} FROM sig")
def reversed_vwap(spark, sf_dir):
    return _signals(strategies.get_strategy("reversed_gtja_vwap")(panels.bars(spark, sf_dir)))


_MF = f"{_factor_ctes(['calc_rsi', 'calc_hv', 'calc_volume_ratio'])[0]}, mo AS (SELECT date, code, {sql.ratio(sql.delta('close', 20), sql.lag('close', 20))} AS m FROM p), al AS (SELECT * FROM fx JOIN mo USING (date, code)), al2 AS (SELECT date, code, m, (100 - v0) / 100 AS r, -v1 AS h, v2 AS q FROM al), sc AS (SELECT date, code, round(({sql.prank('m')} + {sql.prank('r')} + {sql.prank('h')} + {sql.prank('q')} * 0.5) / 3.5, 12) AS score FROM al2)"


@query("rank_hold_multifactor", f"WITH {_MF}, {hold_sql('sc', 20, 5, 3, 21, exited=True)} {_SIG}")
def multifactor(spark, sf_dir):
    return _signals(strategies.get_strategy("multifactor")(panels.bars(spark, sf_dir)))


@query("scores_to_signals", f"WITH {_factor_ctes(FACTORS)[0]}, cs AS (SELECT date, code, {sql.prank('v0')} AS a, 1 - {sql.prank('v1')} AS b FROM fx), sc AS (SELECT date, code, (coalesce(a, 0) + coalesce(b * 0.5, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 1.0 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.5 END), 0) AS score0 FROM cs), sd AS (SELECT date, code, round(score0, 9) AS score FROM sc), {hold_sql('sd', 10, 6, 4, 0, drop=True, exited=True, min_rows=0)} {_SIG}")
def scores_to_signals(spark, sf_dir):
    made = evaluation.combine_factor_scores(two_factors(spark, sf_dir), {FACTORS[0]: 1.0, FACTORS[1]: -0.5}).withColumn("score", F.round("score", 9))
    return _signals(strategies.scores_to_signals(made, "score", 10, 6, 4))


# threshold strategies


def _threshold_query(name: str, ctes: str, buy: str, sell: str, confidence: str, valid: str = "true"):
    oracle = f"WITH {ctes}, sig AS (SELECT date, code, CASE WHEN {valid} AND {sell} THEN -1 WHEN {valid} AND {buy} THEN 1 ELSE 0 END AS signal, CASE WHEN {valid} AND ({confidence}) IS NOT NULL THEN least({confidence}, 1.0) ELSE 0.0 END AS confidence FROM last) {_SIG}"

    @query(f"strategy_{name}", oracle)
    def run(spark, sf_dir):
        return _signals(strategies.get_strategy(name)(panels.bars(spark, sf_dir)))


_threshold_query("mean_reversion", f"{sql.P}, last AS (SELECT date, code, close, {sql.roll('avg', 'close', 20)} AS m, {sql.roll('stddev_samp', 'close', 20)} AS s FROM p)", "close - m < -2.0 * s", "close - m > 2.0 * s", "abs((close - m) / nullif(2.0 * s, 0))", "m IS NOT NULL")
_threshold_query("rsi_reversal", f"{_factor_ctes(['calc_rsi'])[0]}, last AS (SELECT * FROM fx)", "v0 < 30", "v0 > 70", "abs(v0 - 50) / 50")
_OBV = f"{_factor_ctes(['calc_volume_ratio', 'calc_obv'])[0]}, last AS (SELECT fx.date, fx.code, close, v0, coalesce(avg(v1) OVER ({sql.BC} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) > v1, false) AS up, {sql.roll('avg', 'close', 60)} AS ma FROM fx JOIN p USING (date, code))"
_threshold_query("momentum_breakout", _OBV, "v0 > 1.5 AND NOT up", "v0 > 1.5 AND up", "v0 / 1.5")
_threshold_query("momentum_trend", _OBV, "v0 > 1.5 AND up AND close > ma", "v0 > 1.5 AND NOT up AND close < ma", "v0 / 1.5", "ma IS NOT NULL")

# combinators

_VOL_SCORE = _score_sql(list(strategies.RANKED["gtja_volatility"][0]), [1.0] * 3)


def _two_signals() -> str:
    """CTEs m (momentum signals) and r (Bollinger signals)."""
    return f"m AS (WITH {_MOM} SELECT * FROM sig), r AS (WITH {sql.P}, last AS (SELECT date, code, close, {sql.roll('avg', 'close', 20)} AS m, {sql.roll('stddev_samp', 'close', 20)} AS s FROM p) SELECT date, code, CASE WHEN m IS NOT NULL AND close - m > 2.0 * s THEN -1 WHEN m IS NOT NULL AND close - m < -2.0 * s THEN 1 ELSE 0 END AS signal, CASE WHEN m IS NOT NULL AND abs((close - m) / nullif(2.0 * s, 0)) IS NOT NULL THEN least(abs((close - m) / nullif(2.0 * s, 0)), 1.0) ELSE 0.0 END AS confidence FROM last)"


def _pair_of_signals(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return strategies.get_strategy("gtja_momentum")(p), strategies.get_strategy("mean_reversion")(p)


@query("weighted_vote", f"WITH {_two_signals()}, v AS (SELECT date, code, (m.signal * 0.6 + r.signal * 0.4) / 1.0 AS v, (m.confidence * 0.6 + r.confidence * 0.4) / 1.0 AS c FROM m JOIN r USING (date, code)) SELECT date, code, CASE WHEN v > 0.3 THEN 1 WHEN v < -0.3 THEN -1 ELSE 0 END AS signal, {sql.rounded('c', 6, 'confidence')} FROM v")
def weighted_vote(spark, sf_dir):
    return _signals(strategies.weighted_vote(list(_pair_of_signals(spark, sf_dir)), [0.6, 0.4], 0.3))


@query("filter_combine", f"WITH {_two_signals()} SELECT date, code, CASE WHEN r.signal <> 0 THEN m.signal ELSE 0 END AS signal, {sql.rounded('CASE WHEN r.signal <> 0 THEN m.confidence ELSE 0 END', 6, 'confidence')} FROM m JOIN r USING (date, code)")
def filter_combine(spark, sf_dir):
    m, r = _pair_of_signals(spark, sf_dir)
    return _signals(strategies.filter_combine(m, [r]))


@query("reversed", f"WITH {_MOM} SELECT date, code, -signal AS signal, {sql.rounded('confidence', 6, 'confidence')} FROM sig")
def reversed_(spark, sf_dir):
    return _signals(strategies.reverse(momentum_signals(spark, sf_dir)))


def _ranked_signals(name: str) -> str:
    names, least, ascending = strategies.RANKED[name]
    return f"(WITH {_score_sql(list(names), [1.0] * len(names))}, {hold_sql('sc', 20, 5, 3, least, ascending)} SELECT * FROM sig)"


@query("multi_category", f"WITH a AS {_ranked_signals('gtja_momentum')}, b AS {_ranked_signals('gtja_volatility')}, c AS {_ranked_signals('gtja_trend')}, v AS (SELECT date, code, (a.signal + b.signal + c.signal) / 3.0 AS v, (a.confidence + b.confidence + c.confidence) / 3.0 AS c FROM a JOIN b USING (date, code) JOIN c USING (date, code)) SELECT date, code, CASE WHEN v > 0.3 THEN 1 WHEN v < -0.3 THEN -1 ELSE 0 END AS signal, {sql.rounded('c', 6, 'confidence')} FROM v")
def multi_category(spark, sf_dir):
    return _signals(strategies.get_strategy("multi_category")(kept_bars(spark, sf_dir)))


# regimes

_IDX = f"ix AS (SELECT date, sum(close * volume) / sum(volume) AS close FROM p GROUP BY 1)"


def index_of(panel):
    return panel.groupBy("date").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("close"))


@query("market_regime", f"WITH {sql.P}, {_IDX}, a AS (SELECT date, close, CASE WHEN count(*) OVER s = 50 THEN avg(close) OVER s END AS s, CASE WHEN count(*) OVER l = 200 THEN avg(close) OVER l END AS l FROM ix WINDOW s AS (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), l AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) SELECT date, CASE WHEN l IS NULL THEN 0.6 WHEN close > l AND s > l THEN 1.0 WHEN close > l THEN 0.6 WHEN s > l THEN 0.4 ELSE 0.2 END::DOUBLE AS exposure FROM a")
def market_regime(spark, sf_dir):
    return strategies.market_exposure(index_of(panels.bars(spark, sf_dir))).select("date", F.col("exposure").cast("double").alias("exposure"))


@query("regime_inputs", f"WITH {sql.P}, a AS (SELECT *, {sql.roll('avg', 'close', 20)} AS m, close / {sql.lag('close', 20)} - 1 AS r20, close / {sql.lag('close', 1)} - 1 AS r1 FROM p) SELECT date, {sql.rounded('avg(CASE WHEN close > m THEN 1.0 ELSE 0.0 END) - 0.5', 6, 'breadth')}, {sql.rounded('quantile_cont(r20, 0.5)', 6, 'median_return')}, {sql.rounded('stddev_samp(r1)', 6, 'realized_vol')} FROM a GROUP BY 1")
def regime_inputs(spark, sf_dir):
    r = strategies.regime_inputs(panels.bars(spark, sf_dir))
    return r.select("date", *[rounded(c, 6).alias(c) for c in ("breadth", "median_return", "realized_vol")])


def _ewm5(x: str) -> str:
    """Exponential mean of span 5 over the days, missing values keeping their place."""
    f = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"sum({x} * pow(1.5, t)) {f} / sum(CASE WHEN {x} IS NOT NULL THEN pow(1.5, t) END) {f}"


def regime_sql(index: bool) -> str:
    """CTEs from p to ``rg`` (date, regime): labels by smoothed breadth, median return and volatility, runs under seven days merged."""
    w60 = "OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    held = f"""{_IDX}, ia AS (SELECT date, close > s AND s > l AS bull, close < s AND s < l AS bear FROM (SELECT date, close, CASE WHEN count(*) OVER a = 50 THEN avg(close) OVER a END AS s, CASE WHEN count(*) OVER b = 200 THEN avg(close) OVER b END AS l FROM ix WINDOW a AS (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)))""" if index else "ia AS (SELECT date, false AS bull, false AS bear FROM p GROUP BY 1)"
    return f"""g0 AS (SELECT *, {sql.roll('avg', 'close', 20)} AS m, close / {sql.lag('close', 20)} - 1 AS r20, close / {sql.lag('close', 1)} - 1 AS r1 FROM p),
 g1 AS (SELECT date, avg(CASE WHEN close > m THEN 1.0 ELSE 0.0 END) - 0.5 AS b, quantile_cont(r20, 0.5) AS m, stddev_samp(r1) AS v, row_number() OVER (ORDER BY date) - 1 AS t FROM g0 GROUP BY 1),
 g2 AS (SELECT date, t, {_ewm5('b')} AS b, {_ewm5('m')} AS m, {_ewm5('v')} AS v FROM g1),
 g3 AS (SELECT *, coalesce(CASE WHEN count(v) {w60} >= 20 THEN quantile_cont(v, 0.75) {w60} END, (SELECT quantile_cont(v, 0.75) FROM g2)) AS hi, coalesce(CASE WHEN count(v) {w60} >= 20 THEN quantile_cont(v, 0.25) {w60} END, (SELECT quantile_cont(v, 0.25) FROM g2)) AS lo FROM g2),
 g4 AS (SELECT *, coalesce(v > hi, false) AS hot, coalesce(v < lo, false) AS cold, coalesce(b > 0, false) OR coalesce(m > 0, false) AS up, coalesce(b < 0, false) OR coalesce(m < 0, false) AS down FROM g3),
 g5 AS (SELECT date, t, CASE WHEN NOT hot AND NOT cold AND abs(b) > 0.15 AND down THEN 'trend_down' WHEN NOT hot AND NOT cold AND abs(b) > 0.15 AND up THEN 'trend_up' WHEN hot AND NOT abs(b) > 0.2 THEN 'volatile' WHEN hot AND down THEN 'trend_down' WHEN hot AND up THEN 'trend_up' ELSE 'range' END AS label FROM g4),
 {held}, g6 AS (SELECT g5.date, t, CASE WHEN (label = 'trend_up' AND coalesce(bear, false)) OR (label = 'trend_down' AND coalesce(bull, false)) THEN 'range' ELSE label END AS label FROM g5 LEFT JOIN ia USING (date)),
 g7 AS (SELECT *, count(*) FILTER (n) OVER (ORDER BY t) AS k FROM (SELECT *, label IS DISTINCT FROM lag(label) OVER (ORDER BY t) AS n FROM g6)),
 g8 AS MATERIALIZED (SELECT k, any_value(label) AS label, count(*) AS n FROM g7 GROUP BY 1),
 g9 AS (SELECT k, label AS name, n AS size, 1 AS o FROM g8 WHERE k = 1 UNION ALL SELECT g8.k, CASE WHEN size < 7 AND name <> label THEN label WHEN g8.n < 7 THEN name ELSE label END, CASE WHEN (size < 7 AND name <> label) OR g8.n < 7 THEN size + g8.n ELSE g8.n END, CASE WHEN (size < 7 AND name <> label) OR g8.n < 7 THEN o ELSE o + 1 END FROM g9 JOIN g8 ON g8.k = g9.k + 1),
 rg AS (SELECT date, last_value(name) OVER (PARTITION BY o ORDER BY g9.k, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS regime, t FROM g7 JOIN g9 USING (k))"""


@query("detect_regime", f"WITH RECURSIVE {sql.P}, {regime_sql(True)} SELECT date, regime FROM rg")
def detect_regime(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return strategies.detect_regime(p, index=index_of(p))


#: Changes of label take effect ten days later, if the new one has stayed.
_SURE = """cf AS (SELECT t, regime AS sure, NULL::VARCHAR AS pending, 0::BIGINT AS since FROM rg WHERE t = 0
 UNION ALL SELECT rg.t, CASE WHEN regime = pending AND rg.t - since >= 10 THEN pending ELSE sure END, CASE WHEN regime = pending THEN CASE WHEN rg.t - since >= 10 THEN NULL ELSE pending END WHEN pending IS NOT NULL OR regime <> sure THEN regime END, CASE WHEN regime = pending THEN since WHEN pending IS NOT NULL OR regime <> sure THEN rg.t ELSE since END FROM cf JOIN rg ON rg.t = cf.t + 1),
 sr AS (SELECT date, sure FROM cf JOIN rg USING (t))"""
_RSI_SIG = f"""rs AS (WITH {_factor_ctes(['calc_rsi'])[0]} SELECT date, code, CASE WHEN v0 > 70 THEN -1 WHEN v0 < 30 THEN 1 ELSE 0 END AS signal, CASE WHEN v0 IS NOT NULL THEN least(abs(v0 - 50) / 50, 1.0) ELSE 0.0 END AS confidence FROM fx)"""


@query("regime_switch", f"WITH RECURSIVE {sql.P}, {regime_sql(False)}, {_SURE}, {_two_signals()}, {_RSI_SIG}, u AS (SELECT 'trend_up' AS sure, * FROM m UNION ALL SELECT 'range', * FROM r UNION ALL SELECT 'volatile', * FROM rs) SELECT p.date, p.code, coalesce(signal, 0) AS signal, {sql.rounded('coalesce(confidence, 0)', 6, 'confidence')} FROM p JOIN sr USING (date) LEFT JOIN u ON u.sure = sr.sure AND u.date = p.date AND u.code = p.code")
def regime_switch(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return _signals(strategies.regime_switch(p, strategies.detect_regime(p), {"trend_up": "gtja_momentum", "range": "mean_reversion", "volatile": "rsi_reversal"}))


def _regime_audit() -> str:
    """CTE rc: coverage, stability and dispersion of both factors, on the rows of each regime alone."""
    by = "PARTITION BY factor, regime, code"
    f20 = f"OVER ({by} ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    stab = sql.cor("r", "lr", 20).replace("PARTITION BY code", by)
    return f"""{_FWD}, {regime_sql(False)}, ra AS (SELECT regime, date, code, unnest(['{FACTORS[0]}', '{FACTORS[1]}']) AS factor, unnest([mom, vr]) AS x FROM b JOIN rg USING (date)), rk AS (SELECT *, {sql.prank('x', 'date, factor')} AS r FROM ra), rl AS (SELECT *, lag(r, 5) OVER ({by} ORDER BY date) AS lr FROM rk),
 rc AS (SELECT factor, regime, CASE WHEN count(*) {f20} = 20 THEN avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) {f20} END AS cov, CASE WHEN {stab} IS NOT NULL THEN least(greatest({stab}, -1), 1) END AS stab, stddev_samp(x) OVER (PARTITION BY factor, date) / nullif(avg(abs(x)) OVER (PARTITION BY factor, date), 0) AS disp, row_number() OVER (PARTITION BY factor, date ORDER BY code) AS rn FROM rl)"""


_MEDIANS = {"coverage": "avg(cov)", "stability": "quantile_cont(stab, 0.5)", "dispersion": "quantile_cont(disp, 0.5) FILTER (rn = 1)"}


@query("audit_by_regime", f"WITH RECURSIVE {_regime_audit()} SELECT factor, regime, {', '.join(sql.rounded(x, 6, n) for n, x in _MEDIANS.items())}, coalesce(avg(cov) >= 0.8 AND {_MEDIANS['stability']} >= 0.3 AND {_MEDIANS['dispersion']} >= 0.1, false) AS active FROM rc GROUP BY 1, 2")
def audit_by_regime(spark, sf_dir):
    p = kept_bars(spark, sf_dir)
    made = evaluation.audit_factors_by_regime(factors.with_factors(p, FACTORS), FACTORS, strategies.detect_regime(p), lookback=20)
    return made.select("factor", "regime", *[rounded(c, 6).alias(c) for c in _MEDIANS], "active")


# allocation and risk

_EW = f"{_MOM}, eb AS (SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM sig WHERE signal = 1), ew AS (SELECT date, code, weight, CAST(floor(1000000.0 * weight / close / 100) * 100 AS BIGINT) AS shares FROM eb JOIN p USING (date, code))"


def momentum_positions(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return portfolio.equal_weight(strategies.get_strategy("gtja_momentum")(p), p)


def _positions(df):
    return df.select("date", "code", rounded("weight", 6).alias("weight"), F.col("shares").cast("long").alias("shares"))


@query("equal_weight", f"WITH {_EW} SELECT date, code, {sql.rounded('weight', 6, 'weight')}, shares FROM ew")
def equal_weight(spark, sf_dir):
    return _positions(momentum_positions(spark, sf_dir))


@query("tradable_filter", f"WITH {_MOM}, a AS (SELECT date, code, close, {sql.lag('close', 1)} AS b FROM p), lm AS (SELECT date, code, coalesce(close >= round_even(b * (1 + {sql.LIMIT}) * 100, 0) / 100 - 0.001, false) AS u, coalesce(close <= round_even(b * (1 - {sql.LIMIT}) * 100, 0) / 100 + 0.001, false) AS d FROM a) SELECT date, code, CASE WHEN (signal = 1 AND u) OR (signal = -1 AND d) THEN 0 ELSE signal END AS signal, {sql.rounded('CASE WHEN (signal = 1 AND u) OR (signal = -1 AND d) THEN 0 ELSE confidence END', 6, 'confidence')} FROM sig JOIN lm USING (date, code)")
def tradable_filter(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return _signals(cleaning.filter_tradable(cleaning.detect_limit_price(p), strategies.get_strategy("gtja_momentum")(p)))


@query("t1_filter", f"WITH {_two_signals()}, u AS (SELECT * FROM m UNION ALL SELECT * FROM r), k AS (SELECT *, count(*) OVER (PARTITION BY date, code) > 1 AND signal <> 1 AS x FROM u) SELECT date, code, CASE WHEN x THEN 0 ELSE signal END AS signal, {sql.rounded('CASE WHEN x THEN 0 ELSE confidence END', 6, 'confidence')} FROM k")
def t1_filter(spark, sf_dir):
    m, r = _pair_of_signals(spark, sf_dir)
    return _signals(cleaning.enforce_t1(m.unionByName(r)))


def cap_sql(base: str) -> str:
    """CTEs from base (date, code, weight, shares) to c3 with the capped weight w2."""
    return f"""c0 AS (SELECT {base}.*, coalesce(industry, 'other') AS g FROM {base} LEFT JOIN i USING (code)), c1 AS (SELECT *, sum(weight) OVER (PARTITION BY date, g) AS t FROM c0), ct AS (SELECT date, g, any_value(t) AS t FROM c1 GROUP BY 1, 2),
 cd AS (SELECT date, sum(CASE WHEN t > 0.3 + 1e-10 THEN t - 0.3 ELSE 0 END) AS x, sum(CASE WHEN t > 0.3 + 1e-10 THEN 0 ELSE t END) AS u, bool_or(t > 0.3 + 1e-10) AS o, bool_or(NOT (t > 0.3 + 1e-10)) AS n FROM ct GROUP BY 1),
 c2 AS (SELECT c1.*, o, n, CASE WHEN t > 0.3 + 1e-10 THEN weight * 0.3 / t WHEN u > 0 THEN weight + x * weight / u ELSE weight END AS w FROM c1 JOIN cd USING (date)), c3 AS (SELECT *, CASE WHEN NOT o THEN weight WHEN n THEN w / sum(w) OVER (PARTITION BY date) ELSE w END AS w2 FROM c2)"""


_CAP = f"{_EW}, {sql.INDUSTRY}, {cap_sql('ew')}"
_CAPPED = f"SELECT date, code, {sql.rounded('w2', 6, 'weight')}, CAST(floor((shares * w2 / weight + 1e-9) / 100) * 100 AS BIGINT) AS shares FROM c3"
_TILT = f"""{_EW}, {sql.INDUSTRY}, a1 AS (SELECT p.*, industry, close / {sql.lag('close', 1)} - 1 AS ret FROM p JOIN i USING (code)), a2 AS (SELECT *, {sql.roll('avg', 'ret', 20)} AS m FROM a1), mo AS (SELECT date, industry, avg(m) AS m FROM a2 GROUP BY 1, 2), mr AS (SELECT date, industry, {sql.prank('m')} AS r FROM mo),
 t0 AS (SELECT ew.*, mr.r, weight * coalesce(1 + 0.5 * (mr.r - 0.5) * 2, 1) AS nw FROM ew LEFT JOIN i USING (code) LEFT JOIN mr ON mr.date = ew.date AND mr.industry = i.industry), t1 AS (SELECT date, code, weight, shares, CASE WHEN count(r) OVER (PARTITION BY date) > 0 THEN nw / sum(nw) OVER (PARTITION BY date) ELSE weight END AS w1 FROM t0),
 tw AS (SELECT date, code, w1 AS weight, floor((shares * w1 / weight + 1e-9) / 100) * 100 AS shares FROM t1), {cap_sql('tw')}"""


@query("industry_cap", f"WITH {_CAP} {_CAPPED}")
def industry_cap(spark, sf_dir):
    return _positions(portfolio.apply_industry_cap(momentum_positions(spark, sf_dir), panels.industries(spark, sf_dir)))


@query("industry_tilt", f"WITH {_TILT} {_CAPPED}")
def industry_tilt(spark, sf_dir):
    ind = panels.industries(spark, sf_dir)
    m = evaluation.industry_momentum(panels.bars(spark, sf_dir).join(ind, "code"))
    return _positions(portfolio.apply_industry_tilt(momentum_positions(spark, sf_dir), ind, m))


def uneven_positions(spark, sf_dir):
    """Weights by rank of code: 1 to 5 parts of 15."""
    parts = F.row_number().over(Window.partitionBy("date").orderBy("code"))
    p = momentum_positions(spark, sf_dir).withColumn("k", parts)
    return p.select("date", "code", (F.col("k") / F.sum("k").over(Window.partitionBy("date"))).alias("weight"), "shares")


_UNEVEN = f"{_EW}, ue AS (SELECT 'all' AS run_id, date, code, k / sum(k) OVER (PARTITION BY date) AS weight, shares FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY code) AS k FROM ew))"


@query("position_limit", f"WITH RECURSIVE {_UNEVEN}, {eng.limited('ue', 0.25)} SELECT date, code, {sql.rounded('weight', 6, 'weight')}, shares FROM lim")
def position_limit(spark, sf_dir):
    return _positions(portfolio.apply_position_limit(uneven_positions(spark, sf_dir), 0.25))


@query("smooth_positions", f"WITH RECURSIVE {_UNEVEN}, {eng.smoothed('ue', 0.05)} SELECT date, code, {sql.rounded('weight', 6, 'weight')}, shares FROM smo")
def smooth_positions(spark, sf_dir):
    return _positions(portfolio.smooth_positions(uneven_positions(spark, sf_dir), panels.bars(spark, sf_dir), dead_zone=0.05))


@query("smooth_with_exposure", f"WITH RECURSIVE {_UNEVEN}, {eng.smoothed('ue', 0.05)} SELECT date, smo.code, {sql.rounded('weight', 6, 'weight')}, coalesce(floor(1000000.0 * CASE WHEN month(date) % 2 = 0 THEN 0.5 ELSE 1.0 END * weight / so.close / 100) * 100, 0)::BIGINT AS shares FROM smo JOIN so USING (run_id, date, code, weight)")
def smooth_with_exposure(spark, sf_dir):
    """Half the capital in even months; other days are fully invested."""
    p = panels.bars(spark, sf_dir)
    exposure = p.select("date").distinct().filter(F.month("date") % 2 == 0).select("date", F.lit(0.5).alias("exposure"))
    return _positions(portfolio.smooth_positions(uneven_positions(spark, sf_dir), p, dead_zone=0.05, exposure=exposure))


@query("risk_rules", f"WITH RECURSIVE {_EW}, ue AS (SELECT 'all' AS run_id, * FROM ew), {eng.limited('ue', 0.1)} SELECT date, code, {sql.rounded('weight', 6, 'weight')}, shares FROM lim")
def risk_rules(spark, sf_dir):
    p = cleaning.detect_limit_price(panels.bars(spark, sf_dir))
    rules = [portfolio.get_risk_rule(n)() for n in portfolio.list_risk_rules()]
    done = portfolio.run_rules(rules, portfolio.RuleContext(strategies.get_strategy("gtja_momentum")(p), momentum_positions(spark, sf_dir), p))
    return _positions(done.positions)


# backtests


def _run(spark, sf_dir, engine=None, **build):
    p = kept_bars(spark, sf_dir)
    return backtest.run_pipeline(p, {"momentum": strategies.get_strategy("gtja_momentum")(p), "reversal": strategies.get_strategy("mean_reversion")(p)}, engine or backtest.Engine(cost=backtest.TradingCost()), **build)


def _figures(df):
    return df.select(*[c for c in df.columns if c not in (*eng.FIGURES, "run_id", "trade_count")], *(["run_id"] if "run_id" in df.columns else []), *[rounded(c, 6).alias(c) for c in eng.FIGURES], "trade_count")


_TWO_RUNS = f"{sql.P}, {_two_signals()}, tg AS ({eng.equal_weights('m', run='momentum')} UNION ALL {eng.equal_weights('r', run='reversal')}), {eng.days_of(chr(83) + 'ELECT unnest([' + repr('momentum') + ', ' + repr('reversal') + ']) AS run_id')}"
_COSTED = f"WITH RECURSIVE {_TWO_RUNS}, {eng.engine(k=eng.COST)}"


@query("backtest_trades", f"{_COSTED} SELECT run_id, date, code, action, {sql.rounded('price', 6, 'price')}, shares, {sql.rounded('pnl', 4, 'pnl')}, {sql.rounded('cost', 4, 'cost')} FROM (SELECT run_id, date, unnest(trades, recursive := true) FROM bt WHERE len(trades) > 0)")
def backtest_trades(spark, sf_dir):
    return _run(spark, sf_dir)[0].select("run_id", "date", "code", "action", rounded("price", 6).alias("price"), "shares", rounded("pnl", 4).alias("pnl"), rounded("cost", 4).alias("cost"))


@query("backtest_equity", f"WITH RECURSIVE {_TWO_RUNS}, ax AS (WITH {_factor_ctes(['calc_atr'])[0]} SELECT * FROM fx), fx AS (SELECT * FROM ax), {eng.engine(k=eng.COST, stop=-0.3, take=0.6, swing=3.0, breaker=True)} SELECT run_id, date, {sql.rounded('eq', 3, 'equity')}, {sql.rounded('cash', 3, 'cash')}, {sql.rounded('value', 3, 'position_value')}, {sql.rounded('back', 6, 'returns')} FROM bt WHERE i > 0")
def backtest_equity(spark, sf_dir):
    engine = backtest.Engine(stop_loss=-0.3, take_profit=0.6, atr_multiplier=3.0, cost=backtest.TradingCost(), breaker=portfolio.CircuitBreaker())
    return _run(spark, sf_dir, engine)[1].select("run_id", "date", *[rounded(c, 3).alias(c) for c in ("equity", "cash", "position_value")], rounded("returns", 6).alias("returns"))


@query("backtest_metrics", f"{_COSTED}, {eng.figures()} SELECT run_id, {eng.SELECT_FIGURES} FROM fg")
def backtest_metrics(spark, sf_dir):
    return _figures(_run(spark, sf_dir)[2])


_EQ = f"eq AS (SELECT 'index' AS run_id, date, 500.0 * sum(close * volume) / sum(volume) AS equity FROM p GROUP BY 2)"


@query("drawdown", f"WITH {sql.P}, {_EQ}, k AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM eq) SELECT date, {sql.rounded('equity', 4, 'equity')}, {sql.rounded('(equity - peak) / peak', 6, 'drawdown')} FROM k")
def drawdown(spark, sf_dir):
    return portfolio.drawdowns(index_equity(spark, sf_dir)).select("date", rounded("equity", 4).alias("equity"), rounded("drawdown", 6).alias("drawdown"))


def index_equity(spark, sf_dir):
    return index_of(panels.bars(spark, sf_dir)).select(F.lit("index").alias("run_id"), "date", (500 * F.col("close")).alias("equity"))


@query("equity_metrics", f"WITH {sql.P}, {_EQ}, k AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak, equity / lag(equity) OVER (ORDER BY date) - 1 - 0.03 / 252 AS r FROM eq) SELECT {sql.rounded('arg_max(equity, date) / 1000000 - 1', 6, 'total_return')}, {sql.rounded('pow(arg_max(equity, date) / 1000000, 252.0 / count(*)) - 1', 6, 'annual_return')}, {sql.rounded('avg(r) / stddev_pop(r) * sqrt(252)', 6, 'sharpe_ratio')}, {sql.rounded('max(abs((equity - peak) / peak))', 6, 'max_drawdown')} FROM k")
def equity_metrics(spark, sf_dir):
    return backtest.equity_metrics(index_equity(spark, sf_dir)).select(*[rounded(c, 6).alias(c) for c in ("total_return", "annual_return", "sharpe_ratio", "max_drawdown")])


@query("breaker_exposure", f"""WITH RECURSIVE {sql.P}, {_EQ}, en AS MATERIALIZED (SELECT *, max(equity) OVER (ORDER BY date) AS peak, row_number() OVER (ORDER BY date) AS i FROM eq), eb AS (SELECT run_id, date, i, peak, (equity - peak) / peak AS dd FROM en), ec AS (SELECT *, CASE WHEN dd >= -0.05 THEN 1.0 WHEN dd <= -0.15 THEN 0.1 ELSE 0.1 + (1 - 0.1) * pow((dd + 0.15) / (-0.05 + 0.15), 2.0) END AS raw FROM eb),
 ee AS (SELECT 0::BIGINT AS i, 1.0::DOUBLE AS now UNION ALL SELECT ec.i, CASE WHEN abs(raw - now) > 0.05 THEN raw ELSE now END FROM ee JOIN ec ON ec.i = ee.i + 1) SELECT run_id, date, {sql.rounded('now', 6, 'exposure')} FROM ee JOIN ec USING (i)""")
def breaker_exposure(spark, sf_dir):
    return portfolio.breaker_exposure(index_equity(spark, sf_dir), portfolio.CircuitBreaker()).withColumn("exposure", rounded("exposure", 6))


def panel_windows(p):
    """Windows of 12 and 6 months from the panel's first date to its last; a rest at the end is a shorter test window."""
    first, last = p.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return []
    windows = backtest.generate_windows(first, last, 12, 6)
    stop = windows[-1][3] if windows else backtest.add_months(first, 12)
    if stop < last:
        windows.append((backtest.add_months(first, 6 * len(windows)), stop - datetime.timedelta(days=1), stop, last))
    return windows


def _walk(weights: str, limit: float | None = None) -> str:
    """CTEs from held weights ``hw`` (run_id, date, code, weight) to tg of a walk-forward run: targets with their weights after each cap."""
    cap = f"hs AS (SELECT *, 0 AS shares FROM hw), {eng.limited('hs', limit)}, hx AS (SELECT run_id, date, code, [hw.weight, lim.weight] AS weights FROM hw JOIN lim USING (run_id, date, code))" if limit is not None else "hx AS (SELECT run_id, date, code, [weight] AS weights FROM hw)"
    return f"{weights}, {cap}, tg AS (SELECT run_id, period, date, hx.code, weights, close AS x FROM hx JOIN wn ON date BETWEEN start AND stop LEFT JOIN p USING (date, code))"


def _overall(df):
    return df.select(*[rounded(c, 6).alias(c) for c in (*eng.WALK, "per_period_ir")])


@query("walk_forward", f"WITH RECURSIVE {_MOM}, {eng.walk_days(12, 6)}, {_walk('hw AS (SELECT ' + repr('walk') + ' AS run_id, date, code, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM sig WHERE signal = 1)')}, {eng.walk_dx('tg')}, {eng.engine(walk=True)}, {eng.walk_figures()} SELECT {eng.SELECT_WALK} FROM wo")
def walk_forward(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    return _overall(backtest.overall_metrics(backtest.walked(p, strategies.get_strategy("gtja_momentum")(p), panel_windows(p))))


@query("merge_silos", f"WITH {_EW}, a AS (SELECT date, code, weight * 0.7 AS w FROM ew UNION ALL SELECT date, code, 0.3 / count(*) OVER (PARTITION BY date) AS w FROM sig WHERE signal = -1), s AS (SELECT date, code, sum(w) AS w FROM a GROUP BY 1, 2), n AS (SELECT date, code, w / sum(w) OVER (PARTITION BY date) AS w FROM s) SELECT date, code, {sql.rounded('w', 6, 'weight')}, CAST(floor(1000000.0 * w / close / 100) * 100 AS BIGINT) AS shares FROM n JOIN p USING (date, code)")
def merge_silos(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    s = strategies.get_strategy("gtja_momentum")(p)
    a, b = portfolio.equal_weight(s, p), portfolio.equal_weight(strategies.reverse(s), p)
    return _positions(backtest.merge_silos([(a, 0.7), (b, 0.3)], p))


def _runs(parts: dict[str, str], engine_sql: str) -> str:
    """WITH ... fg for signal tables by run: SQL that yields (date, code, signal) for each."""
    signals = " UNION ALL ".join(f"SELECT '{r}' AS run_id, date, code, signal FROM ({q})" for r, q in parts.items())
    names = "SELECT unnest([" + ", ".join(f"'{r}'" for r in parts) + "]) AS run_id"
    return f"WITH RECURSIVE {sql.P}, ss AS MATERIALIZED ({signals}), tg AS ({eng.equal_weights('ss')}), {eng.days_of(names)}, {engine_sql}, {eng.figures()}"


_GRID = [{"rebalance": r, "top_n": n} for r in (10, 20) for n in (3, 5)]


@query("param_sweep", f"{_runs({f'{k:04d}': 'WITH ' + _MOM_SCORE + ', ' + hold_sql('sc', g['rebalance'], g['top_n'], 3, 21) + ' SELECT * FROM sig' for k, g in enumerate(_GRID)}, eng.engine())} SELECT run_id, {eng.SELECT_FIGURES} FROM fg")
def param_sweep(spark, sf_dir):
    return _figures(backtest.run_sweep(kept_bars(spark, sf_dir), "gtja_momentum", cleaning.build_grid({"rebalance": [10, 20], "top_n": [3, 5]})))


_POOL_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_POOL_RUNS = {f"{pool}|{name}": f"WITH {sql.INDUSTRY}, m AS (WITH {cte}) SELECT m.* FROM m JOIN i USING (code) WHERE industry = '{pool}'" for pool in _POOL_NAMES for name, cte in (("mean_reversion", f"{_two_signals()} SELECT date, code, signal FROM r"), ("rsi_reversal", f"{_RSI_SIG} SELECT date, code, signal FROM rs"))}


@query("run_matrix", f"{_runs(_POOL_RUNS, eng.engine())} SELECT split_part(run_id, '|', 1) AS pool, split_part(run_id, '|', 2) AS strategy, {eng.SELECT_FIGURES} FROM fg")
def run_matrix(spark, sf_dir):
    pools = panels.industries(spark, sf_dir).select(F.col("industry").alias("pool"), "code")
    return _figures(backtest.run_matrix(panels.bars(spark, sf_dir), pools, ["mean_reversion", "rsi_reversal"]))


@query("best_result", f"{_runs({f'{k:04d}': 'WITH ' + _MOM_SCORE + ', ' + hold_sql('sc', g['rebalance'], g['top_n'], 3, 21) + ' SELECT * FROM sig' for k, g in enumerate(_GRID)}, eng.engine())} SELECT run_id, {eng.SELECT_FIGURES} FROM fg ORDER BY round(total_return, 6) DESC, run_id LIMIT 1")
def best_result(spark, sf_dir):
    """The set of the sweep with the greatest return."""
    swept = param_sweep(spark, sf_dir)
    return evaluation.best_result(swept.select("run_id", *[c for c in swept.columns if c != "run_id"]), "total_return")


@query("best_per_pool", f"{_runs(_POOL_RUNS, eng.engine())}, rk AS (SELECT split_part(run_id, '|', 1) AS pool, split_part(run_id, '|', 2) AS strategy, *, row_number() OVER (PARTITION BY split_part(run_id, '|', 1) ORDER BY round(total_return, 6) DESC, split_part(run_id, '|', 2)) AS k FROM fg) SELECT pool, strategy, {eng.SELECT_FIGURES} FROM rk WHERE k = 1")
def best_per_pool(spark, sf_dir):
    """The strategy with the greatest return in each pool."""
    made = run_matrix(spark, sf_dir)
    return evaluation.best_per_pool(made.select("pool", "strategy", *[c for c in made.columns if c not in ("pool", "strategy")]), "total_return")


@query("compare_backtests", f"WITH RECURSIVE {sql.P}, {_two_signals()}, ew AS ({eng.equal_weights('m', run='momentum')} UNION ALL {eng.equal_weights('r', run='reversal')}), {eng.smoothed('ew', 0.015)}, {eng.limited('smo', 0.3)}, tg AS (SELECT * FROM lim), {eng.days_of(chr(83) + 'ELECT unnest([' + repr('momentum') + ', ' + repr('reversal') + ']) AS run_id')}, {eng.engine()}, {eng.figures()} SELECT run_id, {eng.SELECT_FIGURES} FROM fg")
def compare_backtests(spark, sf_dir):
    """Two strategies side by side, with a dead zone and a limit on each weight."""
    p = kept_bars(spark, sf_dir)
    return _figures(lifecycle.compare_backtests(p, {"momentum": strategies.get_strategy("gtja_momentum")(p), "reversal": strategies.get_strategy("mean_reversion")(p)})[0])


@query("rebalanced_positions", f"WITH {_MOM}, ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM sig)), kept AS (SELECT sig.* FROM sig JOIN ds USING (date) WHERE i % 5 = 0) SELECT date, code, {sql.rounded('weight', 6, 'weight')}, shares::BIGINT AS shares FROM ({eng.equal_weights('kept', run='all')})")
def rebalanced_positions(spark, sf_dir):
    """Positions of every fifth signal date."""
    p = panels.bars(spark, sf_dir)
    return _positions(backtest.build_positions(p, strategies.get_strategy("gtja_momentum")(p), rebalance_days=5))


@query("continuous_backtest", f"{_runs({'continuous': 'WITH ' + _MOM + ' SELECT * FROM sig'}, eng.engine())}, bz AS (SELECT *, eq / lag(eq) OVER (ORDER BY i) - 1 - 0.03 / 252 AS x, max(eq) OVER (ORDER BY i) AS top FROM bt WHERE i > 0) SELECT 'continuous' AS run_id, {sql.rounded('arg_max(eq, i) / 1000000 - 1', 6, 'total_return')}, {sql.rounded('pow(arg_max(eq, i) / 1000000, 252.0 / count(*)) - 1', 6, 'annual_return')}, {sql.rounded('avg(x) / stddev_pop(x) * sqrt(252)', 6, 'sharpe_ratio')}, {sql.rounded('max(abs((eq - top) / top))', 6, 'max_drawdown')} FROM bz")
def continuous_backtest(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    made = backtest.continuous_backtest(p, strategies.get_strategy("gtja_momentum")(p))[2]
    return made.select("run_id", *[rounded(c, 6).alias(c) for c in ("total_return", "annual_return", "sharpe_ratio", "max_drawdown")])


_SILOS = f"{_two_signals()}, h0 AS (SELECT date, code, 0.6 / count(*) OVER (PARTITION BY date) AS w FROM m WHERE signal = 1 UNION ALL SELECT date, code, 0.4 / count(*) OVER (PARTITION BY date) FROM r WHERE signal = 1), hw AS (SELECT 'walk' AS run_id, date, code, sum(w) / sum(sum(w)) OVER (PARTITION BY date) AS weight FROM h0 GROUP BY date, code)"


@query("walk_forward_silos", f"WITH RECURSIVE {sql.P}, {eng.walk_days(12, 6)}, {_walk(_SILOS, 0.3)}, {eng.walk_dx('tg')}, {eng.engine(walk=True)}, {eng.walk_figures()} SELECT {eng.SELECT_WALK} FROM wo")
def walk_forward_silos(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    silos = [(strategies.get_strategy("gtja_momentum")(p), 0.6), (strategies.get_strategy("mean_reversion")(p), 0.4)]
    return _overall(backtest.overall_metrics(backtest.walked_silos(p, silos, panel_windows(p), max_weight=0.3)))


@query("pool_matrix", f"WITH {sql.FIGURES}, {sql.INDUSTRY}, a AS (SELECT industry AS pool, CASE WHEN month(date) <= 6 THEN 'h1' ELSE 'h2' END AS half, avg(close) AS v FROM f JOIN i USING (code) GROUP BY 1, 2) SELECT pool, {sql.rounded('''max(v) FILTER (half = 'h1')''', 4, 'h1')}, {sql.rounded('''max(v) FILTER (half = 'h2')''', 4, 'h2')} FROM a GROUP BY 1")
def pool_matrix(spark, sf_dir):
    made = panels.bars(spark, sf_dir).join(panels.industries(spark, sf_dir), "code")
    cells = made.groupBy(F.col("industry").alias("pool"), F.when(F.month("date") <= 6, "h1").otherwise("h2").alias("half")).agg(F.avg("close").alias("v"))
    return evaluation.pivot_matrix(cells, "pool", "half", "v", ["h1", "h2"]).select("pool", rounded("h1", 4).alias("h1"), rounded("h2", 4).alias("h2"))


# diagnostics


def kept_bars(spark, sf_dir):
    """The bars, made once and written, for queries that read them several times."""
    return dated.materialised(panels.bars(spark, sf_dir), "bars")


@query("signal_stage_counts", f"WITH {_two_signals()}, u AS (SELECT 'momentum' AS stage, signal FROM m UNION ALL SELECT 'reversal', signal FROM r) SELECT stage, count(*) AS total, count(*) FILTER (signal = 1) AS buy, count(*) FILTER (signal = -1) AS sell, count(*) FILTER (signal = 0) AS hold FROM u GROUP BY 1")
def signal_stage_counts(spark, sf_dir):
    m, r = _pair_of_signals(spark, sf_dir)
    return evaluation.signal_stage_counts({"momentum": m, "reversal": r})


_FRA = f"""{_MOM}, fr AS (SELECT date, code, 5 AS "window", lead(close, 5) OVER ({sql.BC}) / close - 1 AS r FROM p UNION ALL SELECT date, code, 1, lead(close, 1) OVER ({sql.BC}) / close - 1 FROM p), fj AS (SELECT * FROM sig JOIN fr USING (date, code) WHERE r IS NOT NULL), fa AS (SELECT "window", signal, count(*) AS count, avg(r) AS mean, quantile_cont(r, 0.5) AS median, count(*) FILTER (r > 0) * 1.0 / count(*) AS hit_rate FROM fj GROUP BY 1, 2)"""


@query("forward_return_analysis",  f"""WITH {_FRA} SELECT "window", signal, count, {sql.rounded('mean', 6, 'mean')}, {sql.rounded('median', 6, 'median')}, {sql.rounded('hit_rate', 6, 'hit_rate')} FROM fa""")
def forward_return_analysis(spark, sf_dir):
    p = kept_bars(spark, sf_dir)
    a = evaluation.forward_return_analysis(strategies.get_strategy("gtja_momentum")(p), p, (1, 5))
    return a.select("window", "signal", "count", *[rounded(c, 6).alias(c) for c in ("mean", "median", "hit_rate")])


@query("signal_spread",  f"""WITH {_FRA}, s AS (SELECT "window", max(mean) FILTER (signal = 1) - max(mean) FILTER (signal = -1) AS spread, max(hit_rate) FILTER (signal = 1) AS h FROM fa GROUP BY 1) SELECT "window", {sql.rounded('spread', 6, 'spread')}, CASE WHEN spread IS NULL THEN 'insufficient_data' WHEN spread > 0.001 AND h > 0.5 THEN 'good' WHEN spread > 0 THEN 'weak_but_directional' WHEN spread > -0.001 THEN 'no_signal' ELSE 'inverted' END AS quality FROM s""")
def signal_spread(spark, sf_dir):
    a = evaluation.forward_return_analysis(momentum_signals(spark, sf_dir), panels.bars(spark, sf_dir), (1, 5))
    return evaluation.signal_spread(a).withColumn("spread", rounded("spread", 6))


_DIAGNOSIS = f"""fr AS (SELECT date, code, unnest([1, 5, 20]) AS w, unnest([lead(close, 1) OVER ({sql.BC}), lead(close, 5) OVER ({sql.BC}), lead(close, 20) OVER ({sql.BC})]) / close - 1 AS r FROM p),
 fa AS (SELECT w, signal, count(*) AS n, avg(r) AS mean, quantile_cont(r, 0.5) AS median, count(*) FILTER (r > 0) * 1.0 / count(*) AS hit FROM m JOIN fr USING (date, code) WHERE r IS NOT NULL GROUP BY 1, 2),
 sc AS (SELECT 'momentum' AS stage, signal FROM m UNION ALL SELECT 'reversal', signal FROM r)"""


@query("full_diagnosis", f"""WITH {sql.P}, {_two_signals()}, {_DIAGNOSIS}, al AS (
 SELECT 'stage_counts' AS part, stage AS item, unnest(['total', 'buy', 'sell', 'hold']) AS name, unnest([count(*), count(*) FILTER (signal = 1), count(*) FILTER (signal = -1), count(*) FILTER (signal = 0)])::DOUBLE AS value FROM sc GROUP BY 2
 UNION ALL SELECT 'forward_returns', w || '/' || signal, unnest(['count', 'mean', 'median', 'hit_rate']), unnest([n::DOUBLE, mean, median, hit]) FROM fa
 UNION ALL SELECT 'spread', w::VARCHAR, 'spread', max(mean) FILTER (signal = 1) - max(mean) FILTER (signal = -1) FROM fa GROUP BY w)
 SELECT part, item, name, {sql.rounded('value', 6, 'value')} FROM al""")
def full_diagnosis(spark, sf_dir):
    """All tables of the diagnosis as one, by part, item and name."""
    p = kept_bars(spark, sf_dir)
    made = evaluation.full_diagnosis({"momentum": strategies.get_strategy("gtja_momentum")(p), "reversal": strategies.get_strategy("mean_reversion")(p)}, p)

    def long(part, item, names):
        each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
        return made[part].select(F.lit(part).alias("part"), item.alias("item"), F.explode(each).alias("x")).select("part", "item", "x.*")

    out = long("stage_counts", F.col("stage"), ["total", "buy", "sell", "hold"]).unionByName(long("forward_returns", F.concat_ws("/", F.col("window").cast("string"), F.col("signal").cast("string")), ["count", "mean", "median", "hit_rate"]))
    return out.unionByName(long("spread", F.col("window").cast("string"), ["spread"])).withColumn("value", rounded("value", 6))


# pairs

_PQ = f"{sql.P}, pr AS (SELECT s_suppkey::INTEGER AS pair, s_suppkey::VARCHAR AS code_a, other::VARCHAR AS code_b FROM (SELECT s_suppkey, lead(s_suppkey) OVER w AS other, row_number() OVER w AS k FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE k % 2 = 1 AND other IS NOT NULL), pp AS (SELECT pair, a.date, ln(a.close) AS la, ln(b.close) AS lb FROM pr JOIN p a ON a.code = code_a JOIN p b ON b.code = code_b AND b.date = a.date), ps AS (SELECT *, la - covar_pop(la, lb) OVER k / nullif(var_pop(lb) OVER k, 0) * lb AS spread FROM pp WINDOW k AS (PARTITION BY pair))"


def _pair_rows(spark, sf_dir):
    return pairs.pair_prices(panels.bars(spark, sf_dir), panels.pairs(spark, sf_dir))


@query("pair_spread", f"WITH {_PQ} SELECT pair, date, {sql.rounded('spread', 6, 'spread')} FROM ps")
def pair_spread(spark, sf_dir):
    return pairs.spread(_pair_rows(spark, sf_dir)).select("pair", "date", rounded("spread", 6).alias("spread"))


_PW = "OVER (PARTITION BY pair ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("pair_spread_zscore", f"WITH {_PQ} SELECT pair, date, {sql.rounded(f'CASE WHEN count(spread) {_PW} = 20 THEN coalesce((spread - avg(spread) {_PW}) / nullif(stddev_samp(spread) {_PW}, 0), 0) ELSE 0 END', 6, 'zscore')} FROM ps")
def pair_spread_zscore(spark, sf_dir):
    return pairs.spread_zscore(pairs.spread(_pair_rows(spark, sf_dir))).select("pair", "date", rounded("zscore", 6).alias("zscore"))


@query("pair_half_life", f"WITH {_PQ}, h AS (SELECT *, lag(spread) OVER (PARTITION BY pair ORDER BY date) AS x, row_number() OVER (PARTITION BY pair ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY pair) AS n FROM ps), g AS (SELECT pair, sum((spread - x) * x) / sum(x * x) AS lam FROM h WHERE k <= 60 AND n > 60 AND x IS NOT NULL GROUP BY 1) SELECT pair, {sql.rounded('CASE WHEN lam < 0 THEN -ln(2) / lam END', 4, 'half_life')} FROM (SELECT DISTINCT pair FROM ps) LEFT JOIN g USING (pair)")
def pair_half_life(spark, sf_dir):
    return pairs.half_life(pairs.spread(_pair_rows(spark, sf_dir))).withColumn("half_life", rounded("half_life", 4))


def _crossed(rows: str, name: str) -> str:
    """CTEs from rows (pair, v: a row of numbers) to name (pair, k, m): the matrix of cross products, and what is left of it after k columns are swept out."""
    cell = "m[i][j] - m[i][1] * m[1][j] / m[1][1]"
    return f"""{name}a AS (SELECT pair, v, unnest(range(1, len(v) + 1)) AS i FROM {rows}), {name}b AS (SELECT pair, i, v, unnest(range(1, len(v) + 1)) AS j FROM {name}a), {name}c AS (SELECT pair, i, j, sum(v[i] * v[j]) AS g FROM {name}b GROUP BY 1, 2, 3),
 {name}d AS (SELECT pair, i, list(g ORDER BY j) AS r FROM {name}c GROUP BY 1, 2), {name} AS (SELECT pair, 0 AS k, list(r ORDER BY i) AS m FROM {name}d GROUP BY 1 UNION ALL SELECT pair, k + 1, [[{cell} for j in range(2, len(m) + 1)] for i in range(2, len(m) + 1)] FROM {name} WHERE len(m) > 1)"""


#: Share of the normal distribution below z, by Simpson's rule from -10 on.
_SHARE = "(z + 10) / 6000 / sqrt(2 * pi()) * list_sum([(CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(-10 + s * (z + 10) / 2000, 2) / 2) for s in range(2001)])"
_COINT = f"""{_PQ}, c0 AS (SELECT pair, date, la - avg(la) OVER k - coalesce(covar_pop(la, lb) OVER k / nullif(var_pop(lb) OVER k, 0), 0) * (lb - avg(lb) OVER k) AS x, count(*) OVER k AS n FROM pp WINDOW k AS (PARTITION BY pair)),
 c1 AS (SELECT *, row_number() OVER w - 1 AS t, lead(x) OVER w - x AS y FROM c0 WINDOW w AS (PARTITION BY pair ORDER BY date)),
 c2 AS MATERIALIZED (SELECT pair, n, t, x, y, least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2)::INTEGER AS top, list_reverse(coalesce(list(y) OVER (PARTITION BY pair ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), [])) AS lg FROM c1 WHERE n >= 60),
 c3 AS (SELECT pair, [1.0::DOUBLE, x] || lg[1:top] || [y] AS v FROM c2 WHERE y IS NOT NULL AND t >= top), {_crossed('c3', 'el')},
 c4 AS MATERIALIZED (SELECT pair, any_value(n) AS n, arg_min(k - 2, u * (ln(2 * pi()) + ln(m[-1][-1] / u) + 1) + 2 * k) AS lags FROM el JOIN (SELECT DISTINCT pair, n, n - 1 - top AS u FROM c2) USING (pair) WHERE k >= 2 AND len(m) > 0 GROUP BY 1),
 c5 AS (SELECT pair, [1.0::DOUBLE] || lg[1:lags] || [x, y] AS v FROM c2 JOIN c4 USING (pair) WHERE y IS NOT NULL AND t >= lags), {_crossed('c5', 'fl')},
 c6 AS (SELECT pair, n, lags, m[1][2] / m[1][1] / sqrt((m[2][2] - m[1][2] * m[1][2] / m[1][1]) / (n - 2 * lags - 3) / m[1][1]) AS tau FROM fl JOIN c4 USING (pair) WHERE len(m) = 2),
 c7 AS (SELECT *, CASE WHEN tau <= {pairs.TAU_STAR} THEN {' + '.join(f'({c}) * pow(tau, {k})' for k, c in enumerate(pairs.TAU_SMALL))} ELSE {' + '.join(f'({c}) * pow(tau, {k})' for k, c in enumerate(pairs.TAU_LARGE))} END AS z FROM c6)"""


@query("pair_cointegration", f"WITH RECURSIVE {_COINT} SELECT pair, {sql.rounded(f'CASE WHEN c0.n < 60 THEN 1 WHEN tau > {pairs.TAU_MAX} THEN 1 WHEN tau < {pairs.TAU_MIN} OR z < -9 THEN 0 ELSE {_SHARE} END', 6, 'pvalue')}, {sql.rounded('tau', 5, 'tau')}, lags, c0.n AS n_obs FROM (SELECT DISTINCT pair, n FROM c0) c0 LEFT JOIN c7 USING (pair)")
def pair_cointegration(spark, sf_dir):
    made = pairs.cointegration(_pair_rows(spark, sf_dir))
    return made.select("pair", rounded("pvalue", 6).alias("pvalue"), rounded("tau", 5).alias("tau"), "lags", "n_obs")


@query("pair_kalman", f"""WITH RECURSIVE {_PQ}, kn AS MATERIALIZED (SELECT pair, date, la, lb, row_number() OVER (PARTITION BY pair ORDER BY date) AS i FROM pp), k0 AS (SELECT pair, regr_slope(la, lb) AS b FROM kn WHERE i <= 10 GROUP BY 1),
 kf AS (SELECT pair, 0::BIGINT AS i, b AS beta, 1.0::DOUBLE AS var FROM k0 UNION ALL SELECT pair, i, beta + g * (la - beta * lb), (1 - g * lb) * ahead FROM (SELECT *, ahead * lb / (ahead * lb * lb + 0.001) AS g FROM (SELECT kn.pair, kn.i, la, lb, beta, var + 0.00001 AS ahead FROM kf JOIN kn ON kn.pair = kf.pair AND kn.i = kf.i + 1)))
 SELECT pair, date, {sql.rounded('beta', 5, 'beta')} FROM kf JOIN kn USING (pair, i)""")
def pair_kalman(spark, sf_dir):
    return pairs.kalman_betas(_pair_rows(spark, sf_dir)).withColumn("beta", rounded("beta", 5))


_PZ = "OVER (PARTITION BY pair ORDER BY date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW)"


_Z = f"{_PQ}, z0 AS (SELECT pair, date, la, lb, count(*) {_PZ} AS n, covar_pop(la, lb) {_PZ} / nullif(var_pop(lb) {_PZ}, 0) AS b, avg(la) {_PZ} AS ma, avg(lb) {_PZ} AS mb, var_pop(la) {_PZ} AS va, var_pop(lb) {_PZ} AS vb, covar_pop(la, lb) {_PZ} AS c FROM pp), z1 AS (SELECT *, sqrt(greatest(va - 2 * b * c + b * b * vb, 0)) AS sd FROM z0), z2 AS (SELECT pair, date, CASE WHEN n > 60 THEN CASE WHEN sd > 1e-10 THEN ((la - b * lb) - (ma - b * mb)) / sd ELSE 0 END END AS z FROM z1)"


@query("pair_zscores", f"WITH {_Z} SELECT pair, date, {sql.rounded('z', 5, 'z')} FROM z2")
def pair_zscores(spark, sf_dir):
    return strategies.pair_zscores(panels.bars(spark, sf_dir), panels.pairs(spark, sf_dir)).select("pair", "date", rounded("z", 5).alias("z"))


@query("pair_trading", f"""WITH RECURSIVE {_Z}, zn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY date) AS i FROM z2),
 zt AS (SELECT pair, 0::BIGINT AS i, 0 AS held, NULL::DOUBLE AS z FROM pr UNION ALL SELECT zn.pair, zn.i, CASE WHEN zn.z IS NULL THEN held WHEN held = 0 THEN CASE WHEN zn.z < -2 THEN 1 WHEN zn.z > 2 THEN -1 ELSE 0 END WHEN abs(zn.z) < 0.5 THEN 0 ELSE held END, zn.z FROM zt JOIN zn ON zn.pair = zt.pair AND zn.i = zt.i + 1),
 zl AS (SELECT date, pair, held AS s, least(abs(zt.z) / 2.0, 1.0) AS c FROM zt JOIN zn USING (pair, i) WHERE zt.z IS NOT NULL AND held <> 0), zs AS (SELECT date, code_a AS code, s, c FROM zl JOIN pr USING (pair) UNION ALL SELECT date, code_b, -s, c FROM zl JOIN pr USING (pair))
 SELECT p.date, p.code, coalesce(s, 0) AS signal, {sql.rounded('coalesce(c, 0)', 6, 'confidence')} FROM p LEFT JOIN zs ON zs.date = p.date AND zs.code = p.code AND c > 0""")
def pair_trading(spark, sf_dir):
    return _signals(strategies.get_strategy("pair_trading")(panels.bars(spark, sf_dir), panels.pairs(spark, sf_dir)))


# announcements

_EV = """ev0 AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS ann_date, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey),
 ev AS (SELECT code, ann_date, strftime(date_trunc('quarter', ann_date) - INTERVAL 1 DAY, '%Y%m%d') AS end_date, avg(o_totalprice) / 1000 AS roe, avg(c_acctbal) / 100 AS ocfps, sum(o_totalprice) AS actual_profit, sum(c_acctbal) * 20 AS predicted_profit FROM ev0 GROUP BY 1, 2, 3)"""
_DAYS = "dy AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders)"


def month_days(spark, sf_dir):
    return panels.table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).distinct()


@query("asof_panel", f"WITH {_EV}, {_DAYS}, g AS (SELECT date, code FROM dy, (SELECT DISTINCT code FROM ev)) SELECT g.date, g.code, {sql.rounded('e.ocfps', 4, 'ocfps')} FROM g ASOF LEFT JOIN ev e ON g.code = e.code AND g.date >= e.ann_date")
def asof_panel(spark, sf_dir):
    e = panels.announcements(spark, sf_dir)
    return announcements.as_of(announcements.grid_of(month_days(spark, sf_dir), e), e, ["ocfps"]).select("date", "code", rounded("ocfps", 4).alias("ocfps"))


_PREV = "CASE right(e.end_date, 4) WHEN '0331' THEN (left(e.end_date, 4)::INT - 1)::VARCHAR || '1231' WHEN '0630' THEN left(e.end_date, 4) || '0331' WHEN '0930' THEN left(e.end_date, 4) || '0630' ELSE left(e.end_date, 4) || '0930' END"


@query("acceleration", f"WITH {_EV}, l AS (SELECT code, end_date, arg_max(roe, ann_date) AS v FROM ev GROUP BY 1, 2) SELECT e.code, e.ann_date, e.end_date, {sql.rounded('coalesce(e.roe - l.v, 0)', 4, 'acceleration')} FROM ev e LEFT JOIN l ON l.code = e.code AND l.end_date = {_PREV}")
def acceleration(spark, sf_dir):
    a = announcements.acceleration(panels.announcements(spark, sf_dir), "roe")
    return a.select("code", "ann_date", "end_date", rounded("raw_acceleration", 4).alias("acceleration"))


def _z(c: str) -> str:
    by = "OVER (PARTITION BY date)"
    return f"CASE WHEN {c} IS NOT NULL AND count({c}) {by} >= 2 AND stddev_samp({c}) {by} > 0 THEN greatest(least(({c} - avg({c}) {by}) / stddev_samp({c}) {by}, 3), -3) ELSE {c} END"


@query("quality_panel", f"WITH {_EV}, {_DAYS}, q AS (SELECT *, CASE WHEN count(roe) OVER w >= 2 THEN -stddev_samp(roe) OVER w END AS st FROM ev WINDOW w AS (PARTITION BY code ORDER BY ann_date, end_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), g AS (SELECT date, code FROM dy, (SELECT DISTINCT code FROM ev)), j AS (SELECT g.date, g.code, roe, st, ocfps FROM g ASOF LEFT JOIN q ON g.code = q.code AND g.date >= q.ann_date) SELECT date, code, {sql.rounded(_z('roe'), 6, 'roe_level')}, {sql.rounded(_z('st'), 6, 'roe_stability')}, {sql.rounded(_z('ocfps'), 6, 'cashflow_quality')} FROM j")
def quality_panel(spark, sf_dir):
    e = panels.announcements(spark, sf_dir)
    q = announcements.quality_panel(e, month_days(spark, sf_dir), e)
    return q.select("date", "code", *[rounded(c, 6).alias(c) for c in ("roe_level", "roe_stability", "cashflow_quality")])


def earnings_events(spark, sf_dir):
    """Forecasts on even days, express reports on odd ones."""
    e = panels.announcements(spark, sf_dir)
    even = F.dayofmonth("ann_date") % 2 == 0
    kind = F.element_at(F.array(*[F.lit(k) for k in announcements.FORECAST_SCORE]), (F.month("ann_date") % 8 + 1))
    return e.select("code", "ann_date", "end_date", F.when(even, "forecast").otherwise("express").alias("event_type"), "predicted_profit", "actual_profit", F.when(even, kind).alias("forecast_type"))


_SCORE = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in announcements.FORECAST_SCORE.items()) + " ELSE 0.0 END"
_KINDS = "[" + ", ".join(f"'{k}'" for k in announcements.FORECAST_SCORE) + "]"
_PIT = f"""{_EV}, ee AS (SELECT code, ann_date, end_date, CASE WHEN day(ann_date) % 2 = 0 THEN 'forecast' ELSE 'express' END AS event_type, predicted_profit AS pp, actual_profit AS ap, CASE WHEN day(ann_date) % 2 = 0 THEN {_KINDS}[month(ann_date) % 8 + 1] END AS kind FROM ev),
 eo AS (SELECT *, row_number() OVER (PARTITION BY end_date ORDER BY ann_date, code, event_type) AS o FROM ee),
 es AS (SELECT *, last_value(pp) OVER h AS p_now, last_value(CASE WHEN event_type = 'express' THEN ap END IGNORE NULLS) OVER h AS a_now, last_value(kind IGNORE NULLS) OVER h AS k_now, lead(o) OVER (PARTITION BY end_date, code ORDER BY o) AS until FROM eo WINDOW h AS (PARTITION BY end_date, code ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 er AS (SELECT e.end_date, e.o, count(*) AS n, (count(*) FILTER (s.a_now < e.a_now) + count(*) FILTER (s.a_now <= e.a_now)) / 2.0 AS ra, (count(*) FILTER (s.p_now < e.p_now) + count(*) FILTER (s.p_now <= e.p_now)) / 2.0 AS rp FROM es e JOIN es s ON s.end_date = e.end_date AND s.o <= e.o AND coalesce(s.until > e.o, true) AND s.a_now IS NOT NULL AND s.p_now IS NOT NULL WHERE e.event_type = 'express' GROUP BY 1, 2),
 ps AS (SELECT es.*, CASE WHEN event_type = 'forecast' THEN {_SCORE.format('kind')} WHEN n >= 3 THEN (ra - rp) / n ELSE {_SCORE.format('k_now')} END AS raw FROM es LEFT JOIN er USING (end_date, o))"""


@query("pit_surprise", f"WITH {_PIT} SELECT code, ann_date, end_date, event_type, {sql.rounded('raw', 6, 'raw_surprise')} FROM ps")
def pit_surprise(spark, sf_dir):
    made = announcements.pit_surprise(earnings_events(spark, sf_dir))
    return made.select("code", "ann_date", "end_date", "event_type", rounded("raw_surprise", 6).alias("raw_surprise"))


def _z0(c: str) -> str:
    return f"coalesce({_z(c)}, 0.0)"


@query("earnings_panel", f"WITH {_PIT}, {_DAYS}, lv AS (SELECT code, end_date, arg_max(raw, ann_date) AS v FROM ps GROUP BY 1, 2), ac AS (SELECT e.code, e.ann_date, e.end_date, e.raw AS s, coalesce(e.raw - lv.v, 0) AS a FROM ps e LEFT JOIN lv ON lv.code = e.code AND lv.end_date = {_PREV}), g AS (SELECT date, code FROM dy, (SELECT DISTINCT code FROM ps)), j AS (SELECT g.date, g.code, s, a FROM g ASOF LEFT JOIN ac ON g.code = ac.code AND g.date >= ac.ann_date) SELECT date, code, {sql.rounded(_z0('s'), 6, 'earnings_surprise')}, {sql.rounded(_z0('a'), 6, 'earnings_acceleration')} FROM j")
def earnings_panel(spark, sf_dir):
    e = earnings_events(spark, sf_dir)
    made = announcements.earnings_panel(e, month_days(spark, sf_dir), e)
    return made.select("date", "code", *[rounded(c, 6).alias(c) for c in ("earnings_surprise", "earnings_acceleration")])


# life cycle


_ST = f"{_ROLLED}, {eng.states('ro', 5)}"
_STATE_VALUES = ("ic", "rolling_ic", "rolling_ir", "t_stat")


def _states(spark, sf_dir):
    return lifecycle.monitor(panels.bars(spark, sf_dir), FACTORS, min_sustain=5)


@query("monitor_states", f"WITH RECURSIVE {_ST} SELECT date, factor, fwd_window, {', '.join(sql.rounded(c, 6, c) for c in _STATE_VALUES)}, state, sustain_days, old_state FROM st")
def monitor_states(spark, sf_dir):
    return _states(spark, sf_dir).select("date", "factor", "fwd_window", *[rounded(c, 6).alias(c) for c in _STATE_VALUES], "state", "sustain_days", "old_state")


@query("monitor_changes", f"WITH RECURSIVE {_ST} SELECT date, factor, fwd_window, old_state, state AS new_state FROM st WHERE old_state IS NOT NULL")
def monitor_changes(spark, sf_dir):
    return lifecycle.diff_states(_states(spark, sf_dir))


_STATUS = f"SELECT factor, fwd_window, max(date) AS date, arg_max(state, date) AS state, {sql.rounded('last(t_stat ORDER BY date)', 6, 't_stat')}, arg_max(sustain_days, date) AS sustain_days, max(date) FILTER (old_state IS NOT NULL) AS last_change FROM st GROUP BY 1, 2"


@query("monitor_status", f"WITH RECURSIVE {_ST} {_STATUS}")
def monitor_status(spark, sf_dir):
    return lifecycle.status_table(_states(spark, sf_dir)).withColumn("t_stat", rounded("t_stat", 6))


@query("state_timeline", f"WITH RECURSIVE {_ST}, sp AS (SELECT *, row_number() OVER w - sustain_days AS g FROM st WINDOW w AS (PARTITION BY factor, fwd_window ORDER BY date)) SELECT factor, fwd_window, state, min(date) AS start, max(date) AS end, count(*) AS days, {sql.rounded('avg(rolling_ir)', 6, 'mean_ir')}, {sql.rounded('avg(t_stat)', 6, 'mean_t')} FROM sp GROUP BY factor, fwd_window, g, state")
def state_timeline(spark, sf_dir):
    """The table behind the life-cycle plot."""
    spans = lifecycle.state_spans(_states(spark, sf_dir))
    return spans.select("factor", "fwd_window", "state", "start", "end", "days", *[rounded(c, 6).alias(c) for c in ("mean_ir", "mean_t")])


@query("factor_health", f"WITH RECURSIVE {_ST}, sc AS (SELECT greatest(abs(quantile_cont(rolling_ir, 0.05)), abs(quantile_cont(rolling_ir, 0.95))) AS s FROM st) SELECT factor, fwd_window, date, {sql.rounded('rolling_ir', 6, 'value')}, {sql.rounded('CASE WHEN rolling_ir IS NOT NULL THEN greatest(least(rolling_ir / s, 1), -1) END', 6, 'shade')} FROM st, sc")
def factor_health(spark, sf_dir):
    """The table behind the health heatmap."""
    made = lifecycle.factor_health(_states(spark, sf_dir))
    return made.select("factor", "fwd_window", "date", *[rounded(c, 6).alias(c) for c in ("value", "shade")])


_NULL = f"""{_IC}, b0 AS (SELECT factor, date, ic AS v, lag(ic) OVER (PARTITION BY factor ORDER BY date) AS x, count(*) OVER (PARTITION BY factor) AS m FROM ic WHERE ic IS NOT NULL),
 b1 AS MATERIALIZED (SELECT factor, any_value(m) AS m, covar_pop(x, v) / nullif(var_pop(x), 0) AS phi, avg(x) AS mx, avg(v) AS my FROM b0 WHERE x IS NOT NULL GROUP BY 1),
 b2 AS (SELECT factor, row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS k, v - my - phi * (x - mx) AS e FROM b0 JOIN b1 USING (factor) WHERE x IS NOT NULL),
 b3 AS MATERIALIZED (SELECT factor, it, row_number() OVER (PARTITION BY factor, it ORDER BY md5(concat_ws('|', '0', factor, it, k))) AS j, e FROM b2, range(200) t(it)),
 b4 AS (SELECT factor, it, 0::BIGINT AS j, 0.0::DOUBLE AS o FROM b1, range(200) t(it) UNION ALL SELECT b4.factor, b4.it, b4.j + 1, phi * o + e FROM b4 JOIN b3 ON b3.factor = b4.factor AND b3.it = b4.it AND b3.j = b4.j + 1 JOIN b1 ON b1.factor = b4.factor),
 dr AS (SELECT factor, it, avg(o) / stddev_samp(o) * sqrt(count(*)) AS t FROM b4 JOIN b1 USING (factor) WHERE j >= m - 60 AND m >= 60 GROUP BY 1, 2)"""


def _draws(spark, sf_dir):
    return lifecycle.bootstrap_draws(evaluation.ic(two_factors(spark, sf_dir), FACTORS), ["factor"])


@query("bootstrap_null", f"WITH RECURSIVE {_NULL} SELECT factor, {sql.rounded('quantile_cont(abs(t), 0.95)', 6, 'null_q')} FROM dr GROUP BY 1")
def bootstrap_null(spark, sf_dir):
    return lifecycle.bootstrap_null(evaluation.ic(two_factors(spark, sf_dir), FACTORS), ["factor"]).withColumn("null_q", rounded("null_q", 6))


@query("null_histogram", f"WITH RECURSIVE {_NULL} SELECT factor, bin, (bin * 0.25 - 4)::DOUBLE AS lower, count(*) AS n FROM (SELECT factor, greatest(least(floor((t + 4) / 0.25), 31), 0)::INTEGER AS bin FROM dr) GROUP BY 1, 2")
def null_histogram(spark, sf_dir):
    """The table behind the plot of the null distribution."""
    return lifecycle.null_histogram(_draws(spark, sf_dir), ["factor"])


_BAR_FACTORS = [n for n in sql.FACTORS if len(sql.FACTORS[n]) == 3]


def _all_states(factors_: list[str] = _BAR_FACTORS) -> str:
    """CTEs to st of factors that bars alone feed."""
    ctes, last = _factor_ctes(factors_)
    names = ", ".join(f"'{n}'" for n in factors_)
    values = ", ".join(f"v{k}::DOUBLE" for k in range(len(factors_)))
    ranks = ", ".join(f"{sql.prank(c, 'date, factor')} AS r{c}" for c in "xy")
    corr = "CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 1e-14 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END"
    w = "OVER (PARTITION BY factor, fwd_window ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"""{ctes}, yl AS (SELECT date, code, lead(close, 5) OVER ({sql.BC}) / close - 1 AS y FROM p), al AS (SELECT date, code, unnest([{names}]) AS factor, unnest([{values}]) AS x, y FROM {last} JOIN yl USING (date, code)),
 ar AS (SELECT *, {ranks} FROM (SELECT * FROM al WHERE x IS NOT NULL AND y IS NOT NULL)), ic AS (SELECT date, factor, 5 AS fwd_window, {corr} AS ic FROM ar GROUP BY 1, 2 HAVING count(*) >= 5), ro AS (SELECT *, count(ic) {w} AS k, avg(ic) {w} AS m, stddev_samp(ic) {w} AS s FROM ic), {eng.states('ro', 5)}"""


@query("monitor_all_factors", f"WITH RECURSIVE {_all_states()} {_STATUS.replace(sql.rounded('last(t_stat ORDER BY date)', 6, 't_stat'), sql.rounded('last(t_stat ORDER BY date)', 2, 't_stat'))}")
def monitor_all_factors(spark, sf_dir):
    """Latest state of every single factor that bars alone feed.

    Two decimals: deviations of whole numbers tie but for the last bits, which the two engines sum in other orders.
    """
    return lifecycle.status_table(lifecycle.monitor(panels.bars(spark, sf_dir), min_sustain=5)).withColumn("t_stat", rounded("t_stat", 2))


@query("top_factors", f"WITH RECURSIVE {_all_states()}, la AS (SELECT factor, round(arg_max(coalesce(t_stat, 'nan'), date), 2) AS t FROM st GROUP BY 1) SELECT factor, {sql.rounded('t', 2, 't_stat')} FROM la WHERE NOT isnan(t) AND abs(t) >= 1 ORDER BY abs(t) DESC, factor LIMIT 10")
def top_factors(spark, sf_dir):
    """The ten bar factors of greatest latest |t| (two decimals), of those with one of 1 or more."""
    last = lifecycle.status_table(lifecycle.monitor(panels.bars(spark, sf_dir), min_sustain=5)).withColumn("t_stat", F.round("t_stat", 2))
    return lifecycle.select_top_factors(last, 10, 1.0).select("factor", rounded("t_stat", 2).alias("t_stat"))


#: Codes whose number is 1 modulo 4 are away for 100 dates up to the sixth date from the end, where the old run stands.
_AWAY = 100
_GAPPED = f"""p0 AS ({sql.bars()}), ds AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS back FROM (SELECT DISTINCT date FROM p0)),
 p AS (SELECT p0.* FROM p0 JOIN ds USING (date) WHERE NOT (code::INT % 4 = 1 AND back BETWEEN 5 AND 5 + {_AWAY})),
 fd AS (SELECT min(date) AS first FROM (SELECT date, lead(date, 5) OVER ({sql.BC}) AS done FROM p) WHERE done > (SELECT date FROM ds WHERE back = 5))"""


def gapped_panel(spark, sf_dir):
    """The panel without those rows, and the date at which the old run stands."""
    p = kept_bars(spark, sf_dir)
    dates = p.select("date").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.col("date").desc())) - 1)  # one row a date
    p = p.join(F.broadcast(dates), "date").filter(~((F.col("code").cast("int") % 4 == 1) & F.col("back").between(5, 5 + _AWAY))).drop("back")
    return p, dates.filter("back = 5").first()["date"]


@query("monitor_update", f"WITH RECURSIVE {_all_states().replace(sql.P, _GAPPED, 1)} SELECT date, factor, fwd_window, {sql.rounded('t_stat', 2, 't_stat')}, state, sustain_days FROM st WHERE date >= (SELECT first FROM fd)")
def monitor_update(spark, sf_dir):
    """New rows of all bar factors after a run that ends five dates earlier, from what it carried and the last five dates alone.

    A quarter of the codes come back after 100 dates; the rows from their last dates on are those of a full run.
    """
    p, last = gapped_panel(spark, sf_dir)
    root = dated.working_folder(spark, "monitor")
    lifecycle.run_monitor(p.filter(F.col("date") <= F.lit(last)), root, _BAR_FACTORS, min_sustain=5)
    old, carry = io.load_state(spark, root), io.load_carry(spark, root)
    new = lifecycle.update_monitor(p, old, carry, _BAR_FACTORS, min_sustain=5)[0]
    return new.select("date", "factor", "fwd_window", rounded("t_stat", 2).alias("t_stat"), "state", "sustain_days")


_KEPT = ["calc_high_vol_rank_corr_3d", "calc_macd_like", "calc_obv"]


@query("factor_cache", f"WITH {_factor_ctes(_KEPT)[0].replace(sql.P, _GAPPED, 1)} SELECT date, code, {', '.join(sql.rounded(f'v{k}', 2, n) for k, n in enumerate(_KEPT))}, date > (SELECT date FROM ds WHERE back = 5) AS fresh FROM fx")
def factor_cache(spark, sf_dir):
    """Factors of a panel that has grown by five dates since they were cached, codes that come back among them; fresh: made by the second run."""
    p, last = gapped_panel(spark, sf_dir)
    root = dated.working_folder(spark, "factors")
    io.cached_factors(p.filter(F.col("date") <= F.lit(last)), _KEPT, root)
    values, first = io.cached_factors(p, _KEPT, root)
    return values.select("date", "code", *[rounded(n, 2).alias(n) for n in _KEPT], (F.col("date") >= F.lit(first)).alias("fresh"))


@query("test_period_stats", f"WITH {_IC}, s AS (SELECT factor, avg(ic) AS m, stddev_samp(ic) AS sd, count(ic) AS n FROM ic WHERE date >= DATE '2000-01-01' GROUP BY 1) SELECT factor, {sql.rounded('m', 6, 'ic_mean')}, {sql.rounded('m / nullif(sd, 0) * sqrt(n)', 6, 'ic_t')}, n AS ic_n, abs(m / nullif(sd, 0) * sqrt(n)) > 2 AS sig FROM s")
def test_period_stats(spark, sf_dir):
    ics = evaluation.ic(two_factors(spark, sf_dir), FACTORS).filter(F.col("date") >= F.lit(datetime.date(2000, 1, 1)))
    return lifecycle.test_stats(ics).select("factor", rounded("ic_mean", 6).alias("ic_mean"), rounded("ic_t", 6).alias("ic_t"), "ic_n", "sig")


#: The factors that phase A looks at.
_ALIKE = ["calc_ma_slope_20d", "calc_momentum_20d_return", "calc_momentum_5d_change", "calc_momentum_6d_return", "calc_rsi", "calc_volume_ratio"]


def _heights(among: str) -> str:
    """CTEs from fx to m3 (a, b, h) of the factors (numbers k) in ``among``: single linkage joins two factors at the least height over all ways
    between them of the longest step; distances are squared until all ways are in."""
    pairs_ = [(a, b) for a in range(len(_ALIKE)) for b in range(a + 1, len(_ALIKE))]
    each = ", ".join(f"unnest([{', '.join(x)}]) AS {n}" for n, x in (("fa", [f"{a}" for a, _ in pairs_]), ("fb", [f"{b}" for _, b in pairs_]), ("x", [f"v{a}::DOUBLE" for a, _ in pairs_]), ("y", [f"v{b}::DOUBLE" for _, b in pairs_])))
    corr = "CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 1e-14 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END"
    ways = ["m0 AS (SELECT fa AS a, fb AS b, h FROM dc UNION ALL SELECT fb, fa, h FROM dc UNION ALL SELECT k, k, 0.0 FROM {among})".format(among=among)]
    ways += [f"m{k + 1} AS (SELECT x.a, y.b, min(greatest(x.h, y.h)) AS h FROM m{k} x JOIN m{k} y ON x.b = y.a GROUP BY 1, 2)" for k in range(3)]
    return f"""dl AS (SELECT DISTINCT date FROM p ORDER BY date DESC LIMIT 60), dx AS (SELECT date, code, {each} FROM fx WHERE date IN (SELECT date FROM dl)), dk AS (SELECT * FROM dx WHERE x IS NOT NULL AND y IS NOT NULL AND fa IN (SELECT k FROM {among}) AND fb IN (SELECT k FROM {among})),
 dr AS (SELECT *, {sql.prank('x', 'date, fa, fb')} AS rx, {sql.prank('y', 'date, fa, fb')} AS ry FROM dk), dd AS (SELECT date, fa, fb, {corr} AS c FROM dr GROUP BY 1, 2, 3 HAVING count(*) >= 5), dc AS (SELECT fa, fb, coalesce(1 - abs(avg(c)), 1.0) AS h FROM dd GROUP BY 1, 2), {', '.join(ways)}"""


_NAMES = "[" + ", ".join(f"'{n}'" for n in _ALIKE) + "]"


@query("factor_dendrogram", f"WITH {_factor_ctes(_ALIKE)[0]}, {_heights('(SELECT unnest(range(6)) AS k)')} SELECT {_NAMES}[a + 1] AS factor_a, {_NAMES}[b + 1] AS factor_b, {sql.rounded('h', 6, 'height')} FROM m3 WHERE a < b")
def factor_dendrogram(spark, sf_dir):
    """Heights at which factors come together."""
    merged = evaluation.dendrogram(factors.with_factors(panels.bars(spark, sf_dir), _ALIKE), _ALIKE, linkage="single", min_obs=5)
    return evaluation.cophenetic(merged).withColumn("height", rounded("height", 6))


@query("phase_a")
def phase_a(spark, sf_dir):
    p = panels.bars(spark, sf_dir)
    names = ["calc_momentum_5d_change", "calc_momentum_6d_return", "calc_momentum_20d_return", "calc_ma_slope_20d", "calc_volume_ratio", "calc_rsi"]
    return lifecycle.phase_a(p, lifecycle.monitor(p, names, min_sustain=5))


@query("phase_a_single", f"""WITH RECURSIVE {_all_states(_ALIKE)}, la AS (SELECT list_position({_NAMES}, factor) - 1 AS k, arg_max(state, date) AS state, abs(last(t_stat ORDER BY date)) AS t FROM st GROUP BY factor), op AS (SELECT k, t FROM la WHERE state <> 'dead'), {_heights('op')},
 cl AS (SELECT a AS k, min(b) AS g FROM m3 WHERE h <= 1 - 0.3 GROUP BY 1), cr AS (SELECT k, t, dense_rank() OVER (ORDER BY g) AS cluster FROM cl JOIN op USING (k))
 SELECT cluster::INTEGER AS cluster, {_NAMES}[first(k ORDER BY t DESC NULLS LAST, k) + 1] AS representative, string_agg({_NAMES}[k + 1], ',' ORDER BY k) AS members FROM cr GROUP BY 1""")
def phase_a_single(spark, sf_dir):
    """Phase A by single linkage, factors with correlations of 0.3 or more alike; reversed factors count as active, to be held the other way round."""
    p = panels.bars(spark, sf_dir)
    states = lifecycle.monitor(p, _ALIKE, min_sustain=5).replace({"reverse": "active"}, subset=["state"])
    made = lifecycle.phase_a(p, states, threshold=0.3, linkage="single")
    return made.withColumn("members", F.array_join("members", ","))


@query("phase_b")
def phase_b(spark, sf_dir):
    """Factors, forward returns and states are made once and written, for several steps read them."""
    names = ["calc_momentum_5d_change", "calc_momentum_6d_return", "calc_momentum_20d_return", "calc_ma_slope_20d", "calc_volume_ratio", "calc_rsi"]
    p = dated.materialised(lifecycle.ahead(panels.bars(spark, sf_dir), names), "factors")
    first, last = p.agg(F.min("date"), F.max("date")).first()
    windows = lifecycle.oos_windows(first, last, 24, 3)
    states = dated.materialised(lifecycle.monitor(p, names, min_sustain=5), "states")
    return lifecycle.phase_b(p, states, windows, t_window=40, min_obs=5)[0]


def _composite(weights: dict[int, float]) -> str:
    """Signals of a composite of the two factors (v0, v1): weighted mean of the ranks present."""
    top = " + ".join(f"coalesce(q{k} * {w}, 0)" for k, w in weights.items())
    total = " + ".join(f"CASE WHEN q{k} IS NULL THEN 0 ELSE {w} END" for k, w in weights.items())
    return f"WITH {_factor_ctes(FACTORS)[0]}, cq AS (SELECT date, code, {sql.prank('v0')} AS q0, {sql.prank('v1')} AS q1 FROM fx), sd AS (SELECT date, code, ({top}) / nullif({total}, 0) AS score FROM cq), {hold_sql('sd', 20, 10, 5, 0, drop=True, exited=True, min_rows=0)} SELECT * FROM sig"


@query("phase_c", f"{_runs({'composite': _composite({0: 1.0, 1: 1.0}), FACTORS[0]: _composite({0: 1.0}), FACTORS[1]: _composite({1: 1.0})}, eng.engine())} SELECT run_id, {eng.SELECT_FIGURES} FROM fg")
def phase_c(spark, sf_dir):
    return _figures(lifecycle.phase_c(kept_bars(spark, sf_dir), {FACTORS[0]: 1.0, FACTORS[1]: 1.0}))


_MINED = ["calc_moneyflow_net_ratio", "calc_moneyflow_streak", "calc_moneyflow_big_net_ratio"]


def _screen_sql() -> str:
    ctes = [f"{sql.FIGURES}, {sql.FLOWS}, wf AS (SELECT * FROM f JOIN w USING (date, code))"]
    for k, n in enumerate(_MINED):
        stages, final, *_ = sql.FACTORS[n]
        last = "wf"
        for j, cols in enumerate([{"t": f"row_number() OVER ({sql.BC}) - 1"}, *stages]):
            ctes.append(f"u{k}_{j} AS (SELECT *, {', '.join(f'{v} AS {c}' for c, v in cols.items())} FROM {last})")
            last = f"u{k}_{j}"
        ctes.append(f"u{k} AS (SELECT date, code, round(({final})::DOUBLE, 12) AS x FROM {last})")
    every = " UNION ALL ".join(f"SELECT '{n}' AS factor, * FROM u{k}" for k, n in enumerate(_MINED))
    layers = _LAYERS.replace("FROM f WINDOW", "FROM wf WINDOW")
    wide = ", ".join(f"max({v}) FILTER (layer = '{layer}') AS \"{layer}_{v}\"" for layer in lifecycle.LAYERS for v in ("m", "t", "n"))
    named = ", ".join(", ".join((sql.rounded(f'"{layer}_m"', 6, f'"{layer}_mean_ic"'), sql.rounded(f'"{layer}_t"', 5, f'"{layer}_t_stat"'), f'"{layer}_n" AS "{layer}_n_days"')) for layer in lifecycle.LAYERS)
    strong = "list_sort(list_filter([" + ", ".join(f"CASE WHEN abs(\"{layer}_t\") >= 2.81 THEN '{layer}' END" for layer in lifecycle.LAYERS[1:]) + "], lambda x: x IS NOT NULL))"
    return f"""WITH {', '.join(ctes)}{layers}, yy AS (SELECT date, code, size_layer || '_' || liq_layer AS cell, lead(close, 5) OVER ({sql.BC}) / close - 1 AS y FROM ly),
 b AS (SELECT factor, date, code, unnest(['all', cell]) AS layer, x, y FROM ({every}) JOIN yy USING (date, code) WHERE x IS NOT NULL AND y IS NOT NULL),
 r AS (SELECT *, {sql.prank('x', 'date, factor, layer')} AS rx, {sql.prank('y', 'date, factor, layer')} AS ry FROM b WHERE layer IS NOT NULL),
 ic AS (SELECT factor, date, layer, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 1e-14 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5),
 c AS (SELECT factor, layer, avg(ic) AS m, CASE WHEN count(ic) >= 10 THEN avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) END AS t, count(ic) AS n FROM ic GROUP BY 1, 2), wd AS (SELECT factor, {wide} FROM c GROUP BY 1),
 dm AS (SELECT *, CASE WHEN abs(all_t) >= 2 THEN 'universal' WHEN len({strong}) > 0 THEN array_to_string({strong}, ',') ELSE 'none' END AS domain FROM wd)
 SELECT factor, 5 AS fwd_window, {named}, domain, CASE WHEN domain = 'none' THEN 0 WHEN all_t > 0 THEN 1 ELSE -1 END AS sign FROM dm"""


@query("mining_screen", _screen_sql())
def mining_screen(spark, sf_dir):
    made = lifecycle.mining_screen(full_panel(spark, sf_dir), _MINED)
    digits = {"mean_ic": 6, "t_stat": 5}
    return made.select(*[rounded(c, next(d for e, d in digits.items() if c.endswith(e))).alias(c) if c.endswith(tuple(digits)) else F.col(c) for c in made.columns])
