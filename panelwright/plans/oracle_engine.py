"""DuckDB SQL of the event-ordered engine and of other day-by-day recursions, written apart from the operators.

A day is one step of a recursive query, and what is held is a list in its row.
"""
from __future__ import annotations

from . import oracle_sql as sql

TRADE = "STRUCT(code VARCHAR, action VARCHAR, price DOUBLE, shares BIGINT, pnl DOUBLE, cost DOUBLE)[]"
HELD = "STRUCT(c VARCHAR, n BIGINT, p DOUBLE)[]"
COST = {"rate": 1e-4, "stamp": 5e-4, "transfer": 1e-5, "least": 5.0, "tick": 0.01}
FREE = {"rate": 0.0, "stamp": 0.0, "transfer": 0.0, "least": 0.0, "tick": 0.0}


def _fees(amount: str, sale: bool, k: dict) -> str:
    if not k["rate"]:
        return "0.0"
    return f"(CASE WHEN {amount} <= 0 THEN 0.0 ELSE greatest({amount} * {k['rate']}, {k['least']}){' + ' + amount + ' * ' + str(k['stamp']) if sale else ''} + {amount} * {k['transfer']} END)"


def _buyable(cash: str, price: str, k: dict) -> str:
    room = f"least(({cash} - {k['least']}) / (1 + {k['transfer']}), {cash} / (1 + {k['rate']} + {k['transfer']}))" if k["rate"] else cash
    return f"(CASE WHEN {room} > 0 AND {price} > 0 THEN floor({room} / {price} / 100)::BIGINT * 100 ELSE 0 END)"


def engine(capital: float = 1_000_000, k: dict = FREE, stop: float | None = None, take: float | None = None, swing: float | None = None, breaker: bool = False, walk: bool = False) -> str:
    """CTEs from days dx (run_id, i, date, period, fresh), quotes p and targets to ``bt`` (run_id, i, period, date, eq, cash, value, back, trades).

    Targets: tg (run_id, date, code, shares); with walk: tg (run_id, period, date, code, weights, x), whose shares follow from the capital that
    the period began with.  With swing, fx (date, code, v0) holds true ranges.
    """
    price, sold = "q[h.c]", f"(q[h.c] - {k['tick']})"
    gain = "(CASE WHEN h.p > 0 THEN (q[h.c] - h.p) / h.p ELSE 0 END)"
    tests = [(f"h.p > 0 AND {price} < h.p - {swing} * a[h.c]", "atr_stop_loss") if swing else None, (f"{gain} < {stop}", "stop_loss") if stop is not None else None, (f"{gain} > {take}", "take_profit") if take is not None else None]
    tests = [t for t in tests if t]
    why = "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{n}'" for c, n in tests) + " END" if tests else "NULL::VARCHAR"

    def sale(n: str, action: str) -> str:
        return f"{{'code': h.c, 'action': {action}, 'price': {sold}, 'shares': {n}, 'pnl': {n} * ({sold} - h.p) - {_fees(f'({n} * {sold})', True, k)}, 'cost': {_fees(f'({n} * {sold})', True, k)}}}"

    px = "b.px"
    n = f"least({_buyable('y.cash', px, k)}, b.w)"
    pay = f"({n} * {px} + {_fees(f'({n} * {px})', False, k)})"
    wanted = "CASE WHEN len(hist) >= 4 AND hist[-4] > 0 AND hist[-1] / hist[-4] - 1 > 0.05 THEN 1.0 WHEN dd >= -0.05 THEN 1.0 WHEN dd <= -0.15 THEN 0.1 ELSE 0.1 + (1 - 0.1) * pow((dd + 0.15) / (-0.05 + 0.15), 2.0) END"
    shares = "t.n"
    if walk:
        lots = "floor(pc * t.ws[1] / t.x / 100) * 100"
        for j in (1, 2):
            lots = f"(CASE WHEN len(t.ws) > {j} THEN CASE WHEN t.ws[{j}] = 0 THEN 0 ELSE floor({lots} * t.ws[{j + 1}] / t.ws[{j}] / 100 + 1e-9) * 100 END ELSE {lots} END)"
        shares = f"coalesce({lots}, 0)::BIGINT"
    scaled = "floor(t.n * active)::BIGINT" if breaker else "t.n"
    targets = "list({'c': code, 'ws': weights, 'x': x} ORDER BY code)" if walk else "list({'c': code, 'n': shares::BIGINT} ORDER BY code) FILTER (shares > 0)"
    swings = ", am AS MATERIALIZED (SELECT date, map_from_entries(list((code, v0))) AS a FROM fx WHERE v0 IS NOT NULL GROUP BY 1)" if swing else ""
    none = "{'c': VARCHAR, 'n': BIGINT}"  # noqa: F841  shape of a target
    return f"""qm AS MATERIALIZED (SELECT date, map_from_entries(list((code, close))) AS q FROM p WHERE close IS NOT NULL GROUP BY 1),
 tm AS MATERIALIZED (SELECT run_id, {'period, ' if walk else ''}date, {targets} AS t FROM tg GROUP BY ALL){swings},
 rd AS MATERIALIZED (SELECT dx.*, q, t{', a' if swing else ''} FROM dx JOIN qm USING (date) LEFT JOIN tm USING (run_id, {'period, ' if walk else ''}date){' LEFT JOIN am USING (date)' if swing else ''}),
 r0 AS (SELECT DISTINCT run_id FROM dx),
 bt AS (SELECT run_id, 0::BIGINT AS i, NULL::INTEGER AS period, NULL::DATE AS date, {capital}::DOUBLE AS cash, []::{HELD} AS held, NULL::DOUBLE AS eq, 0.0::DOUBLE AS value, 0.0::DOUBLE AS back, []::{TRADE} AS trades, [{capital}::DOUBLE] AS hist, 0.0::DOUBLE AS peak, 1.0::DOUBLE AS active, {capital}::DOUBLE AS pc FROM r0
 UNION ALL SELECT run_id, i, period, date, cash2, held2, cash2 + v, v, CASE WHEN eq IS NULL OR eq = 0 THEN 0.0 ELSE (cash2 + v) / eq - 1 END, list_concat(stops, list_concat(sales, bought)), list_concat(hist, [cash2 + v])[-4:], peak, active, pc FROM (
 SELECT *, held1 + acc.got AS held2, acc.cash AS cash2, acc.tr AS bought, coalesce(list_sum(list_transform(held1 + acc.got, lambda h: h.n * coalesce(q[h.c], 0.0))), 0.0) AS v FROM (
 SELECT *, list_reduce([{{'c': '', 'w': 0::BIGINT, 'px': 0.0::DOUBLE, 'cash': cash1, 'got': []::{HELD}, 'tr': []::{TRADE}}}] + list_transform(list_filter(goal, lambda t: q[t.c] IS NOT NULL AND NOT list_contains(list_transform(held1, lambda h: h.c), t.c) AND NOT list_contains(list_transform(stops, lambda h: h.code), t.c)), lambda t: {{'c': t.c, 'w': t.n, 'px': (q[t.c] + {k['tick']})::DOUBLE, 'cash': 0.0::DOUBLE, 'got': []::{HELD}, 'tr': []::{TRADE}}}),
 lambda y, b: CASE WHEN {n} > 0 AND {pay} <= y.cash + 0.01 THEN {{'c': b.c, 'w': b.w, 'px': b.px, 'cash': y.cash - {pay}, 'got': y.got + [{{'c': b.c, 'n': {n}, 'p': {pay} / {n}}}], 'tr': y.tr + [{{'code': b.c, 'action': 'buy', 'price': {px}, 'shares': {n}, 'pnl': 0.0::DOUBLE, 'cost': {_fees(f'({n} * {px})', False, k)}::DOUBLE}}]}} ELSE y END) AS acc FROM (
 SELECT *, list_filter(list_transform(kept, lambda h: {{'c': h.c, 'n': CASE WHEN q[h.c] IS NULL THEN h.n ELSE least(h.n, coalesce(want[h.c], 0)) END, 'p': h.p}}), lambda h: h.n > 0)::{HELD} AS held1,
 cash + coalesce(list_sum(list_transform(stops + sales, lambda s: s.shares * s.price - s.cost)), 0.0) AS cash1 FROM (
 SELECT *, list_transform(list_filter(kept, lambda h: q[h.c] IS NOT NULL AND h.n > coalesce(want[h.c], 0)), lambda h: {sale('(h.n - coalesce(want[h.c], 0))', "CASE WHEN coalesce(want[h.c], 0) = 0 THEN 'sell' ELSE 'cb_compress' END")})::{TRADE} AS sales FROM (
 SELECT *, list_transform(list_filter(held, lambda h: q[h.c] IS NOT NULL AND {why} IS NOT NULL), lambda h: {sale('h.n', why)})::{TRADE} AS stops, list_filter(held, lambda h: NOT (q[h.c] IS NOT NULL AND {why} IS NOT NULL)) AS kept,
 map_from_entries(list_transform(goal, lambda t: (t.c, t.n))) AS want FROM (
 SELECT *, list_filter(list_transform(coalesce(t0, []), lambda t: {{'c': t.c, 'n': {scaled}}}), lambda t: t.n > 0) AS goal FROM (
 SELECT *, {f'CASE WHEN abs({wanted} - active0) > 0.05 THEN {wanted} ELSE active0 END' if breaker else '1.0'}::DOUBLE AS active, {"list_transform(t1, lambda t: {'c': t.c, 'n': " + shares + "})" if walk else 't1'} AS t0 FROM (
 SELECT *, CASE WHEN peak > 0 THEN (hist[-1] - peak) / peak ELSE 0.0 END AS dd FROM (
 SELECT rd.run_id, rd.i, rd.period, rd.date, rd.q, rd.t AS t1, {'rd.a, ' if swing else ''}CASE WHEN rd.fresh AND bt.eq IS NOT NULL THEN bt.eq ELSE bt.cash END AS cash, CASE WHEN rd.fresh THEN []::{HELD} ELSE bt.held END AS held, CASE WHEN rd.fresh THEN NULL ELSE bt.eq END AS eq, bt.hist, greatest(bt.peak, bt.hist[-1]) AS peak, bt.active AS active0, CASE WHEN rd.fresh THEN coalesce(bt.eq, bt.pc) ELSE bt.pc END AS pc
 FROM bt JOIN rd ON rd.run_id = bt.run_id AND rd.i = bt.i + 1)))))))))) )""".replace(")))))))))) )", "))))))))))")


DAYS = "dt AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM p))"


def days_of(runs: str) -> str:
    """dx: all days for each of the runs (SQL that yields run_id)."""
    return f"{DAYS}, dx AS (SELECT run_id, i, date, 0 AS period, false AS fresh FROM ({runs}), dt)"


def figures(capital: float = 1_000_000) -> str:
    """CTE fg: the metrics of each run from bt."""
    return f"""be AS (SELECT *, max(eq) OVER (PARTITION BY run_id ORDER BY date) AS top FROM bt WHERE i > 0),
 bf AS (SELECT run_id, arg_max(eq, date) / {capital} - 1 AS total, count(*) AS days, avg(back - 0.03 / 252) AS m, stddev_pop(back - 0.03 / 252) AS s, max(abs(CASE WHEN top > 0 THEN (eq - top) / top ELSE eq - top END)) AS max_drawdown FROM be GROUP BY 1),
 bx AS (SELECT run_id, unnest(trades, recursive := true) FROM bt WHERE len(trades) > 0),
 by_ AS (SELECT run_id, count(*) FILTER (action IN ('sell', 'stop_loss', 'take_profit', 'atr_stop_loss')) AS ex, count(*) FILTER (action IN ('sell', 'stop_loss', 'take_profit', 'atr_stop_loss') AND pnl > 0) AS won, count(*) AS trade_count, sum(cost) AS total_cost, sum(shares * price) AS turned FROM bx GROUP BY 1),
 fg AS (SELECT run_id, total AS total_return, CASE WHEN days > 1 AND total > -1 THEN pow(1 + total, 252.0 / days) - 1 ELSE 0 END AS annual_return, CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END AS sharpe_ratio, max_drawdown, coalesce(won / nullif(ex, 0), 0.0) AS win_rate, coalesce(trade_count, 0) AS trade_count, coalesce(total_cost, 0.0) AS total_cost, coalesce(total_cost / nullif(turned, 0), 0.0) AS cost_ratio FROM bf LEFT JOIN by_ USING (run_id))"""


FIGURES = ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "total_cost", "cost_ratio")
SELECT_FIGURES = ", ".join(sql.rounded(c, 6, c) for c in FIGURES) + ", trade_count"


def equal_weights(signals: str, capital: float = 1_000_000, run: str | None = None) -> str:
    """SELECT run_id, date, code, weight, shares of a signal table."""
    keys = "run_id, " if run is None else ""
    return f"SELECT {'run_id' if run is None else repr(run)} AS run_id, date, code, weight, coalesce(floor({capital} * weight / close / 100) * 100, 0) AS shares FROM (SELECT {keys}date, code, 1.0 / count(*) OVER (PARTITION BY {keys}date) AS weight FROM {signals} WHERE signal = 1) LEFT JOIN p USING (date, code)"


def limited(base: str, limit: float, name: str = "lim") -> str:
    """CTEs from base (run_id, date, code, weight, shares) to ``<name>``: weights clipped and spread again and again."""
    day = "OVER (PARTITION BY run_id, date)"
    return f"""{name}0 AS (SELECT 0 AS it, run_id, date, code, weight AS w FROM {base}
 UNION ALL SELECT it + 1, run_id, date, code, CASE WHEN w < {limit} - 1e-10 THEN w + ex / nullif(fr, 0) ELSE least(w, {limit}) END FROM (SELECT *, sum(greatest(w - {limit}, 0)) {day} AS ex, count(*) FILTER (w < {limit} - 1e-10) {day} AS fr FROM {name}0) WHERE ex > 1e-10 AND it < 60),
 {name}1 AS (SELECT run_id, date, code, arg_max(w, it) AS w FROM {name}0 GROUP BY 1, 2, 3),
 {name} AS (SELECT run_id, date, code, w AS weight, CASE WHEN b.weight > 0 THEN floor(w * (shares / b.weight) / 100 + 1e-9) * 100 ELSE 0 END::BIGINT AS shares FROM {name}1 JOIN {base} b USING (run_id, date, code))"""


def smoothed(base: str, zone: float, capital: float = 1_000_000) -> str:
    """CTEs from base (run_id, date, code, weight) to ``smo`` (run_id, date, code, weight, shares): yesterday's weight where the change is under the zone."""
    return f"""sd AS (SELECT run_id, date, row_number() OVER (PARTITION BY run_id ORDER BY date) AS i FROM (SELECT DISTINCT run_id, date FROM {base})),
 sg AS MATERIALIZED (SELECT sd.run_id, sd.i, sd.date, c.code, coalesce(b.weight, 0.0) AS w FROM sd JOIN (SELECT DISTINCT run_id, code FROM {base}) c USING (run_id) LEFT JOIN {base} b ON b.run_id = sd.run_id AND b.date = sd.date AND b.code = c.code),
 sm AS (SELECT run_id, 1::BIGINT AS i, date, code, w / sum(w) OVER (PARTITION BY run_id) AS w FROM sg WHERE i = 1
 UNION ALL SELECT run_id, i, date, code, CASE WHEN t > 0 THEN w / t ELSE w END FROM (SELECT *, sum(w) OVER (PARTITION BY run_id) AS t FROM (SELECT sg.run_id, sg.i, sg.date, sg.code, CASE WHEN abs(sg.w - sm.w) >= {zone} THEN sg.w ELSE sm.w END AS w FROM sm JOIN sg ON sg.run_id = sm.run_id AND sg.i = sm.i + 1 AND sg.code = sm.code))),
 so AS (SELECT run_id, date, code, w AS weight, last_value(close IGNORE NULLS) OVER (PARTITION BY run_id, code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM sm LEFT JOIN p USING (date, code) WHERE w > 0),
 smo AS (SELECT run_id, date, code, weight, coalesce(floor({capital} * weight / nullif(close, 0) / 100) * 100, 0)::BIGINT AS shares FROM so)"""


def walk_days(train: int, test: int, rest: bool = True) -> str:
    """CTEs wn (period, start, stop) - from the panel's first date to its last - and dx, the days of each period in turn, for run 'walk'.

    Only periods with targets (tw: period) are played."""
    return f"""wl AS (SELECT min(date) AS f, max(date) AS l FROM p), wa AS (SELECT k AS period, f + to_months((k * {test})::INTEGER) AS cur, l, f FROM wl, range(400) t(k)),
 wc AS (SELECT period, (cur + INTERVAL {train} MONTH)::DATE + 1 AS start, l FROM wa), wd AS (SELECT period, start, (start + INTERVAL {test} MONTH)::DATE AS stop, l FROM wc), wf AS (SELECT period, start, stop FROM wd WHERE stop <= l),
 wn AS (SELECT * FROM wf {f"UNION ALL SELECT (SELECT count(*) FROM wf), coalesce((SELECT max(stop) FROM wf), (f + INTERVAL {train} MONTH)::DATE), l FROM wl WHERE coalesce((SELECT max(stop) FROM wf), (f + INTERVAL {train} MONTH)::DATE) < l" if rest else ''})"""


def walk_dx(targets: str) -> str:
    return f"""wp AS (SELECT DISTINCT period FROM {targets}), dx AS (SELECT 'walk' AS run_id, row_number() OVER (ORDER BY period, date) AS i, date, period, date = min(date) OVER (PARTITION BY period) AS fresh FROM (SELECT DISTINCT date FROM p) JOIN wn ON date BETWEEN start AND stop JOIN wp USING (period))"""


def walk_figures(capital: float = 1_000_000) -> str:
    """CTE wo: one row of chained figures with the periods' Sharpe ratios, from bt of a walk."""
    return f"""bw AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY i) AS k, min(period) OVER () AS p0 FROM bt WHERE i > 0),
 bc AS (SELECT *, max(eq) OVER (ORDER BY i) AS top, eq / lag(eq) OVER (ORDER BY i) - 1 - 0.03 / 252 AS x FROM bw WHERE period = p0 OR k > 1),
 bs AS (SELECT period, CASE WHEN stddev_pop(back - 0.03 / 252) > 0 THEN avg(back - 0.03 / 252) / stddev_pop(back - 0.03 / 252) * sqrt(252) ELSE 0 END AS s FROM bw GROUP BY 1),
 ba AS (SELECT period, coalesce(s, 0.0) AS s FROM wn LEFT JOIN bs USING (period) WHERE EXISTS (SELECT 1 FROM p WHERE date BETWEEN start AND stop)),
 wo AS (SELECT arg_max(eq, i) / {capital} - 1 AS total_return, CASE WHEN count(*) > 1 AND arg_max(eq, i) > 0 THEN pow(arg_max(eq, i) / {capital}, 252.0 / count(*)) - 1 ELSE 0 END AS annual_return, CASE WHEN stddev_pop(x) > 1e-10 THEN avg(x) / stddev_pop(x) * sqrt(252) ELSE 0 END AS sharpe_ratio, max(abs((eq - top) / top)) AS max_drawdown, (SELECT avg(s) FROM ba) AS per_period_sharpe_mean, (SELECT coalesce(stddev_samp(s), 0) FROM ba) AS per_period_sharpe_std FROM bc)"""


WALK = ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "per_period_sharpe_mean", "per_period_sharpe_std")
SELECT_WALK = ", ".join(sql.rounded(c, 6, c) for c in WALK) + ", " + sql.rounded("CASE WHEN per_period_sharpe_std > 1e-10 THEN per_period_sharpe_mean / per_period_sharpe_std ELSE 0 END", 6, "per_period_ir")


# states by hysteresis


def states(rolled: str, least: int) -> str:
    """CTEs from rolled (date, factor, fwd_window, ic, k, m, s) to ``st``: state, sustain_days and the state before a change."""
    return f"""t0 AS (SELECT *, CASE WHEN k >= 20 THEN m END AS rolling_ic, CASE WHEN k >= 20 THEN m / nullif(s, 0) END AS rolling_ir, CASE WHEN k >= 20 THEN m / nullif(s, 0) * sqrt(k) END AS t_stat, row_number() OVER (PARTITION BY factor, fwd_window ORDER BY date) AS i FROM {rolled}),
 tc AS MATERIALIZED (SELECT *, CASE WHEN t_stat IS NULL THEN 'dead' WHEN t_stat <= -2 THEN 'reverse' WHEN t_stat >= 2 THEN 'active' WHEN t_stat >= 1 THEN 'decaying' ELSE 'dead' END AS c FROM t0),
 hy AS (SELECT factor, fwd_window, 1::BIGINT AS i, c AS now, NULL::VARCHAR AS w, 0 AS d FROM tc WHERE i = 1
 UNION ALL SELECT factor, fwd_window, i, CASE WHEN d >= {least} THEN c ELSE now END, CASE WHEN c = now OR d >= {least} THEN NULL ELSE c END, CASE WHEN c = now OR d >= {least} THEN 0 ELSE d END
 FROM (SELECT tc.factor, tc.fwd_window, tc.i, tc.c, hy.now, CASE WHEN tc.c = hy.now THEN 0 WHEN tc.c = hy.w THEN hy.d + 1 ELSE 1 END AS d FROM hy JOIN tc ON tc.factor = hy.factor AND tc.fwd_window = hy.fwd_window AND tc.i = hy.i + 1)),
 h1 AS (SELECT *, lag(now) OVER f AS b FROM hy WINDOW f AS (PARTITION BY factor, fwd_window ORDER BY i)), h2 AS (SELECT *, count(*) FILTER (b IS DISTINCT FROM now) OVER (PARTITION BY factor, fwd_window ORDER BY i) AS g FROM h1),
 st AS (SELECT tc.date, factor, fwd_window, ic, rolling_ic, rolling_ir, t_stat, now AS state, row_number() OVER (PARTITION BY factor, fwd_window, g ORDER BY i) AS sustain_days, CASE WHEN b <> now THEN b END AS old_state FROM h2 JOIN tc USING (factor, fwd_window, i))"""
