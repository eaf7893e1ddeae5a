import datetime
import json

import pytest
from pyspark.sql import functions as F

from panelwright import cli, config
from panelwright.operators import factors
from panelwright.sources import io
from panelwright.streaming import bars

D = datetime.date


def rows(spark, n=12):
    return spark.createDataFrame([(D(2024, 1, 1 + i), c, 10.0 + i * k, 11.0 + i * k, 9.0, 10.5 + i * k, 100.0 + i) for i in range(n) for k, c in ((1, "600001"), (2, "600002"))], "date date, code string, open double, high double, low double, close double, volume double")


def test_parquet_and_panel(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.load_parquet(spark, str(tmp_path / "none"))
    path = io.save_parquet(rows(spark), str(tmp_path / "p"), ["code"])
    assert io.load_parquet(spark, path).count() == 24
    raw = spark.createDataFrame([("2024-01-02 00:00:00", "600001.SH", float("nan"), 5)], "date string, code string, close double, volume long").withColumn("date", F.to_timestamp("date"))
    assert io.as_panel(raw).first().asDict() == {"date": D(2024, 1, 2), "code": "600001", "close": None, "volume": 5.0}


def test_snapshots_listing_calendar(spark):
    s = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", D(2024, 2, 1)), ("c", D(2024, 2, 1))], "code string, trade_date date")
    assert io.latest_snapshot(s).count() == 2 and io.latest_snapshot(s, D(2024, 1, 15)).first()["code"] == "a"
    names = spark.createDataFrame([("600001", "x"), ("600002", "*ST y"), ("830001", "z"), ("920001", "w")], "code string, name string")
    assert [r["code"] for r in io.listed_stocks(names).collect()] == ["600001"]
    cal = spark.createDataFrame([(D(2024, 1, 1), 0), (D(2024, 1, 2), 1)], "cal_date date, is_open int")
    assert not io.is_trading_day(cal, D(2024, 1, 1)) and io.is_trading_day(cal, D(2024, 1, 2))


def test_backfill_repeats_failures():
    tried = []

    def fetch(d):
        tried.append(d)
        if d.day == 2 and tried.count(d) < 2 or d.day == 3:
            raise OSError

    days = [D(2024, 1, k) for k in range(1, 5)]
    assert io.backfill_range(days, lambda d: d.day == 4, fetch) == [D(2024, 1, 3)] and tried.count(D(2024, 1, 1)) == 1


def test_factor_cache(spark, tmp_path):
    df, root = rows(spark), str(tmp_path / "cache")
    a = io.cached_factor(df, "calc_rsi", root, window=5)
    assert a.count() == 24 and io.cache_info(spark, root)["files"] > 0
    assert io.fingerprint(df) == io.fingerprint(df.repartition(3)) != io.fingerprint(df.withColumn("date", F.date_add("date", 1)))
    assert io.params_hash({"a": 1, "b": 2}) == io.params_hash({"b": 2, "a": 1})
    assert io.clear_factor_cache(spark, root) and io.cache_info(spark, root)["files"] == 0


def test_states_are_versioned(spark, tmp_path):
    root = str(tmp_path / "s")
    assert io.load_state(spark, root) is None
    s = spark.createDataFrame([(D(2024, 1, 1), "f", 5, 1.0)], "date date, factor string, fwd_window int, ic double")
    io.save_state(s, root)
    io.save_state(io.load_state(spark, root).union(io.load_state(spark, root)), root)
    assert io.load_state(spark, root).count() == 2


def test_updates_write_their_own_dates(spark, tmp_path):
    """Files of earlier dates stay as they are; each version reads as it was; a race has one winner."""
    from panelwright.sources import dated

    root = f"file://{tmp_path}/s"

    def table(first, n, v):
        return spark.createDataFrame([(D(2024, 1, d), v) for d in range(first, first + n)], "date date, v int")

    def values(version=None):
        return {r["date"].day: r["v"] for r in dated.read(spark, root, "states", version).collect()}

    assert dated.manifest(spark, root) == {} and dated.read(spark, root, "states") is None
    io.save_state(table(1, 10, 1), root)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert io.save_state(table(5, 10, 2), root, D(2024, 1, 8)) == 1
    dated.publish(spark, root, {"other": (table(1, 3, 9), None)})
    assert values() == {d: 1 if d < 8 else 2 for d in range(1, 15)} and values(0) == {d: 1 for d in range(1, 11)}
    io.save_state(table(9, 2, 3), root, D(2024, 1, 9))
    assert values() == {**{d: 1 for d in range(1, 8)}, 8: 2, 9: 3, 10: 3} and values(1)[9] == 2
    assert {p: p.stat().st_mtime_ns for p in files} == files
    dated.publish(spark, root, {"other": (table(4, 1, 8), dated.APPEND)})
    assert dated.read(spark, root, "other").count() == 4
    before = values()
    dated.compact(spark, root, "states")
    assert values() == before and len(dated.manifest(spark, root)["states"]) == 1 and dated.clean(spark, root, 1) == 3
    assert values() == before and dated.versions(spark, root) == [5]
    late = dated.put(spark, root, "states", table(1, 1, 7))
    (tmp_path / "s/versions/000000006.json").write_text("{}")  # another writer, between reading and renaming
    with pytest.MonkeyPatch.context() as m:
        m.setattr(dated, "versions", lambda *a: [5])
        with pytest.raises(RuntimeError):
            dated.commit(spark, root, [late])


def test_factors_are_cached_by_date(spark, tmp_path):
    """New dates go on from what is kept; a changed date is made anew with all that follow; nothing new, nothing written."""
    names, root = ["calc_macd_like", "calc_obv", "calc_momentum_5d_change"], f"file://{tmp_path}/c"
    df = rows(spark, 30)

    def values(table):
        return {(r["date"], r["code"]): tuple(None if r[n] is None else round(r[n], 9) for n in names) for r in table.collect()}

    def cut(day):
        return df.filter(F.col("date") <= F.lit(D(2024, 1, day)))

    got, first = io.cached_factors(cut(20), names, root)
    assert first == D(2024, 1, 1) and values(got) == values(factors.with_factors(cut(20), names))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "scored" in str(p)}
    got, first = io.cached_factors(df, names, root)
    assert first == D(2024, 1, 21) and values(got) == values(factors.with_factors(df, names))
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert io.cached_factors(df.repartition(5), names, root)[1] is None
    other = df.withColumn("close", F.when((F.col("date") == F.lit(D(2024, 1, 12))) & (F.col("code") == "600001"), 1.0).otherwise(F.col("close")))
    got, first = io.cached_factors(other, names, root)
    assert first == D(2024, 1, 12) and values(got) == values(factors.with_factors(other, names))
    fewer = other.filter(F.col("date") < F.lit(D(2024, 1, 25)))
    got, first = io.cached_factors(fewer, names, root)
    assert first == D(2024, 1, 25) and values(got) == values(factors.with_factors(fewer, names))


def test_config(spark):
    c = {"strategies": {"a": {"type": "gtja_momentum", "params": {"rebalance": 5}, "weight": 2}, "b": {"type": "mean_reversion", "reversed": True}, "c": {"enabled": False}}, "risk": {"position_limit": {"max_weight": 0.2}, "t1": None}, "backtest": {"capital": 5, "trading_cost": {}, "circuit_breaker": {}, "atr_stop_loss": {"atr_multiplier": 2}}}
    assert [n for n, _, _ in config.build_strategies(config.check_config(c))] == ["a", "b"]
    assert [r.name for r in config.build_risk_rules(c)] == ["position_limit", "t1"] and config.build_engine(c).atr_multiplier == 2
    assert config.build_combined_strategy(c)(rows(spark)).count() == 24
    for bad in ({}, {"strategies": {}}):
        with pytest.raises(ValueError):
            config.check_config(bad)
    with pytest.raises(ValueError):
        config.lifecycle_config({"t_decay": 3.0})
    with pytest.raises(ValueError):
        config.lifecycle_config({"odd": 1})
    assert config.lifecycle_config({"top_k": 2}).top_k == 2


def test_command_line(spark, tmp_path, capsys):
    path = io.save_parquet(rows(spark), str(tmp_path / "p"))
    assert cli.main(["factor", "list", "--tag", "momentum"]) == 0 and "gtja_14" in capsys.readouterr().out
    cli.main(["factor", "run", "--data", path, "--name", "calc_rsi", "--param", "window=5", "--json"])
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 24 and {"date", "code"} <= set(json.loads(lines[0]))
    cli.main(["factor", "evaluate", "--data", path, "--name", "calc_obv", "--window", "1", "--json"])
    cli.main(["cache", "info", "--root", str(tmp_path / "none")])
    with pytest.raises(SystemExit):
        cli.parse_params(["x"])


def test_streams(spark, tmp_path):
    df = rows(spark)
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = bars.running_obv(stream).writeStream.format("memory").queryName("obv").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["code"], r["date"]): r["obv"] for r in spark.table("obv").collect()}
    want = {(r["code"], r["date"]): r["calc_obv"] for r in factors.with_factor(df, "calc_obv").collect()}
    assert got == want
    ticks = df.select(F.to_timestamp("date").alias("ts"), "code", F.col("close").alias("value"))
    src2 = str(tmp_path / "ticks")
    ticks.coalesce(1).write.parquet(src2)
    q = bars.stream_bars(spark.readStream.schema(ticks.schema).parquet(src2)).writeStream.format("memory").queryName("bars").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bars").count() == 24


def test_vendor_tables(spark, tmp_path):
    import datetime

    from panelwright.sources import vendor

    d = datetime.date
    bars = spark.createDataFrame([("600001.SH", "20240102", 1.0, 2.0, 0.5, 1.5, 1.1, 300.0), ("000002.SZ", "20240103", 1.0, 2.0, 0.5, None, 1.1, 0.0)], "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, vol double")
    got = vendor.daily(bars, ["600001.SH"], d(2024, 1, 1), d(2024, 1, 2)).collect()
    assert [(r["date"], r["code"], r["volume"]) for r in got] == [(d(2024, 1, 2), "600001", 300.0)]
    forecast = spark.createDataFrame([("600001.SH", "20240110", "20231231", "预增", 10.0, 30.0), ("600002.SH", "bad", "20231231", "续亏", None, 4.0)], "ts_code string, ann_date string, end_date string, type string, net_profit_min double, net_profit_max double")
    express = spark.createDataFrame([("600001.SH", 20240120, "20231231", "25.5", None)], "ts_code string, ann_date int, end_date string, n_income_attr_p string, increase_rate double")
    events = {(r["code"], r["event_type"]): r for r in vendor.earnings_events(forecast, express).collect()}
    assert events["600001", "forecast"]["predicted_profit"] == 20.0 and events["600002", "forecast"]["predicted_profit"] == 4.0 and events["600002", "forecast"]["ann_date"] is None
    assert events["600001", "express"]["actual_profit"] == 25.5 and events["600001", "express"]["ann_date"] == d(2024, 1, 20)
    flow = spark.createDataFrame([("600001.SH", "20240102", 5.0)], "ts_code string, trade_date string, net_mf_amount double")
    out = vendor.money_flow(flow)
    assert len(out.columns) == 20 and out.first()["net_mf_amount"] == 5.0 and out.first()["buy_sm_vol"] is None
    figures = spark.createDataFrame([("600001.SH", day, "x", 2.0, 30_000.0, 20_000.0, 1.0) for day in ("20240102", "20240106")], "ts_code string, trade_date string, pe string, pb double, total_mv double, circ_mv double, turnover_rate double")
    calendar = spark.createDataFrame([(d(2024, 1, 2), 1), (d(2024, 1, 6), 0)], "cal_date date, is_open int")
    row = vendor.over_days(vendor.daily_figures(figures), calendar, d(2024, 1, 1), d(2024, 1, 31)).collect()
    assert len(row) == 1 and row[0]["total_mv"] == 3.0 and row[0]["pe"] is None
    figures.write.parquet(f"{tmp_path}/f")
    assert vendor.read_folder(spark, f"{tmp_path}/f", "figures").count() == 2
    with pytest.raises(ValueError):
        vendor.read_folder(spark, str(tmp_path), "odd")


def test_rows_put_by_date_are_made_once(spark, tmp_path):
    """Ranges of dates are drawn from a sample, which must not make the rows again; nothing but the segment stays."""
    import datetime

    from pyspark.sql import functions as F
    from panelwright.sources import dated

    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(k):
        made.add(1)
        return k

    day = F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("id").cast("int"))
    segment = dated.put(spark, str(tmp_path), "t", spark.range(40).select(day.alias("date"), counted("id").alias("k")))
    assert made.value == 40 and sorted(r["k"] for r in spark.read.parquet(segment.path).collect()) == list(range(40))
