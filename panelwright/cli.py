"""Command line: python -m panelwright.cli factor list|run|evaluate|monitor, clean-a|-b|-c, mining-screen, cache info|clear."""
from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import LifecycleConfig
from .operators import backtest, evaluation, factors, lifecycle
from .sources import io


def parse_params(items: list[str]) -> dict:
    """key=value pairs; numbers and booleans are read as such."""
    out = {}
    for item in items:
        key, eq, value = item.partition("=")
        if not eq:
            raise SystemExit(f"not key=value: {item}")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def show(df: DataFrame, args) -> None:
    """Up to --limit rows as JSON lines (missing values as null) or as a table."""
    if args.json:
        for line in df.limit(args.limit).toJSON().toLocalIterator():
            print(line)
    else:
        df.show(args.limit, truncate=False)


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelwright").getOrCreate()


def _factor(args) -> None:
    if args.what == "list":
        for name in factors.list_factors(args.tag, args.kind):
            spec = factors.get_spec(name)
            print(name, ",".join(spec.tags), spec.alias_of or "", json.dumps(spec.params))
        return
    data = io.as_panel(io.load_parquet(_session(), args.data))
    if args.what == "run":
        out = factors.with_factor(data, args.name, **parse_params(args.param)).select("date", "code", args.name)
    elif args.what == "evaluate":
        names = args.name.split(",")
        out = evaluation.evaluate_factors(data if set(names) <= set(data.columns) else factors.with_factors(data, names), names, tuple(args.window))
    else:
        limits = {"active": args.active, "decay": args.decay, "min_sustain": args.min_sustain, "exclude_untradable": not args.keep_untradable}
        asked = (args.name.split(",") if args.name else None, tuple(args.window), args.rolling, args.min_periods)
        if args.out:
            changes, skipped = lifecycle.run_monitor(data, args.out, *asked, full=args.full, **limits)
            changes = changes.persist()
            if not changes.isEmpty():
                io.save_changes(changes, args.out)
            print(lifecycle.render_changes(changes))
            changes.unpersist()
            states = io.load_state(data.sparkSession, args.out)
        else:
            states, _, skipped, _ = lifecycle.update_monitor(data, None, None, *asked, **limits)
        for name in skipped:
            print("skipped:", name)
        out = lifecycle.status_table(states)
        args.out = None
    if args.out:
        io.save_parquet(out, args.out)
    show(out, args)


def _clean(args) -> None:
    spark, c = _session(), LifecycleConfig(**parse_params(args.param))
    data = io.as_panel(io.load_parquet(spark, args.data))
    if args.command == "clean-b":
        ends = data.selectExpr("min(date)", "max(date)").first()
        states = io.load_state(spark, args.state) if args.state else lifecycle.monitor(data, args.name.split(",") if args.name else None)
        periods, summary = lifecycle.phase_b(data, states, lifecycle.oos_windows(ends[0], ends[1], c.train_months, c.test_months), c.top_k, c.window, c.n_iters, c.fwd_window, c.corr_window, c.threshold, c.linkage, c.representative)
        show(periods, args)
        show(summary, args)
        return
    if args.command == "clean-a":
        states = io.load_state(spark, args.state) if args.state else lifecycle.monitor(data)
        show(lifecycle.phase_a(data, states, c.corr_window, c.threshold, c.linkage, c.representative, c.fwd_window), args)
    elif args.command == "clean-c":
        names = args.name.split(",")
        states = io.load_state(spark, args.state) if args.state else lifecycle.monitor(data, names) if args.weighting == "ic_weighted" else None
        as_of = data.selectExpr("max(date)").first()[0]
        weights = lifecycle.synth_weights(states, names, as_of, args.weighting, c.fwd_window)
        compare = lifecycle.phase_c(data, weights, c.rebalance, c.top_n, c.bottom_n, backtest.Engine(cost=backtest.TradingCost())).persist()
        show(compare, args)
        show(lifecycle.phase_c_summary(compare), args)
        compare.unpersist()
    else:
        show(lifecycle.mining_screen(data, args.name.split(",")), args)


def _cache(args) -> None:
    if args.what == "info":
        print(json.dumps(io.cache_info(_session(), args.root)))
    else:
        print(json.dumps({"cleared": io.clear_factor_cache(_session(), args.root, args.name)}))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelwright")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--limit", type=int, default=50)
    f = sub.add_parser("factor", parents=[shared])
    f.add_argument("what", choices=["list", "run", "evaluate", "monitor"])
    f.add_argument("--data")
    f.add_argument("--name", default="")
    f.add_argument("--param", nargs="*", default=[])
    f.add_argument("--window", type=int, nargs="*", default=[5])
    f.add_argument("--tag")
    f.add_argument("--kind")
    f.add_argument("--out")
    f.add_argument("--rolling", type=int, default=60)
    f.add_argument("--min-periods", type=int, default=20)
    f.add_argument("--active", type=float, default=2.0)
    f.add_argument("--decay", type=float, default=1.0)
    f.add_argument("--min-sustain", type=int, default=20)
    f.add_argument("--keep-untradable", action="store_true")
    f.add_argument("--full", action="store_true")
    f.set_defaults(run=_factor)
    for name in ("clean-a", "clean-b", "clean-c", "mining-screen"):
        c = sub.add_parser(name, parents=[shared])
        c.add_argument("--data", required=True)
        c.add_argument("--state")
        c.add_argument("--name", default="")
        c.add_argument("--weighting", choices=["equal", "ic_weighted"], default="equal")
        c.add_argument("--param", nargs="*", default=[])
        c.set_defaults(run=_clean)
    k = sub.add_parser("cache", parents=[shared])
    k.add_argument("what", choices=["info", "clear"])
    k.add_argument("--root", required=True)
    k.add_argument("--name")
    k.set_defaults(run=_cache)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.run(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
