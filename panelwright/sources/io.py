"""Tables in and out: parquet, partitioned caches, snapshots, calendars, vendor-shaped projections, factor and state stores.

Vendor downloads stay outside the engine: these readers take the files that an ingestion job leaves, with the same shapes.
"""
from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from datetime import date as Day

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dated

#: Exchange code prefixes that the listing leaves out.
OTHER_BOARD_PREFIXES = ("4", "8", "920")


def save_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


def as_panel(df: DataFrame) -> DataFrame:
    """Dates as dates, codes as six digits without suffix, numbers as doubles with NaN made null."""
    from ..functions.nulls import clean

    out = df.withColumns({"date": F.to_date("date"), "code": F.substring_index(F.col("code").cast("string"), ".", 1)})
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal") and f.name != "code"]
    return out.withColumns({c: clean(F.col(c)) for c in numbers})


def latest_snapshot(df: DataFrame, as_of=None, column: str = "trade_date") -> DataFrame:
    """Index constituents: the rows of the latest snapshot, up to as_of if given."""
    if as_of is not None:
        df = df.filter(F.col(column) <= F.lit(as_of))
    last = df.agg(F.max(column).alias("__last"))
    return df.join(F.broadcast(last), F.col(column) == F.col("__last")).drop("__last")


def listed_stocks(df: DataFrame) -> DataFrame:
    """code, name without special treatment and without the boards of OTHER_BOARD_PREFIXES."""
    out = df.filter(~F.col("name").contains("ST"))
    for p in OTHER_BOARD_PREFIXES:
        out = out.filter(~F.col("code").startswith(p))
    return out.filter(F.col("market") != "北交所") if "market" in df.columns else out


def fundamentals(df: DataFrame) -> DataFrame:
    """Daily figures: market values from ten thousands to hundred millions."""
    return df.withColumns({c: F.col(c) / 10_000 for c in ("total_mv", "circ_mv") if c in df.columns})


def trading_days(calendar: DataFrame, start=None, end=None) -> DataFrame:
    """cal_date of open days within the bounds."""
    out = calendar.filter(F.col("is_open") == 1).select(F.to_date("cal_date").alias("cal_date")).distinct()
    out = out if start is None else out.filter(F.col("cal_date") >= F.lit(start))
    return out if end is None else out.filter(F.col("cal_date") <= F.lit(end))


def is_trading_day(calendar: DataFrame, day: Day) -> bool:
    return not trading_days(calendar, day, day).isEmpty()


def union_days(parts: list[DataFrame]) -> DataFrame:
    """One table of per-day or per-code tables; columns by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def backfill_range(days: list[Day], done: Callable[[Day], bool], fetch: Callable[[Day], object], rounds: int = 3, pause: float = 0.0) -> list[Day]:
    """Fetch the days that are not done, in rounds; the days that still fail.  Each day's output is its own partition, so repeating is safe."""
    left = [d for d in days if not done(d)]
    for k in range(rounds):
        failed = []
        for d in left:
            try:
                fetch(d)
            except Exception:  # noqa: BLE001  any vendor error is retried in the next round
                failed.append(d)
        left = failed
        if not left:
            break
        time.sleep(pause * 2**k)
    return left


# factor results


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(df: DataFrame) -> str:
    """Order-free digest of all cells, keys included."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.columns)}|{r['n']}|{r['x']}|{r['s']}".encode()).hexdigest()[:16]


def cache_path(root: str, name: str, params: dict, content: str) -> str:
    return f"{root}/{name}/{params_hash(params)}-{content}"


def cached_factor(df: DataFrame, name: str, root: str, use_cache: bool = True, **params) -> DataFrame:
    """date, code and the factor, from the cache where the same content and parameters were computed before."""
    from ..operators.factors import get_spec, with_factor

    spec = get_spec(name)
    path = cache_path(root, name, {**spec.params, **params}, fingerprint(df))
    if use_cache:
        try:
            return load_parquet(df.sparkSession, path)
        except FileNotFoundError:
            pass
    save_parquet(with_factor(df, name, **params).select("date", "code", name), path)
    return load_parquet(df.sparkSession, path)


def date_digests(df: DataFrame) -> DataFrame:
    """date, n, x, s: order-free digest of each date's rows, all columns."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.groupBy("date").agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"))


def cached_factors(df: DataFrame, names: list[str], root: str) -> tuple[DataFrame, Day | None]:
    """(date, code and the factors, the first date that was made anew - None: all were there).

    A digest is kept for each date.  Factors look back only, so values before the first date whose digest differs are right as they are.  Where
    that date comes after all that are kept, new dates go on from the carry (``operators.carry``): nothing before them is read but the digests'
    columns.  Where an old date has changed, or other factors are asked for, all rows are computed, and those from that date on are written.
    A cache is of one panel and one set of columns; other columns count as a change of all dates.
    """
    from ..operators.carry import Carry, started
    from ..operators.factors import get_spec

    spark = df.sparkSession
    path = f"{root}/factors-{params_hash({'columns': sorted(df.columns), **{n: get_spec(n).params for n in sorted(names)}})}"
    version = (dated.versions(spark, path) or [None])[-1]
    now = dated.materialised(date_digests(df), "digests")
    if version is None:
        first = now.agg(F.min("date")).first()[0]
    else:
        kept = dated.read(spark, path, "digests", version)
        both = now.withColumn("here", F.lit(1)).join(kept.select("date", *[F.col(c).alias(f"k{c}") for c in "nxs"]), "date", "full")
        same = F.col("here").isNotNull() & F.col("n").eqNullSafe(F.col("kn")) & F.col("x").eqNullSafe(F.col("kx")) & F.col("s").eqNullSafe(F.col("ks"))
        first, last = both.agg(F.min(F.when(~same, F.col("date"))), F.max(F.when(F.col("kn").isNotNull(), F.col("date")))).first()
    if first is not None:
        if version is not None and last is not None and first > last:
            carry = Carry(*[dated.read(spark, path, t, version) for t in ("codes", "scored")], spark.createDataFrame([], "date date, code string, fwd_window int, y double"))
            carry = carry.advanced(df, names, (1,), False)[0]
            values, how = carry.added[0], dated.APPEND
        else:
            carry = started(df, names, (1,), False)
            values, how = carry.scored, None if version is None else first
        parts = [dated.put(spark, path, "codes", carry.codes), dated.put(spark, path, "scored", values, how), dated.put(spark, path, "digests", now)]
        version = dated.commit(spark, path, parts)
    return dated.read(spark, path, "scored", version).select("date", "code", *names), first


def clear_factor_cache(spark: SparkSession, root: str, name: str | None = None) -> bool:
    fs, path = dated.folder(spark, root if name is None else f"{root}/{name}")
    return bool(fs.delete(path, True))


def cache_info(spark: SparkSession, root: str) -> dict:
    """Bytes and files below the cache folder."""
    fs, path = dated.folder(spark, root)
    if not fs.exists(path):
        return {"path": root, "files": 0, "bytes": 0}
    s = fs.getContentSummary(path)
    return {"path": root, "files": int(s.getFileCount()), "bytes": int(s.getLength())}


# monitor states, in versions by date: an update writes its own dates only


def save_state(states: DataFrame, root: str, since=None) -> int:
    """A new version: states from the date since on replace those that are there (None: all of them)."""
    return dated.publish(states.sparkSession, root, {"states": (states, since)})


def load_carry(spark: SparkSession, root: str, version: int | None = None):
    """What the monitor carries from run to run; None where it is not there."""
    from ..operators.carry import Carry

    parts = [dated.read(spark, root, t, version) for t in ("codes", "scored", "returns")]
    return None if any(p is None for p in parts) else Carry(*parts)


def save_changes(changes: DataFrame, root: str) -> None:
    """Adds changes to the log; what is there stays."""
    changes.write.mode("append").parquet(f"{root}/changes")


def load_changes(spark: SparkSession, root: str) -> DataFrame | None:
    fs, path = dated.folder(spark, f"{root}/changes")
    return spark.read.parquet(f"{root}/changes") if fs.exists(path) else None


def load_state(spark: SparkSession, root: str) -> DataFrame | None:
    return dated.read(spark, root, "states")
