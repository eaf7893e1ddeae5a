"""Tables by date in versions: an update writes its own rows only, and readers see one version whole.

A table is a list of segments (folder, first date, end date); a version is one small file that names the segments of all tables.  Publishing writes new
segments, cuts the old ones off at the update's first date, and then puts the version file in place by one rename to a name that
did not exist.  Files of earlier dates are never touched; whoever loses a race gets an error, and readers of a version keep it.
"""
from __future__ import annotations

import datetime
import json
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = folder(spark, f"{root}/versions")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, list]:
    """Segments of each table in a version (default: the last; none: empty)."""
    known = versions(spark, root)
    if not known:
        return {}
    return json.loads(spark.sparkContext.wholeTextFiles(f"{root}/versions/{known[-1] if version is None else version:09d}.json").first()[1])


#: In place of a date: rows come to those that are there.
APPEND = "append"


@dataclass(frozen=True)
class Segment:
    """Rows of a table that are written but belong to no version yet.  since: the date from which they replace what is there, None: all of it, APPEND: nothing."""

    table: str
    path: str
    since: datetime.date | str | None


def put(spark: SparkSession, root: str, table: str, rows: DataFrame, since: datetime.date | str | None = None) -> Segment:
    path = f"{root}/{table}/{uuid.uuid4().hex}"
    if "date" in rows.columns:
        rows = rows.filter(F.col("date") >= F.lit(since)) if isinstance(since, datetime.date) else rows
        made = working_folder(spark, "put")  # ranges are drawn from a sample: without a table, rows would be made twice
        rows.write.parquet(made)
        rows = spark.read.schema(rows.schema).parquet(made).repartitionByRange("date").sortWithinPartitions("date")  # files of few dates: readers skip the others
        rows.write.parquet(path)
        fs, at = folder(spark, made)
        fs.delete(at, True)
    else:
        rows.write.parquet(path)
    return Segment(table, path, since)


def commit(spark: SparkSession, root: str, segments: list[Segment]) -> int:
    """A new version with these segments.  Other tables go over as they are.  Raises RuntimeError if another writer was faster."""
    known = versions(spark, root)
    new = manifest(spark, root, known[-1]) if known else {}
    for s in segments:
        first = s.since.isoformat() if isinstance(s.since, datetime.date) else None
        old = [] if s.since is None else new.get(s.table, [])
        if first is not None:
            old = [[at, lo, min(x for x in (hi, first) if x is not None)] for at, lo, hi in old if lo is None or lo < first]
        new[s.table] = [*old, [s.path, first, None]]
    version = known[-1] + 1 if known else 0
    fs, ready = folder(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(ready, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    _, target = folder(spark, f"{root}/versions/{version:09d}.json")
    if fs.exists(target) or not fs.rename(ready, target):
        fs.delete(ready, False)
        raise RuntimeError(f"version {version} was published meanwhile: read it and update again")
    return version


def publish(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, datetime.date | str | None]]) -> int:
    """``put`` and ``commit`` of several tables at once."""
    return commit(spark, root, [put(spark, root, name, rows, since) for name, (rows, since) in tables.items()])


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table as one version has it; None where it is not there."""
    segments = manifest(spark, root, version).get(name)
    if not segments:
        return None
    parts = []
    for path, lo, hi in segments:
        part = spark.read.parquet(path)
        part = part if lo is None else part.filter(F.col("date") >= F.lit(datetime.date.fromisoformat(lo)))
        parts.append(part if hi is None else part.filter(F.col("date") < F.lit(datetime.date.fromisoformat(hi))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compact(spark: SparkSession, root: str, name: str) -> int:
    """A new version in which the table is one segment; for tables of many small updates."""
    return publish(spark, root, {name: (read(spark, root, name), None)})


def clean(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the last versions, and segments that none of those name; the number of folders deleted.  Not beside a writer."""
    known = versions(spark, root)
    used = {s[0] for v in known[-keep:] for segments in manifest(spark, root, v).values() for s in segments}
    gone = {s[0] for v in known[:-keep] for segments in manifest(spark, root, v).values() for s in segments} - used
    for path in [*gone, *[f"{root}/versions/{v:09d}.json" for v in known[:-keep]]]:
        fs, at = folder(spark, path)
        fs.delete(at, True)
    return len(gone)


def working_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local master may do without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and what sampling has dealt out stays as it is."""
    path = working_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
