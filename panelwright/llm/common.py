"""What the operators of this folder share: the shared folder, materialised tables, texts as UTF-8."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and driver and executors are one process (local master) a temporary folder is made
    and remembered; on a cluster its absence is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made inside each open ``scratch`` block.
_SCRATCH: list[list[str]] = []


def fresh_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def delete_dirs(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the folders that operators made inside the block, but for those taken off the list that it yields.

    For callers that write an operator's result before the block ends; results still to be read need their folders.
    """
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        delete_dirs(spark, _SCRATCH.pop())


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; it survives the loss of any executor."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text (null: empty); any other column is dropped before work begins."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def filesystem(uri: str):
    """(pyarrow file system, path in it); used on executors, for the shared folder only."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(ids: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 ascending cut points of a numeric column; bounded by parts, not by rows."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = ids.select(F.percentile_approx(column, at, 20 * parts).alias("b")).first()["b"]
    return sorted(set(got or []))


def bucket_of(column, bounds: list):
    """Index of the range that holds the value (nulls: 0).  Two-level search, so that cost grows as the root of the cuts."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))

    def table(cuts):  # one literal, folded once, however many cuts there are
        return F.split(F.lit(",".join(str(int(b)) for b in cuts)), ",").cast("array<long>")

    fine, coarse = table(bounds), table(bounds[step - 1 :: step])
    base = F.size(F.filter(coarse, lambda b: b <= column)) * step
    rest = F.size(F.filter(F.slice(fine, base + 1, F.lit(step)), lambda b: b <= column))
    return F.when(column.isNull(), 0).otherwise(base + rest)


def split_join(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, spread, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with a table of one row for each key, however many rows a key has.

    n: the number of the key's rows, in counts (default: in per_key), a materialised table of all keys that repeat.  A key with
    more than a share of 1 / (2 * partitions) of those rows is dealt over as many salts as it has such shares (the next power
    of two), by the hash of spread; its row of per_key is repeated for each.  There are fewer than 2 * partitions such keys at
    any size, so their hashes go into the plan itself.
    """
    counts, key = per_key if counts is None else counts, F.xxhash64(*keys)
    share = max(1, (counts.agg(F.sum(n)).first()[0] or 0) // (2 * partitions(rows.sparkSession)))
    tiers: dict[int, list[int]] = {}
    for r in counts.filter(F.col(n) > share).select(key.alias("key"), F.ceil(F.col(n) / share).alias("shares")).collect():  # under 2 * partitions rows
        tiers.setdefault(1 << (int(r["shares"]) - 1).bit_length(), []).append(r["key"])
    salts = F.coalesce(*[F.when(key.isin(hashes), F.lit(k)) for k, hashes in sorted(tiers.items())], F.lit(1))
    dealt = rows.withColumn("__salt", F.pmod(spread, salts).cast("int"))
    repeated = per_key.drop(n).withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(repeated, [*keys, "__salt"]).drop("__salt")


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a materialised table of narrow rows that is found small enough; else the table as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df


_MEMOS: dict = {}


def claim_worker(owner: str, clear=None) -> None:
    """Python workers outlive a task and keep their operator's memo for the next one; another operator's memo is dropped here."""
    import gc

    others = [k for k in _MEMOS if k != owner]
    for k in others:
        _MEMOS.pop(k)()
    if others:
        gc.collect()
    if clear is not None:
        _MEMOS[owner] = clear
