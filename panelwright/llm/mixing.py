"""Mixing sources to target weights along a curriculum.

Each source has a weight that varies over training time 0 to 1; its integral is the source's weight in the mix.  Targets follow by
water-filling under a cap of passes over the source.  Within a pass, documents come in the order of a digest of their doc_id; the words
before a document, inverted through the source's cumulative demand, give the time at which it is trained on; the mix is range-sorted by time.
"""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

#: (time, weight) knots of a source's schedule, linear between; sources take them in turn.  Their integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 3.0), (1.0, 7.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 0.5)))
#: Rows of a source that share one bucket of the prefix sums, at most but for chance.
BUCKET_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def integrals(knots) -> list[float]:
    """Demand up to each knot."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots) or not any(w for _, w in knots):
        raise ValueError("a schedule rises in time from 0 to 1, with weights of at least 0 that are not all 0")
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def time_of(share: Column, knots) -> Column:
    """When a schedule has made this share (0 to 1) of its demand: its integral inverted, a square root for each piece."""
    total = integrals(knots)
    want = share * total[-1]
    pieces = []
    for (t0, w0), (t1, w1), d0, d1 in zip(knots, knots[1:], total, total[1:]):
        if d1 > d0:
            slope = (w1 - w0) / (t1 - t0)
            rest = F.greatest(want - d0, F.lit(0.0))
            # the stable root of slope / 2 * x^2 + w0 * x = rest
            x = 2 * rest / F.nullif(w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))), F.lit(0.0))
            pieces.append((d1, F.least(t0 + F.coalesce(x, F.lit(0.0)), F.lit(float(t1)))))
    out = pieces[-1][1]
    for d1, at in reversed(pieces[:-1]):
        out = F.when(want < d1, at).otherwise(out)
    return out


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, rows, source_size and i: the place of each source by code points, null last.

    Sources are range-partitioned and counted by partition, so that any number of them is ranked without meeting in one task; the
    driver learns one count for each partition.
    """
    spark = sizes.sparkSession
    each = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    each = each.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    each = materialise(each.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "mix-sources")
    before, at = 0, []
    for r in each.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        at.append((r["part"], before))
        before += r["n"]
    first = F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for p, n in at if n], F.lit(0))
    return each.withColumn("i", F.col("place") + first).drop("part", "place")


def targets(sources: DataFrame, share: Fraction, passes: int, schedules) -> DataFrame:
    """Adds weight and target: share of all sizes by weight, at most passes times a source's size, the excess reshared until none is above.

    A round is one aggregation; the driver learns two sums.  Sums are whole numbers, so that reruns agree to the last bit.
    """
    weights = [integrals(k)[-1] for k in schedules]
    k = F.col("i") % len(weights)
    weighed = sources.withColumn("weight", F.coalesce(*[F.when(k == j, F.lit(w)) for j, w in enumerate(weights)]))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        above = F.lit(False) if level is None else passes * F.col("source_size") <= F.col("weight") * level
        sums = weighed.groupBy("weight", above.alias("above")).agg(F.count("*").alias("n"), F.sum("source_size").alias("s")).collect()  # two rows a weight
        free = sum(r["weight"] * r["n"] for r in sums if not r["above"])
        full = passes * sum(r["s"] for r in sums if r["above"])
        before, level = level, float(share * total - full) / free if free else float("inf")
        if level == before:
            break
    capped = passes * F.col("source_size")
    return weighed.withColumn("target", F.when(F.col("weight") * level >= capped, capped.cast("double")).otherwise(F.col("weight") * level))


def curriculum(docs: DataFrame, share: Fraction = Fraction(3, 2), passes: int = 2, schedules=SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and plays: an array of (pass, words, at), one for each time the document is
    trained on - ``words`` of it, beginning at training time ``at``.

    size: number of stretches without \\x20 and \\x09-\\x0D, of the whole text.  A source's passes follow each other; the document in which
    its target (rounded to a whole word) falls is cut there, so that taken words of a source add up to the target.  Order within a
    source: MD5 of doc_id as text, then doc_id (nulls last), then size; rows alike in these are alike to the mix, which of them is
    cut is one and the same.  Null and empty texts have size 0 and are never taken; null sources are one source, the last; an empty
    table gives an empty one; other columns are dropped, whatever their names.

    A source's rows are dealt over buckets of equal ranges of the digest, so that a source of any size is summed in parallel: sums by
    bucket first, then prefix sums over buckets, then within each bucket.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = materialise(sizes.withColumn("digest", digest), "mix-sizes")
    known = materialise(targets(ranked_sources(sizes), share, passes, schedules), "mix-targets")
    buckets = max(8 * partitions(spark), sizes.count() // BUCKET_ROWS)
    dealt = sizes.withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    # null sources need a key that joins
    keyed = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key")]
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(so_far), F.lit(0))).select(*keyed, "bucket", "before")
    per_bucket = sums.join(known.select(*keyed, "source_size", "target", "i"), ["no_source", "key"])
    within = Window.partitionBy("no_source", "key", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select(*keyed, "doc_id", "source", "size", "digest", "bucket").withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(per_bucket, ["no_source", "key", "bucket"]).withColumn("before", F.col("before") + F.col("own"))
    goal = F.floor(F.col("target") + 0.5)
    k = F.col("i") % len(schedules)

    def play(p: int) -> Column:
        at = F.col("before") + p * F.col("source_size")
        words = F.greatest(F.least(goal - at, F.col("size")), F.lit(0))
        share_ = at / F.col("target")
        time = F.coalesce(*[F.when(k == j, time_of(share_, knots)) for j, knots in enumerate(schedules)])
        return F.when(words > 0, F.struct(F.lit(p + 1).alias("pass"), words.alias("words"), time.alias("at")))

    plays = F.array_compact(F.array(*[play(p) for p in range(passes)]))
    rows = rows.withColumn("plays", plays)
    taken = F.aggregate("plays", F.lit(0).cast("long"), lambda a, x: a + x.words)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "plays")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is trained on, range-sorted by training time: read in order, its files are the curriculum."""
    out = mixed.select("doc_id", "source", F.explode("plays").alias("p")).select("doc_id", "source", "p.*")
    order = ["at", "doc_id", "pass", "words"]
    return out.repartitionByRange(partitions(mixed.sparkSession), *order).sortWithinPartitions(*order)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix with its production parameters, one row a document, range-sorted by when it is first trained on (untaken ones last)."""
    first = F.round(F.try_element_at("plays", F.lit(1)).at, 9)
    out = curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("plays").cast("long").alias("n_plays"), first.alias("first_at"))
    order = [F.col("first_at").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
