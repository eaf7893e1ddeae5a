"""Hard negatives: norm-bucketed search for the rows that come closest to an anchor within a window of scores.

Rows are sorted by norm and range-partitioned into groups; a group is cut into buckets of BUCKET rows.  By Cauchy-Schwarz no row of a
bucket scores more than the anchor's norm times the bucket's largest.  A window (an anchor, its lower and upper limit) skips
a group whose bound lies below its lower limit, and within a group the first bucket whose bound lies below its lower limit or its kth score so far,
with all that follow.  The same search finds an anchor's positives (no limits, own label) and its negatives (other labels).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim_worker, materialise, partitions

#: Rows of a bucket, windows handled at a time, and most components of a group's rows (which one task holds as numbers of 8 bytes).
BUCKET, BATCH, GROUP = 2048, 256, 1 << 24
#: Bounds are compared with so much room for rounding.
ROOM = 1 + 1e-9
LONG = (1 << 63) - 1


def integer_rows(rows: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, label, v (each component as floor(256 x)), norm; rows that take no part are left out."""
    vec = F.col("embedding")
    whole = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() to long is exact in this range; beyond it components stop at its ends
    as_long = F.transform(vec, lambda x: F.floor(F.greatest(F.least(F.floor(x.cast("double") * 256).cast("double"), F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long"))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    out = good.select("vec_id", "label", as_long.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id())


def norm_groups(rows: DataFrame) -> DataFrame:
    """Adds g: groups of falling norms, three for each partition, or as many as hold GROUP components each.  Rows alike in norm are dealt on by vec_id."""
    n = materialise(rows, "negatives-rows")
    groups = max(3 * partitions(rows.sparkSession), -(-(n.agg(F.sum(F.size("v"))).first()[0] or 0) // GROUP))
    return materialise(n.repartitionByRange(groups, F.col("norm").desc(), "vec_id", "row").withColumn("g", F.spark_partition_id()), "negatives-index")


class Group:
    """One group's rows as buckets of falling norms; within a bucket by vec_id."""

    def __init__(self, row, ids, label, vec, norm):
        order = np.lexsort((ids, -norm))
        self.row, self.ids, self.label, self.norm = row[order], ids[order], label[order], norm[order]
        self.width = max((len(vec[i]) for i in order), default=0)
        self.peak = float(norm.max(initial=0))
        self.m = padded([vec[i] for i in order], self.width)

    def search(self, found: "Found", anchors: np.ndarray, of: np.ndarray) -> None:
        """Offers every row to the windows; of: the anchor of each window."""
        width = max(self.width, anchors.shape[1])
        top = float(found.norm.max(initial=0)) * self.peak
        # sums of products within the bound are exact whatever their order; beyond doubles, Python's integers
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
        m, a = (widened(x, width).astype(kind) for x in (self.m, anchors))
        for lo in range(0, len(m), BUCKET):
            hi = lo + BUCKET
            bound = found.norm * float(self.norm[lo]) * ROOM
            open_ = np.flatnonzero(bound >= found.floor())
            if not len(open_):
                return  # what follows has smaller norms
            used, at = np.unique(of[open_], return_inverse=True)
            scores = a[used] @ m[lo:hi].T
            if kind is object:
                scores = np.clip(scores, -LONG, LONG)
            s = scores.astype(np.int64)[at]
            fits = (s >= found.floor_int()[open_, None]) & (s <= found.high[open_, None])
            fits &= (self.label[None, lo:hi] == found.label[open_, None]) == found.same
            if found.same:  # a row is not its own positive
                fits &= self.row[None, lo:hi] != found.row[open_, None]
            w, c = np.nonzero(fits)
            if len(w):
                found.offer(open_[w], s[w, c], self.ids[lo + c], self.row[lo + c])


class Found:
    """The best k so far of each window, by score, then vec_id."""

    def __init__(self, k, same, row, label, norm, low, high):
        self.k, self.same, self.row, self.label, self.norm, self.low, self.high = k, same, row, label, norm, low, high
        self.w, self.score, self.id, self.at = (np.zeros(0, np.int64) for _ in range(4))
        self.kth = np.full(len(row), -LONG - 1, np.int64)

    def floor_int(self) -> np.ndarray:
        return np.maximum(self.low, self.kth)

    def floor(self) -> np.ndarray:
        return self.floor_int().astype(np.float64)

    def offer(self, w, score, ids, at) -> None:
        w, score, ids, at = (np.concatenate(x) for x in ((self.w, w), (self.score, score), (self.id, ids), (self.at, at)))
        order = np.lexsort((at, ids, -score, w))
        w, score, ids, at = w[order], score[order], ids[order], at[order]
        first = np.searchsorted(w, w)
        place = np.arange(len(w)) - first
        keep = place < self.k
        last = place == self.k - 1
        self.w, self.score, self.id, self.at = w[keep], score[keep], ids[keep], at[keep]
        self.kth[w[last]] = score[last]


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def search(index: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """window, vec_id, row, score: the best k of each group for each window that its bound lets in.

    windows: window, row, label, v, norm, low, high.  A task gets one group's rows first and holds them; windows stream past, BATCH at a
    time.
    """
    import pyarrow as pa

    peaks = index.groupBy("g").agg(F.max("norm").alias("peak"))  # one row a group: components / GROUP, or 3 for each partition
    held = index.select("g", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("window"), "row", "vec_id", "label", "v", "norm", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    sent = windows.join(F.broadcast(peaks), F.col("norm") * F.col("peak") * ROOM >= F.col("low")).select("g", F.lit(1).alias("kind"), "window", "row", F.lit(None).cast("long").alias("vec_id"), "label", "v", "norm", "low", "high")
    sent = sent.withColumn("spread", F.col("window"))
    dealt = held.withColumn("spread", F.lit(-1).cast("long")).unionByName(sent)

    def run(batches):
        claim_worker("hard-negatives")
        g, rows, group = None, [], None

        def answers(batch):
            row, label, norm, low, high, window = (column(batch, c) for c in ("row", "label", "norm", "low", "high", "window"))
            vec = vectors(batch)
            firsts, of = np.unique(row, return_index=True, return_inverse=True)[1:]
            found = Found(k, same, row, label, norm, low, high)
            anchors = padded([vec[i] for i in firsts], max((len(vec[i]) for i in firsts), default=0))
            group.search(found, anchors, of)
            return pa.RecordBatch.from_arrays([pa.array(window[found.w]), pa.array(found.id, mask=found.id == LONG), pa.array(found.at), pa.array(found.score)], ["window", "vec_id", "row", "score"])

        for batch in batches:
            keys, kinds = column(batch, "g"), column(batch, "kind")
            at = np.flatnonzero(np.append(True, (np.diff(keys) != 0) | (np.diff(kinds) != 0))).tolist() if len(keys) else []
            for lo, hi in zip(at, [*at[1:], len(keys)]):
                part = batch.slice(lo, hi - lo)
                if keys[lo] != g:
                    g, rows, group = keys[lo], [], None
                if kinds[lo] == 0:
                    rows.append(part)
                    continue
                if group is None:
                    vec = [v for p in rows for v in vectors(p)]
                    own = {c: np.concatenate([column(p, c) for p in rows]) if rows else np.zeros(0) for c in ("row", "vec_id", "label", "norm")}
                    group, rows = Group(own["row"], own["vec_id"], own["label"], vec, own["norm"]), []
                for b in range(0, len(part), BATCH):
                    yield answers(part.slice(b, BATCH))

    many = max(partitions(index.sparkSession), peaks.count())
    return dealt.repartition(many, "g").sortWithinPartitions("g", "kind", "spread").drop("spread").mapInArrow(run, "window long, vec_id long, row long, score long")


def column(batch, name: str) -> np.ndarray:
    """A column as numbers; a null vec_id counts as the largest."""
    import pyarrow.compute as pc

    got = batch.column(name)
    if got.null_count:
        got = pc.fill_null(got, LONG if name == "vec_id" else 0)
    return got.to_numpy(zero_copy_only=False)


def vectors(batch) -> list[np.ndarray]:
    v = batch.column("v")
    flat, offsets = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  rows: vec_id, label, embedding.

    Anchors are the rows whose vec_id is divisible by ``every``; positives an anchor's best other rows of its label; negatives, for each
    positive, the best rows of other labels whose score lies within low_pct to high_pct percent of the positive's.  Scores are inner products of
    components floor(256 x), exact; components stop at 2^62 and scores at the ends of long.  Vectors of different lengths meet as
    if the shorter went on with zeros.  Rows without a label, a vector or a finite component take no part; a null vec_id is no
    anchor and comes last among ties; repeated rows are rows of their own; an empty table gives an empty one; other columns are dropped.
    """
    index = norm_groups(integer_rows(rows))
    anchors = index.filter(F.col("vec_id") % every == 0)
    least, most = F.lit(-LONG - 1).cast("long"), F.lit(LONG).cast("long")
    pos = search(index, anchors.select(F.col("row").alias("window"), "row", "label", "v", "norm", least.alias("low"), most.alias("high")), positives, True)
    pos = best(pos, ["window"], positives).select(F.col("window").alias("anchor"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the least and the largest whole score of the window; whole numbers of any size
    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(score * low_pct / 100).cast("long"), F.floor(score * high_pct / 100).cast("long")
    pos = materialise(pos.withColumns({"low": low, "high": high}), "negatives-positives")
    asked = pos.filter("low <= high").join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v", "norm"), "anchor")
    asked = materialise(asked.withColumn("window", F.col("anchor") * positives + F.col("place") - 1), "negatives-windows")
    neg = search(index, asked.select("window", F.col("anchor").alias("row"), "label", "v", "norm", "low", "high"), negatives, False)
    neg = best(neg, ["window"], negatives).select("window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return asked.select("window", "anchor_id", "positive_id", "positive_score").join(neg, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
