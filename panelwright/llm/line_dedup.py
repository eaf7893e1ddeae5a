"""Line deduplication by a deletion-neighbourhood join: repeated lines go, also with one edit; the earliest stays.

A line goes if an earlier line (by doc_id, text hash, line number) is equal to it, or is within one edit
(insertion, deletion or substitution of a code point) of it where the shorter has at least ``near_from``
code points.  Lines of blanks alone always stay.  Rows alike in doc_id and text are treated alike.

1. Lines become hashes; equal lines meet in one partially aggregated group.
2. Lines that could have a neighbour share one half with it: either half of a line (and, against lines one
   shorter, either half at that length) is a key; only lines with a shared key go on.  For those the same is asked
   of all but one of SEGMENTS segments, which tells where an edit can be.  Exact, no cap.
3. Within those segments all variants with one code point deleted are emitted as hashed keys: with the position (equal
   variant and position: one substitution), and without it against whole lines (one insertion).
4. Equal variants join through the earliest line of their group - an aggregate, never all pairs -
   and the edit distance of each line to that earliest one is verified on the texts.

Null texts are empty: one blank line, nothing removed.  Empty tables give empty results.  A line of any length is hashed as
a whole.  Other columns stay as they are; an input's own ``line_dedup_*`` columns are replaced.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, id_and_text, materialise, split_join
from .mph import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Parts of a line, one of which an edit is in.
SEGMENTS = 32
PLACE = ["doc_id", "th", "line_no"]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), line_no, line, h1, h2 for each line that is not blank.

    A column seeds the hash of the next: with the constant first, the line is hashed under another seed, and h1 and h2 are 128 bits.
    """
    keyed = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    out = keyed.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.filter(F.length(F.trim("line")) > 0).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _half_keys(line, near_from: int) -> dict:
    """Keys of the two halves at the line's own length and at one less; null for lines too short."""
    n, out = F.length(line), {}
    for name, size in (("0", n), ("1", n - 1)):
        half = F.floor(size / 2).cast("int")
        out["k" + name] = F.when(size >= near_from, F.xxhash64(F.lit(0), size, F.substr(line, F.lit(1), half)))
        out["q" + name] = F.when(size >= near_from, F.xxhash64(F.lit(1), size, F.right(line, size - half)))
    return out


class LineHash:
    """Polynomial hashes of a line, of all but a middle part, and of its variants with one code point deleted."""

    def __init__(self, line: str):
        cps = mix(np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64), 3)
        self.n = n = len(cps)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, BASE, np.uint64)
            power[0] = 1
            self.back = np.cumprod(np.concatenate([power[:1], np.full(n, INVERSE, np.uint64)]), dtype=np.uint64)
            self.before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cps * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64)])

    def whole(self) -> np.ndarray:
        return mix(self.before[-1:] + np.uint64(self.n), 5)

    def deleted(self, p: np.ndarray) -> np.ndarray:
        """Hash of the line without code point p; equal to whole() of a line so written."""
        with np.errstate(over="ignore"):
            return mix(self.before[p] + (self.before[-1] - self.before[p + 1]) * INVERSE + np.uint64(self.n - 1), 5)

    def around(self, size: int, edges: np.ndarray) -> np.ndarray:
        """For each segment between edges, at a length of size: hash of what precedes it and of what follows it, counted from the end."""
        with np.errstate(over="ignore"):
            head = self.before[edges[:-1]]
            tail_at = self.n - (size - edges[1:])
            tail = (self.before[-1] - self.before[tail_at]) * self.back[tail_at]
            return mix(mix(head + np.uint64(size), 7) + mix(tail, 8) + np.arange(len(head), dtype=np.uint64), 9)


def edges_of(size: int) -> np.ndarray:
    return np.arange(SEGMENTS + 1) * size // SEGMENTS


def _batches(made, names: list[str], rows: int = 20_000):
    """Record batches of about so many rows from an iterator of (h1, h2, columns) for single lines."""
    import pyarrow as pa

    held, size = [], 0

    def flush():
        lengths = [len(c[0]) for _, _, c in held]
        keys = [np.repeat(np.array([r[i] for r in held], np.int64), lengths) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *map(np.concatenate, zip(*(c for _, _, c in held))))], names=["h1", "h2", *names])

    for row in made:
        held.append(row)
        size += len(row[2][0])
        if size >= rows:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _emit_segments(batches):
    def lines():
        for b in batches:
            for h1, h2, line in zip(*(b.column(n).to_pylist() for n in ("h1", "h2", "line"))):
                made = LineHash(line)
                k = np.concatenate([made.around(size, edges_of(size)) for size in (made.n, made.n - 1)]).astype(np.int64)
                yield h1, h2, (np.arange(len(k), dtype=np.int32), k)

    return _batches(lines(), ["segment", "k"])


def _variants(batches):
    for b in batches:
        for h1, h2, line, segments in zip(*(b.column(n).to_pylist() for n in ("h1", "h2", "line", "segments"))):
            made = LineHash(line)
            v, p = [made.whole()], [np.array([-1])]
            for s in segments:
                longer, j = divmod(s, SEGMENTS)
                edge = edges_of(made.n - longer)
                at = np.arange(edge[j], min(edge[j + 1] + longer, made.n))
                v.append(made.deleted(at))
                p.append(np.full(len(at), -2) if longer else at)
            v, p = np.unique(np.stack([np.concatenate(v).astype(np.int64), np.concatenate(p).astype(np.int64)]), axis=1)
            yield h1, h2, (v, p)


def _emit_variants(batches):
    return _batches(_variants(batches), ["v", "p"])


def distinct_lines(lines: DataFrame, near_from: int) -> DataFrame:
    """h1, h2, n (occurrences) and half keys of each distinct line: plain longs, so that partial sums stay in hash tables."""
    keys = _half_keys(F.col("line"), near_from)
    return materialise(lines.select("h1", "h2", *[c.alias(n) for n, c in keys.items()]).groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.max(k).alias(k) for k in keys]), "lines")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two distinct lines have."""
    return rows.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).filter("a <> b or c <> d").select(key)


def near_links(lines: DataFrame, distinct: DataFrame, near_from: int) -> DataFrame:
    """(h1, h2) of distinct lines that have an earlier line within one edit, verified."""
    keyed = distinct.select("h1", "h2", F.explode(F.array_compact(F.array("k0", "q0", "k1", "q1"))).alias("k"))
    candidates = materialise(keyed.join(_shared(keyed, "k"), "k", "left_semi").select("h1", "h2").distinct(), "line-candidates")
    found = lines.join(broadcast_if_small(candidates), ["h1", "h2"], "left_semi").select("h1", "h2", "line", F.struct(*PLACE).alias("place"))
    texts = materialise(found.groupBy("h1", "h2").agg(F.min(F.struct("place", "line")).alias("f")).select("h1", "h2", "f.place", "f.line"), "line-texts")
    spots = texts.select("h1", "h2", "line").mapInArrow(_emit_segments, "h1 long, h2 long, segment int, k long")
    where = spots.join(_shared(spots, "k"), "k", "left_semi").groupBy("h1", "h2").agg(F.collect_set("segment").alias("segments"))
    rows = texts.select("h1", "h2", "line").join(where, ["h1", "h2"]).mapInArrow(_emit_variants, "h1 long, h2 long, v long, p long")
    rows = materialise(rows.join(texts.select("h1", "h2", "place"), ["h1", "h2"]).select("v", "p", F.struct("place", "h1", "h2").alias("me")), "line-variants")
    # p >= 0: one substitution; -1: the whole line, met by variants (-2) of lines one longer
    sub = rows.filter("p >= 0")
    first = sub.groupBy("v", "p").agg(F.min("me").alias("e"), F.count("*").alias("n")).filter("n > 1")
    swaps = sub.join(first, ["v", "p"]).filter("me > e").select("me", "e")
    whole, longer = rows.filter("p = -1").select("v", F.col("me").alias("w")), rows.filter("p = -2").select("v", F.col("me").alias("b"))
    met = longer.join(whole, "v")
    inserts = met.filter("b > w").select(F.col("b").alias("me"), F.col("w").alias("e")).unionByName(met.filter("b < w").groupBy(F.col("w").alias("me")).agg(F.min("b").alias("e")))
    links = swaps.unionByName(inserts).select(F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    line = texts.select("h1", "h2", "line")
    earlier = line.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("e_line"))
    close = (F.levenshtein("line", "e_line", 1) >= 0) & (F.least(F.length("line"), F.length("e_line")) >= near_from)
    return materialise(links.join(line, ["h1", "h2"]).join(earlier, ["e1", "e2"]).filter(close).select("h1", "h2").distinct(), "line-near")


def dedup_lines(docs: DataFrame, near_from: int = 16) -> DataFrame:
    """doc_id, th, removed: the numbers of each document's lines that go (only documents that lose any)."""
    lines = lines_of(docs)
    distinct = distinct_lines(lines, near_from)
    near = near_links(lines, distinct, near_from).withColumn("near", F.lit(True))
    doomed = distinct.join(near, ["h1", "h2"], "left").filter("n > 1 or near").select("h1", "h2", "n", F.coalesce("near", F.lit(False)).alias("near"))
    doomed = materialise(doomed, "line-doomed")
    met = split_join(lines.select(*PLACE, "h1", "h2"), doomed, ["h1", "h2"], "n", F.xxhash64(*PLACE))
    met = materialise(met, "line-places")
    # of equal lines the earliest stays: one row for each line, sums first, then the same split
    repeated = materialise(met.filter("not near").groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")), "line-first")
    later = split_join(met.filter("not near").select(*PLACE, "h1", "h2"), repeated, ["h1", "h2"], "n", F.xxhash64(*PLACE)).filter(F.struct(*PLACE) > F.col("first"))
    gone = later.select(*PLACE).unionByName(met.filter("near").select(*PLACE))
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _without(lines, removed):
    """Elements of an array but those at the ascending positions in removed: the stretches between them, so that cost is linear."""
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), removed), F.concat(removed, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(gaps)


def without_repeated_lines(docs: DataFrame, near_from: int = 16) -> DataFrame:
    """All columns of docs with text rewritten, and n_lines, n_removed (as line_dedup_*).  One row for each input row."""
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    gone = dedup_lines(docs, near_from).select(F.col("doc_id").alias("__g"), F.col("th").alias("__t"), F.col("removed").alias("__removed"))
    both = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__th") == F.col("__t")), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    both = both.withColumn("__lines", lines)
    kept = F.array_join(_without(F.col("__lines"), F.col("__removed")), "\n")
    out = both.withColumn("line_dedup_lines", F.size("__lines")).withColumn("line_dedup_removed", F.coalesce(F.size("__removed"), F.lit(0)))
    return out.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)).drop("__id", "__th", "__g", "__t", "__removed", "__lines")
