"""Near-duplicate join on word n-grams: MinHash banding, then verification on full n-gram sets.

1. Every text becomes its set of distinct word n-grams (64-bit hashes) and a MinHash signature.  Texts with equal sets
   are one class; its representative is the least (doc_id, text hash).  All further work is on representatives.
2. Bands of rows, their counts chosen for the target recall at the threshold, shuffle on band hashes.
   Only buckets with two classes or more go on; chains of buckets are candidate groups (connected components).
3. The pairs that share a bucket are verified on their full sets, each pair once.  What meets in one place is a whole
   group, or, where weak collisions have chained more than BLOCK members for each band into a group, each of its buckets
   alone, the pair being verified in the first bucket that it shares: so a member is copied at most as often as there
   are bands, for each block of BLOCK members in a bucket.  Each pair of blocks is one task's work: it counts each
   member's links and emits a spanning forest of them - never the pairs themselves.
4. Components of the forest edges, by tables alone, give the classes of near copies.

Nulls are empty texts.  A text of fewer than n words is one n-gram of all its words; a text without words has an
empty set and links to nothing.  Texts of any length are taken whole.  Repeated rows each get a row; of equal texts the
least doc_id represents the class, nulls first.  Other columns are ignored (or carried by without_near_copies), whatever
their names.  Empty tables give empty results.
"""
from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, claim_worker, id_and_text, materialise, split_join
from .components import components
from .mph import mix

_WORDS = re.compile(r"\w+").findall
MEMO = 200_000
BLOCK = 128


def bands_for(threshold: float, recall: float, most: int = 512) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose least number of bands for the recall at the threshold fits."""
    best = None
    for rows in range(1, 16):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            noise = 1 - (1 - (threshold / 2) ** rows) ** bands
            cost = bands * rows + 200 * noise
            if best is None or cost < best[0]:
                best = (cost, bands, rows)
    return best[1], best[2]


class Shingler:
    def __init__(self, n: int, bands: int, rows: int):
        import xxhash

        self.n, self.bands, self.rows, self.hash = n, bands, rows, xxhash.xxh3_64_intdigest
        seeds = np.arange(1, bands * rows + 1, dtype=np.uint64)
        self.mul, self.add = mix(seeds, 11) | np.uint64(1), mix(seeds, 12)
        self.word: dict[str, int] = {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct n-gram hashes of each text."""
        found = [_WORDS(t.lower()) for t in texts]
        if len(self.word) > MEMO:
            self.word.clear()
        known = self.word
        for w in set().union(*found).difference(known):
            known[w] = self.hash(w.encode())
        out, n = [], self.n
        with np.errstate(over="ignore"):
            for ws in found:
                h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
                if not len(h):
                    out.append(h)
                    continue
                k = min(n, len(h))
                g = np.zeros(len(h) - k + 1, np.uint64)
                for i in range(k):
                    g = mix(g + h[i : len(h) - k + 1 + i], 20 + i)
                out.append(np.unique(mix(g, k)))
        return out

    def band_hashes(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """Band hashes of each set; none for an empty set."""
        full = [s for s in sets if len(s)]
        if not full:
            return [np.zeros(0, np.int64) for _ in sets]
        flat, starts = np.concatenate(full), np.cumsum([0, *map(len, full)])[:-1]
        with np.errstate(over="ignore"):
            low = np.empty((len(full), self.bands), np.uint64)
            for band in range(self.bands):
                acc = np.full(len(full), band + 1, np.uint64)
                for r in range(band * self.rows, (band + 1) * self.rows):
                    x = flat * self.mul[r] + self.add[r]
                    acc = mix(acc ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts), 40)
                low[:, band] = acc
        it = iter(low.astype(np.int64))
        return [next(it) if len(s) else np.zeros(0, np.int64) for s in sets]


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th, size, s1, s2 (128-bit digest of the set) and band hashes of each row."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        claim_worker("n-grams")
        made = Shingler(n, bands, rows)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = made.sets(part.column("text").to_pylist())
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                hashes = made.band_hashes(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "th", "size", "s1", "s2", "bands"])

    keyed = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, th long, size long, s1 long, s2 long, bands array<long>")


def verify_block(left: list, right: list | None, threshold: float, candidates=None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of two lists of (id, set) - or within one list - as (link counts left, right, forest edges).

    candidates: boolean matrix of the pairs to verify (default: all).  One set at a time is marked in the left sets'
    common universe; sums over the candidates' sets give its intersections with them, so memory is linear in the n-grams.
    """
    other = left if right is None else right
    n, m = len(left), len(other)
    universe, flat = np.unique(np.concatenate([s for _, s in left]), return_inverse=True)
    sizes = np.array([len(s) for _, s in left])
    ends = np.cumsum(sizes)
    starts, mark = ends - sizes, np.zeros(len(universe) + 1, np.int32)
    count_l, count_r, parent, edges = np.zeros(n, np.int64), np.zeros(m, np.int64), list(range(n + m)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j, (_, s) in enumerate(other):
        ask = np.ones(n, bool) if candidates is None else candidates[:, j].copy()
        if right is None:
            ask[j:] = False
        # sets whose sizes alone rule the pair out
        ask &= np.minimum(sizes, len(s)) >= threshold * np.maximum(sizes, len(s)) - 1e-6
        ask = np.flatnonzero(ask)
        if not len(ask):
            continue
        at = np.searchsorted(universe, s)
        at = at[universe[np.minimum(at, len(universe) - 1)] == s]
        mark[at] = 1
        if 4 * len(ask) > n:
            common = np.add.reduceat(mark[flat], starts)[ask]
        else:
            common = np.array([mark[flat[starts[i] : ends[i]]].sum() for i in ask.tolist()])
        mark[at] = 0
        hit = ask[common >= threshold * (sizes[ask] + len(s) - common) - 1e-6]
        count_l[hit] += 1
        count_r[j] += len(hit)
        me = j if right is None else n + j
        for i in hit.tolist():
            a, b = root(i), root(me)
            if a != b:
                parent[a] = b
                edges.append((i, j))
    return (count_l + count_r if right is None else count_l), count_r, edges


def sharing(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of rows of two arrays of band hashes share a band - or, given one (0 or more), share that band and none before it."""
    if band < 0:
        return functools.reduce(np.logical_or, (a[:, k, None] == b[None, :, k] for k in range(a.shape[1])))
    out = a[:, band, None] == b[None, :, band]
    for k in range(band):
        out &= a[:, k, None] != b[None, :, k]
    return out


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, th, class_id, n_links, group_id: one row for each input row.

    class_id: doc_id of the representative of all texts with the same n-gram set; n_links: classes linked to it;
    group_id: least representative reached over links (with equal class for unlinked texts).
    """
    import pandas as pd

    bands, rows = bands_for(threshold, recall)
    signed = materialise(signatures(docs, n, bands, rows), "signatures")
    place = F.struct("doc_id", "th")
    classes = materialise(signed.groupBy("s1", "s2").agg(F.min(place).alias("rep"), F.max("size").alias("size"), F.any_value("bands").alias("bands")), "classes").withColumn("node", F.xxhash64("s1", "s2"))
    spread = classes.filter("size > 0").select("node", F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("band", "h", "a")
    edges = spread.join(buckets, ["band", "h"]).select(F.col("node").alias("b"), "a").filter("a <> b").distinct()
    groups = components(edges).select("node", F.col("component").alias("cand"))
    members = materialise(groups.join(classes.select("node", "bands", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")), "node"), "members")
    sizes = materialise(members.groupBy("cand").agg(F.count("*").alias("n")), "group-sizes")
    # where a member's pairs are verified: in its group (band -1), or in each bucket of a group that is too large for that
    whole = split_join(members.select("node", "cand"), sizes.filter(F.col("n") <= BLOCK * bands).withColumn("of", F.col("n")), ["cand"], "n", F.col("node")).select("node", F.col("cand").alias("place"), F.lit(-1).alias("band"), "of")
    large = split_join(members.select("node", "cand", "bands"), sizes.filter(F.col("n") > BLOCK * bands).withColumn("of", F.col("n")), ["cand"], "n", F.col("node")).select("node", F.posexplode("bands").alias("band", "place"))
    shared = materialise(large.groupBy("band", "place").agg(F.count("*").alias("n")).filter("n > 1").withColumn("of", F.col("n")), "large-buckets")
    parts = split_join(large, shared, ["band", "place"], "n", F.col("node")).select("node", "place", "band", "of")
    # each member goes to every pair of blocks that holds its own; a small group has the one pair (0, 0)
    blocked = whole.unionByName(parts).withColumn("of", F.ceil(F.col("of") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    turns = blocked.groupBy("node").agg(F.collect_list(F.struct("place", "band", "of", "block")).alias("places"))  # one for each band at most
    # full n-gram sets, of one text for each candidate class
    texts = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    wanted = materialise(members.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "node"), "wanted")
    met = texts.join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))).select("node", "text")
    held = met.dropDuplicates(["node"]).join(turns, "node").join(members.select("node", "bands"), "node")
    turn = F.transform(F.sequence(F.lit(0), F.col("p.of") - 1), lambda o: F.struct(F.least("p.block", o).alias("x"), F.greatest("p.block", o).alias("y")))
    work = held.select("node", "text", "bands", F.explode("places").alias("p")).select("node", "text", "bands", "p.*", F.explode(turn).alias("t")).select("node", "text", "bands", "place", "band", "block", "t.x", "t.y")

    def compare(key, pdf):
        _, band, x, y = key
        pdf = pdf.sort_values("node")
        at, nodes = pdf["block"].to_numpy(), pdf["node"].to_numpy()
        hashes = np.array(pdf["bands"].tolist(), np.int64)
        a = np.flatnonzero(at == x)
        b = a if x == y else np.flatnonzero(at == y)
        none = pd.DataFrame({"node": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "to": pd.Series([], dtype="Int64")})
        asked = sharing(hashes[a], hashes[b], int(band)) if len(a) and len(b) else np.zeros((0, 0), bool)
        if not asked.any():
            return none
        sets = Shingler(n, bands, rows).sets(pdf["text"].tolist())
        left, other = [(int(nodes[i]), sets[i]) for i in a], [(int(nodes[i]), sets[i]) for i in b]
        cl, cr, found = verify_block(left, None if x == y else other, threshold, asked)
        out = [(left[i][0], int(c), None) for i, c in enumerate(cl) if c]
        out += [(other[j][0], int(c), None) for j, c in enumerate(cr) if c] if x != y else []
        out += [(left[i][0], 0, other[j][0]) for i, j in found]
        return pd.DataFrame({"node": pd.Series([o[0] for o in out], dtype="int64"), "links": pd.Series([o[1] for o in out], dtype="int64"), "to": pd.Series([o[2] for o in out], dtype="Int64")}) if out else none

    verified = materialise(work.groupBy("place", "band", "x", "y").applyInPandas(compare, "node long, links long, to long"), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = components(verified.filter("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    least = joined.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("group_rep"))
    grouped = joined.join(least, "component").select("node", "group_rep")
    of_class = classes.join(links, "node", "left").join(grouped, "node", "left").select("s1", "s2", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_rep", "rep").alias("group_rep"), "size")
    out = signed.select("doc_id", "th", "s1", "s2").join(of_class, ["s1", "s2"])
    own = F.col("size") > 0  # texts without words stand alone
    return out.select("doc_id", "th", F.when(own, F.col("rep.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links", F.when(own, F.col("group_rep.doc_id")).otherwise(F.col("doc_id")).alias("group_id"), F.when(own, F.col("group_rep.th")).otherwise(F.col("th")).alias("group_th"))


def without_near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each group of near copies, the one with the least (doc_id, text hash); rows alike in both are one."""
    found = near_classes(docs, n, threshold)

    def keys(doc_id, th):  # never null, so that join and de-duplication share one partitioning
        return [F.coalesce(doc_id, F.lit(0)).alias("__id"), doc_id.isNull().alias("__none"), th.alias("__th")]

    names = ["__id", "__none", "__th"]
    first = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("th") == F.col("group_th"))
    stay = found.filter(first).select(*keys(F.col("doc_id"), F.col("th"))).distinct()
    keyed = docs.select("*", *keys(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return keyed.join(stay, names, "left_semi").dropDuplicates(names).drop(*names)
