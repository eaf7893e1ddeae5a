"""Periodic runs of words: Crochemore's partition refinement, many documents at a time, and texts with each run collapsed.

Positions of a document are alike at level l if the same l words begin at them.  Level by level the classes are refined by the class
of the next position; only the smaller parts of a class that fell apart split others (the largest part never does), so a
position is handled a logarithmic number of times.  Two neighbours of a class of level l that lie l apart are a square whose root
is primitive; squares at consecutive positions are one run of smallest period l.  Runs hold at least four periods here, so a class of
fewer than three positions can be dropped whole.  Gaps between neighbours wait in a radix heap until the level reaches them.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_worker, id_and_text

#: Words handled at a time (a longer document is on its own).
BLOCK_WORDS = 2_000_000
#: A class of fewer positions holds no square of a run of four periods.
FEW = 3


class RadixHeap:
    """(gap, position) pairs that come out in the order of gaps; no gap put in lies below the level reached."""

    def __init__(self):
        self.level, self.buckets, self.left = 1, [[] for _ in range(64)], 0

    def put(self, gaps: np.ndarray, at: np.ndarray) -> None:
        if not len(gaps):
            return
        self.left += len(gaps)
        bits = np.frexp((gaps ^ self.level).astype(np.float64))[1]
        low, high = int(bits.min()), int(bits.max())
        if low == high:
            self.buckets[low].append((gaps, at))
            return
        for b in range(low, high + 1):
            if (own := bits == b).any():
                self.buckets[b].append((gaps[own], at[own]))

    def advance(self) -> None:
        """To the next level: what shared its higher bits is dealt out anew."""
        self.level += 1
        b = (self.level & -self.level).bit_length()
        again, self.buckets[b] = self.buckets[b], []
        for gaps, at in again:
            self.left -= len(gaps)
            self.put(gaps, at)

    def due(self) -> np.ndarray:
        """Positions whose gap is the level."""
        got, self.buckets[0] = self.buckets[0], []
        self.left -= sum(len(g) for g, _ in got)
        at = np.sort(np.concatenate([at for _, at in got])) if got else np.zeros(0, np.int64)
        return at[heads(at)]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... start + size - 1 for each pair."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def heads(keys: np.ndarray) -> np.ndarray:
    """True where a sorted array's value differs from the one before."""
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


class Refinement:
    """Classes of positions at one level.  cls is -1 for positions that are out; nxt and prv link the positions of a class in order;
    members holds each class as one stretch (start, size), slot is a position's place in it.
    """

    def __init__(self, words: np.ndarray, limit: np.ndarray):
        self.limit, self.heap, self.runs = limit, RadixHeap(), []
        m = len(words)
        self.cls, self.nxt, self.prv, self.slot = (np.full(m, -1, np.int64) for _ in range(4))
        order = np.argsort(words, kind="stable")
        order = order[words[order] >= 0]
        first = np.flatnonzero(heads(words[order]))
        sizes = np.diff(np.append(first, len(order)))
        keep = sizes >= FEW
        self.members = order[np.repeat(keep, sizes)]
        sizes = sizes[keep]
        self.start, self.size, self.classes = np.cumsum(sizes) - sizes, sizes.copy(), len(sizes)
        self.cls[self.members] = np.repeat(np.arange(len(sizes)), sizes)
        self.slot[self.members] = np.arange(len(self.members))
        self.link(self.members, self.cls[self.members])
        self.splitters, self.out = self.members, np.flatnonzero(self.cls < 0)

    def link(self, at: np.ndarray, of: np.ndarray) -> None:
        """Positions sorted by class and place become neighbours; their gaps are put down."""
        same = ~heads(of)[1:]
        self.nxt[at], self.prv[at] = -1, -1
        a, b = at[:-1][same], at[1:][same]
        self.nxt[a], self.prv[b] = b, a
        self.note(a)

    def note(self, at: np.ndarray) -> None:
        gaps = self.nxt[at] - at
        good = (gaps >= self.heap.level) & (gaps <= self.limit[at])
        self.heap.put(gaps[good], at[good])

    def unlink(self, at: np.ndarray, of: np.ndarray) -> None:
        """Takes positions sorted by class and place out of lists that go on without them."""
        if not len(at):
            return
        chained = np.zeros(len(at), bool)
        chained[1:] = (of[1:] == of[:-1]) & (self.prv[at[1:]] == at[:-1])
        before, after = self.prv[at[~chained]], self.nxt[at[np.append(~chained[1:], True)]]
        self.nxt[before[before >= 0]] = after[before >= 0]
        self.prv[after[after >= 0]] = before[after >= 0]
        self.note(before[(before >= 0) & (after >= 0)])

    def new_classes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        more = self.classes + len(sizes)
        if more > len(self.size):
            room = max(more, 2 * len(self.size))
            self.start, self.size = (np.concatenate([x, np.zeros(room - len(x), np.int64)]) for x in (self.start, self.size))
        ids = np.arange(self.classes, more)
        self.start[ids], self.size[ids], self.classes = starts, sizes, more
        return ids

    def refine(self) -> None:
        """From one level to the next."""
        self.heap.advance()
        moved = np.concatenate([self.splitters, self.out]) - 1
        moved = moved[moved >= 0]
        moved = moved[(self.cls[moved] >= 0) & (self.limit[moved] >= self.heap.level)]
        self.splitters = self.out = np.zeros(0, np.int64)
        if not len(moved):
            return
        moved.sort()
        by = self.cls[moved] * (self.classes + 1) + self.cls[moved + 1] + 1
        moved = moved[np.argsort(by, kind="stable")]
        of, ahead = self.cls[moved], self.cls[moved + 1]
        at = np.flatnonzero(heads(of) | heads(ahead))  # of each group: alike before, and in what follows
        sizes = np.diff(np.append(at, len(moved)))
        parent = of[at]
        if (same := (sizes == self.size[parent]) & (ahead[at] >= 0)).any():  # the class goes on as it is
            keep = np.repeat(~same, sizes)
            moved, of, ahead = moved[keep], of[keep], ahead[keep]
            at, sizes, parent = (x[~same] for x in (at, sizes, parent))
            at = np.cumsum(sizes) - sizes
            if not len(moved):
                return
        edge = np.flatnonzero(heads(parent))
        gone = np.add.reduceat(sizes, edge)  # by class, as classes below
        classes = parent[edge]
        rest = self.size[classes] - gone
        lives = (ahead[at] >= 0) & (sizes >= FEW)
        # what is left of a class stays in front of its stretch, what moves goes behind
        marked = self.slot[moved]
        tail = self.start[classes] + rest
        slots = spans(tail, gone)
        self.slot[moved] = -1
        stays = self.members[slots]
        stays = stays[self.slot[stays] >= 0]
        free = marked[marked < np.repeat(tail, gone)]
        self.members[free], self.slot[stays] = stays, free
        self.members[slots], self.slot[moved] = moved, slots
        self.size[classes] = rest
        # lists
        on = np.repeat(rest >= FEW, gone)
        by_place = moved[on][np.lexsort((moved[on], of[on]))]
        self.unlink(by_place, self.cls[by_place])
        alive = np.repeat(lives, sizes)
        ids = self.new_classes((np.cumsum(sizes) - sizes)[lives], sizes[lives])
        self.cls[moved] = -1
        new = np.repeat(ids, sizes[lives])
        self.cls[moved[alive]] = new
        self.start[ids] = self.slot[moved[(np.cumsum(sizes) - sizes)[lives]]]
        self.link(moved[alive], new)
        # the largest part of each class splits nothing
        most = np.maximum.reduceat(np.where(lives, sizes, 0), edge)
        heir_is_rest = (rest >= most) & (rest >= FEW)
        of_class = np.repeat(np.arange(len(classes)), np.diff(np.append(edge, len(parent))))
        largest = lives & (sizes == most[of_class]) & ~heir_is_rest[of_class]
        seen = np.cumsum(largest)
        heir = largest & (seen - np.where(edge > 0, seen[edge - 1], 0)[of_class] == 1)
        few = (rest > 0) & (rest < FEW)
        split = (rest >= FEW) & ~heir_is_rest
        dying = self.members[spans(self.start[classes[few]], rest[few])]
        self.cls[dying] = -1
        self.out = np.concatenate([moved[~alive], dying])
        self.splitters = np.concatenate([moved[np.repeat(lives & ~heir, sizes)], self.members[spans(self.start[classes[split]], rest[split])]])

    def squares(self) -> None:
        """Squares of the level, consecutive ones as one run."""
        at, q = self.heap.due(), self.heap.level
        at = at[(self.cls[at] >= 0) & (self.nxt[at] == at + q)]
        if len(at):
            first = np.flatnonzero(np.append(True, np.diff(at) != 1))
            last = np.append(first[1:], len(at)) - 1
            self.runs.append((at[first], at[last] - at[first] + 2 * q, np.full(len(first), q)))


def find_runs(words: np.ndarray, limit: np.ndarray, least: int = 6, periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of each run of at least ``least`` words and ``periods`` (4 or more) periods.

    words: a number for each word, alike where words of one document are; a document ends with -1.  limit: at each position, the longest
    period that its document has room for.
    """
    if periods < 4:
        raise ValueError("runs of fewer than four periods are not found")
    state, top = Refinement(words, limit), int(limit.max(initial=0))
    if top:
        state.squares()
    while state.heap.level < top and (state.heap.left or len(state.splitters) or len(state.out)):
        state.refine()
        state.squares()
    start, length, period = (np.concatenate(x) if state.runs else np.zeros(0, np.int64) for x in (zip(*state.runs) if state.runs else ((), (), ())))
    good = length >= np.maximum(least, periods * period)
    order = np.lexsort((period[good], start[good]))
    return start[good][order], length[good][order], period[good][order]


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, the words repeat with period p; for a tenth of the documents, by the checksum of doc_id."""
    import zlib

    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def collapsed_block(ids: list, texts: list[bytes], tail: Callable | None, least: int, periods: int) -> list[tuple]:
    """(doc_id, runs, collapsed text) of each document; all of them are refined together."""
    import pyarrow as pa

    split = [t.split() for t in texts]  # bytes.split() parts at exactly \x20 and \x09-\x0D
    for k, (doc_id, w) in enumerate(zip(ids, split)):
        if tail is not None and (cut := tail(doc_id, len(w))) is not None:
            a, p = cut
            split[k] = w[:a] + (w[a : a + p] * -(-(len(w) - a) // p))[: len(w) - a]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    codes = pa.array([w for ws in split for w in ws], pa.large_binary()).dictionary_encode()
    words = np.asarray(codes.indices).astype(np.int64)
    words += np.repeat(np.arange(len(split)) * (len(codes.dictionary) + 1), sizes)
    laid = np.full(len(words) + len(split), -1, np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    laid[spans(first, sizes)] = words
    start, length, period = find_runs(laid, np.repeat(sizes // periods, sizes + 1), least, periods)
    of = np.searchsorted(first, start, "right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, s, n, q in zip(of.tolist(), (start - first[of]).tolist(), length.tolist(), period.tolist()):
        found.setdefault(k, []).append((s, n, q))
    out = []
    for k, w in enumerate(split):
        runs = found.get(k, [])
        if runs:
            kept = np.ones(len(w), bool)
            for s, n, q in runs:
                kept[s + q : s + n] = False
            w = [w[j] for j in np.flatnonzero(kept).tolist()]
        out.append((ids[k], runs, b" ".join(w)))
    return out


def collapse_runs(docs: DataFrame, tail: Callable | None = None, least: int = 6, periods: int = 4) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and collapsed: the text's words joined by one space, but for
    those that any run holds after its first period.  A narrow map: no shuffle, BLOCK_WORDS words at a time.

    Words are stretches without \\x20 and \\x09-\\x0D.  tail(doc_id, number of words) may give (a, p): words from a on are replaced by a
    repetition of period p before runs are looked for.  Null and empty texts have no run and collapse to an empty text; a null
    doc_id stays and is never given a tail; repeated rows give repeated rows; a text of any length is taken whole (memory: some
    300 bytes for each of its words); an empty table gives an empty one; other columns are dropped, whatever their names.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        claim_worker("periodic")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            sizes = np.fromiter((len(t.as_buffer()) for t in texts), np.int64, len(texts)) // 5
            block = np.cumsum(sizes) // BLOCK_WORDS
            for b in np.unique(block).tolist():
                lo, hi = np.searchsorted(block, b), np.searchsorted(block, b, "right")
                rows = collapsed_block(ids[lo:hi], texts[lo:hi].to_pylist(), tail, least, periods)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x[1]] for x in rows], kind)
                text = pa.array([x[2] for x in rows], pa.large_binary()).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), runs, text.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_report(collapsed: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest (ties: the first, then the shorter period), and digests of all runs and of the text."""
    best = F.element_at(F.array_sort("runs", lambda a, b: F.when(a.length != b.length, F.when(a.length > b.length, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    has = F.size("runs") > 0
    return collapsed.withColumn("best", F.when(has, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(has, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
