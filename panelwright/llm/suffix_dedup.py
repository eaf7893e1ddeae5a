"""Suffix-array deduplication: bytes covered by a LENGTH-byte string that also starts elsewhere are removed.

Sorting a suffix for every byte would move LENGTH times the corpus.  Instead:

1. In every window of LENGTH bytes the k-gram of least hash (leftmost of equals) is the window's anchor: equal windows
   have equal anchors at equal offsets, so only about one position in eighty stands for all windows around it.
2. Anchors whose k-gram hash occurs once in the corpus end here.  The others are summed up by their context (all bytes
   of their windows), so that copies meet the sort as one: a context that occurs twice repeats in full, wherever it occurs.
3. Where contexts of one k-gram differ, some of their windows may still be equal.  Their suffixes are dealt out by
   sampled splitters on the leading bytes; each bucket forms the suffixes at all window starts, sorts them by multikey
   quicksort on 8-byte symbols, and finds neighbours with LENGTH equal bytes.  A k-gram with more than GROUP contexts does
   not fit one bucket: each of its suffixes is a row, dealt by splitters on all its bytes and its place, so that even
   equal suffixes spread over buckets; a bucket compares neighbours, and its first and last run with those of the
   buckets next to it.
4. Repeated windows become byte ranges of documents, merged per document and cut out.

Every step is exact but for the hash equality of k-grams and contexts (128 bits together).  A text longer than SLICE is
cut into slices that overlap by LENGTH - 1 bytes, so that each window is in one of them.  Null texts are empty; texts
under LENGTH bytes are never touched; rows alike in doc_id and text count as separate copies of each other and get the
same result; empty tables stay empty.  Other columns are ignored; with keep_text they are carried, and an input's own
``suffix_*`` columns are replaced.
"""
from __future__ import annotations

import hashlib
from itertools import chain, groupby, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, claim_worker, id_and_text, materialise, partitions, split_join
from .mph import mix

LENGTH, K = 200, 40
#: Contexts of one k-gram that one bucket sorts; more are compared across buckets.  Suffixes sorted at once.
GROUP, SUFFIXES = 16_384, 300_000
SLICE = 2 << 20
_POS = np.uint64(28)
_BYTE = mix(np.arange(256, dtype=np.uint64), 31)
_MUL = [int(x) | 1 for x in mix(np.arange(8, dtype=np.uint64), 32)]


def kgram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 40-byte strings of buf, by doubling: 1, 2, 4, 8, 16, 32, then 32 + 8."""
    with np.errstate(over="ignore"):
        h, kept, size = _BYTE[buf], None, 1
        for level in range(5):
            h = h[:-size] * np.uint64(_MUL[level]) + h[size:]
            size *= 2
            if size == 8:
                kept = h
        h = h[: len(kept) - 32] * np.uint64(_MUL[5]) + kept[32 : 32 + len(h)]
        return h ^ (h >> np.uint64(29))


def window_anchors(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """(anchor position, first window, last window, k-gram hash) for the texts laid end to end in buf; no window crosses texts."""
    none = np.zeros(0, np.int64)
    long = stops - starts >= LENGTH
    if not long.any():
        return none, none, none, none.astype(np.uint64)
    h = kgram_hashes(buf)
    with np.errstate(over="ignore"):
        order = ((h * np.uint64(_MUL[6])) >> _POS) << _POS
    order |= np.arange(len(h), dtype=np.uint64)
    span, low = LENGTH - K + 1, order
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(order) - span + 1], low[span - size : span - size + len(order) - span + 1])
    step = np.zeros(len(buf) + 1, np.int8)
    step[starts[long]] += 1
    step[stops[long] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[: len(low)], dtype=np.int8))
    p = (low[at] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    last = np.r_[new[1:], len(p)] - 1
    return p[new], at[new], at[last], h[p[new]]


def _together(slices):
    """Lists of slices of about SLICE bytes in all, at least one each."""
    held, size = [], 0
    for s in slices:
        if held and size + len(s[2]) > SLICE:
            yield held
            held, size = [], 0
        held.append(s)
        size += len(s[2])
    if held:
        yield held


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, th, place, g, c.  place packs first window (from bit 24), windows - 1 (12 bits), anchor - first window (12 bits)."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        claim_worker("suffixes")
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            ids, ths = b.column("doc_id"), b.column("th").to_numpy()
            slices = ((i, at, raw[at : at + SLICE + LENGTH - 1]) for i, raw in enumerate(b.column("raw").to_pylist()) for at in range(0, max(1, len(raw) - LENGTH + 1), SLICE))
            for part in _together(slices):
                raw = b"".join(x for _, _, x in part)
                of, first = (np.array([x[i] for x in part], np.int64) for i in (0, 1))
                edges = np.cumsum([0, *(len(x) for _, _, x in part)])
                p, lo, hi, g = window_anchors(np.frombuffer(raw, np.uint8), edges[:-1], edges[1:])
                doc = np.searchsorted(edges, p, "right") - 1
                c = np.fromiter((digest(raw[s : e + LENGTH], o) for s, e, o in zip(lo.tolist(), hi.tolist(), (p - lo).tolist())), np.uint64, len(p))
                place = ((lo - edges[doc] + first[doc]) << 24) | ((hi - lo) << 12) | (p - lo)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[doc])), pa.array(ths[of[doc]]), pa.array(place), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], names=["doc_id", "th", "place", "g", "c"])

    keyed = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("raw"))
    return keyed.mapInArrow(run, "doc_id long, th long, place long, g long, c long")


def multikey_groups(symbols, n: int, depth: int) -> np.ndarray:
    """True for each of n strings that equals another one in all symbols.  symbols(d, which) gives symbol d of some strings.

    Strings are sorted by the first symbol; runs of equals are sorted on by the next, and strings alone in their run drop out.
    """
    active, run = np.arange(n), np.zeros(n, np.int64)
    for d in range(depth):
        if not len(active):
            break
        value = symbols(d, active)
        order = np.lexsort((value, run))
        active, run, value = active[order], run[order], value[order]
        new = np.r_[True, (run[1:] != run[:-1]) | (value[1:] != value[:-1])]
        ids = np.cumsum(new) - 1
        many = np.bincount(ids)[ids] > 1
        active, run = active[many], ids[many]
    out = np.zeros(n, bool)
    out[active] = True
    return out


def equal_windows(contexts: list[bytes], before: list[int], group: list[int]) -> list[np.ndarray]:
    """For contexts of several k-grams (before: the anchor's offset in the context, group: number of the k-gram), which of each one's
    windows occur in another context of the k-gram.

    Only windows with the anchor at the same offset can be equal: k-gram and offset are the first symbol, and offsets are taken in
    turns of at most SUFFIXES suffixes.
    """
    n, before, group = np.array([len(c) - LENGTH + 1 for c in contexts]), np.array(before), np.array(group, np.uint64)
    flat = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    base, flag_base = np.cumsum([0, *map(len, contexts)])[:-1], np.cumsum(n) - n
    word = np.zeros(len(flat) - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | flat[i : len(flat) - 7 + i]
    flags = np.zeros(n.sum(), bool)
    step = max(1, SUFFIXES // len(n))
    for low in range(0, int(before.max()) + 1, step):
        first = np.maximum(0, before - low - step + 1)
        k = np.maximum(np.minimum(n, before - low + 1) - first, 0)
        owner = np.repeat(np.arange(len(n)), k)
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + first[owner]
        start, head = base[owner] + inner, (group[owner] << np.uint64(16)) | (before[owner] - inner).astype(np.uint64)
        found = multikey_groups(lambda d, which: head[which] if d == 0 else word[start[which] + 8 * (d - 1)], len(start), 1 + LENGTH // 8)
        flags[(flag_base[owner] + inner)[found]] = True
    return np.split(flags, np.cumsum(n)[:-1])


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


WINDOWS = "g long, c long, n long, windows array<struct<first:int,last:int>>"


def partial_repeats(bytes_of: DataFrame) -> DataFrame:
    """g, c, windows: the repeated windows of contexts that occur once, by sorted buckets."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        held, lead = [], None

        def flush():
            names: dict = {}
            flags = equal_windows([r[2] for r in held], [r[3] for r in held], [names.setdefault(r[0], len(names)) for r in held])
            out = [(r[0], r[1], _ranges(f)) for r, f in zip(held, flags) if r[4] == 1 and f.any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([1] * len(out), pa.int64()), pa.array([[{"first": a, "last": z} for a, z in o[2]] for o in out], kind)], names=["g", "c", "n", "windows"])

        for b in batches:
            for d, *row in zip(*(b.column(n).to_pylist() for n in ("lead", "g", "c", "context", "before", "n"))):
                if d != lead and len(held) >= 2000:  # many k-grams to a sort; one k-gram never in two
                    yield from flush()
                    held = []
                lead = d
                held.append(row)
        if held:
            yield from flush()

    dealt = bytes_of.repartitionByRange(partitions(bytes_of.sparkSession), "lead").sortWithinPartitions("lead")
    return dealt.select("lead", "g", "c", "context", "before", "n").mapInArrow(run, WINDOWS)


def partial_repeats_hot(bytes_of: DataFrame) -> DataFrame:
    """The same for k-grams with very many contexts: one sorted order of suffixes over all buckets, compared across their borders."""
    import pyarrow as pa

    def suffixes(batches):
        for b in batches:
            for g, c, context, before, n in zip(*(b.column(x).to_pylist() for x in ("g", "c", "context", "before", "n"))):
                m = len(context) - LENGTH + 1
                bytes_ = [(before - i).to_bytes(2, "big") + context[i : i + LENGTH] for i in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * m, pa.int64()), pa.array([c] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(np.arange(m, dtype=np.int32)), pa.array(bytes_, pa.binary())], names=["g", "c", "n", "i", "suffix"])

    names = ["g", "c", "n", "i", "suffix"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_()]

    def judged(rows, part):
        """Rows that occur twice; a bucket's first and last suffix as marks (g null); and lone rows there, undecided (twice null)."""
        count, lone, suffix = 0, None, None
        for suffix, run in groupby(rows, key=lambda r: r[4]):
            head, second = next(run), next(run, None)
            if count == 0:
                yield None, None, None, None, suffix, None, part, False
            lone = None
            if second is not None:
                for row in chain((head, second), run):
                    yield *row[:4], None, True, part, None
            elif count == 0:
                yield *head, None, part, None
            else:
                lone = head
            count += 1
        if lone is not None:
            yield *lone, None, part, None
        if count:
            yield None, None, None, None, suffix, None, part, True

    def neighbours(batches):
        from pyspark import TaskContext

        rows = (row for b in batches for row in zip(*(b.column(x).to_pylist() for x in names)))
        made = judged(rows, TaskContext.get().partitionId())
        while held := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*held), kinds)], names=[*names, "twice", "part", "is_last"])

    rows = materialise(bytes_of.select("g", "c", "context", "before", "n").mapInArrow(suffixes, "g long, c long, n long, i int, suffix binary"), "hot-suffixes")
    dealt = rows.repartitionByRange(partitions(bytes_of.sparkSession), "suffix", "c", "i").sortWithinPartitions("suffix", "c", "i")
    found = materialise(dealt.mapInArrow(neighbours, "g long, c long, n long, i int, suffix binary, twice boolean, part int, is_last boolean"), "hot-neighbours")
    order = Window.orderBy("part", "is_last")  # two marks a bucket
    across = F.when(F.col("is_last"), F.lead("suffix").over(order)).otherwise(F.lag("suffix").over(order))
    met = found.filter("is_last is not null").withColumn("other", across).filter("other = suffix").select("part", "suffix").distinct()
    lone = found.filter("twice is null and is_last is null").join(met, ["part", "suffix"], "left_semi")
    hit = found.filter("twice").select("g", "c", "n", "i").unionByName(lone.select("g", "c", "n", "i")).filter("n = 1")
    return hit.groupBy("g", "c", "n").agg(F.transform(F.sort_array(F.collect_list("i")), lambda i: F.struct(i.alias("first"), i.alias("last"))).alias("windows"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, th, ranges: byte ranges [start, stop) of each document that has any, unmerged."""
    found = materialise(anchors(docs), "anchors")
    twice = materialise(found.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1"), "hot-grams")
    hot = materialise(split_join(found, twice, ["g"], "k", F.xxhash64("doc_id", "th", "place")), "hot-anchors")
    contexts = materialise(hot.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("rep")), "contexts")
    groups = materialise(contexts.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("g", "k", F.col("k").alias("rows")), "contested-grams")
    contested = materialise(split_join(contexts, groups, ["g"], "rows", F.col("c")).select("g", "c", "n", "k", "rep.*"), "contested")
    first, before = F.shiftright("place", 24), F.col("place").bitwiseAND(4095)
    windows = F.shiftright("place", 12).bitwiseAND(4095)
    keyed = id_and_text(docs).select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("raw"))
    fetched = keyed.join(broadcast_if_small(contested), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    cut = fetched.select("g", "c", "n", "k", F.substring(F.col("raw"), (first + before + 1).cast("int"), F.lit(K)).alias("lead"), F.substring(F.col("raw"), (first + 1).cast("int"), (windows + LENGTH).cast("int")).alias("context"), before.cast("int").alias("before"))
    bytes_of = materialise(cut.dropDuplicates(), "context-bytes")  # rows alike in doc_id and text give the same context
    some = partial_repeats(bytes_of.filter(F.col("k") <= GROUP))
    if not bytes_of.filter(F.col("k") > GROUP).isEmpty():
        some = some.unionByName(partial_repeats_hot(bytes_of.filter(F.col("k") > GROUP)))
    whole = contexts.filter("n > 1").select("g", "c", "n", F.lit(None).cast("array<struct<first:int,last:int>>").alias("windows"))
    verdict = materialise(whole.unionByName(some), "verdicts")
    full = F.array(F.struct(F.lit(0).alias("first"), windows.cast("int").alias("last")))
    cut = split_join(hot, verdict, ["g", "c"], "n", F.xxhash64("doc_id", "th", "place")).select("doc_id", "th", first.alias("at"), F.explode(F.coalesce("windows", full)).alias("w"))
    ranges = cut.select("doc_id", "th", (F.col("at") + F.col("w.first")).alias("start"), (F.col("at") + F.col("w.last") + LENGTH).alias("stop"))
    return ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def cut_out(raw: bytes, ranges: list) -> tuple[bytes, int, int]:
    """(bytes that stay, number removed, maximal runs removed)."""
    kept, at, spans, gone = [], 0, 0, 0
    end = -1
    for start, stop in sorted(ranges):
        if start > end:
            spans += 1
            kept.append(raw[at:start])
        if stop > end:
            gone += stop - max(start, end)
            at = end = stop
    kept.append(raw[at:])
    return b"".join(kept), gone, spans


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 - and with keep_text all columns of docs, text rewritten.

    The rewritten text leaves out the rest of a character that a range has cut.
    """
    import pyarrow as pa

    ranges = repeated_ranges(docs).select(F.col("doc_id").alias("__g"), F.col("th").alias("__t"), F.transform("ranges", lambda r: F.array(r["start"], r["stop"])).alias("__ranges"))
    names = docs.columns if keep_text else ["doc_id", "text"]
    keyed = docs.select(*names).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__raw", F.coalesce("text", F.lit("")))
    joined = keyed.withColumn("__th", F.xxhash64("__raw")).join(ranges, F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__th") == F.col("__t")), "left")
    made = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string())}
    if keep_text:
        made = {"text": ("string", pa.string())} | {f"suffix_{n}": t for n, t in made.items()}
    rest = [n for n in names if n != "doc_id" and n not in made] if keep_text else []

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, rows = b.slice(at, 512), []
                for text, ranges in zip(part.column("__raw").to_pylist(), part.column("__ranges").to_pylist()):
                    raw = text.encode()
                    kept, gone, spans = cut_out(raw, ranges or [])
                    row = (len(raw), gone, spans, hashlib.sha256(kept).hexdigest())
                    rows.append((kept.decode(errors="ignore") if gone else text, *row) if keep_text else row)
                cols = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), made.values())]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *(part.column(n) for n in rest), *cols], names=["doc_id", *rest, *made])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(["doc_id long", *(f"`{n}` {kinds[n]}" for n in rest), *(f"`{n}` {k}" for n, (k, _) in made.items())])
    return joined.select("__id", "__raw", "__ranges", *rest).mapInArrow(run, schema)
