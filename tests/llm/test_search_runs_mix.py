"""Hard negatives, periodic runs and mixing against brute force, on tables with nulls, ties, repeated rows, odd values and clashing columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import hard_negatives, mixing, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# hard negatives

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_negatives(rows, every=50):
    """rows: vec_id, label, vector."""
    good = [(v, l, [max(-(2**62), min(2**62, math.floor(256 * x))) for x in e]) for v, l, e in rows if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]

    def dot(a, b):
        s = sum(x * y for x, y in zip(a, b))
        return max(-(2**63) + 1, min(2**63 - 1, s))

    def key(s, r):
        return (-s, good[r][0] is None, good[r][0] or 0, r)

    out = Counter()
    for i, (v, l, e) in enumerate(good):
        if v is None or v % every:
            continue
        scores = sorted((key(dot(e, g[2]), r) for r, g in enumerate(good) if r != i))
        for s, _, _, p in [x for x in scores if good[x[3]][1] == l][:5]:
            found = [x for x in scores if good[x[3]][1] != l and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            for k, x in enumerate(found):
                out[v, good[p][0], k + 1, good[x[3]][0], -s, -x[0]] += 1
    return out


def vectors(seed, n, scale):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) + 0.5 for _ in range(8)] for _ in range(n)]
    return [(k, rng.choice([1, 1, 1, 2, 3]), [x * scale(rng) for x in base[rng.randrange(n)]]) for k in range(n)]


@pytest.mark.parametrize("scale", [lambda r: 1.0, lambda r: 0.1 * r.random(), lambda r: 1e6 * r.random(), lambda r: 1e17 * r.random()])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "GROUP", 400)  # many groups
    rows = vectors(3, 260, scale)
    rows += [rows[50], rows[50], (50, 2, rows[51][2]), (None, 1, rows[3][2]), (None, 2, rows[4][2]), (100, None, rows[5][2]), (150, 1, None), (200, 1, [None] * 8), (201, 2, [float("nan")] * 8), (202, 2, [float("inf")] + [0.0] * 7), (250, 1, []), (251, 2, [0.0] * 8), (252, 2, [1.0, 2.0]), (-50, 3, [-x for x in rows[7][2]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("g", "row", "norm", "v", "window", "score", "rank")})
    want = brute_negatives(rows)
    assert sum(want.values()) >= 15
    assert rows_of(hard_negatives.hard_negatives(df), COLS) == want
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_one_vector_for_a_third(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 400)
    rows = vectors(4, 200, lambda r: 1.0)
    rows += [(300 + k, 1 + k % 3, rows[0][2]) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(hard_negatives.hard_negatives(df), COLS) == brute_negatives(rows)


def test_buckets_are_pruned(monkeypatch):
    """Small rows come after large ones and are never multiplied once the kth score lies above their bound."""
    monkeypatch.setattr(hard_negatives, "BUCKET", 10)
    n, seen = 200, []
    vec = [np.array([1000 if i < 50 else 1, 0]) for i in range(n)]
    group = hard_negatives.Group(np.arange(n), np.arange(n), np.ones(n, int), vec, np.array([float(v[0]) for v in vec]))
    found = hard_negatives.Found(3, True, np.array([-1]), np.array([1]), np.array([1000.0]), np.array([-(2**63)]), np.array([2**63 - 1]))
    offer = found.offer
    monkeypatch.setattr(found, "offer", lambda w, s, i, a: (seen.extend(i.tolist()), offer(w, s, i, a)))
    group.search(found, np.array([[1000, 0]]), np.array([0]))
    assert found.id.tolist() == [0, 1, 2] and max(seen) < 60


# periodic runs


def brute_runs(w, least=6, periods=4):
    n, out = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n_, q) for (s, n_), q in out.items())


def odd_words(rng):
    k, w = rng.choice([1, 2, 3, 5, 30]), []
    for _ in range(rng.randint(0, 7)):
        u = [rng.randrange(k) for _ in range(rng.randint(1, 8))]
        w += u * rng.randint(1, 8)
    return w


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_find_runs():
    rng = random.Random(5)
    for _ in range(400):
        docs = [odd_words(rng) for _ in range(rng.randint(1, 5))]
        laid, limit, first = [], [], []
        for d, w in enumerate(docs):
            first.append(len(laid))
            laid += [d * 1000 + x for x in w] + [-1]
            limit += [len(w) // 4] * (len(w) + 1)
        s, n, q = periodic.find_runs(np.array(laid), np.array(limit))
        got = defaultdict(list)
        for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()):
            d = np.searchsorted(first, a, "right") - 1
            got[d].append((a - first[d], b, c))
        assert [got[d] for d in range(len(docs))] == [brute_runs(w) for w in docs]
    with pytest.raises(ValueError):
        periodic.find_runs(np.array([1, -1]), np.array([0, 0]), periods=3)


@pytest.fixture(scope="module")
def run_rows():
    rng = random.Random(6)
    texts = [" ".join(f"w{x}" for x in odd_words(rng)) for _ in range(300)]
    texts += [None, "", " \t\n", "a " * 4000, "ab\tcd\x0bef\n" * 500, "x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y", " ".join(fibonacci(900)), "aé 日本 " * 9, " ".join(f"u{i % 977}" for i in range(5000))]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(3, texts[3]), (3, texts[3]), (None, "z " * 9), (-5, "q r " * 8)]


def brute_report(rows):
    out = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        n = len(w)
        if d is not None and n and not (h := zlib.crc32(str(d).encode())) % 10:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for i, x in enumerate(w) if i not in drop))]
        out[d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha] += 1
    return out


def test_periodic_query(spark, run_rows, tmp_path, monkeypatch):
    df = spark.createDataFrame(run_rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "best", "collapsed", "start", "length")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = brute_report(run_rows)
    assert sum(v for k, v in want.items() if k[1]) > 40
    assert rows_of(got, got.columns) == want
    assert periodic.run_report(periodic.collapse_runs(df.limit(0))).count() == 0


def test_runs_in_blocks(run_rows, monkeypatch):
    """Documents refined together or alone give the same."""
    ids, texts = zip(*[(d, (t or "").encode()) for d, t in run_rows])
    whole = periodic.collapsed_block(list(ids), list(texts), periodic.planted_tail, 6, 4)
    assert whole == [periodic.collapsed_block([d], [t], periodic.planted_tail, 6, 4)[0] for d, t in zip(ids, texts)]


def test_radix_heap():
    rng, heap, want = random.Random(1), periodic.RadixHeap(), []
    pairs = [(rng.randint(1, 300), k) for k in range(500)]
    heap.put(*map(np.array, zip(*pairs)))
    for level in range(1, 301):
        if level > 1:
            heap.advance()
        assert heap.due().tolist() == sorted(k for g, k in pairs if g == level)
        want.append(heap.left)
    assert want[-1] == 0


# mixing


def brute_targets(size_of, weights, share, passes):
    """Exact water-filling."""
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, full = share * sum(size_of.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (total - passes * sum(size_of[s] for s in full)) / free if free else 0
        new = {s for s in names if s not in full and weight[s] * level >= passes * size_of[s]}
        if not new:
            return {s: Fraction(passes * size_of[s]) if s in full else weight[s] * level for s in names}
        full |= new


@pytest.fixture(scope="module")
def mix_rows():
    rng = random.Random(7)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["src0"] * 8 + [f"src{j}" for j in range(12)] + ["é", "Z", ""])) for k in range(600)]
    return rows + [(9, "a b c", None), (9, "a b c", None), (9, "a b", "src0"), (None, "a\tb\x0bc", "src0"), (None, None, "src3"), (700, "x " * 20000, "src5"), (701, "", "empty"), (702, "long " * 9, "zz\U0001f600")]


@pytest.mark.parametrize("share, passes", [(Fraction(3, 2), 2), (Fraction(1, 3), 1), (Fraction(5), 2)])
def test_mixing(spark, mix_rows, share, passes):
    df = spark.createDataFrame(mix_rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "bucket", "before", "weight", "i", "key")})
    got = mixing.curriculum(df, share, passes).collect()
    sizes = Counter()
    for _, t, s in mix_rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets({s: sizes[s] for _, _, s in mix_rows}, (5, 2, 1), share, passes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, s in mix_rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(target[r["source"]]), rel=1e-12)
        assert r["taken"] == sum(p["words"] for p in r["plays"]) <= passes * r["size"] and all(0 < p["words"] <= r["size"] for p in r["plays"])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(float(target[s]) + 0.5) for s in target)
    # time: the words of a source trained on before a moment are its demand up to then
    plays = defaultdict(list)
    for r in got:
        plays[r["source"]] += [(p["at"], p["words"]) for p in r["plays"]]
    names = sorted(target, key=lambda s: (s is None, s or ""))
    for i, s in enumerate(names):
        knots, done = mixing.SCHEDULES[i % 3], 0
        for at, words in sorted(plays[s]):
            (_, a), (_, b) = knots
            assert (a * at + (b - a) * at * at / 2) / mixing.integrals(knots)[-1] == pytest.approx(done / float(target[s]), abs=1e-9)
            done += words


def test_mixing_again_and_in_order(spark, mix_rows, monkeypatch):
    df = spark.createDataFrame(mix_rows, "doc_id long, text string, source string")
    cols = ["doc_id", "source", "size", "taken"]
    first = mixing.curriculum(df)
    order = [(r["at"], r["doc_id"] or -1) for r in mixing.training_order(first).select("at", "doc_id").collect()]
    assert order == sorted(order) and len(order) > 300
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)  # other buckets, other partitions
    assert rows_of(first, cols) == rows_of(mixing.curriculum(df.repartition(9)), cols)
    assert mixing.mix_documents(df.limit(0)).count() == 0
    assert mixing.mix_documents(df.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_schedules(spark):
    knots = ((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 2.0))
    total = mixing.integrals(knots)
    assert total == [0, 0.5, 1.0, 1.0, 1.25]
    df = spark.range(101).select((F.col("id") / 100).alias("y"))
    for r in df.select("y", mixing.time_of(F.col("y"), knots).alias("t")).collect():
        made = np.trapezoid(np.interp(x := np.linspace(0, r["t"], 4001), *zip(*knots)), x)
        assert made == pytest.approx(r["y"] * 1.25, abs=1e-4)
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (0.9, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, -1.0))):
        with pytest.raises(ValueError):
            mixing.integrals(bad)
