"""Toxic spans by a two-state linear-chain conditional random field; marginals add up to document scores.

Training sees only labelled rows outside the held-out fifth.  Document labels become token labels by
distant supervision: a token of a toxic document is labelled when one of its features is far commoner in
toxic than in clean documents.  The chain (one per sentence) has token features (word, its beginnings
and endings) and transition weights, fitted by maximum likelihood with forward-backward in numpy.  A
document's score is a logistic function of its highest and its summed marginals, fitted on the same sample.

Bounds (documented parameters): at most ``sample`` labelled documents of each label with at most ``characters``
characters in all take part in training, whole texts chosen by a hash of doc_id, long ones included; of the sample's
sentences without any telling feature ``others`` stand for all, weighted by their number.  Scoring reads whole texts of
all rows.  Labels, language, source and doc_id never enter a score.

Null texts are empty and score like any text without words; texts and sentences of any length are run whole.  Without
any toxic, or any clean, training row all scores are the share of toxic rows.  A repeated doc_id trains with one of its
texts; repeated rows score alike.  An empty table gives an empty result.  A carried column that has the name of a result
column is replaced by the result.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_worker, id_and_text

_TOKENS = re.compile(r"\w+|[.!?\n]")
_STOPS = frozenset(".!?\n")
#: Chains beyond this length are run one by one, shorter ones side by side; results are the same.
LONG = 256
MEMO = 200_000
AFFIXES = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    out = ["=" + word]
    for k in AFFIXES:
        if len(word) >= k:
            out += ["^" + word[:k], "$" + word[-k:]]
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # log-odds of the toxic state, by feature
    bias: float = -6.0
    trans: tuple = ((0.0, 0.0), (0.0, 0.0))  # log weights from state to state
    doc: tuple = (0.0, 0.0, 0.0)  # intercept, highest marginal logit, log of the summed marginals

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in features(word))


class Memo(dict):
    def __init__(self, model: Model):
        super().__init__({s: np.inf for s in _STOPS})
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
            self.update({s: np.inf for s in _STOPS})
        self[word] = e = self.model.emission(word)
        return e


def chains(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token positions without stops, start of each chain among them); chains end at stops and documents' ends."""
    stop = np.isinf(values)
    keep = np.flatnonzero(~stop)
    if not len(keep):
        return keep, np.zeros(0, np.int64)
    group = np.cumsum(stop)[keep]
    new = np.r_[True, (group[1:] != group[:-1]) | (docs[keep][1:] != docs[keep][:-1])]
    return keep, np.flatnonzero(new)


def _layout(starts: np.ndarray, lengths: np.ndarray):
    """Chains longest first: starts, lengths, and how many are alive at each step."""
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    return starts[order], lengths, alive


def forward_backward(e: np.ndarray, starts: np.ndarray, trans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state 1 against 0: forward r, backward s and marginal r*s, for emissions e of all chains laid end to end."""
    t = np.exp(np.asarray(trans, float))
    x, r, s = np.exp(e), np.empty(len(e)), np.ones(len(e))
    ends = np.r_[starts[1:], len(e)]
    (t00, t01), (t10, t11) = t.tolist()
    for a, z in zip(starts[ends - starts > LONG].tolist(), ends[ends - starts > LONG].tolist()):
        xs = x[a:z].tolist()
        odds, back = [xs[0]], [1.0]
        for v in xs[1:]:
            odds.append(v * (t01 + odds[-1] * t11) / (t00 + odds[-1] * t10))
        for v in xs[:0:-1]:
            y = v * back[-1]
            back.append((t10 + y * t11) / (t00 + y * t01))
        r[a:z], s[a:z] = odds, back[::-1]
    short = ends - starts <= LONG
    begin, lengths, alive = _layout(starts[short], (ends - starts)[short])
    if not len(begin):
        return r, s, r * s
    prev = r[begin] = x[begin]
    for k in range(1, len(alive)):
        at = begin[: alive[k]] + k
        prev = prev[: alive[k]]
        prev = r[at] = x[at] * (t[0, 1] + prev * t[1, 1]) / (t[0, 0] + prev * t[1, 0])
    for k in range(len(alive) - 2, -1, -1):
        at = begin[: alive[k + 1]] + k
        y = x[at + 1] * s[at + 1]
        s[at] = (t[1, 0] + y * t[1, 1]) / (t[0, 0] + y * t[0, 1])
    return r, s, r * s


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _aggregate(odds: np.ndarray, keep: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """(n, 2): highest marginal logit, clipped to +-12, and log(1 + expected toxic tokens)."""
    p = odds / (1 + odds)
    top, total = np.full(n, -12.0), np.zeros(n)
    if len(keep):
        np.maximum.at(top, docs[keep], np.clip(np.log(np.maximum(odds, 1e-300)), -12, 12))
        total += np.bincount(docs[keep], p, n)
    return np.c_[top, np.log1p(total)]


def _telling(b: int, a: int, n1: int, n0: int, tried: int) -> bool:
    """Whether b of n1 toxic and a of n0 clean documents make a feature telling: twelve times as common, and beyond chance for so many features tried."""
    if b < 3 or b * n0 < 12 * (a + 0.5) * n1:
        return False
    p, q = b / (a + b), n1 / (n1 + n0)
    g = 2 * (b * np.log(p / q) + (a * np.log((1 - p) / (1 - q)) if a else 0.0))
    return g > 2 * np.log(tried) + 6


def _lone(words: list[list[str]]) -> list[int]:
    """Texts that share none of their four least five-word hashes with an earlier one: copies would count as evidence twice."""
    taken: set[int] = set()
    out = []
    for i, ws in enumerate(words):
        ws = [w for w in ws if w not in _STOPS]
        least = sorted({zlib.crc32(t.encode()) for t in map(" ".join, zip(ws, ws[1:], ws[2:], ws[3:], ws[4:]))} or {zlib.crc32(" ".join(ws).encode())})[:4]
        if taken.isdisjoint(least):
            out.append(i)
        taken.update(least)
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = 100, l2: float = 0.02, others: int = 20_000) -> Model:
    y = np.asarray(toxic)
    same: dict[str, str] = {}  # one object for each distinct token
    words = [[same.setdefault(w, w) for w in _TOKENS.findall(t.lower())] for t in texts]
    if not y.sum() or y.all():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(doc=(float(np.log(share / (1 - share))), 0.0, 0.0))
    lone = _lone(words)
    made: dict[str, list[str]] = {}
    for ws in words:
        for w in ws:
            if w not in made and w not in _STOPS:
                made[w] = features(w)
    hits: Counter = Counter()
    for i in lone:
        if toxic[i]:
            hits.update({f for w in set(words[i]) - _STOPS for f in made[w]})
    tried, hits = len(hits), {f: c for f, c in hits.items() if c >= 3}
    some = {w: found for w, fs in made.items() if (found := [f for f in fs if f in hits])}
    misses: Counter = Counter()
    for i in lone:
        if not toxic[i]:
            misses.update({f for w in set(words[i]).intersection(some) for f in some[w]})
    n1 = int(y[lone].sum())
    names = {f: i for i, f in enumerate(sorted(f for f, c in hits.items() if _telling(c, misses[f], n1, len(lone) - n1, tried)))}
    of = {w: [names[f] for f in fs if f in names] for w, fs in made.items()}
    # labelled tokens of the chains, laid end to end; stops become chain ends
    flat = [w for ws in words for w in ws]
    docs = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    values = np.fromiter((np.inf if w in _STOPS else 0.0 for w in flat), float, len(flat))
    all_keep, all_starts = chains(values, docs)
    hit = np.fromiter((bool(of[flat[k]]) for k in all_keep), bool, len(all_keep))
    all_label = hit & (y[docs[all_keep]] == 1)
    # chains with a labelled token or a telling feature, and others that stand for all without, weighted by their share
    chain = np.cumsum(np.isin(np.arange(len(all_keep)), all_starts)) - 1
    told = np.bincount(chain, hit, len(all_starts)) > 0
    rest = np.flatnonzero(~told)
    taken = rest[:: max(1, -(-len(rest) // others))]
    weight = told.astype(float)
    weight[taken] = len(rest) / max(1, len(taken))
    used = weight[chain] > 0
    keep, label, many = all_keep[used], all_label[used].astype(float), weight[chain][used]
    starts = np.flatnonzero(np.r_[True, np.diff(chain[used]) != 0])
    ids = [of[flat[k]] for k in keep]
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    col = np.array([c for i in ids for c in i], np.int64)
    inner = np.ones(len(keep), bool)
    inner[starts] = False
    nxt = np.flatnonzero(inner)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (label[nxt - 1].astype(int), label[nxt].astype(int)), many[nxt])
    # maximum likelihood by Adagrad on the mean gradient
    w, bias, trans = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    gw, gb, gt, scale = np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8), max(1.0, label.sum())
    for _ in range(rounds):
        e = bias + np.bincount(row, w[col], len(keep))
        r, s, odds = forward_backward(e, starts, trans)
        p = odds / (1 + odds)
        xi = np.zeros((len(nxt), 2, 2))
        a1, b1, x1, t = r[nxt - 1], s[nxt], np.exp(e[nxt]), np.exp(trans)
        xi[:, 0, 0], xi[:, 0, 1], xi[:, 1, 0], xi[:, 1, 1] = t[0, 0], t[0, 1] * x1 * b1, a1 * t[1, 0], a1 * t[1, 1] * x1 * b1
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        off = many * (label - p)
        dw = (np.bincount(col, off[row], len(names)) - l2 * w) / scale
        db = off.sum() / scale
        dt = (seen_pairs - (many[nxt, None, None] * xi).sum(axis=0) - l2 * trans) / scale
        gw, gb, gt = gw + dw * dw, gb + db * db, gt + dt * dt
        w, bias, trans = w + 0.5 * dw / np.sqrt(gw), bias + 0.3 * db / np.sqrt(gb), trans + 0.1 * dt / np.sqrt(gt)
    model = Model({f: float(w[i]) for f, i in names.items() if w[i]}, float(bias), tuple(map(tuple, trans.tolist())))
    memo = Memo(model)
    odds = forward_backward(np.fromiter((memo[flat[k]] for k in all_keep), float, len(all_keep)), all_starts, trans)[2]
    x = np.c_[np.ones(len(y)), _aggregate(odds, all_keep, docs, len(y))]
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = _sigmoid(x @ beta)
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (y - q) - 0.01 * beta)
    model.doc = tuple(beta.tolist())
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, characters: int) -> tuple[list[str], list[int]]:
    """Bounded sample of labelled rows outside the held-out fifth.

    Of each label the ``sample`` documents that come first by a hash of doc_id are looked at (their lengths alone), and taken in that
    order as long as their characters fit; a document that does not fit is passed over.  2 * characters at most reach the driver.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    open_rows = one.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    texts = id_and_text(docs).filter("doc_id is not null")
    sized = open_rows.join(texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")), "doc_id")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    seen = [r for k in (1, 0) for r in sized.filter(F.col("toxic") == k).orderBy(*by_hash).limit(sample).collect()]  # 2 * sample rows
    left, ids = {0: characters, 1: characters}, []
    for r in seen:
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            ids.append((r["doc_id"], r["toxic"]))
    if not ids:
        return [], []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int"))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score_texts(model: Model, memo: Memo, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score and toxic spans (start, end in code points; marginal >= 0.5, neighbours joined) of each text."""
    words = [_TOKENS.findall(t.lower()) for t in texts]
    sizes = [len(w) for w in words]
    values = np.fromiter((v for ws in words for v in map(memo.__getitem__, ws)), float, sum(sizes))
    docs = np.repeat(np.arange(len(texts)), sizes)
    keep, starts = chains(values, docs)
    odds = forward_backward(values[keep], starts, model.trans)[2] if len(keep) else np.zeros(0)
    x = _aggregate(odds, keep, docs, len(texts))
    scores = _sigmoid(model.doc[0] + x @ np.array(model.doc[1:]))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    hot = keep[odds >= 1]
    first = np.cumsum([0, *sizes])
    for d in np.unique(docs[hot]).tolist():
        at = set((hot[docs[hot] == d] - first[d]).tolist())
        found = [m.span() for m in _TOKENS.finditer(texts[d])]
        if len(found) != sizes[d]:  # lower case changed the tokens: offsets of the lower-cased text
            found = [m.span() for m in _TOKENS.finditer(texts[d].lower())]
        for k in sorted(at):
            if spans[d] and k - 1 in at:
                spans[d][-1] = (spans[d][-1][0], found[k][1])
            else:
                spans[d].append(found[k])
    return scores, spans


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans - and the columns named in carry, as they are.

    A narrow map; the model is a few thousand weights at most.
    """
    import pyarrow as pa

    carry = [c for c in carry or [] if c not in ("doc_id", "held_out", "score", "predicted", "spans")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        claim_worker("toxicity")
        memo = Memo(model)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                scores, spans = score_texts(model, memo, part.column("__text").to_pylist())
                made = pa.array([[{"start": a, "stop": z} for a, z in s] for s in spans], span)
                yield pa.RecordBatch.from_arrays([part.column("__id"), *(part.column(c) for c in carry), pa.array(scores, pa.float64()), made], names=["__id", *carry, "__score", "__spans"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(["__id long", *(f"`{c}` {kinds[c]}" for c in carry), "__score double, __spans array<struct<start:int,stop:int>>"])
    scored = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"), *carry).mapInArrow(run, schema)
    held = F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(5)) == 0
    return scored.select(F.col("__id").alias("doc_id"), *carry, held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__spans").alias("spans"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 2000, characters: int = 2_500_000, carry: list[str] | None = None) -> DataFrame:
    """Scores all rows of docs by a tagger trained on at most sample documents and characters of each label."""
    return score(docs, fit(*training_rows(docs, labels, sample, characters)), carry)
