"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole tokens.
Tier two: all other pre-tokens merge by rank, with a heap over linked bytes.

Nulls are empty texts and give no ids; empty tables give empty results; repeated rows each give a row.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import claim_worker, id_and_text
from .mph import MinimalPerfectHash

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct pre-tokens that a worker remembers before it starts anew: memory is bounded, results are not affected.
MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import xxhash

        self.ranks, self.find, self.hash = ranks, regex.compile(pattern).findall, xxhash.xxh3_64_intdigest
        words = list(ranks)
        hashes = np.fromiter(map(self.hash, words), np.uint64, len(words))
        self.index = MinimalPerfectHash.build(hashes)
        self.slot_word: list[bytes] = [b""] * len(words)
        self.slot_id = [0] * len(words)
        for slot, w in zip(self.index.lookup(hashes).tolist(), words):
            self.slot_word[slot], self.slot_id[slot] = w, ranks[w]
        self.words = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            self.words[i] = w
        self.memo: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the adjacent pair of lowest rank, leftmost first, is joined until none has a rank."""
        get, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))  # end[i]: where the piece that starts at i ends; 0 if none starts there
        before = list(range(-1, n - 1))  # start of the piece to the left
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two pieces has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := get(word[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def learn(self, tokens: list[str]) -> None:
        """Put pre-tokens into the memo: the perfect hash for all at once, then merges for those it lacks."""
        raw = [t.encode() for t in tokens]
        slots = self.index.lookup(np.fromiter(map(self.hash, raw), np.uint64, len(raw))).tolist()
        memo, words, ids, merge = self.memo, self.slot_word, self.slot_id, self.merge
        for t, w, s in zip(tokens, raw, slots):
            memo[t] = array("I", [ids[s]] if s >= 0 and words[s] == w else merge(w)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            found = [self.find(t) for t in texts[at : at + 256]]
            if len(self.memo) > MEMO:
                self.memo.clear()
            if new := set().union(*found).difference(self.memo):
                self.learn(list(new))
            get = self.memo.__getitem__
            out += [b"".join(map(get, f)) for f in found]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OPEN: dict = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each Python worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBPE(load_ranks(path), pattern)
    claim_worker("byte-bpe", _OPEN[path, pattern].memo.clear)
    return _OPEN[path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again, and digest both; with keep_ids the ids are returned as well.

    A narrow map: no shuffle, one Arrow batch in memory at a time.
    """
    import pyarrow as pa

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = bpe.encode(part.column("text").to_pylist())
                cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * keep_ids, names=names)

    return id_and_text(docs).mapInArrow(run, SCHEMA + ", ids binary" * keep_ids)
