"""Best-fit-decreasing packing of token sequences into windows.

Documents are tokenized, ended with an id, and cut into full windows plus one remainder.  Pieces are
dealt into groups of some thousands by a hash (so no key, source or length can make a group large),
and each group is packed on its own: longest first, each into the tightest open window that holds it,
found in a segment tree indexed by remaining capacity.  Only piece lengths are shuffled, never ids.

Null texts are empty; an empty text is its end id alone.  A text of any length is cut into full windows first.  Rows with a
null doc_id are packed like others.  Ties in length go by doc_id and start.  Other columns are ignored, whatever their names.
"""
from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces in a group, about: the windows left open at a group's end are the only loss against one group.
GROUP = 2048


class CapacityTree:
    """Counts of open windows by remaining capacity; ``tightest`` finds the least capacity >= a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        """-1 if no open window has so much room."""
        count, i = self.count, least + self.size
        if count[i]:
            return least
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length; ties keep input order."""
    tree, open_bins = CapacityTree(window), [[] for _ in range(window + 1)]
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.tightest(n) if n < window else -1
        if room < 0:
            b, room, used = used, window, used + 1
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = b, window - room
        if room > n:
            open_bins[room - n].append(b)
            tree.add(room - n, 1)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    """One row per piece of at most window ids; an empty text has the end id alone."""
    import pyarrow as pa

    def run(batches):
        from .word_bpe import encoder

        enc = encoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, rows = b.slice(at, 512), []
                for doc, raw in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    ids = np.append(np.frombuffer(raw, enc.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4")
                    rows += [(doc, s, min(window, len(ids) - s), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """Adds sequence_id (unique) and offset (gapless from 0).  Pieces must be a materialised table: they are read twice.

    Repeated rows are packed as often as they occur, each by its place in the table, so that copies of one row spread over the
    groups too; an empty table gives an empty result.
    """
    import pandas as pd

    groups = max(1, -(-pieces.count() // GROUP))

    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        return pdf.drop(columns="part").assign(sequence_id=np.array(bins, np.int64) + (int(key[0]) << 32), offset=np.array(offsets, np.int64))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    return pack(materialise(token_pieces(docs, tokenizer_path, end_id, window), "pieces"), window)
