"""Token ids in flat binary shards, with a minimal-perfect-hash index from document keys to shard offsets.

Format.  A shard holds the ids of a contiguous doc_id range, ascending, each document closed by the end
id, as raw little-endian integers of the narrowest width that holds the vocabulary.  Shards are as many as
hold about SHARD_BYTES of text each.  An index file has a section for each hash bucket of keys - a perfect hash
gives a slot, the slot holds a 64-bit key fingerprint, shard number, offset and length - and, once, the paths of
the shards that its sections name.  A lookup costs one hash and one read, whatever the corpus size.

Rows with a null doc_id sort first.  Repeated doc_ids are told apart by their ordinal (order: id, then
ids' bytes).  Null texts are empty: they hold the end id alone.  An empty table gives an empty result.  A text
of any length is one document.  Other columns are ignored, whatever their names.
Files carry the writer's random suffix, so a repeated task never writes over another's file; only files
named in the committed metadata are read.
"""
from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, filesystem, fresh_dir, id_and_text, materialise, partitions, range_bounds
from .mph import MinimalPerfectHash

ENTRY = np.dtype([("print", "<u8"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
#: Keys in one section of an index file, about; text in one shard, about.
INDEX_KEYS, SHARD_BYTES = 2_048, 1 << 30


def key_hashes(doc_ids: list, ordinals: list) -> tuple[np.ndarray, np.ndarray]:
    """(placement hash, independent fingerprint) of each (doc_id, ordinal)."""
    import xxhash

    raw = [f"{d}:{o}".encode() for d, o in zip(doc_ids, ordinals)]
    place = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in raw), np.uint64, len(raw))
    prints = np.fromiter((xxhash.xxh64_intdigest(r, 7) for r in raw), np.uint64, len(raw))
    return place, prints


class KeyIndex:
    def __init__(self, mph: MinimalPerfectHash, entries: np.ndarray, shards: dict[int, str], width: int):
        self.mph, self.entries, self.shards, self.width = mph, entries, shards, width

    @classmethod
    def build(cls, doc_ids, ordinals, shard, offset, length, shards: dict[int, str], width: int) -> "KeyIndex":
        place, prints = key_hashes(doc_ids, ordinals)
        mph = MinimalPerfectHash.build(place)
        entries = np.zeros(len(place), ENTRY)
        at = mph.lookup(place)
        for name, values in (("print", prints), ("shard", shard), ("offset", offset), ("length", length)):
            entries[name][at] = values
        return cls(mph, entries, shards, width)

    def find(self, doc_ids: list, ordinals: list) -> np.ndarray:
        """Entry number of each key, -1 for keys that the fingerprint disowns."""
        place, prints = key_hashes(doc_ids, ordinals)
        at = self.mph.lookup(place)
        if not len(self.entries):
            return np.full(len(at), -1)
        return np.where((at >= 0) & (self.entries["print"][at] == prints), at, -1)

    def dumps(self) -> bytes:
        head, mph = json.dumps({"width": self.width, "shards": self.shards}).encode(), self.mph.dumps()
        return np.array([len(head), len(mph)], "<u8").tobytes() + head + mph + self.entries.tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> "KeyIndex":
        a, b = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        head = json.loads(raw[16 : 16 + a])
        return cls(MinimalPerfectHash.loads(raw[16 + a : 16 + a + b]), np.frombuffer(raw, ENTRY, -1, 16 + a + b), {int(k): v for k, v in head["shards"].items()}, head["width"])


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        from .word_bpe import encoder

        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([enc.width] * len(ids), pa.int32())], names=["doc_id", "ids", "width"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, width int")


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> tuple[DataFrame, DataFrame]:
    """Write shards and index files.  Returns (rows: doc_id, ordinal, part; index sections: part, path and places in the file).

    One shuffle carries the packed ids to their shard; a second one carries keys and offsets only.
    Shard ranges come from doc_id quantiles, so that a hot source or long texts do not gather in one.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    root = fresh_dir(spark, "token-store")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = range_bounds(ids, "doc_id", max(4 * partitions(spark), -(-size // SHARD_BYTES)))

    def write(batches):
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        out, shard, path, at, last, ordinal = None, None, None, 0, object(), 0
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("shard", "doc_id", "ids", "width")]
            rows = []
            for s, doc, raw, width in zip(*cols):
                if s != shard:
                    if out:
                        out.close()
                    shard, at, last = s, 0, object()
                    path = f"{base}/shard-{s:06d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(path)
                ordinal = ordinal + 1 if doc == last else 0
                last = doc
                out.write(raw)
                rows.append((doc, ordinal, s, path, at, len(raw) // width, width))
                at += len(raw) // width
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "ordinal", "shard", "path", "offset", "length", "width"])
        if out:
            out.close()

    encoded = encode_ids(docs, tokenizer_path, end_id).withColumn("shard", bucket_of(F.col("doc_id"), bounds).cast("int"))
    written = encoded.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    meta = materialise(written.mapInArrow(write, "doc_id long, ordinal long, shard int, path string, offset long, length long, width int"), "token-meta")
    parts = max(1, -(-meta.count() // INDEX_KEYS))
    meta = meta.withColumn("part", F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(parts)).cast("int"))

    def index(batches):
        fs, base = filesystem(root)
        name, out, at, shards, made, held, part = None, None, 0, {}, [], [], None

        def flush():
            nonlocal at
            doc, ordinal, shard, path, offset, length, width = zip(*held)
            raw = KeyIndex.build(doc, ordinal, shard, offset, length, {}, width[0]).dumps()
            shards.update(zip(shard, path))
            out.write(raw)
            made.append((part, at, len(raw)))
            at += len(raw)

        for b in batches:
            for p, *row in zip(*(b.column(n).to_pylist() for n in ("part", "doc_id", "ordinal", "shard", "path", "offset", "length", "width"))):
                if out is None:
                    name = f"{base}/index-{uuid.uuid4().hex}.mph"
                    out = fs.open_output_stream(name)
                if p != part and held:
                    flush()
                    held = []
                part = p
                held.append(row)
        if held:
            flush()
            names = json.dumps({str(k): v for k, v in shards.items()}).encode()
            out.write(names)
            out.close()
            rows = [(p, name, o, n, at, len(names)) for p, o, n in made]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["part", "index_path", "at", "bytes", "names_at", "names_bytes"])

    files = materialise(meta.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(index, "part int, index_path string, at long, bytes long, names_at long, names_bytes long"), "token-index")
    return meta.select("doc_id", "ordinal", "part"), files.withColumn("root", F.lit(root))


def read_keys(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Look keys up in the index files and read their ids back: n_tokens and ids_crc32 of each key found."""
    import pyarrow as pa

    def read(batches):
        part, index, fs, handles, file, shards = None, None, None, {}, (None, None), {}
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("part", "index_path", "at", "bytes", "names_at", "names_bytes", "root", "doc_id", "ordinal")}
            start, n = 0, b.num_rows
            while start < n:
                stop = start
                while stop < n and cols["part"][stop] == cols["part"][start]:
                    stop += 1
                if cols["part"][start] != part:
                    part = cols["part"][start]
                    fs = fs or filesystem(cols["root"][start])[0]
                    if cols["index_path"][start] != file[0]:
                        if file[1]:
                            file[1].close()
                        file = cols["index_path"][start], fs.open_input_file(cols["index_path"][start])
                        shards = json.loads(file[1].read_at(cols["names_bytes"][start], cols["names_at"][start]))
                    index = KeyIndex.loads(file[1].read_at(cols["bytes"][start], cols["at"][start]))
                at = index.find(cols["doc_id"][start:stop], cols["ordinal"][start:stop])
                found = index.entries[at[at >= 0]]
                rows = {}
                for k in np.argsort(found, order=["shard", "offset"]).tolist():
                    e = found[k]
                    path = shards[str(int(e["shard"]))]
                    if path not in handles:
                        if len(handles) >= 64:
                            handles.pop(next(iter(handles))).close()
                        handles[path] = fs.open_input_file(path)
                    size = int(e["length"]) * index.width
                    raw = handles[path].read_at(size, int(e["offset"]) * index.width)
                    ids = np.frombuffer(raw, f"<u{index.width}").astype("<u4")
                    rows[k] = (int(e["shard"]), len(ids), zlib.crc32(ids.tobytes()), int(e["offset"]))
                kept = np.flatnonzero(at >= 0).tolist()
                if kept:
                    doc = [cols["doc_id"][start + i] for i in kept]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array([cols["ordinal"][start + i] for i in kept], pa.int64()), *(pa.array([rows[k][c] for k in range(len(kept))], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                        names=["doc_id", "ordinal", "shard", "n_tokens", "ids_crc32", "offset"],
                    )
                start = stop

    parts = partitions(keys.sparkSession)  # both sides are dealt by part, each key's rows beside its section
    dealt = keys.repartition(parts, "part").join(files.repartition(parts, "part"), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(read, "doc_id long, ordinal long, shard int, n_tokens long, ids_crc32 long, offset long")


def store_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ordinal, shard: all from the files, start over all documents before."""
    read = materialise(read_keys(*write_store(docs, tokenizer_path, end_id)), "token-read")
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # one row for SHARD_BYTES of text
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return read.join(before, "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ordinal", "shard")
