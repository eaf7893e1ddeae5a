"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, one row per 576 samples, under the name of its SHA-256.
Each map task appends what it meets first to its own tar shard, so payload bytes are never shuffled; of
equal payloads in several shards the first (by shard name and offset) becomes the address that all rows
carry: digest, shard, offset, length.  Header-only range reads fill the metadata columns, and a full
read gives back the payload for features.  Equal payloads have equal values throughout.

Null texts are empty payloads (one row of padding).  An empty table gives an empty result.  Repeated rows and rows with
equal texts each get a row, with the same address and values.  A text of any length is one payload.  Columns other than
doc_id and text are ignored, whatever their names.  Shard names are random (a repeated task never overwrites another's
shard), so shard and offset differ from run to run while all other columns do not.
"""
from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, id_and_text, materialise, partitions, split_join

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
UNIT, PAD = 576, 255
#: A tar shard is closed beyond this size.
SHARD_BYTES = 256 << 20


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", raw[16:25])


def png_decode(raw: bytes) -> bytes:
    width, height, _ = png_header(raw)
    at, data = 8, []
    while at < len(raw):
        (n,), kind, body = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8], raw[at + 8 : at + 8 + int.from_bytes(raw[at : at + 4], "big")]
        if zlib.crc32(kind + body) != int.from_bytes(raw[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Hex of a 64-bit brightness signature over an 8 x 8 grid and a 16-bin sample histogram (shares of 255)."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * (len(x) // 64)) / (len(x) // 64)
    sign = np.packbits(cells > np.median(cells)).tobytes()
    shares = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return (sign + shares.astype(np.uint8).tobytes()).hex()


def store(docs: DataFrame) -> DataFrame:
    """Write tar shards; a materialised row for each document: doc_id, n_bytes, digest, shard, offset, length."""
    import pyarrow as pa

    root = fresh_dir(docs.sparkSession, "media")

    def run(batches):
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        out, path, at, known = None, "", 0, {}
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part, rows = b.slice(k, 512), []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    n, payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if out is None or at > SHARD_BYTES:
                            if out:
                                out.write(bytes(1024))
                                out.close()
                                known = {}
                            path, at = f"{base}/media-{uuid.uuid4().hex}.tar", 0
                            out = fs.open_output_stream(path)
                        media = png_encode(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        out.write(media + bytes(-len(media) % 512))
                        known[digest] = (path, at + 512, len(media))
                        at += 512 + len(media) + -len(media) % 512
                    rows.append((doc, n, digest, *known[digest]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out:
            out.write(bytes(1024))
            out.close()

    return materialise(id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-meta").withColumn("root", F.lit(root))


def _dealt(stored: DataFrame) -> DataFrame:
    """One address for each digest, dealt by place so that a task reads neighbours."""
    one = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "root")).alias("a")).select("digest", "a.*")
    place = F.floor(F.col("offset") / (1 << 22))
    return one.repartition(partitions(stored.sparkSession), "shard", place).sortWithinPartitions("shard", "offset")


def _read(stored: DataFrame, size, names: list[str], kinds: str, made) -> DataFrame:
    import pyarrow as pa

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}

    def run(batches):
        fs, name, f = None, None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length, root in zip(*(b.column(n).to_pylist() for n in ("digest", "shard", "offset", "length", "root"))):
                fs = fs or filesystem(root)[0]
                if shard != name:
                    if f:
                        f.close()
                    name, f = shard, fs.open_input_file(shard)
                rows.append((digest, shard, offset, length, *made(digest, f.read_at(size or length, offset))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, t in zip(zip(*rows), ["string", "string", "long", "long", *kinds.split()])], names=["digest", "shard", "offset", "length", *names])

    schema = "digest string, shard string, offset long, length long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split()))
    return _dealt(stored).mapInArrow(run, schema)


def metadata(stored: DataFrame) -> DataFrame:
    """width, height, bit_depth of each stored medium from its first bytes alone."""
    return _read(stored, HEADER_BYTES, ["width", "height", "bit_depth"], "int int int", lambda _, raw: png_header(raw))


def read_back(stored: DataFrame) -> DataFrame:
    """Full reads: digests of payload and medium, tail checksum and feature of each stored medium."""

    def made(digest, raw):
        payload = png_decode(raw)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest:
            raise ValueError("payload does not match its address")
        return len(payload), sha, zlib.crc32(payload[-32:]), hashlib.sha256(raw).hexdigest(), feature_of(payload)

    return _read(stored, None, ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"], "long string long string string", made)


def media_columns(docs: DataFrame) -> DataFrame:
    stored = store(docs)
    head = metadata(stored).select("digest", "width", "height", "bit_depth")
    full = read_back(stored).withColumnRenamed("length", "media_bytes")
    shared = materialise(stored.groupBy("digest").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"), "media-shared")
    rows = split_join(stored.select("doc_id", "n_bytes", "digest"), full.join(head, "digest"), ["digest"], "n_rows", F.xxhash64("doc_id"), shared)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "width", "height", "bit_depth")
