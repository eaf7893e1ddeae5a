"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into paragraph pieces (sentence ends, line ends, at most PIECE characters), each piece is a
60-bit digest, and each distinct digest is added to one cell in each of three sub-tables: count, xor of
digests, xor of check values.  The stored fingerprint is such a sketch of 3 x FIXED cells, whatever the text's length.

The fingerprint of one version minus that of another, cell by cell, leaves the digests that differ.  A cell with
count +-1 whose check and place fit is pure, gives one digest away, and is subtracted from the two other
sub-tables, and so on (peeling).  Fingerprints whose difference fills too many cells, or is not emptied in STEPS steps, are
made anew with cells for the expected difference, GROWTH times as many at each further failure; pairs that fail
TRIES times are settled by their digest lists, so that each likeness is exact.  Cells are rows, each peeling step is one
aggregation, and all steps share one partitioning by document.

Likeness of two versions is shared / (shared + differing digests), from the stored counts and the number of
peeled digests: 1 for equal sets, 0 for sets without a common digest.

Defined results: null texts are empty; an empty text has no pieces, and two empty texts are alike (1).  The
next document is by ascending doc_id, ties by text; nulls come first; after the last comes the first.  Texts of any
length are taken whole; repeated rows each get a row, and equal texts equal fingerprints; an empty table gives an empty
result.  Other columns are ignored, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, id_and_text, materialise, partitions, range_bounds

#: Longest piece in characters.
PIECE = 120
PATTERN = r"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]+" % PIECE
#: Cells of each of the three sub-tables of the stored fingerprint; a difference that fills more than FULL cells in all is not peeled.
FIXED, FULL = 8, 18
#: Cells of each sub-table for each expected digest, in thousandths (three sub-tables: two cells a digest).
ROOM = 667
#: Peeling steps, one sub-table after the other.
STEPS = 15
GROWTH, TRIES = 2, 2
#: Digests in a partition, about, and rows in a range of documents.
DIGESTS, BUCKET_ROWS = 300_000, 100_000
#: Fixed odd factors of the check value.
FACTORS = (1073741789, 998244353)
LOW = (1 << 30) - 1


def pieces(text):
    """Distinct digests of a text's paragraph pieces: the first 60 bits of their MD5."""
    cut = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.array_distinct(F.transform(cut, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long")))


def check_of(key):
    return F.shiftright(key.bitwiseAND(LOW) * FACTORS[0], 20).bitwiseXOR(F.shiftright(F.shiftright(key, 30) * FACTORS[1], 18))


def cell_of(key, sub: int, cells):
    """Cell of a digest in one sub-table: another 30 bits of the digest for each."""
    low, high = key.bitwiseAND(LOW), F.shiftright(key, 30)
    bits = (low, high, F.shiftright(low * FACTORS[0], 25).bitwiseXOR(high).bitwiseAND(LOW))[sub]
    return F.lit(sub).cast("long") * cells + F.pmod(bits, cells)


def contributions(key, sign, cells):
    check = check_of(key)
    return F.array(*[F.struct(cell_of(key, s, cells).alias("cell"), sign.cast("int").alias("n"), key.alias("key"), check.alias("chk")) for s in range(3)])


def summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")).filter("n <> 0 or key <> 0 or chk <> 0")


def is_pure(c, sub, cells):
    return (F.abs(c["n"]) == 1) & (c["chk"] == check_of(c["key"])) & (c["cell"] == cell_of(c["key"], sub, cells))


def peel(rows: DataFrame, by: list[str], recover: bool = False) -> DataFrame:
    """rows: by, cells, cell, n, key, chk - the cells of a difference.  Returns by, cells, d (digests recovered), rest (cells that stay,
    as an array) - and with recover the digests themselves as found: (key, n), n 1 for the first version's and -1 for the second's.
    """
    by = [*by, "cells"]
    for step in range(STEPS):
        sub = step % 3
        cells, me = F.col("cells"), {c: F.col(c) for c in ("cell", "n", "key", "chk")}
        pure = (me["cell"] >= F.lit(sub).cast("long") * cells) & (me["cell"] < F.lit(sub + 1).cast("long") * cells) & is_pure(me, sub, cells)
        out = [F.struct(cell_of(me["key"], s, cells).alias("cell"), (-me["n"]).alias("n"), me["key"], me["chk"]) for s in range(3) if s != sub]
        # a recovered digest leaves the cells: as a row of its own, or as a count
        if recover:
            found = F.struct((-1 - me["key"]).alias("cell"), me["n"], me["key"], F.lit(0).cast("long").alias("chk"))
        else:
            found = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))
        rows = summed(rows.select(*by, F.explode(F.when(pure, F.array(*out, found)).otherwise(F.array(F.struct(*me.values())))).alias("c")).select(*by, "c.*"), by)
    gone, cell = F.col("cell") < 0, F.struct("cell", "n", "key", "chk")
    count = F.sum(F.when(gone, F.lit(1) if recover else F.col("n")).otherwise(0)).alias("d")
    found = [F.collect_list(F.when(gone, F.struct("key", "n"))).alias("found")] if recover else []
    return rows.groupBy(*by).agg(count, F.collect_list(F.when(~gone, cell)).alias("rest"), *found)


def peeled(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """by, d, left: digests recovered and cells that stay, as a table."""
    return materialise(peel(rows, by).select(*by, "d", F.size("rest").alias("left")), tag)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, rn, doc_id, text, next_text.  One shuffle of the texts, by ranges of doc_id; only the first text of a range crosses ranges."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    bounds = range_bounds(rows.select("doc_id"), "doc_id", max(8 * partitions(spark), rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds).cast("int"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ranged = rows.select("bucket", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("follower"))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f")).select("bucket", F.col("f.text").alias("text"))
    by_bucket = Window.orderBy("bucket")  # one row for each range
    crossing = firsts.select("bucket", F.coalesce(F.lead("text").over(by_bucket), F.first("text").over(by_bucket)).alias("crossing"))
    return ranged.join(crossing, "bucket").select("bucket", "rn", "doc_id", "text", F.coalesce("follower", "crossing").alias("next_text"))


def edited_text(text, next_text):
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(next_text, F.lit(1), half))


def sketched(dealt: DataFrame, versions: list[str]) -> DataFrame:
    """bucket, rn, cells: the fixed sketches of all versions of a document, as one array of (cell, <version>: n, key, chk)."""
    small = F.lit(FIXED).cast("long")

    def tagged(i, v):
        return F.transform(v, lambda k: F.struct(F.lit(i).alias("v"), k.alias("k")))

    each = [tagged(i, v) for i, v in enumerate(versions)]
    rows = dealt.select("bucket", "rn", F.explode(F.concat(*each)).alias("x")).select("bucket", "rn", "x.v", F.explode(contributions(F.col("x.k"), F.lit(1), small)).alias("c")).select("bucket", "rn", "v", "c.*")
    zero = F.lit(0).cast("long")

    def of(i):
        return [F.count_if(F.col("v") == i).cast("int").alias(f"n{i}"), *[F.coalesce(F.bit_xor(F.when(F.col("v") == i, F.col(c))), zero).alias(f"{c}{i}") for c in ("key", "chk")]]

    cells = rows.groupBy("bucket", "rn", "cell").agg(*[a for i in range(len(versions)) for a in of(i)])
    made = [F.struct(F.col(f"n{i}").alias("n"), F.col(f"key{i}").alias("key"), F.col(f"chk{i}").alias("chk")).alias(v) for i, v in enumerate(versions)]
    return cells.groupBy("bucket", "rn").agg(F.sort_array(F.collect_list(F.struct("cell", *made))).alias("cells"))


def print_of(cells, version: str, size):
    """A fixed sketch as text: the number of digests, then cell:count:digest:check of each cell in use."""
    used = F.filter(cells, lambda c: c[version]["n"] != 0)
    each = F.transform(used, lambda c: F.concat_ws(":", c["cell"].cast("string"), c[version]["n"].cast("string"), F.lower(F.hex(c[version]["key"])), F.lower(F.hex(c[version]["chk"]))))
    return F.concat_ws(" ", size.cast("string"), each)


def minus(cells, a: str, b: str):
    """Cells of one version's sketch less those of another, without the empty ones."""
    diff = F.transform(cells, lambda c: F.struct(c["cell"].alias("cell"), (c[a]["n"] - c[b]["n"]).alias("n"), c[a]["key"].bitwiseXOR(c[b]["key"]).alias("key"), c[a]["chk"].bitwiseXOR(c[b]["chk"]).alias("chk")))
    return F.filter(diff, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))


def larger(dealt: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """bucket, rn, pair, cells, cell, n, key, chk: differences of sketches made for so many digests as the column expect says."""
    def side(keys, sign):
        return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("sign"), k.alias("k")))

    both = F.coalesce(*[F.when(F.col("pair") == p, F.concat(side(a, 1), side(b, -1))) for p, (a, b) in enumerate(pairs)])
    cells = F.greatest(F.lit(FIXED), F.ceil(F.col("expect") * ROOM / 1000)).cast("long")
    rows = dealt.select("bucket", "rn", "pair", cells.alias("cells"), F.explode(both).alias("x"))
    by = ["bucket", "rn", "pair", "cells"]
    return summed(rows.select(*by, F.explode(contributions(F.col("x.k"), F.col("x.sign"), F.col("cells"))).alias("c")).select(*by, "c.*"), by)


#: Versions that are compared: a text with its edited text, and with the next document's.
PAIRS = [("own", "edited"), ("own", "next")]


def differences(dealt: DataFrame, parts: int) -> DataFrame:
    """bucket, rn, pair, d: differing digests of each pair of versions that are not alike.  dealt: bucket, rn and the versions' digests."""
    by = ["bucket", "rn", "pair"]
    each = F.array(*[F.struct(F.lit(p).alias("pair"), minus(F.col("cells"), a, b).alias("diff")) for p, (a, b) in enumerate(PAIRS)])
    start = sketched(dealt, ["own", "edited", "next"]).select("bucket", "rn", F.explode(each).alias("x")).select("bucket", "rn", "x.*").filter(F.size("diff") > 0)
    start = materialise(start.select(*by, F.when(F.size("diff") <= FULL, F.col("diff")).alias("diff")), "differences")
    small = start.filter("diff is not null").select(*by, F.lit(FIXED).cast("long").alias("cells"), F.explode("diff").alias("c")).select(*by, "cells", "c.*")
    seen = peeled(small.repartition(parts, "bucket", "rn"), by, "peeled")
    known = [seen.filter("left = 0").select(*by, "d")]
    failed = start.filter("diff is null").select(*by).unionByName(seen.filter("left > 0").select(*by))
    total = F.coalesce(*[F.when(F.col("pair") == p, F.size(a) + F.size(b)) for p, (a, b) in enumerate(PAIRS)])
    # half of the digests of an edited text, all of another document's
    expect = F.when(F.col("pair") == 0, F.ceil(total / 2)).otherwise(total)
    for k in range(TRIES):
        if failed.isEmpty():
            break
        again = dealt.join(failed.repartition(parts, "bucket", "rn"), ["bucket", "rn"]).withColumn("expect", expect * GROWTH**k)
        seen = peeled(larger(again, PAIRS), by, f"peeled-{k}")
        known.append(seen.filter("left = 0").select(*by, "d"))
        failed = seen.filter("left > 0").select(*by)
    exact = F.coalesce(*[F.when(F.col("pair") == p, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) for p, (a, b) in enumerate(PAIRS)])
    out = dealt.join(failed, ["bucket", "rn"]).select(*by, exact.cast("long").alias("d"))
    for part in known:
        out = out.unionByName(part)
    return out


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = with_next(docs).withColumn("edited_text", edited_text(F.col("text"), F.col("next_text")))
    base = materialise(texts.select("bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), pieces(F.col("text")).alias("own"), pieces(F.col("edited_text")).alias("edited"), pieces(F.col("next_text")).alias("next")), "fingerprints")
    digests = base.agg(F.sum(F.size("own") + F.size("edited") + F.size("next"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-digests // DIGESTS))
    dealt = base.select("bucket", "rn", "own", "edited", "next").repartition(parts, "bucket", "rn")
    d = differences(dealt, parts).groupBy("bucket", "rn").agg(*[F.sum(F.when(F.col("pair") == p, F.col("d"))).alias(f"d{p}") for p in (0, 1)])

    def near(p, other):
        total, d = F.col("n_own") + F.col(f"n_{other}"), F.coalesce(f"d{p}", F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - d) / (total + d))

    sketches = sketched(dealt, ["own", "edited"])
    cells = F.coalesce("cells", F.array().cast(sketches.schema["cells"].dataType))
    sizes = [F.size(v).alias(f"n_{v}") for v in ("own", "edited", "next")]
    return (
        base.select("bucket", "rn", "doc_id", "n_chars", "edited_sha256", *sizes)
        .repartition(parts, "bucket", "rn")
        .join(sketches, ["bucket", "rn"], "left")
        .join(d, ["bucket", "rn"], "left")
        .select("doc_id", "n_chars", "edited_sha256", print_of(cells, "own", F.col("n_own")).alias("fingerprint"), print_of(cells, "edited", F.col("n_edited")).alias("edited_fingerprint"), near(0, "edited").alias("near_edited"), near(1, "next").alias("near_next"))
    )
