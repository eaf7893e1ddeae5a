"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs.
All but the last return the columns of documents, with n_chars kept true to the text.  Other columns of docs are dropped, whatever
their names.  Null texts are empty; texts of any length are taken whole; rows alike in doc_id and text are one after the
n-gram stage; an empty table gives an empty result.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import materialise, scratch, table
from panelwright.llm.line_dedup import without_repeated_lines
from panelwright.llm.ngram_join import without_near_copies
from panelwright.llm.packing import pack_documents
from panelwright.llm.suffix_dedup import remove_repeats
from panelwright.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; the model learns from labelled rows outside the held-out fifth."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts without repeated lines; a document goes if nothing but repeated lines was in it."""
    out = without_repeated_lines(docs)
    emptied = (F.col("line_dedup_removed") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) == 0)
    return _documents(out.filter(~F.coalesce(emptied, F.lit(False))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return without_near_copies(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur elsewhere; a document goes if nothing is left of it."""
    out = remove_repeats(docs, keep_text=True)
    return _documents(out.filter((F.col("suffix_n_removed") == 0) | (F.length(F.trim("text")) > 0)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids: one row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: No stage but the joins' relational parts can be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's intermediate tables go once its own table is written; so do earlier stages' tables."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = []
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            own = made.pop()
            made += before
        before = [own]
    return docs
