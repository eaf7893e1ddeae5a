"""The corpus pipeline stage by stage and as a whole, against plain Python."""
import random

import pytest

import corpus_pipeline as pipeline
from panelwright.llm import queries

from .test_operators import brute_repeats, shingles, text_of, within_one


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    docs, labels = [], []
    for d in range(300):
        ws, toxic = text_of(rng, rng.randint(20, 120)).split(" "), d % 6 == 0
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vexlo", "grumpf"]))
        docs.append((d, " ".join(ws), "en", "s", 0))
        labels.append((d, 1, int(toxic)))
    shared = text_of(rng, 80).replace("\n", " ")
    docs += [(1000 + k, text_of(rng, 40).replace("\n", " ") + " " + shared, "en", "s", 0) for k in range(3)]
    docs += [(1100, docs[1][1], "en", "s", 0), (1101, docs[2][1].replace("\n", " ") + " more", "en", "s", 0), (1102, None, "en", "s", 0), (1103, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialise(stage(spark, docs, folder), "t")
        assert out.columns == pipeline.COLUMNS
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            assert {d for d in seen if d not in now} == {d for d in range(0, 300, 6)}
            assert all(now[d] == seen[d] for d in now)
        elif name == "line dedup":
            before, expect = [], {}
            for d in sorted(seen):
                kept = []
                for line in (seen[d] or "").split("\n"):
                    twice = line.strip(" ") and any(line == s or (min(len(line), len(s)) >= 16 and within_one(line, s)) for s in before)
                    if not twice:
                        kept.append(line)
                    if line.strip(" "):
                        before.append(line)
                whole = "\n".join(kept)
                if whole.strip() or whole == (seen[d] or ""):
                    expect[d] = whole
            assert {d: t or "" for d, t in now.items()} == expect
        elif name == "n-gram Jaccard join":
            gone = {d for d in seen if d not in now}
            sets = {d: shingles(t or "") for d, t in seen.items()}
            like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]
            assert all(any(like(d, k) for k in seen if k < d) for d in gone)
            assert not any(like(a, b) for a in now for b in now if a < b)
        else:
            assert sum((n > 0) * k for (_, _, n, _, _), k in brute_repeats([(d, t or "") for d, t in seen.items()]).items()) == sum((seen[d] or "") != (now.get(d, "") or "") for d in seen)
        docs, seen = out, now


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "start", "length", "offset"} <= set(out.columns) and out.count() > 200


def test_stages_on_odd_tables(spark, folder):
    """Empty, repeated, tied and very long rows, and columns with the operators' own names."""
    long = "sea wind " * 20_000
    rows = [(1, "a b c d e f g. h", "en", "s", 9), (1, "a b c d e f g. h", "en", "s", 9), (2, None, None, None, None), (None, "x y z", "en", "s", 5), (3, long, "en", "s", 1), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as predicted", "3 as spans", "4 as held_out", "5 as line_dedup_lines", "6 as suffix_n_removed", "7 as th")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, docs, folder)
        assert out.count() >= 3 and (name == "packing" or out.columns == pipeline.COLUMNS), name


@pytest.mark.parametrize("name", [*sorted(queries.ORACLE), "op6_license_scan"])
def test_against_sql(spark, name):
    import duckdb
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.oracle_sql()[name])
    at = [want.columns.index(c) for c in got.columns]
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and len(queries.QUERIES) == 10
