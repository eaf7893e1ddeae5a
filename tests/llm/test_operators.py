"""Each operator against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from panelwright.llm import byte_bpe, fingerprints, license_scan, line_dedup, media, mph, ngram_join, packing, suffix_dedup, token_store, toxicity, word_bpe

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
NAMES = ("ids", "th", "bucket", "shard", "part", "n_bytes", "rn", "text_", "offset", "start", "node", "size", "score", "family")


def clash():
    return {c: F.lit(1) for c in NAMES}


def text_of(rng, n):
    return " ".join("".join(rng.choice("abdeghilnorstuvé") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n))


def rows_of(seed=1, n=40):
    rng = random.Random(seed)
    base = [text_of(rng, rng.randint(1, 160)) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    shared = text_of(rng, 90)
    rows += [(n + k, text_of(rng, 30) + shared + text_of(rng, 30)) for k in range(4)]
    rows += [(n + 10, base[3]), (n + 11, base[3] + " end"), (n + 12, None), (n + 13, ""), (n + 14, "x"), (n + 15, "aé" * 3000), (n + 16, text_of(rng, 3000)), (n + 17, " \t\n 'S Don't <|endoftext|>  \x1c\x85 ½²!  ΟΔΟΣ İ 日本語 🙂")]
    rows += [(2, base[2]), (2, base[2]), (None, base[5]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns(clash())


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(rows):
    return [(d, t or "") for d, t in rows]


# lookups


def test_line_hashes_are_independent(spark):
    """Neither hash follows from the other: h2 is not h1 hashed on."""
    df = line_dedup.lines_of(spark.createDataFrame([(k, f"line {k}\nother {k}") for k in range(50)], "doc_id long, text string"))
    rows = df.withColumn("on", F.expr("xxhash64(1, line)")).collect()
    assert all(r["h2"] == r["on"] for r in rows) and len({r["h1"] ^ r["h2"] for r in rows}) == len(rows)
    chained = {r["x"] for r in df.select(F.xxhash64("line", F.lit(1)).alias("x")).collect()}
    assert not chained & {r["h2"] for r in rows}


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64))
    h = mph.MinimalPerfectHash.loads(mph.MinimalPerfectHash.build(keys).dumps())
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    assert mph.MinimalPerfectHash.build(keys[:0]).lookup(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError):
        mph.MinimalPerfectHash.build(np.array([7, 7], np.uint64))


# byte-level BPE


def reference_bpe():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_on_odd_texts():
    rng, want, mine = random.Random(2), reference_bpe(), byte_bpe.codec(RANKS, P.PATTERN)
    odd = ["", " ", "\n\n  a", "a" * 3000, "日本語 テキスト", "🙂🙂 🙂", "don't I'LL we're 12345 x²", "\x00\x1c\x85  z"] + ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FF), rng.randint(0x3000, 0x4FFF)])) for _ in range(200)) for _ in range(60)]
    for t, ids in zip(odd, mine.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_byte_bpe_query(docs, rows, empty):
    want = reference_bpe()
    expect = Counter()
    for d, t in texts(rows):
        ids = np.array(want.encode_ordinary(t), "<u4")
        expect[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.encode_decode(docs, RANKS, P.PATTERN).collect()) == expect
    assert byte_bpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0


# tokenizers


def library_ids(t):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids


def test_chunk_encoder_is_the_library():
    from tokenizers import Tokenizer

    lib, mine, rng = Tokenizer.from_file(WORDS), word_bpe.encoder(WORDS), random.Random(5)
    odd = ["It's, don't! <|endoftext|> X<|ENDOFTEXT|>", "a.́ b,'s É, ΟΔΟΣ. İx. ǅ \x1c\x85q ﬁ ½, ²! ª. straße? word word"] + ["".join(rng.choice("aé'sT.,!?<|>09 \n½ªÀIıİΣσ́\x1d ") for _ in range(300)) for _ in range(150)]
    for t, raw in zip(odd, mine.encode(odd)):
        assert np.frombuffer(raw, mine.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    out = packing.pack_documents(docs, WORDS, 1, 256).collect()
    ids = defaultdict(list)
    for d, t in texts(rows):
        ids[d].append(np.array(library_ids(t) + [1], "<u4"))
    seen, used = Counter(), defaultdict(list)
    for r in out:
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == Counter({d: sum(map(len, x)) for d, x in ids.items()})
    for s in used.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    total = sum(n for s in used.values() for _, n in s)
    assert len(used) <= total / 256 * 1.02 + 1
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_copies_of_a_row_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    out = packing.pack_documents(spark.createDataFrame([(1, "the same words")] * 200, "doc_id long, text string"), WORDS, 1, 64).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(out) == 200 and len(groups) > 10 and max(groups.values()) < 40


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(WORDS))
    assert word_bpe.cuts_at_blanks(spec)
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    mine, lib = word_bpe.ChunkEncoder(str(path)), Tokenizer.from_file(str(path))
    for t, raw in zip(["Some Words", "", "a  b"], mine.encode(["Some Words", "", "a  b"])):
        assert np.frombuffer(raw, mine.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    room, fill = [], {}
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        left = (min(fits) if fits else 64) - lengths[i]
        if fits:
            room.remove(min(fits))
        room.append(left)
        fill.setdefault(bins[i], 0)
        assert offsets[i] == fill[bins[i]]
        fill[bins[i]] += lengths[i]
    assert sorted(64 - f for f in fill.values()) == sorted(room)


def test_token_store(docs, rows, empty):
    got = token_store.store_and_read_back(docs, WORDS, 2).collect()
    at, expect = 0, Counter()
    order = sorted(((d is not None, d or 0, np.array(library_ids(t) + [2], "<u2").tobytes(), d, t) for d, t in texts(rows)))
    for *_, d, t in order:
        ids = np.array(library_ids(t) + [2], "<u4")
        expect[d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expect
    assert token_store.store_and_read_back(empty, WORDS).count() == 0


def test_key_index_rejects_strangers():
    ids = list(range(500))
    index = token_store.KeyIndex.loads(token_store.KeyIndex.build(ids, [0] * 500, [1] * 500, range(500), [3] * 500, {1: "f"}, 2).dumps())
    assert (index.find(ids, [0] * 500) >= 0).all() and index.entries["offset"][index.find([7], [0])[0]] == 7
    assert (index.find(list(range(1000, 2000)), [0] * 1000) == -1).all()


# media


def test_media(docs, rows, empty):
    got = media.media_columns(docs).collect()
    expect = Counter()
    for d, t in texts(rows):
        raw = t.encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        expect[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == expect
    assert all(r["width"] == 576 and r["height"] * 576 == r["payload_bytes"] and r["bit_depth"] == 8 for r in got)
    alike = defaultdict(set)
    for r in got:
        alike[r["digest"]].add((r["media_sha256"], r["media_bytes"], r["feature"], r["shard"], r["offset"]))
    assert all(len(v) == 1 for v in alike.values())
    assert media.media_columns(empty).count() == 0


def test_shards_are_tar_files_and_png_is_standard(docs):
    import tarfile

    stored = media.store(docs)
    for path in {r["shard"] for r in stored.select("shard").collect()}:
        with tarfile.open(path) as tar:
            for m in tar:
                assert hashlib.sha256(media.png_decode(tar.extractfile(m).read())).hexdigest() + ".png" == m.name
    with pytest.raises(ValueError):
        media.png_header(b"GIF89a" + bytes(30))
    whole = media.png_encode(bytes(576))
    with pytest.raises(ValueError):
        media.png_decode(whole[:45] + b"\x07" + whole[46:])


# fingerprints


def paragraphs(t):
    return set(re.findall(r"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]+" % fingerprints.PIECE, t))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, rows, empty):
    got = fingerprints.fingerprint_versions(docs).collect()
    order = sorted(texts(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expect = Counter()
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        expect[d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(paragraphs(t), paragraphs(e)), 9), round(likeness(paragraphs(t), paragraphs(nxt)), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == expect
    by_text = defaultdict(set)
    for r, n in ((r, r["n_chars"]) for r in got if r["doc_id"] == 2):
        by_text[n].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint_versions(empty).count() == 0


def test_fingerprints_retry_on_small_sketches(docs, rows, monkeypatch):
    """Far too few cells: larger ones recover, or the digest lists settle the rest; likenesses are the same."""
    monkeypatch.setattr(fingerprints, "ROOM", 150)
    got = fingerprints.fingerprint_versions(docs).collect()
    order = sorted(texts(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expect = Counter()
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        h = len(t) // 2
        expect[d, len(t), round(likeness(paragraphs(t), paragraphs(t[: len(t) - h] + nxt[:h])), 9), round(likeness(paragraphs(t), paragraphs(nxt)), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == expect


def test_peeling_recovers_the_differing_digests(spark):
    mine, other = {10**15 + 7919 * k for k in range(30)}, {10**15 + 7919 * k for k in range(24)} | {5 * 10**14 + k for k in range(5)}
    dealt = spark.createDataFrame([(1, 1, sorted(mine), sorted(other), sorted(mine), 0, 12)], "bucket int, rn int, own array<long>, edited array<long>, next array<long>, pair int, expect int")
    got = fingerprints.peel(fingerprints.larger(dealt, fingerprints.PAIRS), ["bucket", "rn", "pair"], recover=True).first()
    assert got["rest"] == [] and got["d"] == 11
    assert {(f["key"], f["n"]) for f in got["found"]} == {(k, 1) for k in mine - other} | {(k, -1) for k in other - mine}


def test_fingerprints_run_no_python(docs):
    plan = fingerprints.fingerprint_versions(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# licences


def test_licence_scan(spark, docs, empty):
    lines = [("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("licensed under the gnu lesser general public license version 3", "lgpl"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("Distributed under the Frobnitz license, version 1.0", "unknown"), ("A driving test is held in the public domain of the town", ""), ("Plain words about the weather and the sea.", ""), ("", ""), (None, "")]
    df = spark.createDataFrame([(i, None if t is None else f"First line.\n{t}\nLast one") for i, (t, _) in enumerate(lines)] + [(0, f"First line.\n{lines[0][0]}\nLast one")], "doc_id long, text string").withColumns(clash())
    got = license_scan.scan_documents(df).collect()
    assert len(got) == len(lines) + 1
    for r in got:
        assert r["families"] == lines[r["doc_id"]][1], (r, lines[r["doc_id"]])
    assert license_scan.scan_documents(empty).count() == 0 and license_scan.scan_documents(docs).count() == docs.count()


def test_licence_scan_runs_no_python(docs):
    plan = license_scan.scan_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notices_over_several_lines_and_prose(spark):
    gpl = "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version."
    apache = '# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    prose = ["The terms of the license agreement between the two publishers were never released.", "He lost his fishing license and sold the boat.", "The copyright of the song was settled in court.", "The general public was let in at noon."]
    rows = [(0, gpl), (1, "int x;\n\n" + apache + "\n\nint y;"), *((2 + k, t) for k, t in enumerate(prose)), (9, "word " * 50_000 + "\n" + "Released under the MIT License.")]
    got = {r["doc_id"]: r["families"] for r in license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "gpl", 1: "apache", 2: "", 3: "", 4: "", 5: "", 9: "mit"}


def test_families_are_found_in_unseen_variations():
    """Precision and recall of each family on notices that neither training nor calibration has seen."""
    rng, (weights, bias) = random.Random(99), license_scan.trained()
    right, said, asked = Counter(), Counter(), Counter()
    for grams, c in license_scan.variations(rng, 12):
        z = bias + sum((weights[g] for g in grams if g in weights), np.zeros(len(bias)))
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        told = license_scan.CLASSES[k] if p[k] >= license_scan.SURE and k < len(license_scan.CLASSES) - 2 else ""
        truth = license_scan.CLASSES[c] if c < len(license_scan.CLASSES) - 2 else ""
        right[truth] += told == truth
        said[told] += 1
        asked[truth] += 1
    for family in license_scan.TEMPLATES:
        assert right[family] >= 0.7 * asked[family] and right[family] >= 0.9 * said[family], (family, right[family], asked[family], said[family])


def test_gate_loses_no_confirmed_paragraph():
    gate, rng = set(license_scan.gate_words()), random.Random(1)
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            ws = sorted(set(license_scan.words_of(t)))
            for _ in range(200):
                kept = rng.sample(ws, int(np.ceil(len(ws) * license_scan.CONFIRM - 1e-9)))
                assert gate & set(kept)


def test_unlisted_notices_are_unknown(spark):
    lines = ["All rights reserved.", "Copyright 2020 Foo. All rights reserved.", "Distributed under CC BY-ND 4.0.", "Licensed under the Eclipse Public License 2.0", "The table was reserved.", "He worked at MIT and in public service.", "To.", "Les Rech."]
    got = license_scan.scan_documents(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in got] == ["unknown"] * 4 + [""] * 4


def test_gate_loses_no_unknown_paragraph():
    gate, (weights, bias) = set(license_scan.gate_words()), license_scan.trained()
    assert all(gate & set(g.split(" ")) for g in weights)
    p = np.exp(bias - bias.max())
    assert 1 - p[-1] / p.sum() < license_scan.SURE


# lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :]


def test_line_dedup(spark, empty):
    rng = random.Random(4)
    base = ["".join(rng.choice("abü") for _ in range(rng.randint(14, 90))) for _ in range(10)]

    def edit(s):
        i, k = rng.randrange(len(s)), rng.random()
        return s[:i] + rng.choice("abx") + s[i + 1 :] if k < 0.4 else s[:i] + s[i + 1 :] if k < 0.7 else s[:i] + rng.choice("ab") + s[i:]

    pick = [lambda: rng.choice(base), lambda: edit(rng.choice(base)), lambda: edit(edit(rng.choice(base))), lambda: "", lambda: "  ", lambda: "ab", lambda: "z" * rng.randint(15, 18)]
    rows = [(d, "\n".join(rng.choice(pick)() for _ in range(rng.randint(0, 6))) if rng.random() > 0.05 else None) for d in range(70)]
    got = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())).collect()}
    seen = []
    for d, t in rows:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            if line.strip(" ") and any(line == s or (min(len(line), len(s)) >= 16 and within_one(line, s)) for s in seen):
                gone += 1
            else:
                kept.append(line)
            if line.strip(" "):
                seen.append(line)
        assert got[d]["line_dedup_removed"] == gone and got[d]["text"] == (t if not gone else "\n".join(kept)) and got[d]["th"] == 1
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_line_dedup_keeps_rows_alike(docs, rows):
    assert line_dedup.without_repeated_lines(docs).count() == len(rows)


# n-grams


def shingles(t, n=5):
    w = re.findall(r"\w+", t.lower())
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("block", [8, 2])
def test_ngram_join(spark, empty, monkeypatch, block):
    """Groups within and beyond the size that is taken apart into buckets."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(6)
    base = [text_of(rng, 120) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):  # near copies of one text: many blocks
        ws = base[0].split(" ")
        ws[rng.randrange(len(ws))] = "changed%d" % k
        rows.append((100 + k, " ".join(ws)))
    rows += [(200, base[1]), (201, base[1].upper()), (202, base[2] + " tail words"), (300, None), (301, ""), (302, "?!"), (303, "two words"), (304, "two words"), (1, base[1]), (None, base[3])]
    got = ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())).collect()
    assert len(got) == len(rows)
    sets = defaultdict(list)
    for d, t in rows:
        if s := shingles(t or ""):
            sets[s].append(d)
    low = lambda ids: None if None in ids else min(ids)  # noqa: E731  nulls come first
    classes = {s: low(ids) for s, ids in sets.items()}
    names = list(classes)
    links, parent = Counter(), {s: s for s in names}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            if len(a & b) / len(a | b) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for s in names:
        groups[root(s)].append(classes[s])
    of = {d: s for s, ids in sets.items() for d in ids}
    for r in got:
        if r["doc_id"] in of:
            s = of[r["doc_id"]]
            assert (r["class_id"], r["n_links"], r["group_id"]) == (classes[s], links[s], low(groups[root(s)]))
        else:
            assert (r["class_id"], r["n_links"], r["group_id"]) == (r["doc_id"], 0, r["doc_id"])
    assert max(links.values()) > 40
    kept = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([low(g) for g in groups.values()] + [300, 301, 302])
    assert ngram_join.near_classes(empty).count() == 0


def test_bands_reach_their_recall():
    for threshold in (0.6, 0.8, 0.9):
        bands, r = ngram_join.bands_for(threshold, 0.999)
        assert 1 - (1 - threshold**r) ** bands >= 0.999


# suffixes


def brute_repeats(rows, n=200):
    count = Counter(b[i : i + n] for _, t in rows for b in [t.encode()] for i in range(len(b) - n + 1))
    out = Counter()
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [4, 16_384])
def test_suffix_dedup(spark, monkeypatch, group, empty, rows):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(2)
    shared, line = "".join(rng.choice("abcdé ") for _ in range(900)), "".join(rng.choice("xyz ") for _ in range(61))
    made = []
    for d in range(70):
        parts = []
        for _ in range(rng.randint(0, 7)):
            k = rng.random()
            at = rng.randrange(700)
            parts.append(shared[at : at + rng.randint(50, 500)] if k < 0.3 else line + "\n" + line if k < 0.5 else "ab" * rng.randint(10, 300) if k < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 400))))
        made.append((d, "".join(parts)))
    made += rows[-12:]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").withColumns(clash())).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == brute_repeats(texts(made))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    made = [(d, "".join(rng.choice("ijklmn ") for _ in range(rng.randint(0, 900))) + shared[rng.randint(0, 500) :] + "é" * 300) for d in range(6)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == brute_repeats(made)


def test_multikey_groups():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 3, (300, 4))
    count = Counter(map(tuple, s.tolist()))
    assert suffix_dedup.multikey_groups(lambda d, w: s[w, d], 300, 4).tolist() == [count[tuple(x)] > 1 for x in s.tolist()]


# toxicity


def test_long_chains_run_as_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    e, trans, starts = rng.normal(size=3000), rng.normal(size=(2, 2)), np.array([0, 5, 1500, 1501])
    want = toxicity.forward_backward(e, starts, trans)
    monkeypatch.setattr(toxicity, "LONG", 10_000)
    for a, b in zip(want, toxicity.forward_backward(e, starts, trans)):
        assert np.allclose(a, b)


def test_training_rows_are_bounded_and_take_long_texts(spark):
    docs = spark.createDataFrame([(d, "x" * (9000 if d % 2 else 10)) for d in range(60)] + [(1, "y"), (1, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0, d % 3 == 0) for d in range(60)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got, toxic = toxicity.training_rows(docs, labels, 100, 20_000)
    assert all(sum(len(t) for t, k in zip(got, toxic) if k == label) <= 20_000 for label in (0, 1)) and any(len(t) == 9000 for t in got)
    assert len(got) == len(toxic) <= 60


def test_carried_columns_give_way_to_results(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "k")], "doc_id long, text string, score int, mine string")
    out = toxicity.score(docs, toxicity.Model(), ["score", "mine"])
    assert out.columns == ["doc_id", "mine", "held_out", "score", "predicted", "spans"] and out.first()["mine"] == "k"


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, trans, starts = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5])
    odds = toxicity.forward_backward(e, starts, trans)[2]
    for a, z in ((0, 4), (4, 5), (5, 9)):
        mass = np.zeros((z - a, 2))
        for path in product((0, 1), repeat=z - a):
            w = np.exp(sum(e[a + i] * s for i, s in enumerate(path)) + sum(trans[p, q] for p, q in zip(path, path[1:])))
            for i, s in enumerate(path):
                mass[i, s] += w
        assert np.allclose(odds[a:z], mass[:, 1] / mass[:, 0])


def test_toxicity_learns_and_leaves_labels_out(spark):
    rng = random.Random(9)
    bad, rows, labels = ["vexlo", "grumpf", "zarnok"], [], []
    for d in range(900):
        ws, toxic = [rng.choice("the of and sea wind tree stone river hill lamp".split()) for _ in range(60)], d % 5 == 0
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(60), rng.choice(bad) + rng.choice(["", "en", "ix"]))
        rows.append((d, " ".join(ws) + "."))
        labels.append((d, 0, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "?!"), (None, "the sea"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())
    got = toxicity.toxicity(docs, spark.createDataFrame(labels + [(None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 100 and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    text = dict(rows)
    for r in held:
        assert all(any(b in text[r["doc_id"]][s["start"] : s["stop"]] for b in bad) for s in r["spans"])
    alike = {r["score"] for r in got if r["doc_id"] in (5000, 5001, 5002)}
    assert len(alike) == 1 and alike.pop() < 0.5


def test_toxicity_without_labels(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, none).count() == len(rows) and toxicity.toxicity(empty, none).count() == 0


# shared helpers


def test_scratch_deletes_what_was_made_inside(spark):
    import os

    from panelwright.llm.common import fresh_dir, materialise, scratch

    with scratch(spark) as made:
        kept = materialise(spark.range(3), "kept")
        materialise(spark.range(2), "gone")
        gone = made[1]
        made.remove(made[0])
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file://")) and fresh_dir(spark, "x")


def test_split_join_is_an_inner_join(spark):
    from panelwright.llm.common import split_join

    rows = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(500)], "key int, v int")
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("key <> 3")
    got = split_join(rows, per_key, ["key"], "n", F.xxhash64("v"))
    assert sorted(map(tuple, got.select("key", "v", "top").collect())) == sorted(map(tuple, rows.join(per_key, "key").select("key", "v", "top").collect()))


# components


def test_components(spark):
    from panelwright.llm.components import components

    rng = random.Random(8)
    nodes = rng.sample(range(-(10**12), 10**12), 400)
    path = sorted(nodes[:60])
    edges = list(zip(path, path[1:])) + [(rng.choice(nodes[60:200]), rng.choice(nodes[60:200])) for _ in range(90)] + [(nodes[200], n) for n in nodes[201:390]] + [(nodes[395], nodes[395])]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_chunks_outlive_a_turn_of_the_memo(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(word_bpe, "MEMO", 40)
    enc, learned = word_bpe.ChunkEncoder(WORDS), []
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    texts = ["common words stay, " + " ".join(f"rare{k}x{j}" for j in range(30)) for k in range(256 * 6)]
    made = enc.encode(texts)
    assert learned.count("common") == learned.count("stay,") == 1
    library = Tokenizer.from_file(WORDS)
    for k in (0, 255, 256, 1000, 1535):
        assert np.frombuffer(made[k], enc.dtype).tolist() == library.encode(texts[k], add_special_tokens=False).ids
