"""Licence scans in DataFrame functions only: a trained paragraph classifier, confirmed by its templates.

Paragraphs end at blank lines and at line ends after a closing mark; other line ends are wraps, and are joined, without the
marks of comments.  Sparse word uni- and bigrams feed a multinomial logistic regression whose classes are the
families below, "unknown" (a notice of no listed family) and "none".  It is trained on the driver, from
seeded variations of the templates (words left out, foreign words mixed in), and a temperature is fitted on
variations that training has not seen.  A paragraph counts for a family if that class has the highest probability, of
at least ``SURE``, and at least ``CONFIRM`` of the words of one of the family's templates are in it; other paragraphs
whose licence classes together reach SURE count as unknown.

Every n-gram with a weight holds a telling word (a word of a template that is not common).  A paragraph without any has no
evidence but the biases, which say none, and is passed over before any n-gram is made; that changes no result.  The
weights, some hundred n-grams at any corpus size, are a literal of the plan, and a paragraph is scored in its row.

Defined results: null texts are empty; an empty text is one paragraph without hits; paragraphs of any length are taken whole.
Each input row gets a row, rows alike in doc_id and text equal ones; of families that tie the first by name counts.  An
empty table gives an empty result.  Columns other than doc_id and text are ignored, whatever their names.
"""
from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

_GNU = [
    "under the terms of the gnu {0}general public license as published by the free software foundation",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "see the gnu {0}general public license for more details",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details",
    "you should have received a copy of the gnu {0}general public license along with this program if not see",
]
#: Wording of public licence notices, by family.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", *(t.format("affero ") for t in _GNU)],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "released under the apache 2.0 license", "you may obtain a copy of the license at apache.org licenses license-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "see the license for the specific language governing permissions and limitations under the license"],
    "bsd": ["licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "use of this source code is governed by a bsd-style license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", *(t.format("") for t in _GNU)],
    "lgpl": ["licensed under the gnu lesser general public license version 3", *(t.format("lesser ") for t in _GNU)],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at mozilla.org mpl 2.0"],
    "public-domain": ["this is free and unencumbered software released into the public domain", "released under cc0 1.0 universal public domain dedication"],
}
UNKNOWN = ["licensed under the terms of the {} license", "released under the {} license version 1.0", "this software is covered by the {} public license", "all rights reserved see the license for {} terms", "distributed under {} licence conditions", "all rights reserved", "copyright {} all rights reserved", "copyright c {} {}", "copyright {} by {}", "distributed under {} 4.0", "licensed under {}", "licensed under the {} public license 2.0", "licensed under the {} license", "{} licenced under {}", "this {} is licensed under {} {}"]
#: Ordinary prose that has words of notices in it; {} stands for any word.
NONE = [
    "the {} of {} and {} was in the {}", "this work on {} is the version of {} and {}", "you may see the {} under the {} with {}", "released in {} by the {} public and {}", "a driving license for {} is permitted in {}", "free {} for any person in {}", "{} in the public domain of the {}", "{} driving licence for {}", "{} driving license {}",
    "the terms of the license agreement between the {} and the {} were never released", "the {} lost its license to {} in {}", "{} signed a license agreement with {} for {}", "the {} granted a licence to {}", "he had a license and {} in the {}", "{} license {}", "{} licence {}", "{} licenses {}", "{} licences {}", "a licensed {} in the {}", "{} licensed {}",
    "the copyright of the {} was {} in {}", "copyright law in {} is {}", "{} and the copyright holders of {}", "the general public was {} in {}", "the public {} of the general {}", "{} had the rights to the {} and {}", "the table was reserved for {}", "rights of the {} and the {}", "the {} foundation was {} in {}", "the apache {} in {} and {}", "{} at mit in {}", "the software {} of {}",
]
CLASSES = [*sorted(TEMPLATES), "unknown", "none"]
SURE, CONFIRM = 0.6, 0.7
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Words that ordinary text of the training set holds in the NONE templates alone.
NAMES_LICENCE = r"licen[sc]e[ds]?|copyright"
SEED, COPIES, PLAIN = 11, 40, 40
#: Common English words, which come last when words are chosen to find candidate paragraphs by and carry no weight alone.
STOPS = frozenset("a an and any are as at be but by can for from had has have he if in into is it its may not of on one or that the this to was were will with you your".split())
COMMON = STOPS | frozenset("""a above according agreed all along and any applicable are as associated at basis be but by can code conditions copies copy deal details
 distributed either even except express file files fitness following for form forms free granted have holder holders hope if implied in included including into is it kind
 language later law limited list may modify more must name names neither nor not notice obtain of on one option or other particular permitted
 person prior products program promote provided public publish published purpose received required retain see sell shall should source specific
 subject terms that the this to under use used useful v version was whether will with without work writing written you general domain software
 international universal""".split())
#: What a line end is joined over, and the marks that a line of a comment may begin with.
WRAP, MARKS = r"([^.!?:;\s])[ \t]*\n[ \t]*", r"(?m)^[ \t]*(?:[/*#;]+|--)[ \t]*"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def telling_words() -> list[str]:
    """Words of the licence templates that are not common."""
    return sorted({w for t in [*(t for ts in TEMPLATES.values() for t in ts), *UNKNOWN] for w in words_of(t.replace("{}", " "))} - COMMON)


def variations(rng: random.Random, copies: int) -> list[tuple[set[str], int]]:
    """Training paragraphs as (n-grams, class)."""
    invented = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    texts = [(t, CLASSES.index(f)) for f, ts in TEMPLATES.items() for t in ts]
    common, telling = sorted(COMMON), [w for w in telling_words() if not re.fullmatch(NAMES_LICENCE, w)]
    out = []
    for _ in range(copies):
        made = texts + [(t, len(CLASSES) - 2) for t in UNKNOWN] + [(t, len(CLASSES) - 1) for t in NONE]
        for t, c in made:
            ws = [w if w != "{}" else rng.choice(invented) for w in re.findall(r"\{\}|" + WORD, t)]
            if rng.random() < 0.5 and c < len(CLASSES) - 2:
                own = {w for w in ws if w in ("apache", "mit", "bsd", "affero", "lesser", "mozilla", "mpl", "by", "by-nc", "by-sa", "cc0")}
                ws = [w for w in ws if w in own or rng.random() > 1 - CONFIRM]
            for _ in range(rng.choice((0, 0, 2, 6, 40))):
                ws.insert(rng.choice((0, len(ws))), rng.choice(invented if rng.random() < 0.7 else common))
            out.append((ngrams_of(ws), c))
        for _ in range(PLAIN):  # ordinary text, with no or few telling words by chance
            ws = [rng.choice(common) if rng.random() < 0.5 else rng.choice(invented) for _ in range(rng.choice((4, 14, 60)))]
            for _ in range(rng.choice((0, 1, 2, 3))):
                ws.insert(rng.randint(0, len(ws)), rng.choice(telling))
            out.append((ngrams_of(ws), len(CLASSES) - 1))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(class weights of each n-gram, class biases), divided by the calibrated temperature."""
    rng = random.Random(SEED)
    rows, unseen = variations(rng, COPIES), variations(rng, COPIES // 4)
    counts: dict[str, int] = {}
    for g, _ in rows:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    telling = set(telling_words())
    names = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= COPIES // 6 and not telling.isdisjoint(g.split(" "))))}

    def matrix(rows):
        x = np.zeros((len(rows), len(names)), np.float32)
        for i, (g, _) in enumerate(rows):
            x[i, [names[w] for w in g if w in names]] = 1
        return x, np.array([c for _, c in rows])

    (x, y), (xu, yu) = matrix(rows), matrix(unseen)
    w, b, hot = np.zeros((len(names), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32), np.eye(len(CLASSES), dtype=np.float32)[y]
    b[-1] = 4.0  # a paragraph without any known n-gram is none
    for k in range(500):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= np.float32(4.0) * (x.T @ (p - hot) / np.float32(len(y)) + np.float32(2e-4) * w)
        b[:-1] -= 0.2 * (p - hot).mean(axis=0)[:-1]

    def loss(t):
        z = (xu @ w + b) / t
        z -= z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(yu)), yu] - np.log(np.exp(z).sum(axis=1))).mean()

    t = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    w = np.round(w.astype(float) / t, 4)
    return {g: w[i] for g, i in names.items() if np.abs(w[i]).max() > 0.02}, np.round(b.astype(float) / t, 4)


def gate_words() -> list[str]:
    """The telling words, and so many of the rarest words of each template that a confirmed paragraph holds one of them."""
    of: dict[str, int] = {}
    for ts in TEMPLATES.values():
        for t in ts:
            for w in set(words_of(t)):
                of[w] = of.get(w, 0) + 1
    out: set[str] = set()
    for ts in TEMPLATES.values():
        for t in ts:
            ws = sorted(set(words_of(t)), key=lambda w: (w in STOPS, w in COMMON, of[w], -len(w), w))
            out.update(ws[: int(len(ws) * (1 - CONFIRM) + 1e-9) + 1])
    return sorted(out.union(telling_words()))


def paragraphs_of(text):
    """Paragraphs of a text, wrapped lines joined."""
    return F.split(F.regexp_replace(F.regexp_replace(text, MARKS, ""), WRAP, "$1 "), "\n")


def _once(df: DataFrame, keys: list[str], **values) -> DataFrame:
    """keys and the named values, computed once a row: a generator in between, through which no later filter or column is pushed or copied."""
    made = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("__once")
    return df.select(*keys, made).select(*keys, "__once.*")


def scan_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, th, paragraph, family, probability: one row for each paragraph with licence wording."""
    weights, bias = trained()
    keyed = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    gate = r"(?i)(?<![a-z0-9])(?:%s)(?![a-z0-9])" % "|".join(re.escape(w).replace(r"\-", "-") for w in gate_words())
    lines = keyed.filter(F.col("text").rlike(gate)).select("doc_id", "th", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "line")).filter(F.col("line").rlike(gate))
    keys = ["doc_id", "th", "paragraph"]
    words = _once(lines, keys, words=F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)))
    size = F.size("words")
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(size - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))

    def listed(xs):
        return F.array(*[F.lit(x) for x in xs])

    # of a paragraph, however long, only the words of templates and the n-grams with a weight go on
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    few = _once(words, keys, known=F.array_intersect("words", listed(vocabulary)), grams=F.array_intersect(F.concat("words", pairs), listed(sorted(weights)))).filter(F.size("grams") > 0)

    def held(template):
        ws = sorted(set(words_of(template)))
        return F.size(F.array_intersect("known", listed(ws))) / F.lit(float(len(ws)))

    table = F.create_map(*[x for g, ws in sorted(weights.items()) for x in (F.lit(g), F.array(*[F.lit(float(w)) for w in ws]))])
    start = F.array(*[F.lit(float(b)) for b in bias])
    scores = F.aggregate("grams", start, lambda total, g: F.zip_with(total, F.element_at(table, g), lambda a, b: a + b))
    likes = F.array(*[F.greatest(*[held(t) for t in TEMPLATES[f]], F.lit(0.0)) for f in sorted(TEMPLATES)])
    families = sorted(TEMPLATES)
    scored = _once(few, keys, likes=likes, scores=scores).withColumn("top", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda t, s: t + F.exp(s - F.col("top")))
    scored = scored.withColumns({"total": total, "at": F.array_position("scores", F.col("top")).cast("int")})
    none = F.exp(F.element_at("scores", -1) - F.col("top")) / F.col("total")
    likeness = F.when(F.col("at") <= len(families), F.get("likes", F.col("at") - 1)).otherwise(0.0)
    best = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("at"))
    back = scored.select(*keys, best.alias("best"), (F.lit(1.0) / F.col("total")).alias("best_chance"), (F.lit(1.0) - none).alias("licence_chance"), likeness.alias("likeness"))
    sure = (F.col("best_chance") >= SURE) & (F.col("likeness") >= CONFIRM)
    family = F.when(sure, F.col("best")).when(F.col("licence_chance") >= SURE, F.lit("unknown"))
    return back.select("doc_id", "th", "paragraph", family.alias("family"), F.round(F.when(sure, F.col("best_chance")).otherwise(F.col("licence_chance")), 4).alias("probability")).filter("family is not null")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_license, n_unknown, families, best_probability: one row for each input row."""
    hits = scan_paragraphs(docs).groupBy("doc_id", "th").agg(F.count_if(F.col("family") != "unknown").alias("n_license"), F.count_if(F.col("family") == "unknown").alias("n_unknown"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("best_probability"))
    keyed = id_and_text(docs).select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.size(paragraphs_of(F.col("text"))).alias("n_paragraphs"))
    both = keyed.join(hits, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left")
    return both.select(F.col("d").alias("doc_id"), "n_paragraphs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_license", "n_unknown")], F.coalesce("families", F.lit("")).alias("families"), "best_probability")


def scan_sql() -> str:
    """DuckDB SQL of scan_documents over the table documents: every paragraph is scored, with the trained weights as a table."""
    weights, bias = trained()
    classes = [f"w{i}" for i in range(len(CLASSES))]
    values = ", ".join("('%s', %s)" % (g, ", ".join(f"{x:.4f}::DOUBLE" for x in ws)) for g, ws in sorted(weights.items()))
    quoted = lambda t: "[" + ", ".join(f"'{w}'" for w in sorted(set(words_of(t)))) + "]"
    likes = ", ".join("greatest(" + ", ".join(f"len(list_intersect({quoted(t)}, ws)) / {float(len(set(words_of(t))))}" for t in TEMPLATES[f]) + f", 0.0) AS l{i}" for i, f in enumerate(sorted(TEMPLATES)))
    scores = ", ".join(f"sum({c}) + {b:.4f} AS s{i}" for i, (c, b) in enumerate(zip(classes, bias)))
    every = [f"s{i}" for i in range(len(CLASSES))]
    best = "CASE " + " ".join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(CLASSES)) + " END"
    like = "CASE " + " ".join(f"WHEN best = '{f}' THEN l{i}" for i, f in enumerate(sorted(TEMPLATES))) + " ELSE 0.0 END"
    return f"""WITH wt AS (SELECT * FROM (VALUES {values}) t(gram, {', '.join(classes)})),
 d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{MARKS}', '', 'g'), '{WRAP}', '\\1 ', 'g'), chr(10)) AS ps FROM documents),
 u AS (SELECT r, unnest(range(len(ps))) AS k, unnest(ps) AS p FROM d), v AS (SELECT r, k, regexp_extract_all(lower(p), '{WORD}') AS ws FROM u),
 n AS (SELECT r, k, ws, list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gs FROM v),
 g AS (SELECT r, k, unnest(gs) AS gram FROM n), s AS (SELECT r, k, {scores} FROM g JOIN wt USING (gram) GROUP BY 1, 2),
 t AS (SELECT *, greatest({', '.join(every)}) AS top FROM s), e AS (SELECT *, {' + '.join(f'exp({c} - top)' for c in every)} AS total FROM t),
 c AS (SELECT r, k, {best} AS best, 1 / total AS chance, 1 - exp({every[-1]} - top) / total AS licence, {likes} FROM e JOIN n USING (r, k)),
 f AS (SELECT r, best, chance, licence, chance >= {SURE} AND {like} >= {CONFIRM} AS sure FROM c),
 h AS (SELECT r, CASE WHEN sure THEN best WHEN licence >= {SURE} THEN 'unknown' END AS family, round(CASE WHEN sure THEN chance ELSE licence END, 4) AS probability FROM f),
 a AS (SELECT r, count(*) FILTER (family <> 'unknown') AS n_license, count(*) FILTER (family = 'unknown') AS n_unknown, array_to_string(list_sort(list_distinct(list(family))), ',') AS families, max(probability) AS best_probability FROM h WHERE family IS NOT NULL GROUP BY 1)
 SELECT doc_id, len(ps) AS n_paragraphs, coalesce(n_license, 0) AS n_license, coalesce(n_unknown, 0) AS n_unknown, coalesce(families, '') AS families, best_probability FROM d LEFT JOIN a USING (r)"""
