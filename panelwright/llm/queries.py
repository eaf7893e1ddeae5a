"""The thin op queries over the operators of this folder, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), end_id=1, window=2048)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_classes

    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "group_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_repeated_lines

    out = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_removed").alias("n_removed"), F.length(text).alias("n_chars_kept"), F.sha2(text, 256).alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_versions

    return fingerprint_versions(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .token_store import store_and_read_back

    return store_and_read_back(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), end_id=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import collapse_runs, planted_tail, run_report

    return run_report(collapse_runs(table(spark, sf_dir, "documents"), planted_tail))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_ngram_join, op3_line_dedup, op4_media_columns, op5_fingerprints, op6_license_scan, op7_suffix_dedup, op8_token_store, op9_toxicity, op10_byte_bpe, op11_hard_negatives, op12_periodic_runs, op13_mixing)}

#: DuckDB SQL for the operators that it can express.  The others call tokenizers, trained models or file formats, or would
#: compare all pairs of lines; tests hold them to brute force, round trips and held-out accuracy.
ORACLE = {
    "op2_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
 g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END)) AS s FROM w),
 c AS (SELECT s, min(doc_id) AS class_id FROM g WHERE len(s) > 0 GROUP BY s),
 u AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM c),
 p AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p WHERE k >= 0.8 * (na + nb - k) - 1e-6),
 r AS (SELECT class_id AS node, class_id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
 m AS (SELECT node, min(root) AS group_id FROM r GROUP BY 1), l AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY 1)
 SELECT g.doc_id, coalesce(c.class_id, g.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(m.group_id, g.doc_id) AS group_id
 FROM g LEFT JOIN c ON c.s = g.s AND len(g.s) > 0 LEFT JOIN m ON m.node = c.class_id LEFT JOIN l ON l.node = c.class_id""",
    # lines within one edit share one half (of the shorter, cut in the middle) with it; candidates are compared by their characters
    "op3_line_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 u AS (SELECT r, doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM d), w AS (SELECT * FROM u WHERE length(trim(line, ' ')) > 0),
 f AS (SELECT line, min({'d': doc_id, 'k': k}) AS at, length(line) AS n FROM w GROUP BY 1),
 g AS MATERIALIZED (SELECT *, n // 2 AS h FROM f WHERE n >= 16),
 o AS MATERIALIZED (SELECT *, (n - 1) // 2 AS h FROM f WHERE n >= 17),
 e AS (SELECT a.line AS x, b.line AS y FROM g a JOIN g b ON a.n = b.n AND left(a.line, a.h) = left(b.line, b.h) AND a.at > b.at
  UNION SELECT a.line, b.line FROM g a JOIN g b ON a.n = b.n AND right(a.line, a.n - a.h) = right(b.line, b.n - b.h) AND a.at > b.at),
 c AS (SELECT x AS line FROM e WHERE len(list_filter(list_zip(string_split(x, ''), string_split(y, '')), lambda p: p[1] <> p[2])) = 1),
 l AS (SELECT a.line AS x, b.line AS y, a.at AS p, b.at AS q FROM o a JOIN g b ON a.n = b.n + 1 AND left(a.line, a.h) = left(b.line, b.h)
  UNION SELECT a.line, b.line, a.at, b.at FROM o a JOIN g b ON a.n = b.n + 1 AND right(a.line, a.n - 1 - a.h) = right(b.line, b.n - b.h)),
 i AS (SELECT * FROM l WHERE len(list_filter(range(1, length(x) + 1), lambda j: left(x, j - 1) || substr(x, j + 1) = y)) > 0),
 near AS (SELECT line FROM c UNION SELECT CASE WHEN p > q THEN x ELSE y END FROM i),
 z AS (SELECT w.r, w.k FROM w JOIN f USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR {'d': w.doc_id, 'k': w.k} > f.at),
 m AS (SELECT r, list(k) AS ks FROM z GROUP BY 1),
 t AS (SELECT doc_id, len(ls) AS n_lines, coalesce(len(ks), 0) AS n_removed, array_to_string(list_filter(ls, lambda x, j: ks IS NULL OR NOT list_contains(ks, j - 1)), chr(10)) AS kept FROM d LEFT JOIN m USING (r))
 SELECT doc_id, n_lines, n_removed, length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256 FROM t""",
    # as sets of digests: sketches of equal sets are equal, and peeling gives back set differences
    "op5_fingerprints": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn FROM documents),
 x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY rn), first_value(t) OVER (ORDER BY rn)) AS nx FROM d),
 e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM x),
 v AS (SELECT rn, unnest([1, 2, 3]) AS v, unnest([t, ed, nx]) AS s FROM e),
 k AS (SELECT rn, v, list_distinct(list_transform(regexp_extract_all(s, '[^.!?\n]{1,120}[.!?\n]*|[.!?\n]+'), lambda p: ('0x' || substr(md5(p), 1, 15))::BIGINT)) AS ks FROM v),
 u AS (SELECT rn, v, unnest(ks) AS key FROM k WHERE v < 3),
 b AS (SELECT rn, v, key, key & 1073741823 AS lo, key >> 30 AS hi FROM u),
 c AS (SELECT rn, v, key, xor((lo * 1073741789) >> 20, (hi * 998244353) >> 18) AS chk, unnest([lo % 8, 8 + hi % 8, 16 + (xor((lo * 1073741789) >> 25, hi) & 1073741823) % 8]) AS cell FROM b),
 g AS (SELECT rn, v, cell, count(*) AS n, bit_xor(key) AS key, bit_xor(chk) AS chk FROM c GROUP BY 1, 2, 3),
 f AS (SELECT rn, v, string_agg(cell || ':' || n || ':' || format('{:x}', key) || ':' || format('{:x}', chk), ' ' ORDER BY cell) AS cells FROM g GROUP BY 1, 2),
 z AS (SELECT rn, max(ks) FILTER (v = 1) AS a, max(ks) FILTER (v = 2) AS e, max(ks) FILTER (v = 3) AS n FROM k GROUP BY 1),
 m AS (SELECT rn, len(a) AS la, len(e) AS le, len(n) AS ln, len(list_intersect(a, e)) AS ie, len(list_intersect(a, n)) AS i_n FROM z)
 SELECT e.doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256, concat_ws(' ', la, fa.cells) AS fingerprint, concat_ws(' ', le, fe.cells) AS edited_fingerprint,
 CASE WHEN la + le = 0 THEN 1.0::DOUBLE ELSE (2 * ie)::DOUBLE / (2 * (la + le - ie)) END AS near_edited, CASE WHEN la + ln = 0 THEN 1.0::DOUBLE ELSE (2 * i_n)::DOUBLE / (2 * (la + ln - i_n)) END AS near_next
 FROM e JOIN m USING (rn) LEFT JOIN f fa ON fa.rn = e.rn AND fa.v = 1 LEFT JOIN f fe ON fe.rn = e.rn AND fe.v = 2""",
    "op7_suffix_dedup": r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM d)),
 t AS (SELECT x FROM w GROUP BY 1 HAVING count(*) > 1),
 s AS (SELECT doc_id, i, i + 200 AS j, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM w SEMI JOIN t USING (x)),
 k AS (SELECT doc_id, i, j, sum(CASE WHEN e IS NULL OR i > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
 r AS (SELECT doc_id, g, min(i) AS a, max(j) AS z FROM k GROUP BY 1, 2),
 q AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM r),
 f AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS l, list([b, a] ORDER BY a) AS ks FROM q GROUP BY 1)
 SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string([substring(h, 2 * y[1] + 1, 2 * (y[2] - y[1])) for y in ks], '') || substring(h, 2 * l + 1) END)) AS kept_sha256
 FROM d LEFT JOIN f USING (doc_id)""",
    # trigrams that recur at distance q, as islands; one start and length is one run, of its least q.  crc32 by nibbles
    "op12_periodic_runs": r"""WITH w0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 t AS (SELECT list(list_reduce([v, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t FROM (SELECT unnest(range(16)) AS v)),
 h AS (SELECT r, xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x) & 15, ascii(x) >> 4])), lambda c, v: xor(t[1 + (xor(c, v) & 15)], c >> 4)), 4294967295) AS h FROM w0, t WHERE doc_id IS NOT NULL),
 e AS (SELECT r, doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN h // 10 END AS g FROM w0 LEFT JOIN h USING (r)),
 f AS (SELECT r, doc_id, n, CASE WHEN g IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) END AS ws FROM e),
 p AS (SELECT r, n, unnest(range(n - 2)) AS i, ws FROM f WHERE n >= 6),
 k AS MATERIALIZED (SELECT r, n, i, md5(ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS x FROM p),
 j AS (SELECT a.r, a.i, b.i - a.i AS q FROM k a JOIN k b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
 s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM j),
 u AS (SELECT r, q, min(i) AS start, count(*) + 2 + q AS length FROM s GROUP BY r, q, g),
 v AS (SELECT r, start, length, min(q) AS period FROM u WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
 m AS (SELECT r, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, {'l': length, 's': -start, 'p': -period}) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM v GROUP BY r),
 d AS (SELECT r, list(DISTINCT i) AS ks FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM v) GROUP BY r),
 z AS (SELECT r, list(y ORDER BY i) AS kept FROM (SELECT r, unnest(ws) AS y, unnest(range(n)) AS i FROM f SEMI JOIN d USING (r)) ANTI JOIN (SELECT r, unnest(ks) AS i FROM d) USING (r, i) GROUP BY r)
 SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256,
 sha256(array_to_string(CASE WHEN n_runs IS NULL THEN ws ELSE kept END, ' ')) AS collapsed_sha256 FROM f LEFT JOIN m USING (r) LEFT JOIN z USING (r)""",
    "op13_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
 w AS (SELECT *, [5.0, 2.0, 1.0][1 + i % 3]::DOUBLE AS w, sum(n) OVER () AS total FROM s),
 c AS (SELECT *, sum(2 * n) OVER o - 2 * n AS capped, sum(w) OVER () - (sum(w) OVER o - w) AS free FROM w WINDOW o AS (ORDER BY n / w, i)),
 l AS (SELECT min_by((1.5 * total - capped)::DOUBLE / free, n / w) AS level FROM c WHERE (1.5 * total - capped)::DOUBLE / free * w <= 2 * n),
 g AS (SELECT source, i, n, CASE WHEN w * coalesce(level, 1e300) >= 2 * n THEN (2 * n)::DOUBLE ELSE w * level END AS target FROM w, l),
 b AS (SELECT d.doc_id, size, n, target, i % 3 AS k, floor(target + 0.5)::BIGINT AS goal, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS x FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
 p AS (SELECT *, greatest(least(goal - x, size), 0) AS p1, greatest(least(goal - x - n, size), 0) AS p2, CASE WHEN target > 0 THEN CASE WHEN goal > x AND size > 0 THEN x ELSE x + n END / target END AS y FROM b)
 SELECT doc_id, size, n AS source_size, target, p1 + p2 AS taken, (p1 > 0)::BIGINT + (p2 > 0)::BIGINT AS n_plays,
 CASE WHEN p1 + p2 > 0 THEN round(CASE k WHEN 0 THEN 2 * (y * 5) / (3 + sqrt(9 + 8 * (y * 5))) WHEN 1 THEN y ELSE 2 * y / (1.5 + sqrt(greatest(2.25 - 2 * y, 0))) END, 9) END AS first_at FROM p""",
    "op11_hard_negatives": r"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS a, b.r AS br, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, b NULLS LAST, br) <= 5),
 n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.s DESC, s.b NULLS LAST, s.br) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
 SELECT * FROM n WHERE rank <= 3""",
}


def oracle_sql() -> dict[str, str]:
    """ORACLE, and the SQL of the licence scan, which holds its trained weights."""
    from .license_scan import scan_sql

    return ORACLE | {"op6_license_scan": scan_sql()}
