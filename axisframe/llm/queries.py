"""The thin queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, linededup, mixing, neardup, pagetext, pieces, quality, vectors, warc
from .common import fresh_path, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@_query("op1_nearest")
def op1_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 100 == 0)


@_query(
    "op2_mixing",
    r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    coalesce(1.0::DOUBLE / (1.0 + 10.0 * ((length(text) - length(translate(text, '!#$%&*|', '')))::DOUBLE / greatest(length(text), 1))), 1.0) AS w,
    (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS n, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM k GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * n AS cap, 3.0::DOUBLE * n / w AS lim FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY lim, source NULLS LAST) AS place,
    (sum(n) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, min(CASE WHEN level <= lim THEN place END) OVER () AS first FROM l),
t AS (SELECT source, n, coalesce(CASE WHEN place < first THEN cap ELSE max(CASE WHEN place = first THEN level END) OVER () * w END, cap) AS target FROM h),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS epochs FROM t),
f AS (SELECT *, floor(target - epochs * n)::BIGINT AS rest FROM e),
g AS (SELECT k.doc_id, k.size, f.n, f.target, f.epochs, f.rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size::BIGINT AS size, n AS source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM g""",
)
def op2_mixing(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@_query(
    "op3_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d FROM p),
o AS (SELECT d, max(page_id) AS owner FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
  CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM q LEFT JOIN o ON q.d = o.d""",
)
def op3_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return pieces.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"), pieces.default_model(spark))


@_query(
    "op10_minhash",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k:k + 3], ' ')) END) AS set FROM w),
k AS (SELECT set, min(doc_id) AS id, len(set)::BIGINT AS n FROM (SELECT doc_id, list_sort(set) AS set FROM s) WHERE len(set) > 0 GROUP BY set),
e AS (SELECT id, n, unnest(set) AS x FROM k),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a),
c AS (SELECT s.doc_id, len(s.set)::BIGINT AS n, m.root FROM s LEFT JOIN k ON list_sort(s.set) = k.set LEFT JOIN m ON k.id = m.id)
SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM c""",
)
def op10_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=80)


@_query("op4_language")
def op4_language(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@_query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.quality_scores(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


@_query(
    "op8_line_dedup",
    r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM s WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ 	-
]+'), lambda x: x <> '') AS ws FROM l),
k AS (SELECT doc_id, pos, array_to_string(ws, ' ') AS line, len(ws) AS n, ws FROM w WHERE len(ws) >= 5),
d AS (SELECT line, any_value(ws) AS ws, any_value(n) AS n, min({'doc_id': doc_id, 'pos': pos}) AS place FROM k GROUP BY line),
v AS (SELECT line, n, place, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:n]), ' ') AS v FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM d)),
c AS (SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY v, i, n) AS m FROM v) WHERE m < place
  UNION SELECT v.line FROM v JOIN d ON v.v = d.line WHERE d.place < v.place
  UNION SELECT d.line FROM v JOIN d ON v.v = d.line WHERE v.place < d.place),
g AS (SELECT k.doc_id, k.pos FROM k JOIN d ON k.line = d.line
  WHERE {'doc_id': k.doc_id, 'pos': k.pos} > d.place OR k.line IN (SELECT line FROM c)),
p AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  md5(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_md5
FROM s LEFT JOIN p ON s.doc_id = p.doc_id""",
)
def op8_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


@_query("op9_page_text")
def op9_page_text(spark, sf_dir):
    return pagetext.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@_query(
    "op7_embedding_dedup",
    """
WITH RECURSIVE g AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a),
n AS (SELECT a AS id, count(*)::BIGINT AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON vec_id = m.id LEFT JOIN n ON vec_id = n.id""",
)
def op7_embedding_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.9)
