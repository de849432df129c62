"""The registered training-data queries and the SQL that checks them on another engine."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import table
from .fingerprints import edited_likeness
from .hardneg import mine
from .langid import language_report
from .linededup import line_report
from .lm import ORDER, score_documents
from .mixing import mix
from .neardup import near_duplicates
from .packing import pack
from .pii import surrogates
from .runs import run_report
from .tokenfile import token_report
from .tokens import count_tokens

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def _scores(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    """Sums are rounded for the check: another engine adds in another order."""
    scored = score_documents(table(spark, sf_dir, "documents"), order)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams, as its check SQL."""
    return _scores(spark, sf_dir, ORDER)


def op7_lm_scoring_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams, with the backoff to bigrams and words."""
    return _scores(spark, sf_dir, 3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mine(vectors, vectors.filter("vec_id % 100 = 0"))


QUERIES |= {f.__name__: f for f in (
    op1_language_id, op2_pii_surrogates, op3_source_mixing, op4_nearest_neighbours, op5_minhash_near_dedup, op6_line_dedup, op7_lm_scoring, op7_lm_scoring_trigrams, op8_token_counts,
    op9_packing, op10_document_fingerprints, op11_token_files, op12_periodic_runs, op13_hard_negatives)}

ORACLE_SQL["op4_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL["op5_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(1) || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

ORACLE_SQL["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY doc_id
"""

ORACLE_SQL["op7_lm_scoring"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
t AS (SELECT *, lag(a) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
u AS (SELECT a, count(*) AS c FROM w GROUP BY a),
du AS (SELECT doc_id, a, count(*) AS c FROM w GROUP BY ALL),
b AS (SELECT p, a, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY ALL),
db AS (SELECT doc_id, p, a, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY ALL),
n AS (SELECT doc_id, len(ws) AS n, (SELECT count(*) FROM w) - len(ws) AS rest FROM d),
c AS (
  SELECT t.doc_id, greatest(n.rest, 1) AS rest, u.c - du.c AS one, b.c - db.c AS two, pu.c - pdu.c AS prefix
  FROM t JOIN n USING (doc_id) JOIN u USING (a) JOIN du USING (doc_id, a) LEFT JOIN b ON b.p = t.p AND b.a = t.a
  LEFT JOIN db ON db.doc_id = t.doc_id AND db.p = t.p AND db.a = t.a LEFT JOIN u pu ON pu.a = t.p LEFT JOIN du pdu ON pdu.doc_id = t.doc_id AND pdu.a = t.p),
v AS (
  SELECT doc_id, CASE WHEN two > 0 THEN ln(two / prefix)
    ELSE (CASE WHEN two IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN one > 0 THEN ln(one / rest) ELSE ln(0.4 / rest) END) END AS x FROM c)
SELECT n.doc_id, n.n AS n_words, round(coalesce(sum(x), 0), 4) AS log_score, round(sum(x) / n.n, 6) AS mean_log_score
FROM n LEFT JOIN v USING (doc_id) GROUP BY n.doc_id, n.n
"""

ORACLE_SQL["op13_hard_negatives"] = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM u a JOIN u c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

# crc32 bit by bit; runs as stretches of equal words q apart, for every q at once
ORACLE_SQL["op12_periodic_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS h FROM documents),
e AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
o AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
w AS (
  SELECT k, n, unnest(list_transform(range(n), lambda i: CASE WHEN i >= a THEN ws[(a + (i - a) % p + 1)::BIGINT] ELSE ws[i + 1] END)) AS word, unnest(range(n)) AS i FROM o),
m AS (SELECT x.k, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM m) GROUP BY k, q, island),
r AS (SELECT k, start, length, min(q) AS q FROM s WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length),
t AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
    first({'start': start, 'length': length, 'q': q} ORDER BY length / q DESC, start, q) AS best FROM r GROUP BY k),
x AS (SELECT DISTINCT k, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT w.k, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN x ON x.k = w.k AND x.i = w.i WHERE x.i IS NULL GROUP BY w.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period, 1000 * best.length // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN c USING (k)
"""
