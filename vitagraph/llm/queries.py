"""Queries over the corpus tables, one for each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    compression_bands,
    conversation_trie,
    cross_polytope,
    curriculum_mix,
    jaccard_pivots,
    language_kernel,
    license_scan,
    middle_cut,
    piece_codec,
    prefix_codec,
    secret_scan,
    toxicity_chain,
    url_rules,
)
from .common import read


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.compression_bands(read(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan in training order: by first position, documents that aren't taken last."""
    plan = curriculum_mix.plan(read(spark, sf_dir, "documents"))
    first = F.round(F.array_min("positions"), 9)
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    order = F.col("first_position").asc_nulls_last()
    # documents that aren't taken have no position: their ids keep them from one range
    return rows.repartitionByRange(order, "doc_id").sortWithinPartitions(order, "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS h
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
r AS (SELECT *, row_number() OVER (ORDER BY encode(src) NULLS LAST) AS rk FROM s),
w AS (SELECT *, ([5, 2, 1])[((rk - 1) % 3 + 1)::INT]::BIGINT AS w FROM r),
v AS (SELECT *, source_size * (10 // w) AS lv FROM w),
c AS (SELECT *, sum(3 * source_size) OVER (ORDER BY lv, rk) - 3 * source_size AS before,
             sum(w) OVER () - sum(w) OVER (ORDER BY lv, rk) + w AS share_w,
             sum(source_size) OVER () AS total FROM v),
k AS (SELECT *, (total - before) * w > 3 * source_size * share_w AS capped FROM c),
t AS (SELECT src, source_size, rk,
        CASE WHEN capped THEN (3 * source_size)::DOUBLE
             ELSE ((total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) * w)::DOUBLE
                  / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
      FROM k),
o AS (SELECT d.*, (sum(size) OVER (PARTITION BY src ORDER BY h
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start FROM d),
p AS (SELECT o.doc_id, o.size, t.source_size, t.target, o.start, -0.5 + 0.5 * ((t.rk - 1) % 3) AS tilt,
        CASE WHEN o.size = 0 THEN 0 ELSE greatest(0, least(3,
          ceil((2 * t.target - 2 * o.start - o.size) / (2 * t.source_size))))::BIGINT END AS passes
      FROM o JOIN t ON o.src IS NOT DISTINCT FROM t.src),
q AS (SELECT *, greatest(0.0, least(1.0, (start::DOUBLE + size / 2.0) / target)) AS y,
             (1.0 - tilt)::DOUBLE AS a FROM p)
SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken,
       CASE WHEN passes > 0 THEN round(2 * y / (a + sqrt(greatest(0.0, a * a + 4 * tilt::DOUBLE * y))), 9) END AS first_position
FROM q
"""


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(read(spark, sf_dir, "documents"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_kernel.identify(read(spark, sf_dir, "documents"))


def op7_jaccard_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_pivots.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(ws), 0) = 0 THEN []
      WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE [array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS sh
  FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles, sh FROM g),
e AS (SELECT doc_id, unnest(sh) AS s FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.x, p.y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id
      WHERE 100 * p.c >= 85 * (a.n_shingles + b.n_shingles - p.c)),
m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT x, y FROM m UNION SELECT r.doc_id, m.y FROM r JOIN m ON r.other = m.x)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(r.other), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"), partial=True)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS k,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(4294967295::BIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
      lambda r, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END, xor(r, b)), 4294967295::BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth
  FROM (SELECT c.conv_id, 0 AS part, t.pos, t.k, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, t.pos, t.k, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h)),
p AS (
  SELECT conv_id, depth, words, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
u AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv_id) = depth AS last FROM p),
g AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, any_value(words) AS words, count(*) AS n FROM u GROUP BY node),
k AS (SELECT up, count(*) AS children FROM g WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT g.*, coalesce(k.children, 0) AS children FROM g LEFT JOIN k ON k.up = g.node),
s AS (SELECT p.node, sum((v.n - 1) * v.words) AS saved, sum(CASE WHEN v.children = 0 THEN 1 ELSE 0 END) AS leaves
      FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node),
e AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM u WHERE last GROUP BY node)
SELECT v.conv_id, v.depth::BIGINT AS depth, w.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, v.children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN s ON s.node = v.node LEFT JOIN g w ON w.node = v.up LEFT JOIN e ON e.node = v.node
"""


def op12_prefix_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_codec.digest_documents(read(spark, sf_dir, "documents"))


def op13_middle_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_cut.digest_documents(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n,
        list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
             WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, t[1 : a] AS pre, t[a + 1 : b] AS mid, t[b + 1 : n] AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_compression_bands": op2_compression_bands,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_piece_codec": op4_piece_codec,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_language_kernel": op6_language_kernel,
    "op7_jaccard_pivots": op7_jaccard_pivots,
    "op8_license_scan": op8_license_scan,
    "op9_url_rules": op9_url_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_prefix_codec": op12_prefix_codec,
    "op13_middle_cut": op13_middle_cut,
}

ORACLES: dict[str, str] = {"op3_curriculum_mix": OP3_SQL, "op7_jaccard_pivots": OP7_SQL, "op11_conversation_trie": OP11_SQL, "op13_middle_cut": OP13_SQL}
