"""What the SQL texts of all queries begin with: the mapped tables, answer rows, and the terms of texts."""

OBJECT, NODE, SUPPLIER, NATION, REGION = "pt:7", "su:3", "su:5", "nt:4", "rg:2"

PRELUDE = """
WITH RECURSIVE node AS (
  SELECT r_regionkey::BIGINT AS ord, 'rg:' || r_regionkey AS id, 'population' AS type, r_name AS name, '' AS domain, '' AS code FROM region
  UNION ALL SELECT 1000000000 + n_nationkey, 'nt:' || n_nationkey, 'mechanism', n_name, '', '' FROM nation
  UNION ALL SELECT 2000000000 + s_suppkey, 'su:' || s_suppkey, 'intervention', s_name, '', '' FROM supplier
  UNION ALL SELECT 3000000000 + p_partkey, 'pt:' || p_partkey, 'outcome', p_name, lower(p_type), CASE WHEN p_size <= 25 THEN 'MESH:' || p_brand ELSE '' END FROM part),
ln AS (
  SELECT l_orderkey, l_linenumber, min(l_suppkey) AS sk, min(l_partkey) AS pk, min(l_returnflag) AS rf, max(l_shipdate) AS sd
  FROM lineitem GROUP BY 1, 2),
claim AS (
  SELECT l_orderkey * 10 + l_linenumber AS ord, 'cl:' || l_orderkey || '-' || l_linenumber AS id,
    CASE l_linenumber WHEN 1 THEN 'reduces_risk_of' WHEN 2 THEN 'improves' WHEN 3 THEN 'treats' WHEN 4 THEN 'increases_risk_of'
      WHEN 5 THEN 'worsens' WHEN 6 THEN 'recommends' WHEN 7 THEN 'is_a' END AS type,
    'su:' || sk AS subject, 'pt:' || pk AS object,
    CASE WHEN o_orderkey % 2 = 0 THEN 'rg:' || n_regionkey END AS population,
    CASE WHEN o_orderkey % 3 = 0 THEN 'nt:' || s_nationkey END AS mechanism,
    CASE rf WHEN 'A' THEN 'increase' WHEN 'N' THEN 'decrease' END AS direction,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'moderate' WHEN '3' THEN 'low' WHEN '4' THEN 'very_low' END AS certainty,
    CASE o_orderstatus WHEN 'F' THEN 'curated' WHEN 'O' THEN 'unverified' WHEN 'P' THEN 'needs_refinement' END AS status,
    CASE WHEN l_linenumber = 2 AND o_orderkey % 4 = 0 THEN 'usual_care' END AS comparator,
    o_orderdate AS created_at, sd AS updated_at
  FROM ln JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON sk = s_suppkey),
evidence AS (
  SELECT 'cl:' || l_orderkey || '-' || l_linenumber AS claim,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS ev_ord,
    'PMID:' || l_partkey AS source_id,
    (['systematic_review_or_meta_analysis', 'rct', 'cohort', 'case_control', 'cross_sectional', 'case_report', 'expert_opinion',
      'guideline'])[(l_quantity::BIGINT % 9 + 1)::INT] AS study_design,
    CASE WHEN l_orderkey % 2 = 0 THEN l_quantity::BIGINT * 40 END AS n
  FROM lineitem WHERE l_linestatus = 'F'),
relation AS (
  SELECT l_orderkey AS ord, 'cl:' || l_orderkey || '-1' AS subject_claim, 'cl:' || l_orderkey || '-4' AS object_claim
  FROM lineitem WHERE l_orderkey % 50 = 0 AND l_linenumber IN (1, 4) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 2),
conflicted AS (SELECT subject_claim AS id FROM relation UNION SELECT object_claim FROM relation),
ranked AS (
  SELECT *, CASE study_design WHEN 'systematic_review_or_meta_analysis' THEN 80 WHEN 'rct' THEN 70 WHEN 'guideline' THEN 60
    WHEN 'cohort' THEN 50 WHEN 'case_control' THEN 40 WHEN 'cross_sectional' THEN 35 WHEN 'case_report' THEN 20
    WHEN 'expert_opinion' THEN 20 END AS base FROM evidence),
per_claim AS (
  SELECT claim, string_agg(source_id, ';' ORDER BY ev_ord) AS sources, max(base) AS base,
    arg_max(study_design, base * 1000 + ev_ord) FILTER (WHERE base IS NOT NULL) AS best_design,
    count(DISTINCT source_id) AS n_sources, max(CASE WHEN n >= 10 THEN n END) AS sample_size
  FROM ranked GROUP BY claim),
scored AS (
  SELECT c.*, coalesce(e.sources, '') AS sources, e.best_design, coalesce(e.n_sources, 0) AS n_sources, e.sample_size, k.id IS NOT NULL AS conflicted,
    greatest(0, least(100, coalesce(e.base, 15)
      + CASE WHEN coalesce(e.n_sources, 0) >= 3 THEN 14 WHEN e.n_sources = 2 THEN 8 ELSE 0 END
      + CASE WHEN e.sample_size >= 1000 THEN 6 WHEN e.sample_size >= 100 THEN 3 ELSE 0 END
      - CASE WHEN k.id IS NOT NULL THEN 20 ELSE 0 END)) AS score
  FROM claim c LEFT JOIN per_claim e ON c.id = e.claim LEFT JOIN conflicted k ON c.id = k.id),
answer AS (
  SELECT s.*, s.ord AS a_ord, s.id AS a_claim, coalesce(x.name, s.subject) AS a_subject, coalesce(y.name, s.object) AS a_object,
    coalesce(z.name, s.population) AS a_population,
    CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'moderate' WHEN score >= 35 THEN 'low' ELSE 'very_low' END AS tier
  FROM scored s LEFT JOIN node x ON s.subject = x.id LEFT JOIN node y ON s.object = y.id LEFT JOIN node z ON s.population = z.id)
"""

FNV = (
    "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),"
    " lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
)
TOKENS = """
words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {table}),
toks AS (SELECT {key}, w AS tok FROM words UNION ALL
         SELECT {key}, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('#' || w || '#', i, 3))) FROM words),
tf AS (SELECT {key}, tok, count(*) AS n FROM toks GROUP BY ALL),
hashed AS (SELECT tok, (""" + FNV.format("tok") + """ % 256)::INT AS bucket FROM (SELECT DISTINCT tok FROM tf)),
bk AS (SELECT {key}, bucket, sum(n)::BIGINT AS n FROM tf JOIN hashed USING (tok) GROUP BY ALL),
nm AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM bk GROUP BY ALL)
"""  # fmt: skip
