"""Further queries over the star-schema tables: writes, reviews, texts, links and rules, each with its SQL.

Where the mapped graph holds no such rows (gaps, broken references, proposals), a query first
alters the graph by a stated rule, and its SQL states the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import quality, text
from ..operators import answers as A
from ..operators import agents, link, review, search, traverse, validate, writes
from ..sources import tabular
from . import mapping as M
from .prelude import OBJECT, PRELUDE, SUPPLIER, TOKENS

NONE = "array<string>"
QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        name = f.__name__
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _cases(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


# --- answers ---------------------------------------------------------------------


@query(PRELUDE + f""" SELECT a.id AS claim, concat_ws(' | ',
    CASE WHEN a.best_design IS NOT NULL THEN 'strongest design: ' || {_cases("a.best_design", quality.DESIGN_LABEL)} || ' (' || e.base || ')' ELSE 'no study design recorded (15)' END,
    CASE WHEN a.n_sources >= 3 THEN a.n_sources || ' independent sources (+14)' WHEN a.n_sources = 2 THEN '2 independent sources (+8)'
      WHEN a.n_sources = 1 THEN '1 source' ELSE '0 sources' END,
    CASE WHEN a.sample_size >= 1000 THEN 'reported sample ~' || a.sample_size || ' (+6)' WHEN a.sample_size >= 100 THEN 'reported sample ~' || a.sample_size || ' (+3)'
      WHEN a.sample_size IS NOT NULL THEN 'reported sample ~' || a.sample_size END,
    CASE WHEN conflicted THEN 'conflicts with other evidence (−20)' END) AS reasons
  FROM answer a LEFT JOIN per_claim e ON a.id = e.claim WHERE a.subject = '{SUPPLIER}'""")
def claim_reasons(spark: SparkSession, d: str) -> DataFrame:
    return A.list_claims(M.graph(spark, d), subject=SUPPLIER).select("claim", F.array_join("reasons", " | ").alias("reasons"))


@query(PRELUDE + f""" SELECT 'direct' AS kind, count(*) AS n FROM answer WHERE subject = '{SUPPLIER}' OR object = '{SUPPLIER}'""")
def landscape_direct(spark: SparkSession, d: str) -> DataFrame:
    row = A.landscape_summary(A.evidence_landscape(M.graph(spark, d), SUPPLIER))
    return row.select(F.lit("direct").alias("kind"), F.col("direct").alias("n"))


GAPS = f"""
, gnode AS (SELECT ord, id, name, CASE WHEN type = 'outcome' AND ord % 10 = 3 THEN 'knowledge_gap' ELSE type END AS type FROM node),
gclaim AS (SELECT ord, id, CASE type WHEN 'recommends' THEN 'generates' ELSE 'related' END AS type, object AS subject, subject AS object
  FROM claim WHERE type IN ('recommends', 'is_a')),
items AS (SELECT c.subject, c.type, c.ord, c.object, coalesce(n.name, c.object) AS name FROM gclaim c JOIN gnode g ON c.subject = g.id AND g.type = 'knowledge_gap'
  LEFT JOIN gnode n ON c.object = n.id)
SELECT g.ord, g.id, (SELECT string_agg(name, ';' ORDER BY ord) FROM items i WHERE i.subject = g.id AND i.type = 'generates') AS questions,
  (SELECT string_agg(object, ';' ORDER BY ord) FROM items i WHERE i.subject = g.id AND i.type = 'related') AS concerns
FROM gnode g WHERE g.type = 'knowledge_gap' AND g.id IN (SELECT subject FROM items WHERE type = 'related' AND contains(lower(name), 'supplier#00000000'))"""


def gap_graph(spark: SparkSession, d: str):
    """Every tenth part is a gap; recommendations and is_a claims run from parts to suppliers."""
    g = M.graph(spark, d)
    gap = (F.col("type") == "outcome") & (F.col("ord") % 10 == 3)
    turned = F.col("type").isin("recommends", "is_a")
    claim = g.claim.select(
        *[
            {"type": F.when(F.col("type") == "recommends", "generates").when(F.col("type") == "is_a", "related").otherwise(F.col("type")),
             "subject": F.when(turned, F.col("object")).otherwise(F.col("subject")),
             "object": F.when(turned, F.col("subject")).otherwise(F.col("object"))}.get(c, F.col(c)).alias(c)
            for c in g.claim.columns
        ]
    )
    return g.with_(node=g.node.withColumn("type", F.when(gap, "knowledge_gap").otherwise(F.col("type"))), claim=claim)


@query(PRELUDE + GAPS)
def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = A.knowledge_gaps(gap_graph(spark, d), "SUPPLIER#00000000")
    joined = lambda c, f: F.when(F.size(c) > 0, F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: x[f]), ";"))
    return rows.select("ord", "id", F.nullif(joined("research_questions", "name"), F.lit("")).alias("questions"), joined("concerns", "id").alias("concerns"))


PATH = f"""
, adjo AS (SELECT subject AS src, object AS dst, id, true AS forward, ord * 2 AS eo FROM claim UNION ALL SELECT object, subject, id, false, ord * 2 + 1 FROM claim),
pairs AS (SELECT DISTINCT src, dst FROM adjo),
wa(id, h) AS (SELECT '{SUPPLIER}', 0 UNION SELECT dst, h + 1 FROM wa JOIN pairs ON id = src WHERE h < 6),
wb(id, h) AS (SELECT '{OBJECT}', 0 UNION SELECT dst, h + 1 FROM wb JOIN pairs ON id = src WHERE h < 6),
da AS (SELECT id, min(h) AS h FROM wa GROUP BY id), db AS (SELECT id, min(h) AS h FROM wb GROUP BY id),
far AS (SELECT h AS n FROM da WHERE id = '{OBJECT}'),
good AS (SELECT e.*, x.h FROM adjo e JOIN da x ON e.src = x.id JOIN da y ON e.dst = y.id JOIN db z ON e.dst = z.id, far WHERE y.h = x.h + 1 AND x.h + 1 + z.h = far.n),
walk(id, h, places, steps) AS (SELECT '{SUPPLIER}', 0, []::BIGINT[], []::STRUCT(f VARCHAR, c VARCHAR, fw BOOLEAN, t VARCHAR)[]
  UNION ALL SELECT dst, walk.h + 1, list_append(places, eo), list_append(steps, {{'f': src, 'c': good.id, 'fw': forward, 't': dst}}) FROM walk JOIN good ON walk.id = src AND walk.h = good.h),
best AS (SELECT steps FROM walk, far WHERE h = far.n ORDER BY places LIMIT 1),
each AS (SELECT unnest(range(1, len(steps) + 1)) AS step, unnest(steps) AS s FROM best)
SELECT step::INT AS step, s.f AS "from", x.name AS from_name, x.type AS from_type, s.c AS claim, s.fw AS forward, s.t AS "to", y.name AS to_name, y.type AS to_type,
  a.type AS relationship, a.sources FROM each JOIN answer a ON a.id = s.c JOIN node x ON s.f = x.id JOIN node y ON s.t = y.id"""


@query(PRELUDE + PATH)
def path_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = traverse.shortest_path(M.graph(spark, d), SUPPLIER, OBJECT, 6).steps
    return steps.select("step", "from", "from_name", "from_type", "claim", "forward", "to", "to_name", "to_type", "relationship", F.array_join("sources", ";").alias("sources"))


# --- search ----------------------------------------------------------------------

CORPUS = """
, corp AS (SELECT 'node' AS owner_type, id AS owner_id, 0 AS side, ord, name, name || ' ' || domain AS txt FROM node
  UNION ALL SELECT 'claim', a_claim, 1, a_ord, a_subject || ' → ' || a_object,
    concat_ws(' ', a_subject, replace(type, '_', ' '), a_object, 'in ' || a_population, direction, comparator) FROM answer),
texts AS (SELECT owner_type || owner_id AS k, txt FROM corp UNION ALL SELECT 'query', '{0}'), """ + TOKENS.format(key="k", text="txt", table="texts") + """
, n2 AS (SELECT k, sum(n * n)::BIGINT AS s FROM bk GROUP BY k),
dots AS (SELECT b.k, sum(b.n * q.n)::BIGINT AS dot FROM bk b JOIN bk q ON b.bucket = q.bucket AND q.k = 'query' GROUP BY b.k),
sc AS (SELECT dots.k, floor(dot::DOUBLE / sqrt((x.s * y.s)::DOUBLE) * 10000 + 0.5) / 10000 AS score FROM dots JOIN n2 x ON dots.k = x.k, n2 y WHERE y.k = 'query')
SELECT owner_type, owner_id, name, coalesce(score, 0.0) AS score, (row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, side, ord))::INT AS place
FROM corp LEFT JOIN sc ON sc.k = owner_type || owner_id WHERE owner_type IN ({1}) ORDER BY place LIMIT {2}"""
ASKED = "supplier 0000012 improves a red widget in asia"


def _hits(spark: SparkSession, d: str, k: int, owner: str | None) -> DataFrame:
    g = M.graph(spark, d, "node", "claim")
    rows = search.search(g, ASKED, k, owner, index=M.term_index(spark, d))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "side", "ord"))  # k rows
    return rows.select("owner_type", "owner_id", "name", "score", place.alias("place"))


@query(PRELUDE + CORPUS.format(ASKED, "'node', 'claim'", 40))
def search_graph(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 40, None)


@query(PRELUDE + CORPUS.format(ASKED, "'claim'", 12))
def search_claims(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 12, "claim")


@query(PRELUDE + """ SELECT owner_type, count(*) AS n FROM (SELECT 'node' AS owner_type FROM node WHERE type <> 'outcome' UNION ALL SELECT 'claim' FROM claim) GROUP BY 1""")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = search.corpus(M.graph(spark, d))
    have = search.embeddings(rows.where("owner_type = 'node' and node_id like 'pt:%'"))
    return search.missing(rows, have).groupBy("owner_type").agg(F.count("*").alias("n"))


LINES = """
, ev AS (SELECT claim, string_agg('    - ' || source_id || coalesce(' (' || study_design || ')', '') || coalesce(': “' || CASE WHEN n IS NOT NULL THEN 'n = ' || n END || '”', ''), chr(10) ORDER BY ev_ord) AS t
  FROM evidence GROUP BY claim)
SELECT a.id, a_subject || ' — ' || replace(a.type, '_', ' ') || coalesce(' (' || direction || ')', '') || ' → ' || a_object || coalesce(' · population: ' || a_population, '')
  || coalesce(' · certainty: ' || certainty, '') || ' · status: ' || status || chr(10) || coalesce(ev.t, '    - (no citation on record)') AS line
FROM answer a LEFT JOIN ev ON ev.claim = a.id WHERE a.object = '{0}'"""


@query(PRELUDE + LINES.format(OBJECT))
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    g = M.graph(spark, d)
    return search.context_lines(search.hydrate(g, g.claim.where(F.col("object") == OBJECT)))


@query(PRELUDE + """ SELECT id, (rank - 1)::INT AS rank FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank
  FROM (SELECT id FROM claim WHERE status = 'curated' AND object = '""" + OBJECT + """' ORDER BY id DESC LIMIT 5)) WHERE rank <= 3""")
def chosen_claims(spark: SparkSession, d: str) -> DataFrame:
    """The first three of a reply's ids that are in the pool; the reply repeats ids and names unknown ones."""
    pool = search.candidate_pool(M.graph(spark, d))
    ids = [r["id"] for r in pool.where(F.col("object") == OBJECT).select("id").orderBy(F.desc("id")).limit(5).collect()]
    rows = search.chosen(pool, [*ids, *ids, "unknown"], 3)
    return rows.select("id", "rank")


# --- rules -----------------------------------------------------------------------


def broken(spark: SparkSession, d: str):
    """The mapped graph with faults at stated places, for every rule."""
    g = M.graph(spark, d)
    put = lambda df, **c: df.select(*[c.get(n, F.col(n)).alias(n) for n in df.columns])
    at = lambda n, v, c: F.when(F.col("ord") % n == 0, v).otherwise(F.col(c))
    part, slot = F.col("type") == "outcome", F.col("ord") % 50
    ids = F.when(part & (slot == 2), F.array(F.lit("nocolon"))).when(part & (slot == 3), F.array(F.lit("ZZZ:1"))).otherwise(F.col("external_ids"))
    node = put(g.node, type=F.when(part & (slot == 1), "bad").otherwise(F.col("type")), external_ids=ids)
    claim = put(
        g.claim, type=at(97, "bogus", "type"), subject=at(89, "missing", "subject"), population=at(83, F.col("subject"), "population"), direction=at(79, "sideways", "direction"),
        certainty=at(73, "sure", "certainty"), setting=at(71, "moon", "setting"), status=at(67, "odd", "status"), rec_strength=at(61, "strong", "rec_strength"),
    )
    key = F.substring_index("source_id", ":", -1).cast("long")
    of = lambda n, v, c: F.when(key % n == 0, v).otherwise(F.col(c))
    ev = put(g.evidence, source_id=of(53, F.concat(F.lit("x"), key.cast("string")), "source_id"), study_design=of(47, "magic", "study_design"), confidence=of(43, 1.5, "confidence"), claim=of(41, "gone", "claim"))
    listed = put(g.listed, evidence=F.when(F.col("ev_ord") == 2, "ghost").otherwise(F.col("evidence")))
    rel = put(g.relation, object_claim=at(150, F.col("subject_claim"), "object_claim"), subject_claim=at(200, "nope", "subject_claim"))
    return g.with_(node=node, claim=claim, evidence=ev, listed=listed, relation=rel)


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


BROKEN = f"""
, bn AS (SELECT ord, id, domain, CASE WHEN type = 'outcome' AND ord % 50 = 1 THEN 'bad' ELSE type END AS type,
    CASE WHEN type = 'outcome' AND ord % 50 = 2 THEN 'nocolon' WHEN type = 'outcome' AND ord % 50 = 3 THEN 'ZZZ:1' ELSE code END AS code FROM node),
bc AS (SELECT ord, id, CASE WHEN ord % 97 = 0 THEN 'bogus' ELSE type END AS type, CASE WHEN ord % 89 = 0 THEN 'missing' ELSE subject END AS subject, object,
    CASE WHEN ord % 83 = 0 THEN subject ELSE population END AS population, mechanism, CASE WHEN ord % 67 = 0 THEN 'odd' ELSE status END AS status FROM claim),
refs AS (SELECT id, 'subject' AS role, subject AS ref FROM bc UNION ALL SELECT id, 'object', object FROM bc UNION ALL SELECT id, 'population', population FROM bc
  UNION ALL SELECT id, 'mechanism', mechanism FROM bc),
known AS (SELECT refs.*, bn.id AS n, bn.type FROM refs LEFT JOIN bn ON ref = bn.id WHERE ref IS NOT NULL),
be AS (SELECT claim AS owner, ev_ord, substr(source_id, 6)::BIGINT AS k, study_design FROM evidence),
bl AS (SELECT * FROM be WHERE owner IN (SELECT id FROM claim)),
br AS (SELECT ord, CASE WHEN ord % 200 = 0 THEN 'nope' ELSE subject_claim END AS s, CASE WHEN ord % 150 = 0 THEN subject_claim ELSE object_claim END AS o FROM relation),
found AS (
  SELECT 'V1' AS rule, 'error' AS severity, count(*) AS n FROM bn WHERE type = 'bad'
  UNION ALL SELECT 'V2', 'warning', count(*) FROM bn WHERE domain <> '' AND domain NOT IN ({_list(schema.DOMAINS)})
  UNION ALL SELECT 'V3', 'error', count(*) FROM bn WHERE code = 'nocolon'
  UNION ALL SELECT 'V3', 'warning', count(*) FROM bn WHERE code = 'ZZZ:1'
  UNION ALL SELECT 'V4', 'error', count(*) FROM bc WHERE type = 'bogus'
  UNION ALL SELECT 'V5', 'error', count(*) FROM known WHERE n IS NULL
  UNION ALL SELECT 'V6', 'warning', count(*) FROM known WHERE role IN ('population', 'mechanism') AND type IS DISTINCT FROM role
  UNION ALL SELECT 'V7', 'error', (SELECT count(*) FROM bc WHERE ord % 79 = 0) + (SELECT count(*) FROM bc WHERE ord % 73 = 0) + (SELECT count(*) FROM bc WHERE ord % 71 = 0)
    + (SELECT count(*) FROM bc WHERE ord % 67 = 0)
  UNION ALL SELECT 'V8', 'error', count(*) FROM bc WHERE ord % 61 = 0 AND type <> 'recommends'
  UNION ALL SELECT 'V9', 'error', count(*) FROM bc WHERE status = 'curated' AND type NOT IN ({_list(schema.DEFINITIONAL)}) AND id NOT IN (SELECT owner FROM be)
  UNION ALL SELECT 'V10', 'error', (SELECT count(*) FROM bl WHERE ev_ord = 2) + (SELECT count(*) FROM bl WHERE ev_ord <> 2 AND k % 41 = 0)
  UNION ALL SELECT 'V11', 'error', (SELECT count(*) FROM be WHERE k % 41 = 0 OR owner NOT IN (SELECT id FROM claim)) + (SELECT count(*) FROM be WHERE k % 53 = 0)
    + (SELECT count(*) FROM be WHERE k % 47 = 0) + (SELECT count(*) FROM be WHERE k % 43 = 0)
  UNION ALL SELECT 'V12', 'error', (SELECT count(*) FROM br WHERE s NOT IN (SELECT id FROM claim)) + (SELECT count(*) FROM br WHERE o NOT IN (SELECT id FROM claim))
    + (SELECT count(*) FROM br WHERE s = o))
SELECT rule, severity, n FROM found WHERE n > 0"""


@query(PRELUDE + BROKEN)
def validate_broken(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(broken(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS cand_id, concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN 'subject.name missing' END, CASE WHEN o_orderkey % 5 = 0 THEN 'object.name missing' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'bad subject.type ''planet''' END, CASE WHEN o_orderstatus = 'P' THEN 'bad relationship ''P''' WHEN o_orderstatus = 'F' THEN 'bad relationship ''F''' END,
    CASE WHEN o_orderkey % 11 = 0 THEN 'bad direction ''up''' END, CASE WHEN o_orderkey % 13 = 0 THEN 'bad certainty ''sure''' END,
    CASE WHEN o_orderkey % 2 = 0 THEN 'citation.title (the paper''s full title) is required' END) AS errors FROM orders""")
def proposal_errors(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = M.read(spark, d, "orders").select(
        key.alias("cand_id"), F.when(key % 7 != 0, "a").alias("subject_name"), F.when(key % 5 != 0, "b").alias("object_name"), F.when(key % 3 == 0, "planet").otherwise("drug").alias("subject_type"),
        F.lit("outcome").alias("object_type"), F.when(F.col("o_orderstatus") == "O", "treats").otherwise(F.col("o_orderstatus")).alias("relationship"),
        F.when(key % 11 == 0, "up").alias("direction"), F.when(key % 13 == 0, "sure").alias("certainty"), F.when(key % 2 == 0, " short ").otherwise("long enough").alias("citation_title"),
    )
    return validate.candidate_errors(rows).select("cand_id", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'message is required' WHEN c_custkey % 7 = 0 THEN 'message is too long (max 4000 characters)'
    WHEN c_custkey % 11 = 0 THEN 'name is too long' WHEN c_custkey % 13 = 0 THEN 'email is too long' WHEN c_custkey % 3 = 0 THEN 'email address looks invalid' END AS error FROM customer""")
def contact_errors(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = M.read(spark, d, "customer").select(
        key.alias("id"), F.when(key % 11 == 0, F.repeat("c_name", F.lit(9))).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 13 == 0, F.concat(F.repeat(F.lit("x"), F.lit(170)), F.lit("@a.b"))).when(key % 3 == 0, "nobody@home").when(key % 2 == 0, "a@b.cd").alias("email"),
        F.when(key % 5 == 0, "  ").when(key % 7 == 0, F.repeat(F.lit("word "), F.lit(900))).otherwise(F.lit("hello")).alias("message"),
    )
    return rows.select("id", validate.contact_error(F.col("name"), F.col("email"), F.col("message")).alias("error"))


# --- links -----------------------------------------------------------------------

FULL = "'alpha beta gamma delta epsilon zeta ' || p_name || ' ' || p_type || ' ' || p_brand || ' w' || p_size"
STEMMED = """list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('the', 'a', 'an', 'of', 'in', 'for', 'and', 'to', 'with', 'on', 'or')),
  lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END))"""


def _full():
    return F.concat(F.lit("alpha beta gamma delta epsilon zeta "), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" w"), F.col("p_size").cast("string"))


@query(f"""WITH n AS (SELECT p_partkey AS ord, {STEMMED.format(FULL)} AS t FROM part),
  c AS (SELECT p_partkey AS k, {STEMMED.format(FULL + " || 'x'")} AS t FROM part),
  s AS (SELECT k, ord, len(list_intersect(c.t, n.t)) / (len(c.t) + len(n.t) - len(list_intersect(c.t, n.t)))::DOUBLE AS s FROM c, n),
  b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, ord) AS rn FROM s WHERE s >= 0.82)
  SELECT k AS cand_id, 'pt:' || ord AS node_id, round(s, 4) AS score, s = 1 AS exact FROM b WHERE rn = 1""")
def fuzzy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Long names of parts, one word changed, against those of all parts: 11 of 13 words in common."""
    parts, none = M.read(spark, d, "part"), F.array().cast(NONE).alias("aliases")
    nodes = parts.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("pt:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("outcome").alias("type"), _full().alias("name"), none)
    cand = parts.select(F.col("p_partkey").alias("cand_id"), F.lit("outcome").alias("type"), F.concat(_full(), F.lit("x")).alias("name"), none)
    return link.best_match(cand, nodes)


@query(f"""WITH w AS (SELECT p_partkey AS k, {FULL} AS title FROM part), p AS (SELECT k, 0 AS ord, 'Erratum: ' || title AS title, k * 10 AS id FROM w
    UNION ALL SELECT k, 1, title || ' and many other words about something else entirely', k * 10 + 1 FROM w WHERE k % 8 = 0
    UNION ALL SELECT k, 2, replace(title, 'alpha', 'omega'), k * 10 + 2 FROM w WHERE k % 3 = 0),
  x AS (SELECT k, 0 AS ord, title, '10.1/' || k || '/review1' AS id FROM w UNION ALL SELECT k, 1, title, '10.1/' || k FROM w WHERE k % 5 = 0),
  cand AS (SELECT k, ord, title, 'PMID:' || id AS id, 'pubmed' AS via FROM p WHERE ord > 0 UNION ALL SELECT k, ord, title, id, 'crossref' FROM x WHERE ord > 0),
  t AS (SELECT cand.*, {STEMMED.format("cand.title")} AS a, {STEMMED.format("w.title")} AS b FROM cand JOIN w USING (k)),
  i AS (SELECT *, len(list_intersect(a, b)) AS c FROM t),
  s AS (SELECT *, round(greatest(c / (len(a) + len(b) - c)::DOUBLE, c / least(len(a), len(b))::DOUBLE * 0.95), 4) AS s FROM i),
  r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY via DESC, s DESC, ord) AS rn FROM s WHERE s >= 0.6)
  SELECT k AS want_id, id AS source_id, title AS matched_title, s AS score, via FROM r WHERE rn = 1""")
def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    w = M.read(spark, d, "part").select(F.col("p_partkey").alias("want_id"), _full().alias("title"))
    key = F.col("want_id")
    of = lambda ord_, title, where=F.lit(True): w.where(where).select("want_id", F.lit(ord_).alias("ord"), title.alias("title"))
    p = of(0, F.concat(F.lit("Erratum: "), "title")).union(of(1, F.concat("title", F.lit(" and many other words about something else entirely")), key % 8 == 0))
    p = p.union(of(2, F.replace("title", F.lit("alpha"), F.lit("omega")), key % 3 == 0))
    p = p.select("want_id", "ord", "title", (key * 10 + F.col("ord")).cast("string").alias("pmid"), F.array().cast(NONE).alias("pubtypes"))
    x = of(0, F.col("title")).union(of(1, F.col("title"), key % 5 == 0))
    doi = F.concat(F.lit("10.1/"), key.cast("string"), F.when(F.col("ord") == 0, "/review1").otherwise(""))
    return link.resolve_citations(w, p, x.select("want_id", "ord", "title", doi.alias("doi"), F.lit("journal-article").alias("type")))


@query(PRELUDE + """ SELECT cand_id, id AS claim FROM (SELECT o_orderkey AS cand_id, c.id, row_number() OVER (PARTITION BY o_orderkey ORDER BY (status = 'curated') DESC NULLS LAST, created_at NULLS LAST, id) AS rn
  FROM (SELECT DISTINCT o_orderkey, 'su:' || (o_custkey % 10) AS s, 'pt:' || (o_orderkey % 200) AS o FROM orders) q JOIN claim c ON c.subject = q.s AND c.object = q.o AND c.type = 'treats' AND c.direction = 'decrease') WHERE rn = 1""")
def existing_edges(spark: SparkSession, d: str) -> DataFrame:
    """The claim that states an asked edge; of several the curated, then the oldest one."""
    q = M.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("cand_id"), F.concat(F.lit("su:"), (F.col("o_custkey") % 10).cast("string")).alias("subject"),
        F.concat(F.lit("pt:"), (F.col("o_orderkey") % 200).cast("string")).alias("object"), F.lit("treats").alias("type"), F.lit("decrease").alias("direction"),
    )
    return link.existing_claims(q, M.graph(spark, d))


# --- texts -----------------------------------------------------------------------

LABEL = "p_name || ' (' || p_type || ') ' || p_brand || '''s'"
SLUG = f"trim(regexp_replace(lower({LABEL}), '[^a-z0-9]+', '-', 'g'), '-')"
SOURCE = "CASE p_partkey % 6 WHEN 0 THEN 'pmid:' || p_partkey WHEN 1 THEN 'DOI:10.1/' || p_partkey WHEN 2 THEN 'https://x.org/' || p_partkey WHEN 3 THEN ' ' || p_partkey || ' ' WHEN 4 THEN '10.1234/' || p_partkey ELSE 'book ' || p_partkey END"


@query(f"""WITH s AS (SELECT *, {SOURCE} AS src FROM part) SELECT p_partkey AS id, 'ga:' || substr({SLUG}, 1, 48) AS node_id, 't:' || substr({SLUG}, 1, 60) AS topic_id,
    trim(regexp_replace(lower({LABEL}), '[^a-z0-9]+', ' ', 'g')) AS norm, p_name || ' ' || p_brand || '''s' AS bare, p_type AS inside,
    concat_ws('|', {LABEL}, p_name || ' ' || p_brand || '''s', p_type, CASE WHEN p_size % 2 = 0 THEN 'alias ' || p_size END) AS variants,
    CASE p_partkey % 6 WHEN 0 THEN 'PMID' WHEN 1 THEN 'DOI' WHEN 2 THEN 'URL' ELSE 'OTHER' END AS kind,
    CASE p_partkey % 6 WHEN 3 THEN 'PMID:' || p_partkey WHEN 4 THEN 'DOI:' || src ELSE src END AS source, p_partkey % 6 IN (0, 1, 2) AS curie,
    'https://meshb.nlm.nih.gov/record/ui?ui=' || replace(p_brand, '#', '%23') AS url, '''' || replace({LABEL}, '''', '''''') || '''' AS quoted,
    p_type || '|' || p_brand AS several FROM s""")
def names_and_ids(spark: SparkSession, d: str) -> DataFrame:
    k, label = F.col("p_partkey"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand", F.lit("'s"))
    num = k.cast("string")
    src = F.when(k % 6 == 0, F.concat(F.lit("pmid:"), num)).when(k % 6 == 1, F.concat(F.lit("DOI:10.1/"), num)).when(k % 6 == 2, F.concat(F.lit("https://x.org/"), num))
    src = src.when(k % 6 == 3, F.concat(F.lit(" "), num, F.lit(" "))).when(k % 6 == 4, F.concat(F.lit("10.1234/"), num)).otherwise(F.concat(F.lit("book "), num))
    alias = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("alias "), F.col("p_size").cast("string")), F.upper("p_type"))).otherwise(F.array().cast(NONE))
    return M.read(spark, d, "part").withColumn("label", label).withColumn("src", src).select(
        k.alias("id"), text.node_id(F.col("label")).alias("node_id"), text.topic_id(F.col("label")).alias("topic_id"), text.norm_term(F.col("label")).alias("norm"),
        text.de_paren(F.col("label")).alias("bare"), F.array_join(text.paren_parts(F.col("label")), ";").alias("inside"), F.array_join(text.name_variants(F.col("label"), alias), "|").alias("variants"),
        text.citation_kind(F.col("src")).alias("kind"), text.normalize_source_id(F.col("src")).alias("source"), text.is_curie(F.col("src")).alias("curie"),
        text.code_url(F.concat(F.lit("mesh:"), "p_brand")).alias("url"), text.sql_quote(F.col("label")).alias("quoted"),
        F.array_join(text.multi(F.concat(F.lit(" ; "), "p_type", F.lit(" | "), "p_brand", F.lit(";"))), "|").alias("several"),
    )


@query("""SELECT event_id AS id, props AS json, CASE event_type WHEN 'click' THEN 'rct' WHEN 'view' THEN 'systematic_review_or_meta_analysis' WHEN 'purchase' THEN 'cohort' ELSE
    CASE WHEN event_id % 2 = 0 THEN 'guideline' END END AS design, event_type = 'error' AS erratum FROM events""")
def records(spark: SparkSession, d: str) -> DataFrame:
    """Replies with JSON inside, and records whose design shows in their publication type, title or kind."""
    t = F.col("event_type")
    types = F.when(t == "click", F.array(F.lit("Journal Article"), F.lit("Randomized Controlled Trial"))).when(t == "error", F.array(F.lit("Published Erratum"))).otherwise(F.array().cast(NONE))
    title = F.when(t == "view", "Sleep: a Systematic Review").when(t == "purchase", "A longitudinal look").otherwise("Plain")
    return M.read(spark, d, "events").select(
        F.col("event_id").alias("id"), text.extract_json(F.concat(F.lit('so "it" is: '), "props", F.lit(" } done"))).alias("json"),
        text.study_design(types, title, F.when(F.col("event_id") % 2 == 0, "standard")).alias("design"), text.is_erratum(title, types).alias("erratum"),
    )


@query("""SELECT 'INSERT INTO nation (n_nationkey, n_name, tags) VALUES (' || n_nationkey || ', ''' || n_name || ''', ARRAY[''' || n_name || ''',''it''''s''])' || ';' AS value FROM nation""")
def insert_statements(spark: SparkSession, d: str) -> DataFrame:
    rows = M.read(spark, d, "nation").select("n_nationkey", "n_name", F.array("n_name", F.lit("it's")).alias("tags"))
    return tabular.insert_statements(rows, "nation")


# --- writes ----------------------------------------------------------------------


@query("""WITH r AS (SELECT c_custkey AS "row", CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'su:' || c_custkey END AS id, c_custkey % 5 = 0 AS t, c_custkey % 11 = 0 AS n, c_custkey % 13 = 0 AS x FROM customer)
  SELECT "row", id, CASE WHEN id = '' OR t OR n OR x THEN 400 WHEN id IN (SELECT 'su:' || s_suppkey FROM supplier) THEN 409 ELSE 200 END::INT AS status_code,
    CASE WHEN id = '' OR t OR n OR x THEN (id = '')::INT + t::INT + n::INT + x::INT WHEN id IN (SELECT 'su:' || s_suppkey FROM supplier) THEN 1 ELSE 0 END::INT AS n_errors FROM r""")
def create_nodes(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.array().cast(NONE)
    rows = M.read(spark, d, "customer").select(
        k.alias("row"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" su:"), k.cast("string"))).alias("id"), F.when(k % 5 == 0, "bad").otherwise("outcome").alias("type"),
        F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 13 == 0, F.array(F.lit("x"))).otherwise(none).alias("external_ids"),
    )
    return writes.check_nodes(M.graph(spark, d), rows).select("row", "id", "status_code", F.size("errors").alias("n_errors"))


@query(PRELUDE + """ SELECT 'su:' || c_custkey AS id, (SELECT max(ord) FROM node) + row_number() OVER (ORDER BY c_custkey) AS ord FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def created_places(spark: SparkSession, d: str) -> DataFrame:
    """Where new nodes come to stand: after all others, in the order of the input."""
    k = F.col("c_custkey")
    rows = M.read(spark, d, "customer").select(k.alias("row"), F.concat(F.lit("su:"), k.cast("string")).alias("id"), F.lit("outcome").alias("type"), F.col("c_name").alias("name"), F.array().cast(NONE).alias("external_ids"))
    g = M.graph(spark, d)
    after = writes.create_nodes(g, rows)[0]
    return after.node.join(g.node.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti").select("id", "ord")


@query(PRELUDE + """, r AS (SELECT o_orderkey AS "row", CASE WHEN o_orderkey % 3 = 0 THEN 'cl:' || o_orderkey || '-1' ELSE 'nw:' || o_orderkey END AS id, 'su:' || (o_custkey % 150) AS s,
    o_orderkey % 5 = 0 AS bad, o_orderkey % 7 = 0 AS bare, o_orderkey % 11 = 0 AS odd FROM orders)
  SELECT "row", CASE WHEN bad OR bare THEN 400 WHEN s NOT IN (SELECT id FROM node) THEN 400 WHEN id IN (SELECT id FROM claim) THEN 409 WHEN odd THEN 400 ELSE 200 END::INT AS status_code FROM r""")
def create_claims(spark: SparkSession, d: str) -> DataFrame:
    k, text_ = F.col("o_orderkey"), lambda c: F.lit(None).cast("string").alias(c)
    record = F.struct(F.when(k % 11 == 0, "nocurie").otherwise("PMID:1").alias("source_id"), text_("source_node"), text_("quote"), text_("study_design"), F.lit(None).cast("double").alias("confidence"), text_("extracted_by"))
    rows = M.read(spark, d, "orders").select(
        k.alias("row"), F.when(k % 3 == 0, F.concat(F.lit("cl:"), k.cast("string"), F.lit("-1"))).otherwise(F.concat(F.lit("nw:"), k.cast("string"))).alias("id"),
        F.when(k % 5 == 0, "bogus").otherwise("treats").alias("type"), F.concat(F.lit("su:"), (F.col("o_custkey") % 150).cast("string")).alias("subject"), F.lit("pt:1").alias("object"),
        *[text_(c) for c in ("population", "mechanism", "setting", "direction", "certainty", "status", "rec_strength")],
        F.when(k % 7 == 0, F.array().cast(writes.EVIDENCE_INPUT)).otherwise(F.array(record)).alias("evidence"),
    )
    return writes.check_claims(M.graph(spark, d), rows).select("row", "status_code")


@query(PRELUDE + """, asked(id) AS (VALUES ('su:1'), ('rg:0'), ('pt:3'), ('pt:none'), ('nt:0')), refs AS (SELECT subject AS id FROM claim UNION SELECT object FROM claim UNION SELECT population FROM claim UNION SELECT mechanism FROM claim)
  SELECT id, CASE WHEN id NOT IN (SELECT id FROM node) THEN 404 WHEN id IN (SELECT id FROM refs WHERE id IS NOT NULL) THEN 409 ELSE 200 END::INT AS status_code FROM asked""")
def delete_nodes(spark: SparkSession, d: str) -> DataFrame:
    return writes.delete_nodes(M.graph(spark, d), ["su:1", "rg:0", "pt:3", "pt:none", "nt:0"])[1]


@query(PRELUDE + f""", gone AS (SELECT id FROM claim WHERE object = '{OBJECT}') SELECT 'claim' AS entity, count(*) AS n FROM claim WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE claim NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'relation', count(*) FROM relation WHERE subject_claim NOT IN (SELECT id FROM gone) AND object_claim NOT IN (SELECT id FROM gone)""")
def delete_claims(spark: SparkSession, d: str) -> DataFrame:
    g = M.graph(spark, d)
    after = writes.delete_claims(g, g.claim.where(F.col("object") == OBJECT).select("id"))
    n = lambda t: getattr(after, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("entity"), "n")
    return n("claim").unionByName(n("evidence")).unionByName(n("relation"))


@query(PRELUDE + """ SELECT id, CASE WHEN ord % 2 = 0 THEN upper(name) ELSE name END AS name, ord FROM node WHERE type = 'outcome'
  UNION ALL SELECT 'se:' || ord, 'seed', ord FROM node WHERE type = 'population'""")
def load_seed(spark: SparkSession, d: str) -> DataFrame:
    """A seed that renames every other part and adds a few nodes, taken over the graph."""
    g = M.graph(spark, d)
    renamed = g.node.where("type = 'outcome' and ord % 2 = 0").withColumn("name", F.upper("name"))
    added = g.node.where("type = 'population'").withColumn("id", F.concat(F.lit("se:"), F.col("ord").cast("string"))).withColumn("name", F.lit("seed"))
    empty = g.with_(node=renamed.unionByName(added), claim=g.claim.limit(0), evidence=g.evidence.limit(0), listed=g.listed.limit(0), relation=g.relation.limit(0))
    return writes.load_seed(g, empty).node.where("type = 'outcome' or id like 'se:%'").select("id", "name", "ord")


@query(PRELUDE + """ SELECT id, CASE WHEN id = 'pt:3' THEN 'Zeta' ELSE '' END AS aliases FROM node WHERE type = 'outcome'""")
def add_alias(spark: SparkSession, d: str) -> DataFrame:
    """An alias, again in another case, and one that equals the name."""
    g = writes.add_alias(writes.add_alias(M.graph(spark, d), "pt:3", " Zeta "), "pt:3", "ZETA")
    name = g.node.where("id = 'pt:4'").select("name").first()["name"]
    return writes.add_alias(g, "pt:4", name.upper()).node.where("type = 'outcome'").select("id", F.array_join("aliases", ";").alias("aliases"))


# --- reviews and queues ----------------------------------------------------------


@query(PRELUDE + """ SELECT id FROM claim WHERE status = 'unverified' AND id IN (SELECT claim FROM evidence) ORDER BY created_at, id LIMIT 25""")
def review_batch(spark: SparkSession, d: str) -> DataFrame:
    return review.review_batch(M.graph(spark, d), 25).select("id")


OUTCOMES = """
, batch AS (SELECT * FROM claim WHERE status = 'unverified' AND id IN (SELECT claim FROM evidence)),
cited AS (SELECT claim, bool_and(substr(source_id, 6)::BIGINT % 7 <> 0) AS ok, bool_or(substr(source_id, 6)::BIGINT % 11 = 0) AS failed FROM evidence GROUP BY claim),
res AS (SELECT id, certainty, ord, CASE WHEN failed OR ord % 13 = 0 THEN 'deferred' WHEN ok AND ord % 3 <> 0 THEN 'curated' ELSE 'flagged' END AS outcome FROM batch JOIN cited ON id = claim)
"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    g = M.graph(spark, d)
    key = F.substring_index("source_id", ":", -1).cast("long")
    meta = g.evidence.select("source_id").distinct().select("source_id", (key % 7 != 0).alias("exists"), (key % 11 == 0).alias("lookup_failed"))
    verdicts = g.claim.where("ord % 13 <> 0").select(F.col("id").alias("claim"), F.when(F.col("ord") % 3 == 0, "reject").otherwise("approve").alias("verdict"), F.lit("low").alias("certainty"))
    return review.review_claims(g, review.reviewable(g), meta, verdicts)


@query(PRELUDE + OUTCOMES + """ SELECT id AS claim, outcome, CASE outcome WHEN 'deferred' THEN 'unverified' WHEN 'curated' THEN 'curated' ELSE 'needs_refinement' END AS status,
  CASE WHEN outcome = 'curated' THEN coalesce(certainty, 'low') ELSE certainty END AS certainty FROM res""")
def review_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)


@query(PRELUDE + OUTCOMES + """ SELECT count(*) AS reviewed, count(*) FILTER (outcome = 'curated') AS curated, count(*) FILTER (outcome = 'flagged') AS flagged, count(*) FILTER (outcome = 'deferred') AS deferred FROM res""")
def review_tallies(spark: SparkSession, d: str) -> DataFrame:
    return review.batch_tallies(_outcomes(spark, d))


@query(PRELUDE + """ SELECT status, certainty, count(*) AS n FROM (SELECT CASE WHEN id = first.i THEN 'curated' ELSE status END AS status, CASE WHEN id = first.i THEN 'high' ELSE certainty END AS certainty
  FROM claim, (SELECT min(id) AS i FROM claim WHERE status = 'unverified') first) GROUP BY ALL""")
def decide_claim(spark: SparkSession, d: str) -> DataFrame:
    g = M.graph(spark, d)
    id_ = g.claim.where("status = 'unverified'").agg(F.min("id").alias("i")).first()["i"]
    return review.decide(g, id_, True, "high").claim.groupBy("status", "certainty").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def newest_questions(spark: SparkSession, d: str) -> DataFrame:
    return review.newest(M.ask_log(spark, d), 9_999).select("id")


@query("""SELECT p_partkey AS id FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20""")
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    return review.page(M.read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), ["p_name", "id"], 3)[0].select("id")


TOPICS = """
WITH new AS (SELECT *, 't:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM customer),
topics AS (SELECT id, c_custkey, 'topic' AS topic, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'pending' END AS status, c_custkey % 5 AS priority FROM new)
"""


def _topics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = M.read(spark, d, "customer").select(
        text.topic_id(F.col("c_name")).alias("id"), F.col("c_name").alias("topic"), F.when(k % 3 == 0, "failed").otherwise("pending").alias("status"), (k % 5).cast("int").alias("priority"),
        F.lit(1).alias("attempts"), F.lit("boom").alias("last_error"), F.timestamp_seconds(k).alias("created_at"),
    )
    return M.conform(rows, schema.TOPIC)


@query(TOPICS + """, nxt AS (SELECT id FROM topics WHERE status = 'pending' ORDER BY priority DESC, c_custkey LIMIT 1)
  SELECT CASE WHEN t.id = nxt.id THEN 'done' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN t.id = nxt.id THEN 2 WHEN status = 'failed' THEN 0 ELSE 1 END::INT AS attempts, count(*) AS n
  FROM topics t, nxt GROUP BY ALL""")
def topic_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The next topic is taken and finished, and failed ones are queued again."""
    topics, id_ = review.claim_next_topic(_topics(spark, d))
    topics = review.requeue_failed(review.finish_topic(topics, id_, "done"))
    return topics.groupBy("status", "attempts").agg(F.count("*").alias("n"))


@query("""SELECT 't:' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS id, 'pending' AS status, 0::INT AS priority FROM supplier
  UNION ALL SELECT 't:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'pending' END, (c_custkey % 5)::INT FROM customer""")
def seed_topics(spark: SparkSession, d: str) -> DataFrame:
    names = M.read(spark, d, "supplier").select(F.col("s_name").alias("topic"), F.col("s_suppkey").alias("ord"))
    again = M.read(spark, d, "customer").select(F.col("c_name").alias("topic"), (F.col("c_custkey") + 10**9).alias("ord"))
    return review.seed_topics(_topics(spark, d), names.union(names).union(again))[0].select("id", "status", "priority")


@query("""SELECT c_custkey AS ord, 't:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 4 <> 1""")
def filter_topics(spark: SparkSession, d: str) -> DataFrame:
    """Proposals that repeat known topics, are too short or in no known domain go."""
    k = F.col("c_custkey")
    c = M.read(spark, d, "customer")
    rows = c.select(k.alias("ord"), F.when(k % 2 == 0, "short").otherwise(F.concat(F.lit(" "), "c_name")).alias("topic"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "sleep").otherwise("cooking").alias("domain"))
    return review.filter_topics(rows, c.where(k % 4 == 1).select(F.col("c_name").alias("topic"))).select("ord", "id")


@query("""SELECT count(DISTINCT l_partkey) AS papers, count(*) AS proposed, count(*) FILTER (l_linenumber = 1) AS created, count(*) FILTER (l_linenumber = 2) AS merged,
  count(*) FILTER (l_linenumber = 3) AS reused, count(*) FILTER (l_linenumber > 3) AS skipped FROM lineitem""")
def harvest_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    status = F.when(n == 1, "created").when(n == 2, "merged").when(n == 3, "reused").otherwise("skipped")
    return review.harvest_summary(M.read(spark, d, "lineitem").select(status.alias("status"), F.col("l_partkey").alias("paper")))


@query("""SELECT p_partkey AS ord FROM part ORDER BY (p_type ILIKE 'pro%') DESC, p_partkey LIMIT 15""")
def rank_papers(spark: SparkSession, d: str) -> DataFrame:
    rows = M.read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.array("p_brand", "p_type").alias("pubtypes"))
    return review.rank_papers(rows, "(?i)^pro", 99).select("ord")


@query(PRELUDE + """ SELECT (SELECT count(*) FROM node) AS nodes, 0::BIGINT AS papers, (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) AS pending_topics""")
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.global_counts(M.graph(spark, d), _topics(spark, d))


@query("""SELECT event_id + (SELECT max(event_id) FROM events) AS id, CAST(NULL AS VARCHAR) AS agent FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS event_id FROM customer) WHERE event_id > 0""")
def append_log(spark: SparkSession, d: str) -> DataFrame:
    runs = M.agent_runs(spark, d)
    new = M.read(spark, d, "customer").select(F.timestamp_seconds(F.col("c_custkey")).alias("created_at"), F.lit("x").alias("claim_id"))
    return review.append_log(runs, new).where("claim_id = 'x'").select("id", "agent")


# --- agents ----------------------------------------------------------------------


@query("""SELECT c_custkey AS id, md5('New contact message' || chr(10) || 'From: ' || CASE WHEN c_custkey % 2 = 0 THEN '(anonymous)' ELSE c_name END || chr(10) || 'Email: ' || CASE WHEN c_custkey % 3 = 0 THEN 'a@b.cd' ELSE '(none)' END
  || chr(10) || chr(10) || c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || chr(10) || 'IP: 1.2.3.4' || CASE WHEN c_custkey % 10 = 0 THEN chr(10) || 'UA: x' ELSE '' END ELSE '' END || chr(10) || '#' || c_custkey) AS notice FROM customer""")
def contact_notices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    notice = agents.contact_notice(F.when(k % 2 == 1, F.concat(F.lit(" "), "c_name")), F.when(k % 3 == 0, "a@b.cd").otherwise(" "), F.concat("c_mktsegment", F.lit(" ")), F.when(k % 5 == 0, "1.2.3.4"), F.when(k % 10 == 0, "x"), k)
    return M.read(spark, d, "customer").select(k.alias("id"), F.md5(notice).alias("notice"))


@query("""SELECT sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 ELSE 0 END)::BIGINT AS input_tokens, count(*) * 10 AS output_tokens FROM events""")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    return agents.usage(M.ask_log(spark, d))


@query(PRELUDE + f""", v AS (SELECT 'nodeTypes' AS vocab, unnest([{_list(t for t in schema.NODE_TYPES if t not in ("theory", "model", "knowledge_gap", "research_question"))}]) AS value
    UNION ALL SELECT 'relationshipTypes', unnest([{_list(t for t in schema.RELATIONSHIPS if t not in ("explains", "informs", "generates"))}])),
  n AS (SELECT 'nodeTypes' AS vocab, type AS value, count(*) AS n FROM node GROUP BY type UNION ALL SELECT 'relationshipTypes', type, count(*) FROM claim GROUP BY type)
  SELECT v.vocab, v.value, coalesce(n.n, 0) AS n FROM v LEFT JOIN n ON v.vocab = n.vocab AND v.value = n.value""")
def harvest_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The types that papers are asked for, and how many nodes or claims of each there are."""
    g = M.graph(spark, d)
    used = [getattr(g, t).groupBy(F.col("type").alias("_value")).agg(F.count("*").alias("n")).withColumn("_vocab", F.lit(v)) for t, v in (("node", "nodeTypes"), ("claim", "relationshipTypes"))]
    rows = agents.harvest_vocabulary(g).join(used[0].unionByName(used[1]), (F.col("vocab") == F.col("_vocab")) & (F.col("value") == F.col("_value")), "left")
    return rows.select("vocab", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT p_partkey AS id, p_name || '|' || p_type || '|' || p_brand AS terms, p_partkey % 3 = 0 AS same FROM part""")
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    listed = F.concat(F.lit('Sure: ["'), "p_name", F.lit('", " ", "'), "p_type", F.lit(' ", "'), "p_brand", F.lit('", "fourth"] ok'))
    same = F.when(k % 3 == 0, 'yes {"same": true}').when(k % 3 == 1, '{"same": "true"}').otherwise("true")
    return M.read(spark, d, "part").select(k.alias("id"), F.array_join(agents.suggested_terms(listed), "|").alias("terms"), agents.same_concept(same).alias("same"))


CODED = """, t AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name)
"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms for every second part's name and, under another name, for the others."""
    rows = M.read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    label = F.when(F.col("ord") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("official "), "p_name"))
    return rows.select(F.lit("MESH").alias("prefix"), "ord", F.concat(F.lit("MESH:D"), F.col("ord").cast("string")).alias("curie"), F.array(label).alias("labels"))


@query(PRELUDE + CODED + """ SELECT id, CASE WHEN code <> '' THEN code WHEN k % 2 = 0 THEN 'MESH:D' || k WHEN k % 3 <> 0 THEN 'MESH:D' || k ELSE '' END AS codes
  FROM node JOIN t ON node.name = t.p_name WHERE type = 'outcome'""")
def codes_in_two_passes(spark: SparkSession, d: str) -> DataFrame:
    """Own names find half of the codes, suggested terms the others, of which some are confirmed."""
    nodes, terms = M.graph(spark, d).node.where("type = 'outcome'"), _terms(spark, d)
    suggested = nodes.select("id", F.array(F.concat(F.lit("Official "), "name")).alias("terms"))
    confirmed = nodes.select("id", "name").join(terms.where("ord % 3 <> 0").select("curie", F.array_join("labels", "").alias("l")), F.lower(F.concat(F.lit("official "), "name")) == F.lower("l"))
    rows = agents.resolve_codes_twice(nodes, terms, suggested, confirmed.select("id", "curie"))
    return rows.select("id", F.array_join("external_ids", ";").alias("codes"))


@query(PRELUDE + CODED + """ SELECT id, 'MESH' AS prefix, CASE WHEN code <> '' OR k % 2 = 1 THEN 0 ELSE 1 END::BIGINT AS n_candidates,
  CASE WHEN code <> '' THEN 'already has a code' WHEN k % 2 = 0 THEN 'matched (name): MESH:D' || k ELSE 'no candidates' END AS decision FROM node JOIN t ON node.name = t.p_name WHERE type = 'outcome'""")
def diagnose_codes(spark: SparkSession, d: str) -> DataFrame:
    return agents.diagnose(M.graph(spark, d).node.where("type = 'outcome'"), _terms(spark, d)).select("id", "prefix", "n_candidates", "decision")


@query(PRELUDE + CODED + """, b AS (SELECT * FROM node WHERE type IN ('outcome', 'intervention', 'mechanism') ORDER BY id LIMIT 200),
  f AS (SELECT b.*, b.type = 'outcome' AND code = '' AND k % 2 = 0 AS hit FROM b LEFT JOIN t ON b.name = t.p_name)
  SELECT count(*) AS scanned, count(*) FILTER (hit) AS mapped, count(*) FILTER (hit) AS codes_added, (SELECT count(*) FROM node WHERE type IN ('outcome', 'intervention', 'mechanism')) - count(*) AS remaining FROM f""")
def map_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return agents.map_nodes(M.graph(spark, d), _terms(spark, d), 999)[1]


@query(PRELUDE + """, e AS (SELECT *, substr(source_id, 6)::BIGINT AS k FROM evidence WHERE claim IN (SELECT id FROM claim WHERE status = 'needs_refinement'))
  SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN k % 5 = 0 THEN 'unnamed' WHEN k % 5 = 1 THEN 'unresolved' WHEN k % 5 = 2 THEN 'correct' ELSE 'repaired' END AS outcome FROM e) GROUP BY 1""")
def repair_claims(spark: SparkSession, d: str) -> DataFrame:
    g = M.graph(spark, d)
    bad = g.claim.where("status = 'needs_refinement'").select("id")
    k = F.substring_index("source_id", ":", -1).cast("long")
    ev = g.evidence.select(F.col("id").alias("evidence"), k.alias("k"))
    named = ev.where("k % 5 <> 0").select("evidence", F.concat(F.lit("A long title about item "), F.col("k").cast("string")).alias("title"))
    pmid = F.when(F.col("k") % 5 == 2, F.col("k")).otherwise(F.col("k") + 1)
    pubmed = ev.where("k % 5 >= 2").select(F.col("evidence").alias("want_id"), F.lit(0).alias("ord"), pmid.cast("string").alias("pmid"), F.concat(F.lit("A long title about item "), F.col("k").cast("string")).alias("title"), F.array().cast(NONE).alias("pubtypes"))
    crossref = pubmed.limit(0).select("want_id", "ord", F.col("pmid").alias("doi"), "title", F.lit("x").alias("type"))
    return agents.repair(g, bad, named, pubmed, crossref)[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query(PRELUDE + """ SELECT ord, id, name, type, domain FROM node""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_nodes(M.graph(spark, d)).select("ord", "id", "name", "type", F.array_join("domains", ";").alias("domain"))


@query(PRELUDE + """ SELECT id, name FROM node ORDER BY name, id LIMIT 200""")
def prompt_names(spark: SparkSession, d: str) -> DataFrame:
    return agents.known_names(M.graph(spark, d)).select("id", "name")


RATE = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, (epoch_us(ts) // 1000) AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
r(key, rn, seq, at_ms, times, accepted) AS (SELECT key, rn, seq, at_ms, [at_ms], true FROM e WHERE rn = 1
  UNION ALL SELECT key, rn, seq, at_ms, CASE WHEN len(live) < 6 THEN list_append(live, at_ms) ELSE live END, len(live) < 6
  FROM (SELECT e.*, list_filter(r.times, lambda t: e.at_ms - t < 86400000) AS live FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1))
SELECT key, seq, at_ms, accepted FROM r"""
#: The registered ``path`` leaves out the names and types of the ends.
PATH_SQL = f"""SELECT step, "from", claim, forward, "to", relationship, sources FROM ({PRELUDE + PATH})"""
