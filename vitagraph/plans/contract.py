"""Every operator as a query over the star-schema tables, and the same in plain SQL.

SQL texts share a prelude that builds the mapped tables; queries build them with
DataFrame operations, so the two are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers as A
from ..operators import link, review, search, traverse, validate
from ..streaming import limits
from . import contract_more, contract_state
from . import mapping as M
from .prelude import FNV, NATION, NODE, OBJECT, PRELUDE, REGION, SUPPLIER, TOKENS

ANSWER_SQL = (
    "a_ord AS ord, a_claim AS claim, a_subject AS subject, type AS relationship, a_object AS object, a_population AS population, direction,"
    " certainty, comparator, sources, score::INT AS score, tier, best_design, n_sources::BIGINT AS n_sources, sample_size::BIGINT AS sample_size, conflicted"
)
COLUMNS = (
    "ord", "claim", "subject", "relationship", "object", "population", "direction", "certainty", "comparator", "sources", "score", "tier",
    "best_design", "n_sources", "sample_size", "conflicted",
)


def flat(rows: DataFrame) -> DataFrame:
    """Answer rows with scalar columns only."""
    return rows.withColumn("sources", F.array_join("sources", ";")).select(*COLUMNS)


def _answers(where: str) -> str:
    return f"{PRELUDE} SELECT {ANSWER_SQL} FROM answer WHERE {where}"


TOUCH = "(coalesce(subject = '{0}', false) OR coalesce(object = '{0}', false) OR coalesce(population = '{0}', false) OR coalesce(mechanism = '{0}', false))"
WEAK = "(status IN ('unverified', 'needs_refinement', 'skeleton') OR coalesce(certainty IN ('low', 'very_low'), false))"


def _pair(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ord", F.col("a.claim").alias("a_claim"), F.col("a.score").alias("a_score"), F.col("a.subject").alias("a_subject"),
        F.col("b.claim").alias("b_claim"), F.col("b.score").alias("b_score"), F.col("b.object").alias("b_object"),
    )


def q_landscape(spark: SparkSession, d: str) -> DataFrame:
    rows = A.evidence_landscape(M.graph(spark, d), SUPPLIER)
    return rows.select("kind", "via", F.col("a.claim").alias("claim"), F.col("a.score").alias("score"), F.col("b.claim").alias("other"))


def q_path(spark: SparkSession, d: str) -> DataFrame:
    p = traverse.shortest_path(M.graph(spark, d), SUPPLIER, OBJECT, 6)
    if p.steps is None:
        return spark.createDataFrame([], "step int, `from` string, claim string, forward boolean, `to` string")
    return p.steps.select("step", "from", "claim", "forward", "to", "relationship", F.array_join("sources", ";").alias("sources"))


def q_distances(spark: SparkSession, d: str) -> DataFrame:
    return traverse.distances(M.graph(spark, d), SUPPLIER, 3)


def q_node_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = A.node_claims(M.graph(spark, d), NODE)
    return rows.select(
        "ord", F.col("id").alias("claim"), "side", "other_id", "other_name", F.col("type").alias("relationship"),
        F.col("population_name").alias("population"), "status", "score", F.size("evidence_rows").cast("long").alias("n_evidence"),
    )


def q_search(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every document's hashed terms to a fixed query."""
    docs = M.read(spark, d, "documents").select(
        F.lit("document").alias("owner_type"), F.col("doc_id").cast("string").alias("owner_id"), F.col("doc_id").alias("ord"), F.lit(0).alias("side"), "text"
    )
    return search.score(docs, "the theory of order and reason").select(F.col("ord").alias("doc_id"), "score")


def q_term_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = M.nodes(spark, d).select("id", "name")
    return text.sparse_vectors(rows, ["id"], "name").select("id", "bucket", F.round("weight", 6).alias("weight"))


def q_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50, among all."""
    rows = M.read(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    return search.nearest(rows, asked, 5)


def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = M.read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.to_timestamp(F.col("ts"))).alias("at_ms"))
    return limits.limited(rows, 6, 24 * 3600 * 1000)


def q_match_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts resolved against all nodes of the graph by name, same type only."""
    g = M.graph(spark, d)
    cand = g.node.where("type = 'outcome'").select(F.col("id").alias("cand_id"), F.concat(F.lit("The "), "name", F.lit(" (trial)")).alias("name"), "type", "aliases")
    return link.best_match(cand, g.node)


def q_codes(spark: SparkSession, d: str) -> DataFrame:
    nodes = M.graph(spark, d).node.where("type = 'outcome'")
    terms = M.read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord")).select(
        F.lit("MESH").alias("prefix"), F.col("ord").alias("ord"), F.concat(F.lit("MESH:D"), F.col("ord").cast("string")).alias("curie"), F.array(F.upper("p_name")).alias("labels")
    )
    return link.resolve_codes(nodes, terms).select("id", F.array_join("external_ids", ";").alias("codes"))


def _on(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(M.graph(spark, d))


NOW = "(SELECT max(ts) FROM events)"


def q_activity(spark: SparkSession, d: str) -> DataFrame:
    runs = M.agent_runs(spark, d)
    now = runs.agg(F.max("created_at").alias("m")).first()["m"]
    return review.recent_activity(runs, F.lit(now))


def q_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = review.review_queue(M.graph(spark, d), M.agent_runs(spark, d), "unverified", 40, 20, "r_a")
    return rows.select("id", "subj", "obj", "pop", "type", "score", F.size(F.coalesce("evidence_rows", F.array().cast(rows.schema["evidence_rows"].dataType))).cast("long").alias("n_evidence"))


def q_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = M.read(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))
    return rows.select("page_id", F.length("body").cast("long").alias("n"), F.md5("body").alias("body_md5"))


def q_cited(spark: SparkSession, d: str) -> DataFrame:
    rows = M.read(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" [PMID: "), F.col("conv_id").cast("string"), F.lit("] and [pmid:"), F.col("turn").cast("string"), F.lit("]")).alias("t"))
    return rows.select("conv_id", "turn", F.array_join(text.cited_ids(F.col("t")), ";").alias("cited"))


def q_claim_ids(spark: SparkSession, d: str) -> DataFrame:
    return M.claims(spark, d).select("id", text.claim_id(F.col("subject"), F.col("type"), F.col("object"), F.col("population")).alias("edge_id"))


def q_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form and topic id of every document's whole text."""
    rows = M.read(spark, d, "documents")
    return rows.select("doc_id", text.canonical(F.col("text")).alias("canon"), text.topic_id(F.col("text")).alias("topic_id"))


def q_context(g) -> DataFrame:
    return A.context_edges(g).select("source", "target", "kind")


def q_neighbours(g) -> DataFrame:
    return A.node_neighbours(g, NODE).select(F.col("seen.ord").alias("ord"), "id", "name", "type")


def q_recommend(g) -> DataFrame:
    rows = A.recommendations(g, REGION, "Supplier#00000000")
    return rows.select("ord", "claim", "issuer_id", "issuer_name", "issuer_type", "intervention_id", "intervention_name", "population", "status", F.array_join("sources", ";").alias("sources"))


def q_effects(g) -> DataFrame:
    return A.effects_on(g, OBJECT).select("name", "type", "direction", "certainty", "sources", "certainty_rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "what_affects": _on(lambda g: flat(A.what_affects(g, OBJECT))),
    "what_affects_protective": _on(lambda g: flat(A.what_affects(g, OBJECT, True))),
    "high_certainty_about": _on(lambda g: flat(A.high_certainty_about(g, NODE))),
    "gaps": _on(lambda g: flat(A.gaps(g))),
    "for_population": _on(lambda g: flat(A.for_population(g, REGION))),
    "neighbourhood": _on(lambda g: flat(A.neighbourhood(g, NATION))),
    "comparative": _on(lambda g: flat(A.comparative(g))),
    "list_claims": _on(lambda g: flat(A.list_claims(g, type="treats", status="curated", certainty="high"))),
    "list_nodes": _on(lambda g: A.list_nodes(g, "outcome", None, "re").select("ord", "id", "name", F.array_join("domains", ";").alias("domain"))),
    "get_node": _on(lambda g: A.get_node(g, OBJECT).select("ord", "id", "type", "name")),
    "resolve_topic": _on(lambda g: A.resolve_topic(g, "SUPPLIER#00000001").select("ord", "id", "name")),
    "conflicts": _on(lambda g: _pair(A.conflicts(g))),
    "weak_evidence": _on(lambda g: flat(A.weak_evidence(g, SUPPLIER))),
    "evidence_landscape": q_landscape,
    "recommendations": _on(q_recommend),
    "path": q_path,
    "distances": q_distances,
    "node_detail": q_node_detail,
    "node_neighbours": _on(q_neighbours),
    "context_edges": _on(q_context),
    "graph_edges": _on(lambda g: A.graph_edges(g).select("ord", "id", "source", "target", "type", "conflict", "score")),
    "entity_counts": _on(A.entity_counts),
    "effects_on": _on(q_effects),
    "validate": _on(lambda g: validate.validate(g).groupBy("rule", "severity", "entity").agg(F.count("*").alias("n"))),
    "duplicate_groups": _on(lambda g: link.duplicate_groups(g)),
    "dedup_dry_run": _on(lambda g: link.dedup_summary(g)),
    "dedup_applied": _on(lambda g: link.dedup_summary(g, apply=True)),
    "dedup_claims_left": _on(lambda g: link.dedup_apply(g).claim.select("id")),
    "unmapped_by_type": _on(lambda g: link.unmapped_report(g)[1]),
    "unmapped_nodes": _on(lambda g: link.unmapped_report(g, 300)[0].select("id", "type", "name")),
    "resolve_codes": q_codes,
    "match_nodes": q_match_nodes,
    "review_queue": q_queue,
    "queue_count": _on(lambda g: review.queue_count(g, "unverified", "r_a")),
    "claims_by_status": _on(review.claims_by_status),
    "reviewable": _on(lambda g: review.reviewable(g).select("id")),
    "recent_activity": q_activity,
    "latest_run": lambda s, d: A.latest(M.agent_runs(s, d), "claim_id", "created_at", "id").select("claim_id", "id", "agent"),
    "ask_gaps": lambda s, d: review.ask_gaps(M.ask_log(s, d), 50).select("id"),
    "ask_panel": lambda s, d: review.ask_panel(M.ask_log(s, d)),
    "rate_limit": q_rate_limit,
    "search": q_search,
    "term_vectors": q_term_vectors,
    "nearest": q_nearest,
    "page_text": q_pages,
    "cited_ids": q_cited,
    "claim_ids": q_claim_ids,
    "canonical_names": q_canonical,
}

# --- the same in SQL -----------------------------------------------------------

QUERY_TEXT = "the theory of order and reason"

KEEPER = """
, grp AS (SELECT *, first_value(id) OVER (PARTITION BY subject, object, type, direction
                     ORDER BY (status = 'curated') DESC, created_at, id) AS keeper FROM claim),
dups AS (SELECT id AS dup, keeper FROM grp WHERE id <> keeper),
mv AS (SELECT e.claim, e.ev_ord, e.source_id, d.keeper,
         EXISTS (SELECT 1 FROM evidence x WHERE x.claim = d.keeper AND x.source_id = e.source_id) AS on_keeper,
         row_number() OVER (PARTITION BY d.keeper, e.source_id ORDER BY e.claim, e.ev_ord) AS nth
       FROM evidence e JOIN dups d ON e.claim = d.dup)
"""
EDGES = """
, adj AS (SELECT subject AS src, object AS dst FROM claim UNION SELECT object, subject FROM claim)
"""

ORACLES: dict[str, str] = {
    "what_affects": _answers(f"object = '{OBJECT}'"),
    "what_affects_protective": _answers(f"object = '{OBJECT}' AND type IN ('reduces_risk_of', 'improves', 'treats', 'prevents')"),
    "high_certainty_about": _answers(f"(subject = '{NODE}' OR object = '{NODE}') AND certainty = 'high'"),
    "gaps": _answers("status IN ('unverified', 'needs_refinement', 'skeleton')"),
    "for_population": _answers(f"population = '{REGION}'"),
    "neighbourhood": _answers(TOUCH.format(NATION)),
    "comparative": _answers("comparator IS NOT NULL"),
    "list_claims": _answers("type = 'treats' AND status = 'curated' AND certainty = 'high'"),
    "list_nodes": PRELUDE + " SELECT ord, id, name, domain FROM node WHERE type = 'outcome' AND (contains(lower(id), 're') OR contains(lower(name), 're'))",
    "get_node": PRELUDE + f" SELECT ord, id, type, name FROM node WHERE id = '{OBJECT}'",
    "resolve_topic": PRELUDE + " SELECT ord, id, name FROM node WHERE contains(lower(name), 'supplier#00000001') OR contains(lower(id), 'supplier#00000001') ORDER BY ord LIMIT 1",
    "conflicts": PRELUDE + """ SELECT r.ord, a.id AS a_claim, a.score::INT AS a_score, a.a_subject, b.id AS b_claim, b.score::INT AS b_score, b.a_object AS b_object
      FROM relation r JOIN answer a ON r.subject_claim = a.id JOIN answer b ON r.object_claim = b.id""",
    "weak_evidence": _answers(f"{TOUCH.format(SUPPLIER)} AND {WEAK}"),
    "evidence_landscape": PRELUDE + f""", direct AS (SELECT * FROM answer WHERE {TOUCH.format(SUPPLIER)}),
      ends AS (SELECT ord, 0 AS slot, mechanism AS m FROM direct UNION ALL SELECT ord, 1, subject FROM direct WHERE subject <> '{SUPPLIER}'
               UNION ALL SELECT ord, 2, object FROM direct WHERE object <> '{SUPPLIER}'),
      mech AS (SELECT m, min(ends.ord * 10 + slot) AS first FROM ends JOIN node ON m = node.id AND node.type = 'mechanism' GROUP BY m),
      ind AS (SELECT a.id, arg_min(m.m, m.first) AS via FROM answer a JOIN mech m ON m.m IN (a.subject, a.object, a.mechanism)
              WHERE NOT {TOUCH.format(SUPPLIER)} GROUP BY a.id)
      SELECT 'direct' AS kind, NULL AS via, id AS claim, score::INT AS score, NULL AS other FROM direct
      UNION ALL SELECT 'weak', NULL, id, score::INT, NULL FROM direct WHERE {WEAK}
      UNION ALL SELECT 'indirect', ind.via, ind.id, a.score::INT, NULL FROM ind JOIN answer a ON ind.id = a.id
      UNION ALL SELECT 'conflicting', NULL, a.id, a.score::INT, b.id FROM relation r JOIN answer a ON r.subject_claim = a.id
        JOIN answer b ON r.object_claim = b.id WHERE a.id IN (SELECT id FROM direct) OR b.id IN (SELECT id FROM direct)""",
    "recommendations": PRELUDE + f""" SELECT a.ord, a.id AS claim, a.subject AS issuer_id, a_subject AS issuer_name, coalesce(n.type, '') AS issuer_type,
      a.object AS intervention_id, a_object AS intervention_name, a_population AS population, status, sources
      FROM answer a LEFT JOIN node n ON a.subject = n.id WHERE a.type = 'recommends' AND population = '{REGION}'
      AND (contains(lower(subject), 'supplier#00000000') OR contains(lower(a_subject), 'supplier#00000000'))""",
    "distances": PRELUDE + EDGES + f""", walk(id, hops) AS (SELECT '{SUPPLIER}', 0 UNION SELECT adj.dst, hops + 1 FROM walk JOIN adj ON walk.id = adj.src WHERE hops < 3)
      SELECT id, min(hops)::INT AS hops FROM walk GROUP BY id""",
    "node_detail": PRELUDE + f""" SELECT ord, a.id AS claim, side, other_id, coalesce(n.name, other_id) AS other_name, a.type AS relationship, a_population AS population,
      status, score::INT AS score, (SELECT count(*) FROM evidence e WHERE e.claim = a.id) AS n_evidence
      FROM (SELECT *, 'outgoing' AS side, object AS other_id FROM answer WHERE subject = '{NODE}'
            UNION ALL SELECT *, 'incoming', subject FROM answer WHERE object = '{NODE}') a LEFT JOIN (SELECT id, name FROM node) n ON other_id = n.id""",
    "node_neighbours": PRELUDE + f""", o AS (SELECT ord, object AS id FROM claim WHERE subject = '{NODE}' UNION ALL SELECT ord, subject FROM claim WHERE object = '{NODE}')
      SELECT min(o.ord) AS ord, n.id, n.name, n.type FROM o JOIN node n ON o.id = n.id GROUP BY n.id, n.name, n.type""",
    "context_edges": PRELUDE + """ SELECT source, target, arg_min(kind, rk) AS kind FROM (
        SELECT population AS source, subject AS target, 'population' AS kind, ord * 10 AS rk FROM claim
        UNION ALL SELECT population, object, 'population', ord * 10 + 1 FROM claim
        UNION ALL SELECT mechanism, subject, 'mechanism', ord * 10 + 2 FROM claim
        UNION ALL SELECT mechanism, object, 'mechanism', ord * 10 + 3 FROM claim)
      WHERE source IN (SELECT id FROM node) AND target IN (SELECT id FROM node) GROUP BY source, target""",
    "graph_edges": PRELUDE + " SELECT ord, id, subject AS source, object AS target, type, conflicted AS conflict, score::INT AS score FROM scored",
    "entity_counts": PRELUDE + """ SELECT 'nodes' AS entity, count(*) AS n FROM node UNION ALL SELECT 'claims', count(*) FROM claim
      UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'contradictions', count(*) FROM relation""",
    "effects_on": PRELUDE + f""" SELECT coalesce(n.name, c.subject) AS name, c.type, direction, certainty, string_agg(e.source_id, '; ' ORDER BY e.source_id) AS sources,
      CASE certainty WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 WHEN 'low' THEN 2 WHEN 'very_low' THEN 3 END AS certainty_rank
      FROM claim c LEFT JOIN node n ON c.subject = n.id LEFT JOIN evidence e ON c.id = e.claim WHERE c.object = '{OBJECT}' GROUP BY 1, 2, 3, 4, 6""",
    "validate": PRELUDE + """ SELECT 'V2' AS rule, 'warning' AS severity, 'node' AS entity, count(*) AS n FROM node WHERE domain NOT IN ('', 'gerontology', 'nutrition', 'exercise', 'sleep', 'frailty', 'falls', 'dementia') HAVING count(*) > 0
      UNION ALL SELECT 'V9', 'error', 'claim', count(*) FROM claim WHERE status = 'curated' AND type <> 'is_a' AND id NOT IN (SELECT claim FROM evidence) HAVING count(*) > 0""",
    "duplicate_groups": PRELUDE + " SELECT subject, object, type, direction, count(*) AS n FROM claim GROUP BY ALL HAVING count(*) > 1",
    "dedup_dry_run": PRELUDE + KEEPER + """ SELECT count(DISTINCT keeper) AS duplicate_groups, count(*) AS claims_deleted,
      (SELECT count(*) FROM mv WHERE NOT on_keeper) AS evidence_moved, (SELECT count(*) FROM mv WHERE on_keeper) AS evidence_dropped FROM dups""",
    "dedup_applied": PRELUDE + KEEPER + """ SELECT count(DISTINCT keeper) AS duplicate_groups, count(*) AS claims_deleted,
      (SELECT count(*) FROM mv WHERE NOT on_keeper AND nth = 1) AS evidence_moved, (SELECT count(*) FROM mv WHERE on_keeper OR nth > 1) AS evidence_dropped FROM dups""",
    "dedup_claims_left": PRELUDE + KEEPER + " SELECT id FROM claim WHERE id NOT IN (SELECT dup FROM dups)",
    "unmapped_by_type": PRELUDE + " SELECT type, count(*) AS n FROM node WHERE type IN ('outcome', 'intervention', 'mechanism') AND code = '' GROUP BY type",
    "unmapped_nodes": PRELUDE + """ SELECT id, type, name FROM node WHERE type IN ('outcome', 'intervention', 'mechanism') AND code = ''
      ORDER BY CASE type WHEN 'outcome' THEN 2 WHEN 'intervention' THEN 4 ELSE 8 END, name, id LIMIT 300""",
    "resolve_codes": PRELUDE + """, t AS (SELECT p_name, 'MESH:D' || min(p_partkey) AS curie FROM part GROUP BY p_name)
      SELECT id, CASE WHEN code <> '' THEN code ELSE curie END AS codes FROM node JOIN t ON node.name = t.p_name WHERE type = 'outcome'""",
    "review_queue": PRELUDE + """ SELECT a.id, a_subject AS subj, a_object AS obj, a_population AS pop, a.type, score::INT AS score, (SELECT count(*) FROM evidence e WHERE e.claim = a.id) AS n_evidence
      FROM answer a WHERE status = 'unverified' AND (a_subject ILIKE '%r_a%' OR a_object ILIKE '%r_a%' OR type ILIKE '%r_a%') ORDER BY updated_at DESC, id LIMIT 40 OFFSET 20""",
    "queue_count": PRELUDE + " SELECT count(*) AS n FROM answer WHERE status = 'unverified' AND (a_subject ILIKE '%r_a%' OR a_object ILIKE '%r_a%' OR type ILIKE '%r_a%')",
    "claims_by_status": PRELUDE + " SELECT status, count(*) AS n FROM claim GROUP BY status",
    "reviewable": PRELUDE + " SELECT id FROM claim WHERE status = 'unverified' AND id IN (SELECT claim FROM evidence)",
    "recent_activity": f""" SELECT agent, coalesce(outcome, '?') AS outcome, n FROM (SELECT event_type AS agent, CASE WHEN value >= 5 THEN event_type END AS outcome, count(*) AS n
      FROM events WHERE ts > {NOW} - INTERVAL 7 DAYS GROUP BY 1, 2)""",
    "latest_run": """ SELECT user_id::VARCHAR AS claim_id, event_id AS id, event_type AS agent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "ask_gaps": """ SELECT event_id AS id FROM events WHERE event_type <> 'error' AND (event_id % 7 = 0 OR floor(value)::BIGINT % 4 = 0) AND event_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "ask_panel": """ SELECT count(*) FILTER (event_type <> 'error' AND (event_id % 7 = 0 OR floor(value)::BIGINT % 4 = 0)) AS gaps, count(*) FILTER (event_type = 'error') AS errors,
      sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 ELSE 0 END + 10)::BIGINT AS tokens FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)""",
    "search": "WITH " + TOKENS.format(key="doc_id", text="text", table=f"(SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{QUERY_TEXT}')")
    + """ , n2 AS (SELECT doc_id, sum(n * n)::BIGINT AS s FROM bk GROUP BY doc_id),
      s AS (SELECT b.doc_id, sum(b.n * q.n)::BIGINT AS dot FROM bk b JOIN bk q ON b.bucket = q.bucket AND q.doc_id = -1 GROUP BY b.doc_id)
      SELECT d.doc_id, coalesce(floor(s.dot::DOUBLE / sqrt((x.s * y.s)::DOUBLE) * 10000 + 0.5) / 10000, 0.0) AS score
      FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN n2 x ON d.doc_id = x.doc_id LEFT JOIN n2 y ON y.doc_id = -1""",
    "term_vectors": PRELUDE + ", " + TOKENS.format(key="id", text="name", table="node") + " SELECT id, bucket, round(n / norm, 6) AS weight FROM bk JOIN nm USING (id)",
    "nearest": """ WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
      s AS (SELECT q.vec_id AS q_id, v.vec_id, round(list_cosine_similarity(v.v, q.v), 6) AS cos FROM v JOIN v q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
      SELECT q_id, vec_id, cos, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, vec_id) AS rk FROM s) WHERE rk <= 5""",
    "page_text": r""" WITH a AS (SELECT page_id, regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis') AS h FROM pages),
      b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'gis') AS h FROM a),
      c AS (SELECT page_id, regexp_replace(h, '<head\b[^>]*>.*?</head\s*>', ' ', 'gis') AS h FROM b),
      d AS (SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM c)
      SELECT page_id, length(body) AS n, md5(body) AS body_md5 FROM d""",
    "match_nodes": """ SELECT 'pt:' || a.p_partkey AS cand_id, 'pt:' || min(b.p_partkey) AS node_id, 1.0::DOUBLE AS score, true AS exact
      FROM part a JOIN part b ON a.p_name = b.p_name GROUP BY a.p_partkey""",
    "cited_ids": """ SELECT conv_id, turn, CASE WHEN conv_id = turn THEN 'PMID:' || conv_id || ';pmid:' || turn ELSE 'PMID:' || conv_id || ';pmid:' || turn END AS cited FROM conversations""",
    "claim_ids": PRELUDE + """, k AS (SELECT id, subject || '|' || type || '|' || object || '|' || coalesce(population, '') AS key FROM claim),
      h AS (SELECT id, """ + FNV.format("key") + """ AS h FROM k)
      SELECT id, 'gc:' || ltrim(string_agg(substr('0123456789abcdefghijklmnopqrstuvwxyz', h // (36 ** p)::BIGINT % 36 + 1, 1), '' ORDER BY p DESC), '0') AS edge_id
      FROM h, (SELECT unnest(range(0, 7)) AS p) GROUP BY id, h""",
}

QUERIES |= contract_more.QUERIES | contract_state.QUERIES
ORACLES |= contract_more.ORACLES | contract_state.ORACLES | {"path": contract_more.PATH_SQL, "rate_limit": contract_more.RATE}
