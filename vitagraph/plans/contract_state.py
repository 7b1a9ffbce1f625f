"""Queries over what is kept between steps: vector cells, leaders of names, hits of a window, deltas of
an index, and runs of several stages.  Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ask, leaders, prompts, propose, review, search, vector_index
from ..operators.answers import contradictions, named
from ..operators.live import Store
from ..runtime import scoped, scratch
from ..sources import pages, seed_source
from ..streaming import limits
from . import mapping as M
from .contract_more import ASKED, CORPUS, RATE
from .prelude import PRELUDE, TOKENS

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL; what it writes on the way is deleted."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = scoped(f.__name__.replace("_", "-"))(f), sql
        return f

    return add


# --- vectors in cells ----------------------------------------------------------


@query(""" WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  s AS (SELECT q.vec_id AS q_id, v.vec_id, round(list_cosine_similarity(v.v, q.v), 6) AS cos FROM v JOIN v q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
  SELECT q_id, vec_id, cos, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, vec_id) AS rk FROM s) WHERE rk <= 10""")
def nearest_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 50, among all, from the inverted file in its exact mode."""
    rows = M.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = vector_index.build(rows, scratch(spark, "cells"))
    found = vector_index.search(index, rows.where("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q")), 10, exact=True)
    return found.select(F.col("q_id").cast("long").alias("q_id"), F.col("id").cast("long").alias("vec_id"), "cos", "rk")


# --- candidates in order ---------------------------------------------------------


@query(""" WITH c AS (SELECT p_partkey AS k, p_name, 'The ' || p_name || ' (trial)' AS name, CASE WHEN p_partkey % 3 = 0 THEN 'outcome' ELSE 'drug' END AS type FROM part),
  old AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1),
  led AS (SELECT p_name, max(k) AS k FROM c WHERE type = 'drug' GROUP BY 1)
  SELECT c.k AS cand_id, CASE WHEN type = 'outcome' THEN 'pt:' || old.k ELSE 'ga:' || substr(regexp_replace(regexp_replace(lower((SELECT x.name FROM c x WHERE x.k = led.k)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) END AS node_id,
    CASE WHEN type = 'drug' AND c.k = led.k THEN 'new' ELSE 'match' END AS how
  FROM c JOIN old USING (p_name) LEFT JOIN led USING (p_name)""")
def names_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts, the last part first: of each name one type is there as a node, the other is led by the first candidate."""
    key = F.col("p_partkey")
    type_ = F.when(key % 3 == 0, "outcome").otherwise("drug")
    name = F.concat(F.lit("The "), "p_name", F.lit(" (trial)"))
    cands = M.read(spark, d, "part").select(key.alias("cand_id"), (-key).alias("pos"), F.lit(None).cast("string").alias("id"), name.alias("name"), type_.alias("type"))
    return leaders.resolve_in_order(cands, M.graph(spark, d)).found


PROPOSED = """ WITH p AS (SELECT o_orderkey AS k, 'agent ' || o_custkey % 40 AS s, 'effect ' || o_orderkey % 30 AS o,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'increase' WHEN '2' THEN 'decrease' WHEN '3' THEN 'no_effect' END AS dir, 'PMID:' || o_custkey % 500 AS src FROM orders),
  f AS (SELECT *, min(k) OVER (PARTITION BY s, o, dir) AS made, min(k) OVER (PARTITION BY s, o, dir, src) = k AS added FROM p)"""


def _proposed(spark: SparkSession, d: str) -> tuple:
    """Each order proposes an edge between 40 agents and 30 effects, with a population for each direction, and cites one of 500 papers."""
    first = F.substring("o_orderpriority", 1, 1)
    direction = F.when(first == "1", "increase").when(first == "2", "decrease").when(first == "3", "no_effect")
    text_ = lambda s: F.lit(s)
    orders = M.read(spark, d, "orders").withColumn("direction", direction)
    rows = orders.select(
        F.col("o_orderkey").alias("cand_id"), F.concat(F.lit("agent "), F.col("o_custkey") % 40).alias("subject_name"), text_("drug").alias("subject_type"),
        F.concat(F.lit("effect "), F.col("o_orderkey") % 30).alias("object_name"), text_("outcome").alias("object_type"), text_("improves").alias("relationship"), "direction",
        F.concat(F.lit("people of "), "direction").alias("population"), text_("low").alias("certainty"), text_("A long enough title").alias("citation_title"),
        F.lit(None).cast("string").alias("quote"), F.when(F.col("o_orderkey") % 2 == 0, "rct").otherwise("no such design").alias("study_design"),
    )
    resolved = orders.select(F.col("o_orderkey").alias("cand_id"), (F.col("o_custkey") % 500).cast("string").alias("source_id"))
    return propose.persist(M.graph(spark, d), rows, resolved)


@query(PROPOSED + """ SELECT k AS cand_id, CASE WHEN k = made THEN 'created' ELSE 'merged' END AS outcome, added FROM f""")
def proposals_taken_in(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d)[1].select("cand_id", "outcome", "added")


@query(PROPOSED + """ SELECT s AS subject, o AS object, dir AS direction, 'people of ' || dir AS population, src AS source_id, k % 2 = 0 AS has_design, 'agent:curator:model' AS extracted_by,
    row_number() OVER (PARTITION BY s, o, dir ORDER BY k) AS ev_ord, (SELECT count(*) FROM (SELECT DISTINCT s FROM p)) + (SELECT count(*) FROM (SELECT DISTINCT o FROM p)) + (SELECT count(DISTINCT dir) FROM p) AS new_nodes
  FROM f WHERE added""")
def graph_after_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The evidence that proposals brought, with the names of their claims' nodes, and how many nodes are new."""
    g, new = M.graph(spark, d), _proposed(spark, d)[0]
    claims = new.claim.where("status = 'unverified' and type = 'improves' and id like 'gc:%'").select("id", "subject", "object", "direction", "population")
    for c in ("subject", "object", "population"):
        claims = named(claims, new.node, c, f"_{c}")
    n = new.node.count() - g.node.count()
    rows = new.evidence.join(claims, F.col("claim") == claims["id"])
    return rows.select(F.col("_subject").alias("subject"), F.col("_object").alias("object"), "direction", F.when(F.col("population").isNotNull(), F.col("_population")).alias("population"), "source_id", F.col("study_design").isNotNull().alias("has_design"), "extracted_by", "ev_ord", F.lit(n).cast("long").alias("new_nodes"))


# --- hits of a window ------------------------------------------------------------


@query(RATE)
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed late and out of order in micro-batches; the verdicts are those of the batch."""
    events = M.read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    stream = limits.replayed(events, scratch(spark, "replay"), jitter_ms=3_600_000)
    return limits.all_verdicts(limits.limited_stream(stream, 6, 86_400_000, "2 hours"), scratch(spark, "verdicts"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id, user_id) AS i FROM events),
  p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY i), 0) AS before FROM e),
  m AS (SELECT count(DISTINCT user_id) * 4 // 5 AS most FROM events),
  s(epoch, start) AS (SELECT 0, 1::BIGINT UNION ALL
    SELECT epoch, i + 1 FROM (SELECT s.epoch + 1 AS epoch, p.i, row_number() OVER (ORDER BY p.i) AS rn FROM s JOIN p ON p.i >= s.start AND p.before < s.start), m WHERE rn = most + 1)
  SELECT user_id AS key, event_id AS seq, p.at_ms, (SELECT max(epoch) FROM s WHERE start <= p.i)::BIGINT AS epoch FROM p""")
def key_epochs(spark: SparkSession, d: str) -> DataFrame:
    """How often a limiter that remembers four fifths of all users has forgotten them before an event."""
    events = M.read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return limits.epochs(events, events.select("key").distinct().count() * 4 // 5)


# --- an index kept current by writes ----------------------------------------------


AFTER_WRITES = """, node2 AS (SELECT ord, id, type, CASE WHEN id LIKE 'su:%' AND split_part(id, ':', 2)::BIGINT % 3 = 0 THEN 'renamed ' || name ELSE name END AS name, domain FROM node
    UNION ALL SELECT (SELECT max(ord) FROM node) + 1 + row_number() OVER (ORDER BY n_nationkey) - 1, 'new:' || n_nationkey, 'exercise', 'supplier in ' || n_name, '' FROM nation),
  answer2 AS (SELECT s.*, s.ord AS a_ord, s.id AS a_claim, coalesce(x.name, s.subject) AS a_subject, coalesce(y.name, s.object) AS a_object, coalesce(z.name, s.population) AS a_population
    FROM scored s LEFT JOIN node2 x ON s.subject = x.id LEFT JOIN node2 y ON s.object = y.id LEFT JOIN node2 z ON s.population = z.id WHERE split_part(s.subject, ':', 2)::BIGINT % 5 <> 0)"""


@query(PRELUDE + AFTER_WRITES + CORPUS.format(ASKED, "'node', 'claim'", 60).replace("FROM node", "FROM node2").replace("FROM answer", "FROM answer2"))
def search_after_writes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes made and renamed, claims deleted; the search reads the old index with what the writes added to it."""
    g = M.graph(spark, d)
    store = Store(g, scratch(spark, "live"), terms=M.term_index(spark, d))
    nation = M.read(spark, d, "nation")
    store.create_nodes(nation.select(F.col("n_nationkey").alias("row"), F.concat(F.lit("new:"), "n_nationkey").alias("id"), F.lit("exercise").alias("type"), F.concat(F.lit("supplier in "), "n_name").alias("name"), F.array().cast("array<string>").alias("external_ids")))
    key = F.substring_index("id", ":", -1).cast("long")
    store.update_nodes(g.node.where(F.col("id").startswith("su:") & (key % 3 == 0)).select(key.alias("row"), "id", "type", F.concat(F.lit("renamed "), "name").alias("name")))
    store.delete_claims(g.claim.where(F.substring_index("subject", ":", -1).cast("long") % 5 == 0).select("id"))
    rows = search.search(store.graph, ASKED, 60, index=store.terms)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "side", "ord"))  # k rows
    return rows.select("owner_type", "owner_id", "name", "score", place.alias("place"))


# --- articles of pages -------------------------------------------------------------


@query(r""" WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages),
  e AS (SELECT page_id, trim(regexp_replace(replace(replace(t, '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
  SELECT page_id, CASE WHEN length(t) >= 200 THEN length(t) END AS n, CASE WHEN length(t) >= 200 THEN md5(t) END AS text_md5 FROM e""")
def page_articles(spark: SparkSession, d: str) -> DataFrame:
    """The articles of pages, found by the density of their text; these pages mark them, which the SQL goes by."""
    text = pages.article_text(F.col("html"))
    rows = M.read(spark, d, "pages").select("page_id", text.alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


# --- seeds ---------------------------------------------------------------------------


@query(PRELUDE + """ SELECT 'node' AS entity, id AS key, name AS value, 1 AS n FROM node WHERE type IN ('population', 'mechanism')
  UNION ALL SELECT 'contradiction', 'rel:' || ord, subject_claim || ' ' || object_claim, 1 FROM relation
  UNION ALL SELECT 'claim', type, status, count(*) FROM claim GROUP BY type, status
  UNION ALL SELECT 'evidence', study_design, NULL, count(*) FROM evidence GROUP BY study_design""")
def graph_from_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as seed files and read by the data source, some of it by filters that the reader takes."""
    path = scratch(spark, "seeds")
    seed_source.write_seeds(M.graph(spark, d), path, 8)
    table = lambda name: seed_source.seed_table(spark, path, name)
    one, g = F.lit(1).cast("long").alias("n"), seed_source.load_seeds(spark, path)
    out = table("nodes").where(F.col("type").isin("population", "mechanism")).select(F.lit("node").alias("entity"), F.col("id").alias("key"), F.col("name").alias("value"), one)
    against = table("contradictions").where("type = 'contradicts'")
    out = out.unionByName(against.select(F.lit("contradiction").alias("entity"), F.col("id").alias("key"), F.concat_ws(" ", "subject_claim", "object_claim").alias("value"), one))
    out = out.unionByName(g.claim.groupBy(F.col("type").alias("key"), F.col("status").alias("value")).agg(F.count("*").alias("n")).withColumn("entity", F.lit("claim")))
    return out.unionByName(g.evidence.groupBy(F.col("study_design").alias("key")).agg(F.count("*").alias("n")).selectExpr("'evidence' AS entity", "key", "CAST(NULL AS STRING) AS value", "n"))


# --- the review desk -----------------------------------------------------------------


@query(PRELUDE + """, runs AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
  t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status FROM orders)
  SELECT 'claims' AS section, status AS key, NULL AS outcome, count(*) AS n FROM claim GROUP BY status UNION ALL SELECT 'claims', NULL, NULL, count(*) FROM claim
  UNION ALL SELECT 'nodes', NULL, NULL, count(*) FROM node
  UNION ALL SELECT 'topics', status, NULL, count(*) FROM t GROUP BY status UNION ALL SELECT 'topics', NULL, NULL, count(*) FROM t
  UNION ALL SELECT 'recent', NULL, NULL, count(*) FROM runs HAVING count(*) > 0
  UNION ALL SELECT 'recent', event_type, CASE WHEN value >= 5 THEN event_type ELSE '?' END, count(*) FROM runs GROUP BY ALL""")
def review_desk(spark: SparkSession, d: str) -> DataFrame:
    topics = M.read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"))
    runs = M.agent_runs(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    last = runs.agg(F.max("created_at").alias("t")).first()["t"]
    return review.review_stats(M.graph(spark, d), topics, runs, F.lit(last))


@query(PRELUDE + """, u AS (SELECT id, ord, EXISTS (SELECT 1 FROM evidence e WHERE e.claim = c.id) AS cited FROM claim c WHERE status = 'unverified'),
  o AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'curated' WHEN 1 THEN 'flagged' ELSE 'deferred' END AS outcome FROM u WHERE cited AND ord % 2 = 0)
  SELECT count(*) AS reviewed, count(*) FILTER (outcome = 'curated') AS curated, count(*) FILTER (outcome = 'flagged') AS flagged, count(*) FILTER (outcome = 'deferred') AS deferred,
    (SELECT count(*) FROM u WHERE cited AND NOT (ord % 2 = 0 AND ord % 3 <> 2)) AS remaining FROM o""")
def review_round(spark: SparkSession, d: str) -> DataFrame:
    """Every other reviewable claim is reviewed; deferred ones stay unverified."""
    g = M.graph(spark, d)
    third = F.col("ord") % 3
    outcomes = review.reviewable(g).where("ord % 2 = 0").select("id", F.when(third == 0, "curated").when(third == 1, "flagged").otherwise("deferred").alias("outcome"))
    new = outcomes.where("outcome <> 'deferred'").select(F.col("id").alias("_r"), F.when(F.col("outcome") == "curated", "curated").otherwise("needs_refinement").alias("_s"))
    claim = g.claim.join(new, F.col("id") == F.col("_r"), "left").withColumn("status", F.coalesce("_s", "status")).drop("_r", "_s")
    return review.review_round(g.with_(claim=claim), outcomes)[1]


DECIDED = """, d AS (SELECT o_orderkey AS k, 'cl:' || o_orderkey || '-1' AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'reject' ELSE 'approve' END AS action, CASE WHEN o_orderkey % 4 = 0 THEN 'high' END AS certainty FROM orders WHERE o_orderstatus = 'O'),
  f AS (SELECT d.*, c.id IS NOT NULL AS found, c.certainty AS old FROM d LEFT JOIN claim c ON c.id = d.id)"""


def _decided(spark: SparkSession, d: str) -> tuple:
    """The first claim of each open order is decided on: every third is rejected."""
    key = F.col("o_orderkey")
    rows = M.read(spark, d, "orders").where("o_orderstatus = 'O'").select(
        key.alias("row"), F.concat(F.lit("cl:"), key, F.lit("-1")).alias("id"), F.when(key % 3 == 0, "reject").otherwise("approve").alias("action"),
        F.when(key % 4 == 0, "high").otherwise("no certainty").alias("certainty"), F.lit("seen").alias("note"), F.timestamp_seconds(key).alias("at"),
    )
    return review.decide_claims(M.graph(spark, d), M.agent_runs(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp")), rows)


@query(PRELUDE + DECIDED + """ SELECT status, certainty, count(*) AS n FROM (
    SELECT CASE WHEN f.id IS NOT NULL THEN 'curated' ELSE c.status END AS status, coalesce(f.certainty, c.certainty) AS certainty FROM claim c LEFT JOIN f ON f.id = c.id WHERE f.id IS NULL OR f.action = 'approve') GROUP BY ALL""")
def claims_after_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[0].claim.groupBy("status", "certainty").agg(F.count("*").alias("n"))


@query(PRELUDE + DECIDED + """ SELECT id AS claim_id, CASE action WHEN 'reject' THEN 'rejected' ELSE 'curated' END AS outcome, '{"action":"' || action || '","note":"seen"' || coalesce(',"certainty":"' || certainty || '"', '') || '}' AS summary,
    (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY k) AS id FROM f WHERE found""")
def human_runs(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[1].where("agent = 'human'").select("claim_id", "outcome", "summary", "id")


@query(PRELUDE + """ SELECT a.id AS claim_a, a.direction AS dir_a, a.population AS pop_a, b.id AS claim_b, b.direction AS dir_b FROM relation r JOIN claim a ON a.id = r.subject_claim JOIN claim b ON b.id = r.object_claim""")
def contradictions_scoped(spark: SparkSession, d: str) -> DataFrame:
    return contradictions(M.graph(spark, d)).drop("dose")


# --- prompts within a budget -----------------------------------------------------------


@query(PRELUDE + """, l AS (SELECT type, name, id, id || ' (' || type || '): ' || name AS line FROM node),
  s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY type ORDER BY name, id) AS upto FROM l)
  SELECT type AS key, id, line, upto::BIGINT AS upto FROM s WHERE upto <= 6000""")
def node_lists(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that a prompt about a type can list in 6,000 characters, by name."""
    return prompts.node_lines(M.graph(spark, d), 6_000)


@query(PRELUDE + """, pool AS (SELECT *, a_claim || ' | ' || a_subject || ' — ' || replace(type, '_', ' ') || coalesce(' (' || direction || ')', '') || ' → ' || a_object || coalesce(' · in ' || a_population, '') || coalesce(' · ' || certainty, '') AS line FROM answer WHERE status = 'curated'),
  s AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY a_ord, a_claim) AS upto FROM pool)
  SELECT md5(string_agg(line, chr(10) ORDER BY a_ord, a_claim)) AS catalogue_md5, count(*) AS n FROM s WHERE upto <= 20000""")
def claim_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of curated claims that fits into 20,000 characters of a prompt."""
    return prompts.catalogue(M.graph(spark, d), 20_000).select(F.md5("catalogue").alias("catalogue_md5"), "n")


# --- runs of several stages ------------------------------------------------------------


ANSWERS = """, q AS (SELECT r_regionkey AS key, 'what improves a red widget for people in ' || lower(r_name) || ' with order' AS question FROM region),
  corp AS (SELECT a_claim AS id, a_ord AS ord, status, concat_ws(' ', a_subject, replace(type, '_', ' '), a_object, 'in ' || a_population, direction, comparator) AS txt FROM answer),
  texts AS (SELECT 'c' || id AS k, txt FROM corp UNION ALL SELECT 'q' || key, question FROM q), """ + TOKENS.format(key="k", text="txt", table="texts") + """,
  n2 AS (SELECT k, sum(n * n)::BIGINT AS s FROM bk GROUP BY k),
  dots AS (SELECT y.k AS q, x.k, sum(x.n * y.n)::BIGINT AS dot FROM bk x JOIN bk y ON x.bucket = y.bucket AND y.k LIKE 'q%' AND x.k LIKE 'c%' GROUP BY 1, 2),
  sc AS (SELECT q, dots.k, floor(dot::DOUBLE / sqrt((a.s * b.s)::DOUBLE) * 10000 + 0.5) / 10000 AS score FROM dots JOIN n2 a ON a.k = dots.k JOIN n2 b ON b.k = dots.q),
  near AS (SELECT q.key, corp.id, corp.status, row_number() OVER (PARTITION BY q.key ORDER BY coalesce(score, 0.0) DESC, ord) AS place FROM q CROSS JOIN corp LEFT JOIN sc ON sc.q = 'q' || q.key AND sc.k = 'c' || corp.id),
  picked AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY place)::INT AS rank FROM near WHERE place <= 600 AND status = 'curated'),
  c AS (SELECT * FROM picked WHERE rank <= 3 AND key <> 2),
  src AS (SELECT c.key, c.rank, c.id, e.source_id, row_number() OVER (PARTITION BY c.key ORDER BY c.rank, e.ev_ord) AS i FROM c JOIN evidence e ON e.claim = c.id),
  said AS (SELECT key, list_distinct(list(source_id)) AS ids, string_agg(source_id, ';' ORDER BY m) AS cites FROM (SELECT key, source_id, min(i) AS m FROM src WHERE i <= 2 GROUP BY ALL) GROUP BY key)
  SELECT q.key, CASE WHEN q.key = 2 THEN 'failed' WHEN EXISTS (SELECT 1 FROM c WHERE c.key = q.key) THEN 'answered' ELSE 'no_evidence' END AS status,
    (SELECT string_agg(c.id, ';' ORDER BY c.rank) FROM c WHERE c.key = q.key) AS claims, said.cites AS citations,
    (SELECT count(*) FROM c WHERE c.key = q.key AND EXISTS (SELECT 1 FROM evidence e WHERE e.claim = c.id AND list_contains(said.ids, e.source_id))) AS n_cited
  FROM q LEFT JOIN said ON said.key = q.key"""


def _reader(prompts_: DataFrame) -> DataFrame:
    """A recorded model: picks the first three claims listed, cites the first two sources it is given; one question gets no reply."""
    picked = F.slice(F.regexp_extract_all("prompt", F.lit(r"(?m)^(\S+) \| "), F.lit(1)), 1, 3)
    sources = F.slice(F.regexp_extract_all("prompt", F.lit(r"(?m)^    - (PMID:\d+)"), F.lit(1)), 1, 2)
    said = F.concat(F.lit("This is known "), F.array_join(F.transform(sources, lambda s: F.concat(F.lit("["), s, F.lit("]"))), " and "), F.lit("."))
    reply = F.when(F.col("prompt").contains("Claims:"), F.to_json(picked)).otherwise(said)
    return prompts_.where("key <> 2").select("key", reply.alias("reply"), F.lit(10).alias("input_tokens"), F.lit(1).alias("output_tokens"))


@query(PRELUDE + ANSWERS)
def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for each region, answered from the claims nearest to it."""
    name = F.concat(F.lit("what improves a red widget for people in "), F.lower("r_name"), F.lit(" with order"))
    questions = M.read(spark, d, "region").select(F.col("r_regionkey").alias("key"), name.alias("question"))
    made = ask.answer_questions(M.graph(spark, d), questions, _reader, scratch(spark, "answers"), 8, M.term_index(spark, d))
    ids = F.when(F.size("claims") > 0, F.array_join(F.transform("claims", lambda c: c["id"]), ";"))
    cites = F.when(F.size("citations") > 0, F.array_join("citations", ";"))
    return made.select("key", "status", ids.alias("claims"), cites.alias("citations"), F.size(F.filter("claims", lambda c: c["cited"])).cast("long").alias("n_cited"))
