"""Graph queries that answer with claims: filters first, then names, sources and quality.

Each query narrows the claims before anything is joined to them, so evidence is aggregated
for the claims of the answer only.  Rows carry ``ord``, the claim's place, which is the
promised order; sorting is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import quality
from ..graph import Graph
from ..runtime import materialize, scoped

ANSWER = (
    "ord", "claim", "subject", "relationship", "object", "population", "direction", "certainty", "comparator", "sources",
    "score", "tier", "best_design", "n_sources", "sample_size", "conflicted", "reasons",
)


def conflicted_claims(relation: DataFrame) -> DataFrame:
    """Ids of claims on either side of a contradiction; other relations between claims don't count."""
    side = lambda c: relation.where("type = 'contradicts'").select(F.col(c).alias("conflict_id"))
    return side("subject_claim").union(side("object_claim")).where("conflict_id is not null").distinct()


def named(df: DataFrame, node: DataFrame, id_column: str, out: str) -> DataFrame:
    """Adds the node's name, or the id where the node is unknown."""
    names = node.select(F.col("id").alias("_n_id"), F.col("name").alias("_n_name"))
    joined = df.join(names, F.col(id_column) == F.col("_n_id"), "left")
    return joined.withColumn(out, F.coalesce("_n_name", id_column)).drop("_n_id", "_n_name")


def with_quality(g: Graph, claims: DataFrame) -> DataFrame:
    """Adds sources and quality to rows whose ``id`` is a claim's."""
    keys = claims.select(F.col("id").alias("_k")).distinct()
    listed = g.listed.join(keys, F.col("claim") == F.col("_k"), "left_semi")
    per_claim = quality.evidence_per_claim(listed, g.evidence).withColumnRenamed("claim", "_ev_claim")
    out = claims.join(per_claim, F.col("id") == F.col("_ev_claim"), "left").drop("_ev_claim")
    out = out.join(conflicted_claims(g.relation), F.col("id") == F.col("conflict_id"), "left")
    out = out.withColumn("conflicted", F.col("conflict_id").isNotNull()).drop("conflict_id")
    return quality.scored(out.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))))


def answer_rows(g: Graph, claims: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Answer rows of some claims; ``keep`` names further columns of ``claims`` to carry along."""
    slim = claims.select("ord", "id", "type", "subject", "object", "population", "direction", "certainty", "comparator", *keep)
    out = with_quality(g, slim)
    for c in ("subject", "object", "population"):
        out = named(out, g.node, c, f"_{c}")
    shown = {"claim": "id", "relationship": "type", "subject": "_subject", "object": "_object", "population": "_population"}
    return out.select(*[F.col(shown.get(c, c)).alias(c) for c in ANSWER], *keep)


def touches(node: Column | str) -> Column:
    """Whether a claim's subject, object, population or mechanism is the node."""
    n = F.lit(node) if isinstance(node, str) else node
    hit = (F.col("subject") == n) | (F.col("object") == n) | (F.col("population") == n) | (F.col("mechanism") == n)
    return F.coalesce(hit, F.lit(False))


def is_weak() -> Column:
    """Open status or low certainty; a missing certainty is not low."""
    return F.coalesce(F.col("status").isin(*schema.OPEN_STATUSES), F.lit(False)) | F.coalesce(
        F.col("certainty").isin(*schema.WEAK_CERTAINTIES), F.lit(False)
    )


def what_affects(g: Graph, object: str, protective: bool = False) -> DataFrame:
    hit = F.col("object") == object
    return answer_rows(g, g.claim.where(hit & F.col("type").isin(*schema.PROTECTIVE) if protective else hit))


def high_certainty_about(g: Graph, node: str) -> DataFrame:
    return answer_rows(g, g.claim.where(((F.col("subject") == node) | (F.col("object") == node)) & (F.col("certainty") == "high")))


def gaps(g: Graph) -> DataFrame:
    return answer_rows(g, g.claim.where(F.col("status").isin(*schema.OPEN_STATUSES)))


def for_population(g: Graph, population: str) -> DataFrame:
    return answer_rows(g, g.claim.where(F.col("population") == population))


def neighbourhood(g: Graph, node: str) -> DataFrame:
    return answer_rows(g, g.claim.where(touches(node)))


def comparative(g: Graph) -> DataFrame:
    return answer_rows(g, g.claim.where("comparator is not null"))


def list_claims(g: Graph, **equal: str | None) -> DataFrame:
    """Conjunction of equalities on type, status, certainty, subject, object; absent ones don't filter."""
    claims = g.claim
    for column, value in equal.items():
        if column not in ("type", "status", "certainty", "subject", "object"):
            raise ValueError(f"no such filter: {column}")
        if value:
            claims = claims.where(F.col(column) == value)
    return answer_rows(g, claims)


def _contains(column: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def list_nodes(g: Graph, type: str | None = None, domain: str | None = None, q: str | None = None) -> DataFrame:
    nodes = g.node
    if type:
        nodes = nodes.where(F.col("type") == type)
    if domain:
        nodes = nodes.where(F.array_contains("domains", domain))
    if q:
        alias = F.exists("aliases", lambda a: _contains(a, q))
        nodes = nodes.where(_contains(F.col("id"), q) | _contains(F.col("name"), q) | alias)
    return nodes


def get_node(g: Graph, id: str) -> DataFrame:
    return g.node.where(F.col("id") == id)


def resolve_topic(g: Graph, topic: str | None) -> DataFrame:
    """At most one node: the one with this id, else the first whose name or id contains the text."""
    wanted = (topic or "").strip()
    if not wanted:
        return g.node.limit(0)
    exact = F.col("id") == wanted
    found = g.node.where(exact | _contains(F.col("name"), wanted) | _contains(F.col("id"), wanted))
    return found.orderBy(exact.desc(), "ord").limit(1)


def _resolved_id(g: Graph, topic: str | None) -> str | None:
    row = resolve_topic(g, topic).select("id").first()
    return row["id"] if row else None


def recommendations(g: Graph, population: str | None = None, issuer: str | None = None) -> DataFrame:
    """Recommends claims; a population that resolves to no node doesn't filter."""
    claims = g.claim.where(F.col("type") == "recommends")
    if population and (known := _resolved_id(g, population)):
        claims = claims.where(F.col("population") == known)
    types = g.node.select(F.col("id").alias("_t_id"), F.col("type").alias("issuer_type"))
    rows = claims.select("ord", "id", "subject", "object", "population", "status", "rec_strength")
    rows = rows.join(types, F.col("subject") == F.col("_t_id"), "left").drop("_t_id")
    for c in ("subject", "object", "population"):
        rows = named(rows, g.node, c, f"{c}_name")
    wanted = (issuer or "").strip()
    if wanted:
        known_name = F.col("issuer_type").isNotNull() & _contains(F.col("subject_name"), wanted)
        rows = rows.where(_contains(F.col("subject"), wanted) | known_name)
    keys = rows.select(F.col("id").alias("_k"))
    per_claim = quality.evidence_per_claim(g.listed.join(keys, F.col("claim") == F.col("_k"), "left_semi"), g.evidence)
    per_claim = per_claim.select(F.col("claim").alias("_c"), "sources")
    rows = rows.join(per_claim, F.col("id") == F.col("_c"), "left")
    return rows.select(
        "ord",
        F.col("id").alias("claim"),
        F.col("subject").alias("issuer_id"),
        F.col("subject_name").alias("issuer_name"),
        F.coalesce("issuer_type", F.lit("")).alias("issuer_type"),
        F.col("object").alias("intervention_id"),
        F.col("object_name").alias("intervention_name"),
        "rec_strength",
        F.col("population_name").alias("population"),
        "status",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
    )


def conflicts(g: Graph, relation: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of answer rows for each contradiction whose two claims exist."""
    rel = (g.relation if relation is None else relation).where("type = 'contradicts'").select("ord", "id", "type", "subject_claim", "object_claim")
    ids = conflicted_claims(rel)
    rows = answer_rows(g, g.claim.join(ids, F.col("id") == F.col("conflict_id"), "left_semi"))
    side = lambda n: rows.select(F.col("claim").alias(f"_{n}"), F.struct(*ANSWER).alias(n))
    both = rel.join(side("a"), F.col("subject_claim") == F.col("_a")).join(side("b"), F.col("object_claim") == F.col("_b"))
    return both.select("ord", F.col("id").alias("relation"), "a", "b")


def knowledge_gaps(g: Graph, topic: str | None = None) -> DataFrame:
    """Gap nodes with their research questions and concerns; with a topic, those that it concerns."""
    gap = g.node.where(F.col("type") == "knowledge_gap").select("ord", "id", "name", "description", "domains")
    out = g.claim.where(F.col("type").isin("generates", "related")).select(
        F.col("ord").alias("c_ord"), F.col("type").alias("c_type"), "subject", "object"
    )
    out = out.join(gap.select(F.col("id").alias("_g")), F.col("subject") == F.col("_g"), "left_semi")
    types = g.node.select(F.col("id").alias("_t_id"), F.col("type").alias("object_type"))
    out = named(out, g.node, "object", "object_name").join(types, F.col("object") == F.col("_t_id"), "left")
    item = F.struct(
        "c_ord", F.col("object").alias("id"), F.col("object_name").alias("name"), F.coalesce("object_type", F.lit("")).alias("type")
    )
    lists = out.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.when(F.col("c_type") == "generates", item))).alias("research_questions"),
        F.array_sort(F.collect_list(F.when(F.col("c_type") == "related", item))).alias("concerns"),
    )
    rows = gap.join(lists, F.col("id") == F.col("subject"), "left").drop("subject")
    for c in ("research_questions", "concerns"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    wanted = (topic or "").strip()
    if not wanted:
        return rows
    known = _resolved_id(g, wanted)
    about = F.exists(
        "concerns", lambda c: _contains(c["id"], wanted) | _contains(c["name"], wanted) | (c["id"] == F.lit(known)) & F.lit(known is not None)
    )
    here = _contains(F.col("id"), wanted) | _contains(F.col("name"), wanted) | _contains(F.col("description"), wanted)
    return rows.where(here | F.exists("domains", lambda d: _contains(d, wanted)) | F.coalesce(about, F.lit(False)))


def weak_evidence(g: Graph, topic: str) -> DataFrame:
    """The weak or unverified claims that touch a topic's node; no rows if it resolves to none."""
    known = _resolved_id(g, topic)
    return answer_rows(g, g.claim.where((touches(known) & is_weak()) if known else F.lit(False)))


@scoped("landscape")
def evidence_landscape(g: Graph, topic: str) -> DataFrame:
    """One tagged table: kind in direct, weak, indirect, conflicting; answer row a (and b of a pair);
    ``via`` is the mechanism of an indirect claim; ``rank`` orders within a kind."""
    known = _resolved_id(g, topic)
    claims = g.claim.withColumn("_touch", touches(known) if known else F.lit(False))
    direct = claims.where("_touch")
    mechanisms = g.node.where(F.col("type") == "mechanism").select(F.col("id").alias("m"))
    # found in the order of direct claims: the qualifier, then subject and object
    ends = direct.select("ord", F.posexplode(F.array("mechanism", "subject", "object")).alias("slot", "m"))
    ends = ends.where(~((F.col("slot") > 0) & (F.col("m") == F.lit(known or ""))))
    found = ends.join(mechanisms, "m", "left_semi").groupBy("m").agg(F.min(F.struct("ord", "slot")).alias("first"))
    # each other claim of a mechanism goes to the one found first: an equi-join on its three ends
    other = claims.where("not _touch").select("id", F.explode(F.array_distinct(F.array("subject", "object", "mechanism"))).alias("m"))
    via = other.join(found, "m").groupBy("id").agg(F.min(F.struct("first", "m")).alias("w")).select(
        F.col("id").alias("_via_id"), F.col("w.m").alias("via"), F.col("w.first.ord").alias("v_ord"), F.col("w.first.slot").alias("v_slot")
    )
    ids = direct.select(F.col("id").alias("_d"))
    sides = g.relation.where("type = 'contradicts'").select("ord", F.explode(F.array("subject_claim", "object_claim")).alias("side"), "subject_claim", "object_claim")
    rel = sides.join(ids, F.col("side") == F.col("_d"), "left_semi").select("ord", "subject_claim", "object_claim").distinct()
    # what each claim is wanted for, then all of these claims are filled in at once
    text, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    rank = lambda *c: F.struct(*[F.coalesce(x, zero).cast("long").alias(f"r{i}") for i, x in enumerate(c)]).alias("rank")
    tag = lambda df, kind, id_, via, other, *place: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("_id"), other.alias("_other"), via.alias("via"), rank(*place))
    tags = tag(direct, "direct", "id", text, text, F.col("ord"), zero, zero)
    tags = tags.unionByName(tag(direct.where(is_weak()), "weak", "id", text, text, F.col("ord"), zero, zero))
    found_via = via.join(claims.select("id", "ord"), F.col("id") == F.col("_via_id"))
    tags = tags.unionByName(tag(found_via, "indirect", "_via_id", F.col("via"), text, F.col("v_ord"), F.col("v_slot"), F.col("ord")))
    tags = materialize(tags.unionByName(tag(rel, "conflicting", "subject_claim", text, F.col("object_claim"), F.col("ord"), zero, zero)), "landscape-tags")
    wanted = tags.select(F.col("_id").alias("_w")).union(tags.where("_other is not null").select("_other")).distinct()
    rows = answer_rows(g, g.claim.join(wanted, F.col("id") == F.col("_w"), "left_semi")).select(F.col("claim").alias("_k"), F.struct(*ANSWER).alias("row"))
    rows = materialize(rows, "landscape-rows")
    a = rows.select(F.col("_k").alias("_a"), F.col("row").alias("a"))
    b = rows.select(F.col("_k").alias("_b"), F.col("row").alias("b"))
    out = tags.join(a, F.col("_id") == F.col("_a")).join(b, F.col("_other") == F.col("_b"), "left")
    # a pair counts only if both its claims are there
    return out.where("_other is null or _b is not null").select("kind", "rank", "via", "a", "b")


def landscape_summary(landscape: DataFrame) -> DataFrame:
    kinds = ("direct", "indirect", "conflicting", "weak")
    return landscape.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def node_claims(g: Graph, id: str) -> DataFrame:
    """Claims of a node with ``side`` outgoing or incoming, the other end, and quality."""
    out = g.claim.where(F.col("subject") == id).withColumn("side", F.lit("outgoing")).withColumn("other_id", F.col("object"))
    inn = g.claim.where(F.col("object") == id).withColumn("side", F.lit("incoming")).withColumn("other_id", F.col("subject"))
    slim = ("ord", "id", "side", "other_id", "type", "population", "direction", "certainty", "comparator", "dose", "effect_note", "status")
    rows = with_quality(g, out.unionByName(inn).select(*slim))
    rows = named(named(rows, g.node, "other_id", "other_name"), g.node, "population", "population_name")
    known = g.listed.join(g.evidence.select(F.col("id").alias("_e"), "source_id", "study_design", "quote"), F.col("evidence") == F.col("_e"))
    ev = known.groupBy("claim").agg(
        F.array_sort(F.collect_list(F.struct("ev_ord", F.col("_e").alias("id"), "source_id", "study_design", "quote"))).alias("evidence_rows")
    )
    rows = rows.join(ev.withColumnRenamed("claim", "_c"), F.col("id") == F.col("_c"), "left").drop("_c")
    return rows.withColumn("evidence_rows", F.coalesce("evidence_rows", F.array().cast(ev.schema["evidence_rows"].dataType)))


def node_neighbours(g: Graph, id: str) -> DataFrame:
    """Known nodes at the other end of a node's claims, each once, in order of first appearance."""
    ends = g.claim.select(
        "ord",
        F.posexplode(
            F.array(F.when(F.col("subject") == id, F.col("object")), F.when(F.col("object") == id, F.col("subject")))
        ).alias("slot", "nid"),
    ).where("nid is not null")
    first = ends.groupBy("nid").agg(F.min(F.struct("ord", "slot")).alias("seen"))
    return first.join(g.node, F.col("nid") == F.col("id")).select("seen", "id", "name", "type", "domains")


def context_edges(g: Graph) -> DataFrame:
    """source, target, kind: links of populations, mechanisms and papers to the ends of their claims.

    Both ends must be known; one edge for each (source, target), the first wins.
    """
    slots = F.array(
        *[F.struct(F.lit(k).alias("slot"), F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("kind"))
          for k, (a, b, kind) in enumerate((("population", "subject", "population"), ("population", "object", "population"),
                                            ("mechanism", "subject", "mechanism"), ("mechanism", "object", "mechanism")))]
    )
    edges = g.claim.select(F.lit(0).alias("phase"), "ord", F.lit(0).cast("long").alias("sub"), F.explode(slots).alias("e"))
    papers = g.evidence.where("source_node is not null and source_node <> ''").select("claim", "source_node", "ev_ord")
    papers = papers.join(g.claim.select("ord", "id", "subject", "object"), F.col("claim") == F.col("id"))
    slots = F.array(
        *[F.struct(F.lit(k).alias("slot"), F.col("source_node").alias("source"), F.col(b).alias("target"), F.lit("paper").alias("kind"))
          for k, b in enumerate(("subject", "object"))]
    )
    edges = edges.unionByName(papers.select(F.lit(1).alias("phase"), "ord", F.col("ev_ord").alias("sub"), F.explode(slots).alias("e")))
    edges = edges.select("phase", "ord", "sub", "e.*").where("source <> '' and target <> ''")
    for c in ("source", "target"):
        edges = edges.join(g.node.select(F.col("id").alias("_n")), F.col(c) == F.col("_n"), "left_semi")
    rank = F.struct("phase", "ord", "sub", "slot")
    return edges.groupBy("source", "target").agg(F.min_by("kind", rank).alias("kind"), F.min(rank).alias("first"))


def graph_edges(g: Graph) -> DataFrame:
    """Every claim as an edge with its conflict flag and quality."""
    rows = with_quality(g, g.claim.select("ord", "id", "type", "subject", "object", "direction", "certainty", "status", "dose", "comparator"))
    return rows.withColumnRenamed("subject", "source").withColumnRenamed("object", "target").withColumnRenamed("conflicted", "conflict")


def graph_nodes(g: Graph) -> DataFrame:
    """The nodes of the drawn graph: no more than a drawing shows."""
    return g.node.select("ord", "id", "name", "type", "domains")


def entity_counts(g: Graph) -> DataFrame:
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("entity"), "n")
    out = count(g.node, "nodes")
    for df, n in ((g.claim, "claims"), (g.evidence, "evidence"), (g.relation, "contradictions")):
        out = out.unionByName(count(df, n))
    return out


def effects_on(g: Graph, object: str) -> DataFrame:
    """Edges into a node grouped by name, type, direction and certainty, with their sources in one text;
    ordered by certainty as the vocabulary lists it."""
    claims = named(g.claim.where(F.col("object") == object).select("id", "subject", "type", "direction", "certainty"), g.node, "subject", "name")
    both = claims.join(g.evidence.select("claim", "source_id"), F.col("id") == F.col("claim"), "left")
    rows = both.groupBy("name", "type", "direction", "certainty").agg(
        F.array_join(F.array_sort(F.collect_list("source_id")), "; ").alias("joined"), F.count("source_id").alias("n")
    )
    rows = rows.select("name", "type", "direction", "certainty", F.when(F.col("n") > 0, F.col("joined")).alias("sources"))
    order = g.vocab.where("vocab = 'certainties'").select(F.col("value").alias("_v"), F.col("ordinal").alias("certainty_rank"))
    return rows.join(F.broadcast(order), F.col("certainty") == F.col("_v"), "left").drop("_v")


def contradictions(g: Graph) -> DataFrame:
    """Pairs of claims that contradict each other, scoped by the first one's population and dose."""
    a = g.claim.select(F.col("id").alias("claim_a"), F.col("direction").alias("dir_a"), F.col("population").alias("pop_a"), "dose")
    b = g.claim.select(F.col("id").alias("claim_b"), F.col("direction").alias("dir_b"))
    pairs = g.relation.where("type = 'contradicts'").join(a, F.col("subject_claim") == F.col("claim_a")).join(b, F.col("object_claim") == F.col("claim_b"))
    return pairs.select("claim_a", "dir_a", "pop_a", "dose", "claim_b", "dir_b")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
