"""From proposed claims to graph rows: citations first, then nodes, then merge or create.

Proposals are taken in as if one by one in order of ``cand_id``.  One whose edge is there already adds
its source to that claim and makes no population; others resolve a population too and make a claim.
Whether an edge is there depends on earlier proposals, and through their populations' nodes on how these
were resolved.  So the two phases, resolution (``leaders``) and edges, are worked out for all proposals at
once, with a guess of which of them resolve a population, and again until what comes out is what was
guessed: by induction over the order that is what one by one gives.  As a rule that takes two or three turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import text
from ..graph import Graph, conform, listed_from
from ..runtime import keeping, materialize, ship
from .leaders import Resolution, grown, resolve_in_order
from .link import existing_claims
from .validate import candidate_errors
from .writes import placed_after

# Fixed prefix of who has extracted the evidence of proposals.
AGENT = "agent:curator:"
EDGE = ["subject", "object", "relationship", "direction"]
# Fixed text of an error, as callers know it.
NO_CURIE = "each evidence needs a CURIE source_id (DOI:/PMID:/URL)"


def _ends(good: DataFrame, active: DataFrame | None) -> DataFrame:
    """Names to resolve: subject, object and, for those in ``active`` (all if none), the population of each proposal, in this order."""
    out = []
    for k, role in enumerate(("subject", "object")):
        id_ = F.col(f"{role}_id") if f"{role}_id" in good.columns else F.lit(None)
        out.append(good.select(F.col("cand_id"), F.lit(k).alias("k"), id_.cast("string").alias("id"), F.col(f"{role}_name").alias("name"), F.col(f"{role}_type").alias("type")))
    pop = good.where(F.coalesce("population", F.lit("")) != "")
    if active is not None:
        pop = pop.join(active, F.col("cand_id") == F.col("_a"), "left_semi")
    out.append(pop.select("cand_id", F.lit(2).alias("k"), F.lit(None).cast("string").alias("id"), F.col("population").alias("name"), F.lit("population").alias("type")))
    every = out[0].unionByName(out[1]).unionByName(out[2])
    return every.select(F.struct("cand_id", "k").alias("cand_id"), (F.col("cand_id").cast("long") * 3 + F.col("k")).alias("pos"), "id", "name", "type")


def _created(g: Graph, rows: DataFrame) -> DataFrame:
    """EDGE, made (cand_id), claim: the proposal that makes the claim of each edge that isn't there, if one can.

    A claim's id leaves the direction out, so proposals of other directions may find it taken, and the edge
    waits for another population.  In a turn the first proposal of each (subject, object, relationship) that
    can make a claim does; an edge is made once, so there are no more turns than directions.
    """
    taken = materialize(g.claim.select(F.col("id").alias("_id")).distinct(), "claim-ids")
    able = rows.where(F.col("old").isNull() & text.is_curie(F.col("source_id")))
    able = materialize(able.groupBy(*EDGE, "would").agg(F.min("cand_id").alias("cand_id")), "first-proposals")
    made = None
    for _ in range(len(schema.DIRECTIONS) + 1):
        free = able.join(taken, F.col("would") == F.col("_id"), "left_anti")
        if made is not None:
            done = made.select(*[F.col(c).alias(f"_{c}") for c in EDGE])
            free = free.join(done, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in EDGE], "left_anti")
        new = free.groupBy("subject", "object", "relationship").agg(F.min(F.struct("cand_id", "direction", "would")).alias("f"))
        new = materialize(new.select("subject", "object", "relationship", "f.direction", F.col("f.cand_id").alias("made"), F.col("f.would").alias("claim")), "made-claims")
        if new.isEmpty():
            return new if made is None else made
        made = new if made is None else materialize(made.unionByName(new), "made-claims")
        taken = taken.unionByName(new.select(F.col("claim").alias("_id")))
    return made


def _edges(g: Graph, good: DataFrame, r: Resolution) -> DataFrame:
    """Proposals with their nodes, the claim that is there (old), the id that theirs would have, and ``made`` and
    ``claim`` of the edge if one of them makes it."""
    places = r.found.select(F.col("cand_id.cand_id").alias("_c"), F.col("cand_id.k").alias("k"), "node_id")
    wide = places.groupBy("_c").agg(*[F.max(F.when(F.col("k") == k, F.col("node_id"))).alias(c) for k, c in enumerate(("subject", "object", "pop"))])
    rows = good.drop("population").join(wide, F.col("cand_id") == F.col("_c")).drop("_c").withColumnRenamed("pop", "population")
    edges = rows.select("cand_id", "subject", "object", F.col("relationship").alias("type"), "direction")
    have = existing_claims(edges.dropDuplicates(["subject", "object", "type", "direction"]), g).withColumnRenamed("cand_id", "_h")
    have = edges.join(have, F.col("cand_id") == F.col("_h")).select(*[F.col(c).alias(f"_{c}") for c in ("subject", "object", "type", "direction")], F.col("claim").alias("old"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(EDGE, ("_subject", "_object", "_type", "_direction"), strict=True)]
    rows = rows.join(have, same, "left").drop("_subject", "_object", "_type", "_direction")
    rows = materialize(rows.withColumn("would", text.claim_id(F.col("subject"), F.col("relationship"), F.col("object"), F.col("population"))), "edges")
    made = _created(g, rows).select(*[F.col(c).alias(f"_{c}") for c in EDGE], "made", "claim")
    return rows.join(made, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in EDGE], "left").drop(*[f"_{c}" for c in EDGE])


def persist(g: Graph, proposals: DataFrame, resolved: DataFrame, model: str = "model") -> tuple[Graph, DataFrame]:
    """The graph with proposals taken in, and (cand_id, outcome, claim, added, errors) of each.

    ``proposals``: cand_id (a number), subject_name, subject_type, object_name, object_type, relationship,
    direction, population, certainty, citation_title, quote, study_design, and subject_id and object_id if
    there.  ``resolved``: cand_id, source_id.  Invalid proposals and those whose citation isn't resolved are
    skipped before anything is made.  Outcomes: created (an unverified claim), merged (into the claim of its
    edge; ``added`` says whether its source is new there), skipped (with errors).
    """
    ship(proposals.sparkSession)
    with keeping() as kept:
        src = resolved.select(F.col("cand_id").alias("_c"), text.normalize_source_id(F.col("source_id")).alias("source_id"))
        rows = materialize(candidate_errors(proposals).join(src, F.col("cand_id") == F.col("_c"), "left").drop("_c"), "proposals")
        kept.append(rows)
        good = rows.where((F.size("errors") == 0) & F.col("source_id").isNotNull())
        active, state = None, None
        while True:
            r = resolve_in_order(_ends(good, active), g)
            edges = materialize(_edges(g, good, r), "edges")
            active = materialize(edges.where(F.col("old").isNull() & (F.col("made").isNull() | (F.col("cand_id") <= F.col("made")))).select(F.col("cand_id").alias("_a")), "new-edges")
            new = active.agg(F.count("*").alias("n"), F.sum(F.xxhash64("_a").cast("decimal(38,0)")).alias("h")).first()
            if new == state:
                break
            state = new
        kept += [edges, r.found, r.nodes, r.aliases]
    return _taken_in(grown(g, r), edges, rows, model)


def _taken_in(g: Graph, edges: DataFrame, rows: DataFrame, model: str) -> tuple[Graph, DataFrame]:
    is_new = F.col("made") == F.col("cand_id")
    late = F.col("old").isNull() & (F.col("made").isNull() | (F.col("cand_id") < F.col("made")))  # no claim there yet, and none made
    outcome = F.when(F.coalesce(is_new, F.lit(False)), "created").when(late, "skipped").otherwise("merged")
    edges = edges.withColumn("outcome", outcome).withColumn("claim", F.when(F.col("outcome") != "skipped", F.coalesce("old", "claim")))
    # a source is cited by a claim once: by the first proposal that brings it, if the claim hasn't it already
    cited = g.evidence.select(F.col("claim").alias("_k"), F.col("source_id").alias("_s")).distinct()
    ok = edges.where((F.col("outcome") != "skipped") & text.is_curie(F.col("source_id")))
    firsts = ok.groupBy(F.col("claim").alias("_k"), F.col("source_id").alias("_s")).agg(F.min("cand_id").alias("_first")).join(cited, ["_k", "_s"], "left_anti").select("_first")
    edges = edges.join(firsts, F.col("cand_id") == F.col("_first"), "left").withColumn("added", F.col("_first").isNotNull()).drop("_first")
    design = F.when(F.col("study_design").isin(*schema.DESIGNS), F.col("study_design"))
    new = edges.where("outcome = 'created'").select(
        "cand_id", F.col("claim").alias("id"), F.col("relationship").alias("type"), "subject", "object", "population", "direction", "certainty", F.lit("unverified").alias("status")
    )
    last = g.evidence.groupBy(F.col("claim").alias("_l")).agg(F.max("ev_ord").alias("last"))
    add = edges.where("added").join(last, F.col("claim") == F.col("_l"), "left")
    nth = F.row_number().over(Window.partitionBy("claim").orderBy("cand_id"))
    ending = F.when(F.col("outcome") == "created", "1").otherwise(F.lower(F.conv(text.fnv32(F.col("source_id")).cast("string"), 10, 36)))
    add = add.withColumn("ev_ord", (F.coalesce("last", F.lit(0)) + nth).cast("long"))
    ev = conform(
        add.select(
            F.concat("claim", F.lit("-e"), ending).alias("id"), "claim", "ev_ord", "source_id", "quote", design.alias("study_design"), F.lit(AGENT + model).alias("extracted_by")
        ),
        schema.EVIDENCE,
    )
    taken = F.when(~text.is_curie(F.col("source_id")), F.lit(NO_CURIE)).otherwise(F.concat(F.lit("claim '"), "would", F.lit("' already exists")))
    done = edges.select("cand_id", "outcome", "claim", "added", F.when(F.col("outcome") == "skipped", F.array(taken)).otherwise(F.col("errors")).alias("errors"))
    skipped = rows.where((F.size("errors") > 0) | F.col("source_id").isNull()).select(
        "cand_id", F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("claim"), F.lit(False).alias("added"),
        F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.array(F.concat(F.lit('citation not resolved: "'), F.substring("citation_title", 1, 90), F.lit('"')))).alias("errors"),
    )
    out = g.with_(
        claim=g.claim.unionByName(conform(placed_after(g.claim, new, "cand_id"), schema.CLAIM)),
        evidence=g.evidence.unionByName(ev),
        listed=g.listed.unionByName(listed_from(ev)),
    )
    return out, done.unionByName(skipped)
