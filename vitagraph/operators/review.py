"""Review queue, dashboards, logs and the topic work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import quality, text
from ..graph import Graph, conform
from ..runtime import in_order
from .answers import conflicted_claims, latest


def _clamp(value: int | None, default: int, least: int, most: int) -> int:
    return max(least, min(most, int(default if value is None else value)))


def queue_claims(g: Graph, status: str = "needs_refinement", q: str = "") -> DataFrame:
    """Claims with both ends known, by status ('all' for any) and a text in a name or the type.

    ``%`` and ``_`` in the text are wildcards, and case doesn't matter.
    """
    names = lambda n: g.node.select(F.col("id").alias(f"_{n}"), F.col("name").alias(n))
    claims = g.claim if status == "all" else g.claim.where(F.col("status") == status)
    rows = claims.join(names("subj"), F.col("subject") == F.col("_subj")).join(names("obj"), F.col("object") == F.col("_obj"))
    rows = rows.join(names("pop"), F.col("population") == F.col("_pop"), "left").drop("_subj", "_obj", "_pop")
    wanted = (q or "").strip()
    if wanted:
        like = F.lit(f"%{wanted}%")
        rows = rows.where(F.ilike("subj", like) | F.ilike("obj", like) | F.ilike("type", like))
    return rows


def queue_count(g: Graph, status: str = "needs_refinement", q: str = "") -> DataFrame:
    return queue_claims(g, status, q).agg(F.count("*").alias("n"))


def review_queue(g: Graph, runs: DataFrame, status: str = "needs_refinement", limit: int | None = None, offset: int | None = None, q: str = "") -> DataFrame:
    """One page, newest first, with evidence, quality and the reviewer's latest log.

    The page is cut first; evidence, logs and conflicts are read for its claims only.
    """
    page = queue_claims(g, status, q).orderBy(F.desc("updated_at"), "id")
    page = page.offset(max(0, int(offset or 0))).limit(_clamp(limit, 50, 1, 200))
    page = page.select("id", "type", "status", "subject", "object", "population", "direction", "certainty", "updated_at", "subj", "obj", "pop")
    keys = F.broadcast(page.select(F.col("id").alias("_k")))  # at most 200 ids
    listed = g.evidence.join(keys, F.col("claim") == F.col("_k"), "left_semi")
    order = listed.select("claim", "ev_ord", F.col("id").alias("evidence"))
    per = quality.evidence_per_claim(order, listed).withColumnRenamed("claim", "_c")
    ev = listed.groupBy(F.col("claim").alias("_e")).agg(
        F.array_sort(F.collect_list(F.struct("ev_ord", "id", "source_id", "quote", "study_design", "source_node"))).alias("evidence_rows")
    )
    logs = runs.where("agent = 'reviewer'").join(keys, F.col("claim_id") == F.col("_k"), "left_semi")
    logs = latest(logs, "claim_id", "created_at", "id").select(F.col("claim_id").alias("_l"), "summary", F.col("created_at").alias("reviewed_at"))
    rel = g.relation.where("type = 'contradicts'")
    hot = conflicted_claims(rel).join(keys, F.col("conflict_id") == F.col("_k"), "left_semi")
    rows = page.join(per, F.col("id") == F.col("_c"), "left").join(ev, F.col("id") == F.col("_e"), "left")
    rows = rows.join(logs, F.col("id") == F.col("_l"), "left").join(hot, F.col("id") == F.col("conflict_id"), "left")
    rows = rows.withColumn("conflicted", F.col("conflict_id").isNotNull())
    shape = "struct<verdict:string,reason:string,certainty:string,enriched:int>"
    rows = rows.withColumn("review", F.from_json("summary", shape))
    return quality.scored(rows.drop("_c", "_e", "_l", "conflict_id"))


def claims_by_status(g: Graph) -> DataFrame:
    return g.claim.groupBy("status").agg(F.count("*").alias("n"))


def global_counts(g: Graph, topics: DataFrame) -> DataFrame:
    a = g.node.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "paper").alias("papers"))
    return a.crossJoin(topics.agg(F.count_if(F.col("status") == "pending").alias("pending_topics")))  # one row each


def recent_activity(runs: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """Runs of the last days by agent and outcome; null outcomes are a group of their own, shown as '?'."""
    at = F.current_timestamp() if now is None else now
    recent = runs.where(F.col("created_at") > at - F.make_interval(days=F.lit(days)))
    return recent.groupBy("agent", "outcome").agg(F.count("*").alias("n")).select("agent", F.coalesce("outcome", F.lit("?")).alias("outcome"), "n")


def review_stats(g: Graph, topics: DataFrame, runs: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """section, key, outcome, n of the review desk in one aggregation: claims by status (a null key is all of
    them), nodes and papers, topics by status, and the last days' runs by agent and outcome.

    Each table is read once, as rows of two labels; the totals are grouping sets of the same pass.
    """
    at = F.current_timestamp() if now is None else now
    recent = runs.where(F.col("created_at") > at - F.make_interval(days=F.lit(days)))
    none = F.lit(None).cast("string")
    rows = g.claim.select(F.lit("claims").alias("section"), F.coalesce("status", F.lit("?")).alias("key"), none.alias("outcome"))
    rows = rows.unionByName(g.node.select(F.lit("nodes").alias("section"), F.when(F.col("type") == "paper", "papers").otherwise("others").alias("key"), none.alias("outcome")))
    rows = rows.unionByName(topics.select(F.lit("topics").alias("section"), F.coalesce("status", F.lit("?")).alias("key"), none.alias("outcome")))
    rows = rows.unionByName(recent.select(F.lit("recent").alias("section"), F.coalesce("agent", F.lit("?")).alias("key"), F.coalesce("outcome", F.lit("?")).alias("outcome")))
    sets = rows.groupingSets([["section"], ["section", "key"], ["section", "key", "outcome"]], "section", "key", "outcome")
    made = sets.agg(F.count("*").alias("n"), F.grouping("key").alias("_all"), F.grouping("outcome").alias("_any"))
    # runs are told apart by outcome, all else by key; every section has its total
    wanted = (F.col("_all") == 1) | F.when(F.col("section") == "recent", F.col("_any") == 0).otherwise((F.col("_any") == 1) & (F.col("key") != "others"))
    return made.where(wanted).select("section", "key", "outcome", "n")


def reviewable(g: Graph) -> DataFrame:
    """Unverified claims with evidence."""
    have = g.evidence.select(F.col("claim").alias("_c"))
    return g.claim.where("status = 'unverified'").join(have, F.col("id") == F.col("_c"), "left_semi")


def review_batch(g: Graph, limit: int = 10) -> DataFrame:
    return reviewable(g).orderBy("created_at", "id").limit(limit)


def decide(g: Graph, claim: str, approve: bool, certainty: str | None = None) -> Graph:
    """Approved claims are curated, with the given certainty if it is a known one; rejected ones go."""
    from .writes import delete_claims

    if not approve:
        return delete_claims(g, [claim])
    hit = F.col("id") == claim
    known = F.lit(certainty if certainty in schema.CERTAINTIES else None).cast("string")
    new = g.claim.withColumn("status", F.when(hit, "curated").otherwise(F.col("status")))
    return g.with_(claim=new.withColumn("certainty", F.when(hit, F.coalesce(known, "certainty")).otherwise(F.col("certainty"))))


def decide_claims(g: Graph, runs: DataFrame, decisions: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph and the run log after people's decisions, and (row, id, status_code, outcome) of each.

    ``decisions``: row (their order), id, action (approve or reject), certainty, note, at.  Approved claims are curated, with
    the last known certainty that was given; rejected ones go, with their evidence, and later decisions on them find
    nothing.  Each decision that found its claim is logged as a run of ``human``.
    """
    from .writes import delete_claims

    known = F.when(F.col("certainty").isin(*schema.CERTAINTIES), F.col("certainty"))
    ends = decisions.where("action = 'reject'").groupBy(F.col("id").alias("_r")).agg(F.min("row").alias("_end"))
    rows = decisions.withColumn("certainty", known).join(ends, F.col("id") == F.col("_r"), "left").join(g.claim.select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left")
    found = F.col("_c").isNotNull() & (F.col("_end").isNull() | (F.col("row") <= F.col("_end")))
    outcome = F.when(found, F.when(F.col("action") == "reject", "rejected").otherwise("curated"))
    rows = rows.select("row", "id", "action", "certainty", "note", "at", "_end", F.when(found, 200).otherwise(404).alias("status_code"), outcome.alias("outcome"))
    done = rows.where("status_code = 200")
    good = done.where("_end is null").groupBy(F.col("id").alias("_g")).agg(F.max(F.when(F.col("certainty").isNotNull(), F.struct("row", "certainty")))["certainty"].alias("_certainty"), F.max("at").alias("_at"))
    after = delete_claims(g, done.where("outcome = 'rejected'").select("id"))
    claim = after.claim.join(good, F.col("id") == F.col("_g"), "left")
    put = {
        "status": F.when(F.col("_g").isNotNull(), "curated").otherwise(F.col("status")),
        "certainty": F.coalesce("_certainty", "certainty"),
        "updated_at": F.coalesce(F.col("_at").cast(dict(g.claim.dtypes)["updated_at"]), "updated_at"),
    }
    after = after.with_(claim=claim.select(*[put.get(c, F.col(c)).alias(c) for c in g.claim.columns]))
    log = done.select(F.lit("human").alias("agent"), F.col("id").alias("claim_id"), "outcome", F.to_json(F.struct("action", "note", "certainty")).alias("summary"), F.col("at").alias("created_at"))
    return after, append_log(runs, conform(log.withColumn("id", F.lit(None).cast("long")), schema.AGENT_RUN)), rows.select("row", "id", "status_code", "outcome")


# --- verdicts ----------------------------------------------------------------


def check_citations(claims_evidence: DataFrame, known: DataFrame) -> DataFrame:
    """claim, source_id, kind, resolved: PMIDs and DOIs are looked up, URLs hold, others don't.

    ``known`` has source_id of citations that exist.
    """
    have = known.select(F.lower("source_id").alias("_s")).distinct()
    rows = claims_evidence.select("claim", "source_id", text.citation_kind(F.col("source_id")).alias("kind"))
    rows = rows.join(have, F.lower("source_id") == F.col("_s"), "left")
    ok = F.when(F.col("kind").isin("PMID", "DOI"), F.col("_s").isNotNull()).otherwise(F.col("kind") == "URL")
    return rows.withColumn("resolved", ok).drop("_s")


def reviewer_status(checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claim, status: curated iff it has citations, all resolve, and the verdict (claim, verdict) approves."""
    per = checks.groupBy("claim").agg(F.count("*").alias("n"), F.bool_and("resolved").alias("all_ok"))
    rows = verdicts.join(per, "claim", "left")
    fine = (F.coalesce("n", F.lit(0)) > 0) & F.coalesce("all_ok", F.lit(False)) & (F.col("verdict") == "approve")
    return rows.select("claim", F.when(fine, "curated").otherwise("needs_refinement").alias("status"))


def review_claims(g: Graph, batch: DataFrame, meta: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claim, outcome, status, certainty of a batch (id).  Claims for which a lookup failed, metadata is
    lacking or no verdict came are deferred and keep their status.  A certainty is set only on
    promotion and where there is none.  ``verdicts``: claim, verdict, certainty."""
    ev = g.evidence.join(batch.select(F.col("id").alias("_k")), F.col("claim") == F.col("_k"), "left_semi").select("claim", "source_id")
    m = meta.select(F.col("source_id").alias("_s"), "exists", F.coalesce("lookup_failed", F.lit(False)).alias("lookup_failed"))
    kind = text.citation_kind(F.col("source_id"))
    rows = ev.join(m, F.col("source_id") == F.col("_s"), "left")
    exists = F.when(kind == "URL", True).when(kind == "OTHER", False).otherwise(F.coalesce("exists", F.lit(False)))
    failed = kind.isin("PMID", "DOI") & F.coalesce("lookup_failed", F.col("_s").isNull())
    per = rows.groupBy("claim").agg(F.count("*").alias("n"), F.bool_and(exists).alias("all_ok"), F.bool_or(failed).alias("failed"))
    own = g.claim.select("id", F.col("status").alias("old_status"), F.col("certainty").alias("old_certainty"))
    v = verdicts.select(F.col("claim").alias("_v"), "verdict", F.col("certainty").alias("v_certainty"))
    rows = batch.select("id").join(own, "id").join(per, F.col("id") == F.col("claim"), "left").drop("claim").join(v, F.col("id") == F.col("_v"), "left")
    deferred = F.coalesce("failed", F.lit(False)) | F.col("verdict").isNull()
    good = (F.coalesce("n", F.lit(0)) > 0) & F.coalesce("all_ok", F.lit(False)) & (F.col("verdict") == "approve")
    known = F.when(F.col("v_certainty").isin(*schema.CERTAINTIES), F.col("v_certainty"))
    return rows.select(
        F.col("id").alias("claim"),
        F.when(deferred, "deferred").when(good, "curated").otherwise("flagged").alias("outcome"),
        F.when(deferred, F.col("old_status")).when(good, "curated").otherwise("needs_refinement").alias("status"),
        F.when(~deferred & good, F.coalesce("old_certainty", known)).otherwise(F.col("old_certainty")).alias("certainty"),
    )


def batch_tallies(outcomes: DataFrame) -> DataFrame:
    names = ("curated", "flagged", "deferred")
    return outcomes.agg(F.count("*").alias("reviewed"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def review_round(after: Graph, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims after a round of reviews, written, and one row of tallies with ``remaining``: how many
    unverified claims with evidence are left, observed while the claims are written instead of counted again."""
    from pyspark.sql import Observation

    from ..runtime import materialize

    have = after.evidence.select(F.col("claim").alias("_c")).distinct()
    rows = after.claim.join(have, F.col("id") == F.col("_c"), "left")
    seen = Observation()
    left = F.count_if((F.col("status") == "unverified") & F.col("_c").isNotNull())
    written = materialize(rows.observe(seen, left.alias("remaining")).drop("_c"), "reviewed-claims")
    return written, batch_tallies(outcomes).withColumn("remaining", F.lit(seen.get["remaining"]).cast("long"))


def evidence_badges(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence with ``resolved`` from the citation checks in the last review of its claim."""
    log = latest(runs.where("agent = 'reviewer'"), "claim_id", "created_at", "id")
    shape = "struct<citations:array<struct<source_id:string,resolved:boolean>>>"
    checks = log.select(F.col("claim_id").alias("_c"), F.explode(F.from_json("summary", shape)["citations"]).alias("x")).select("_c", "x.*")
    checks = checks.groupBy("_c", F.col("source_id").alias("_s")).agg(F.bool_or("resolved").alias("resolved"))
    return evidence.join(checks, (F.col("claim") == F.col("_c")) & (F.col("source_id") == F.col("_s")), "left").drop("_c", "_s")


# --- logs ----------------------------------------------------------------------


def newest(log: DataFrame, limit: int | None = None, default: int = 50, most: int = 500) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(_clamp(limit, default, 1, most))


def ask_gaps(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Questions that were answered without any claim and haven't been judged, newest first."""
    open_ = F.col("ok") & (F.coalesce("num_claims", F.lit(0)) == 0) & F.col("gap_status").isNull()
    return log.where(open_).orderBy(F.desc("created_at"), F.desc("id")).limit(_clamp(limit, 20, 1, 50))


def ask_panel(log: DataFrame, last: int = 50) -> DataFrame:
    """gaps, errors and tokens over the newest entries."""
    rows = log.orderBy(F.desc("created_at"), F.desc("id")).limit(last)
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return rows.agg(
        F.count_if(F.col("ok") & (F.coalesce("num_claims", F.lit(0)) == 0)).alias("gaps"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
    )


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows added; their ids follow the greatest one in order of ``created_at``."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    tie = [c for c, t in rows.dtypes if c != "created_at" and not t.startswith("map")]
    numbered = in_order(rows.drop("id"), F.col("created_at"), *map(F.col, [c for c in tie if c != "id"]), name="_n")
    numbered = numbered.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("_n")).drop("top", "_n")
    return log.unionByName(numbered, allowMissingColumns=True)


def harvest_summary(results: DataFrame) -> DataFrame:
    """Counts of a run's results (status created, merged, reused or skipped; paper)."""
    names = ("created", "merged", "reused", "skipped")
    return results.agg(F.countDistinct("paper").alias("papers"), F.count("*").alias("proposed"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def rank_papers(papers: DataFrame, pattern: str, n: int) -> DataFrame:
    """Papers whose publication types match first, else in their order; at most 15."""
    hit = F.exists("pubtypes", lambda p: p.rlike(pattern))
    return papers.orderBy(F.coalesce(hit, F.lit(False)).desc(), "ord").limit(max(1, min(15, n)))


# --- topic queue -----------------------------------------------------------------


def seed_topics(topics: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, inserted): adds what is absent, by id (made from the text where none is given), first wins."""
    rows = new.withColumn("id", F.coalesce("id", text.topic_id(F.col("topic"))) if "id" in new.columns else text.topic_id(F.col("topic")))
    order = Window.partitionBy("id").orderBy("ord") if "ord" in rows.columns else Window.partitionBy("id").orderBy("topic")
    rows = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "ord")
    rows = rows.join(topics.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    for c, v in (("status", F.lit("pending")), ("priority", F.lit(0)), ("attempts", F.lit(0))):
        rows = rows.withColumn(c, F.coalesce(F.col(c), v) if c in rows.columns else v)
    return topics.unionByName(rows, allowMissingColumns=True), rows


def next_topic(topics: DataFrame) -> DataFrame:
    """The pending topic to work on: highest priority, then oldest."""
    return topics.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(1)


def claim_next_topic(topics: DataFrame) -> tuple[DataFrame, str | None]:
    """The table with the next topic in progress, and its id.  One writer at a time."""
    row = next_topic(topics).select("id").first()
    if row is None:
        return topics, None
    hit = F.col("id") == row["id"]
    out = topics.withColumn("status", F.when(hit, "in_progress").otherwise(F.col("status")))
    return out.withColumn("attempts", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts"))), row["id"]


def finish_topic(topics: DataFrame, id: str, status: str, error: str | None = None) -> DataFrame:
    hit = F.col("id") == id
    out = topics.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    kept = F.lit(error if status == "failed" else None).cast("string")
    return out.withColumn("last_error", F.when(hit, kept).otherwise(F.col("last_error")))


def requeue_failed(topics: DataFrame) -> DataFrame:
    hit = F.col("status") == "failed"
    out = topics.withColumn("attempts", F.when(hit, 0).otherwise(F.col("attempts")))
    return out.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def filter_topics(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposals (ord, topic, domain) that are long enough, in a known domain, and new; the first of equal ids."""
    rows = proposed.withColumn("topic", F.trim("topic")).where((F.length("topic") >= 10) & F.col("domain").isin(*schema.DOMAINS))
    rows = rows.withColumn("id", text.topic_id(F.col("topic")))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_rn = 1").drop("_rn")
    have = existing.select(text.topic_id(F.col("topic")).alias("_i"))
    return rows.join(have, F.col("id") == F.col("_i"), "left_anti").select("ord", "id", "topic", F.lit(3).alias("priority"))


def process_gaps(log: DataFrame, topics: DataFrame, judgements: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, topics, decided) after judging the open gap questions.

    ``judgements``: id, relevant, topic, domain.  Relevant, well-formed and new topics are queued with
    priority 5; questions of one run that lead to the same topic queue it once.
    """
    open_ = ask_gaps(log, limit).select("id", F.col("created_at").alias("at"))
    j = open_.join(judgements, "id", "left")
    order = F.row_number().over(Window.orderBy(F.desc("at"), F.desc("id")))  # at most 50 rows
    good = j.where(F.coalesce("relevant", F.lit(False))).withColumn("ord", order)
    kept = filter_topics(good.select("ord", "topic", "domain"), topics).join(good.select("ord", F.col("id").alias("ask_id")), "ord")
    decided = open_.join(kept.select(F.col("ask_id").alias("_a")), F.col("id") == F.col("_a"), "left")
    decided = decided.select("id", F.when(F.col("_a").isNotNull(), "queued").otherwise("rejected").alias("new_status"))
    new = kept.select("ord", "id", "topic", F.lit(5).alias("priority"), F.lit("ask_gap").alias("source"))
    out = log.join(decided.withColumnRenamed("id", "_d"), F.col("id") == F.col("_d"), "left")
    out = out.withColumn("gap_status", F.coalesce("new_status", "gap_status")).drop("_d", "new_status")
    return out, seed_topics(topics, new)[0], decided


def page(df: DataFrame, order: list, number: int, size: int = 10) -> tuple[DataFrame, int, int]:
    """(rows, page, pages) of a listing; the page is clamped to what there is."""
    pages = max(1, -(-df.count() // size))
    at = max(1, min(pages, number))
    return df.orderBy(*order).offset((at - 1) * size).limit(size), at, pages


def cursor(df: DataFrame, order: list, offset: int, count: int, most: int) -> tuple[DataFrame, int, bool]:
    """(rows, next offset, done) of a batch walk over a list."""
    total = df.count()
    start, n = max(0, min(total, offset)), max(1, min(most, count))
    return df.orderBy(*order).offset(start).limit(n), min(total, start + n), start + n >= total
