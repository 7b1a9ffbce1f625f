"""What agents need around a model: hooks, prompts, replies, code mapping in two passes, repairs, run cycles.

A model or a lookup service is a callable over rows, handed in; without one the parts that
need it find nothing, and everything else goes on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..graph import Graph
from . import review
from .link import TARGETS, resolve_citations, resolve_codes, unmapped
from .search import hydrate

#: Rows (key, prompt) in, rows (key, reply, input_tokens, output_tokens) out; a key without a row has failed.
Complete = Callable[[DataFrame], DataFrame]
NONE = "array<string>"

# --- models ----------------------------------------------------------------------


def replies(prompts: DataFrame, complete: Complete | None) -> DataFrame:
    """key, reply and tokens of each prompt; all null where no model is configured or it failed."""
    if complete is None:
        empty = F.lit(None)
        return prompts.select("key", empty.cast("string").alias("reply"), empty.cast("long").alias("input_tokens"), empty.cast("long").alias("output_tokens"))
    made = complete(prompts.select("key", "prompt")).select(F.col("key").alias("_k"), "reply", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"))
    return prompts.select("key").join(made, F.col("key") == F.col("_k"), "left").drop("_k")


def usage(used: DataFrame) -> DataFrame:
    """Input and output tokens of several calls, summed; missing counts are 0."""
    return used.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")])


def model_in(model: Column, families: tuple[str, ...]) -> Column:
    """Whether a model's id is one of the families or begins with one and then something that is no letter or digit."""
    listed = "|".join(map(re.escape, families))
    return F.coalesce(F.trim(model).rlike(rf"^({listed})\b"), F.lit(False)) if families else F.lit(False)


def suggested_terms(reply: Column) -> Column:
    """Terms of a reply: the strings of its first JSON array, trimmed, without empty ones, three at most."""
    items = F.from_json(text.extract_json(reply), NONE)
    full = F.filter(F.transform(F.coalesce(items, F.array().cast(NONE)), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.slice(full, 1, 3)


def same_concept(reply: Column) -> Column:
    """Whether a reply's JSON object says ``"same": true``, as a boolean; anything else is a no."""
    shape = F.from_json(text.extract_json(reply), "map<string,string>")
    quoted = text.extract_json(reply).rlike(r'"same"\s*:\s*"')
    return F.coalesce((F.element_at(shape, F.lit("same")) == "true") & ~quoted, F.lit(False))


# --- prompts -----------------------------------------------------------------------


def known_names(g: Graph, most: int = 200) -> DataFrame:
    """id, type, name of the first nodes by name, as prompts list them."""
    return g.node.orderBy("name", "id").limit(most).select("id", "type", "name")


def harvest_vocabulary(g: Graph) -> DataFrame:
    """vocab, value: node and relationship types that are asked for from papers, in their order."""
    # The types that papers are not asked for.
    meta = {"nodeTypes": ("theory", "model", "knowledge_gap", "research_question"), "relationshipTypes": ("explains", "informs", "generates")}
    v = g.vocab.where(F.col("vocab").isin(*meta))
    gone = v.sparkSession.createDataFrame([(k, x) for k, xs in meta.items() for x in xs], "_vocab string, _value string")
    return v.join(F.broadcast(gone), (F.col("vocab") == F.col("_vocab")) & (F.col("value") == F.col("_value")), "left_anti").select("vocab", "ordinal", "value")


def term_prompts(nodes: DataFrame) -> DataFrame:
    """key, prompt: asks for vocabulary terms of nodes (id, name, type, aliases, description)."""
    named = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n{label}: "), c)).otherwise("")
    body = F.concat(
        F.lit("Name up to three standard vocabulary terms, as a JSON array of strings, for:\n"), "name", F.lit(" ("), "type", F.lit(")"),
        named("Also called", F.array_join(F.coalesce("aliases", F.array().cast(NONE)), ", ")), named("Description", F.substring("description", 1, 200)),
    )
    return nodes.select(F.col("id").alias("key"), body.alias("prompt"))


def verify_prompts(matches: DataFrame) -> DataFrame:
    """key, prompt: asks whether a node (name, type) and a term (curie, label) are one concept."""
    body = F.concat(F.lit("Node: "), "name", F.lit(" ("), "type", F.lit(")\nTerm: "), "curie", F.lit(" "), "label", F.lit('\nAnswer {"same": true} or {"same": false}.'))
    return matches.select("key", body.alias("prompt"))


def extraction_prompts(papers: DataFrame, names: list[str], most_chars: int = 6000) -> DataFrame:
    """key, prompt: asks for the claims of papers (id, title, abstract); texts are cut to ``most_chars``."""
    listed = "\n".join(names)
    body = F.concat(F.lit("Known concepts:\n" + listed + "\n\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, most_chars))
    return papers.select(F.col("id").alias("key"), body.alias("prompt"))


def judge_prompts(g: Graph, claims: DataFrame) -> DataFrame:
    """key, prompt: a claim with its evidence, to be approved or refined."""
    from .search import context_lines

    rows = context_lines(hydrate(g, claims))
    return rows.select(F.col("id").alias("key"), F.concat(F.lit("Does the evidence bear the claim out? Answer as JSON: verdict (approve or refine), reason, certainty.\n"), "line").alias("prompt"))


def verdicts(replied: DataFrame) -> DataFrame:
    """claim, verdict, certainty of judged claims; a reply without JSON gives no row."""
    j = F.from_json(text.extract_json(F.col("reply")), "struct<verdict:string,certainty:string>")
    rows = replied.where(text.extract_json(F.col("reply")).isNotNull()).select(F.col("key").alias("claim"), j.alias("j"))
    known = F.when(F.col("j.certainty").isin(*schema.CERTAINTIES), F.col("j.certainty"))
    return rows.select("claim", F.when(F.col("j.verdict") == "approve", "approve").otherwise("refine").alias("verdict"), known.alias("certainty"))


def contact_notice(name: Column, email: Column, message: Column, ip: Column, agent: Column, id_: Column) -> Column:
    """The text that tells of a contact message."""
    or_ = lambda c, none: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)).otherwise(none)
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    meta = F.array_compact(F.array(part("IP: ", ip), part("UA: ", agent)))
    return F.concat(
        F.lit("New contact message\nFrom: "), or_(name, "(anonymous)"), F.lit("\nEmail: "), or_(email, "(none)"), F.lit("\n\n"), F.trim(message),
        F.when(F.size(meta) > 0, F.concat(F.lit("\n\n"), F.array_join(meta, "\n"))).otherwise(""), F.coalesce(F.concat(F.lit("\n#"), id_.cast("string")), F.lit("")),
    )


# --- vocabulary codes in two passes -----------------------------------------------------


def map_batch(nodes: DataFrame, limit: int = 25) -> DataFrame:
    """Nodes of a type with vocabularies that weren't checked yet, newest first."""
    able = nodes.where(F.col("type").isin(*TARGETS) & F.col("codes_checked_at").isNull())
    return able.orderBy(F.desc_nulls_first("updated_at"), "id").limit(max(1, min(200, limit)))


def resolve_codes_twice(nodes: DataFrame, terms: DataFrame, suggested: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """id, external_ids: by the nodes' own names first, then by suggested terms (id, terms) for what is still open.

    A code found by suggestion counts only if ``confirmed`` (id, curie) has it; None confirms all.
    """
    first = resolve_codes(nodes, terms)
    none = F.array().cast(NONE)
    left = nodes.drop("external_ids").join(first.select(F.col("id").alias("_i"), "external_ids"), F.col("id") == F.col("_i")).drop("_i")
    asked = left.join(suggested.select(F.col("id").alias("_s"), "terms"), F.col("id") == F.col("_s")).where(F.size("terms") > 0)
    renamed = asked.withColumn("name", F.get("terms", F.lit(0))).withColumn("aliases", F.slice("terms", 2, 2)).drop("_s", "terms")
    second = resolve_codes(renamed, terms).select(F.col("id").alias("_r"), F.col("external_ids").alias("_found"))
    new = first.join(second, F.col("id") == F.col("_r"), "left").withColumn("_new", F.array_except(F.coalesce("_found", none), "external_ids"))
    if confirmed is not None:
        ok = confirmed.groupBy(F.col("id").alias("_o")).agg(F.collect_set("curie").alias("_ok"))
        new = new.join(ok, F.col("id") == F.col("_o"), "left").withColumn("_new", F.array_intersect("_new", F.coalesce("_ok", none)))
    return new.select("id", text.merge_codes(F.col("external_ids"), F.col("_new")).alias("external_ids"))


def map_nodes(g: Graph, terms: DataFrame, limit: int = 25, suggested: DataFrame | None = None, confirmed: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph after one batch of mapping, and scanned, mapped, codes_added, remaining.

    Codes that the batch found are noted in ``codes_auto``; every node of it counts as checked.
    """
    batch = map_batch(g.node, limit)
    now = F.current_timestamp()
    made = resolve_codes(batch, terms) if suggested is None else resolve_codes_twice(batch, terms, suggested, confirmed)
    made = made.select(F.col("id").alias("_m"), F.col("external_ids").alias("_codes"))
    rows = g.node.join(made, F.col("id") == F.col("_m"), "left")
    added = F.array_except(F.coalesce("_codes", F.array().cast(NONE)), F.coalesce("external_ids", F.array().cast(NONE)))
    rows = rows.withColumn("_added", added).withColumn("_hit", F.col("_m").isNotNull())
    totals = rows.agg(
        F.count_if("_hit").alias("scanned"), F.count_if(F.size("_added") > 0).alias("mapped"), F.coalesce(F.sum(F.size("_added")), F.lit(0)).cast("long").alias("codes_added"),
        F.count_if(F.col("type").isin(*TARGETS) & F.col("codes_checked_at").isNull() & ~F.col("_hit")).alias("remaining"),
    )
    put = {
        "external_ids": F.when(F.col("_hit"), F.col("_codes")).otherwise(F.col("external_ids")),
        "codes_auto": F.when(F.col("_hit"), F.array_union(F.coalesce("codes_auto", F.array().cast(NONE)), "_added")).otherwise(F.col("codes_auto")),
        "codes_checked_at": F.when(F.col("_hit"), now).otherwise(F.col("codes_checked_at")),
    }
    return g.with_(node=rows.select(*[put.get(c, F.col(c)).alias(c) for c in g.node.columns])), totals


def diagnose(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """id, prefix, queries, n_candidates, decision: why a node has or hasn't a code of each of its vocabularies.

    Candidates are terms of which a label equals a query; those of them whose label is a name of the node match.
    """
    none = F.array().cast(NONE)
    targets = F.coalesce(F.create_map(*[x for k, v in TARGETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("type")], none)
    base = nodes.select("id", F.coalesce("external_ids", none).alias("codes"), text.name_variants(F.col("name"), F.coalesce("aliases", none)).alias("names"),
        text.search_terms(F.col("name"), F.coalesce("aliases", none)).alias("queries"), F.explode(targets).alias("prefix"))
    base = base.withColumn("has", F.exists("codes", lambda c: F.upper(F.substring_index(c, ":", 1)) == F.col("prefix")))
    asked = base.where("not has").select("id", "prefix", "names", F.explode(F.concat("queries", "names")).alias("q")).withColumn("norm", text.norm_term(F.col("q")))
    labels = terms.select(F.col("prefix").alias("_p"), F.col("ord").alias("t_ord"), "curie", F.explode(F.array_distinct(F.transform("labels", text.norm_term))).alias("_norm"))
    hits = asked.join(labels, (F.col("prefix") == F.col("_p")) & (F.col("norm") == F.col("_norm")))
    hits = hits.groupBy(F.col("id").alias("_i"), F.col("prefix").alias("_x")).agg(F.countDistinct("curie").alias("n"), F.min_by("curie", "t_ord").alias("curie"))
    out = base.join(hits, (F.col("id") == F.col("_i")) & (F.col("prefix") == F.col("_x")), "left")
    decision = F.when(F.col("has"), "already has a code").when(F.col("curie").isNotNull(), F.concat(F.lit("matched (name): "), "curie")).otherwise("no candidates")
    return out.select("id", "prefix", F.when(F.col("has"), none).otherwise(F.col("queries")).alias("queries"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), decision.alias("decision"))


# --- repairs -------------------------------------------------------------------------


def repair(g: Graph, ids: DataFrame, named: DataFrame, pubmed: DataFrame, crossref: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with better sources of some claims (id), and what became of each of their evidence records.

    ``named`` (evidence, title) says which paper a record is likely from; titles are resolved among
    ``pubmed`` and ``crossref`` (``want_id`` is the evidence's id).  Outcomes: repaired, correct, unresolved, unnamed.
    """
    ev = g.evidence.join(ids.select(F.col("id").alias("_c")), F.col("claim") == F.col("_c"), "left_semi").select(F.col("id").alias("evidence"), "claim", F.col("source_id").alias("old"))
    wanted = named.where(F.trim(F.coalesce("title", F.lit(""))) != "").select(F.col("evidence").alias("want_id"), "title")
    found = resolve_citations(wanted, pubmed, crossref).select(F.col("want_id").alias("_w"), F.col("source_id").alias("new"))
    rows = ev.join(wanted.select(F.col("want_id").alias("_n")), F.col("evidence") == F.col("_n"), "left").join(found, F.col("evidence") == F.col("_w"), "left")
    outcome = F.when(F.col("_n").isNull(), "unnamed").when(F.col("new").isNull(), "unresolved").when(F.col("new") == F.col("old"), "correct").otherwise("repaired")
    rows = rows.select("evidence", "claim", "old", "new", outcome.alias("outcome"))
    swap = rows.where("outcome = 'repaired'").select(F.col("evidence").alias("_e"), "new")
    put = {"source_id": F.coalesce("new", "source_id"), "source_node": F.when(F.col("new").isNull(), F.col("source_node"))}
    names = g.evidence.columns
    done = g.evidence.join(swap, F.col("id") == F.col("_e"), "left").select(*[put.get(c, F.col(c)).alias(c) for c in names])
    return g.with_(evidence=done), rows


def to_review_again(details: DataFrame) -> DataFrame:
    """Claims (id, repaired) of a repair that are judged anew: with a new source or a confirmed one."""
    per = details.groupBy(F.col("claim").alias("id")).agg(F.bool_or(F.col("outcome") == "repaired").alias("repaired"), F.bool_or(F.col("outcome") == "correct").alias("correct"))
    return per.where("repaired or correct").select("id", "repaired")


# --- cycles --------------------------------------------------------------------------

# Fixed pattern of errors that pass.
TRANSIENT = r"(?i)fetch failed|terminated|ECONN|ETIMEDOUT|timeout|abort|failed after retries|429|50\d|empty model response"


def after_failure(error: str, attempts: int, most: int = 3) -> str:
    """The status of a topic whose work failed: queued again after a passing error, while few attempts were made."""
    return "pending" if re.search(TRANSIENT, error) and attempts < most else "failed"


@dataclass
class Cycle:
    """One scheduled run: topics are added if few are pending, some are worked on, some claims reviewed.

    ``generate(topics)`` returns new topics; ``curate(graph, topic)`` the graph after work on a topic, or raises;
    ``judge(graph, batch)`` returns (meta, verdicts) of a batch of claims.
    """

    generate: Callable[[DataFrame], DataFrame] | None = None
    curate: Callable[[Graph, str], Graph] | None = None
    judge: Callable[[Graph, DataFrame], tuple[DataFrame, DataFrame]] | None = None
    topics_per_run: int = 3
    claims_per_run: int = 12

    def run(self, g: Graph, topics: DataFrame) -> tuple[Graph, DataFrame, list[tuple[str, str]], DataFrame | None]:
        """The graph and the topics afterwards, (topic, status) of the worked ones, and the review's outcomes."""
        if self.generate and topics.where("status = 'pending'").count() < self.topics_per_run:
            topics = review.seed_topics(topics, self.generate(topics))[0]
        worked = []
        for _ in range(self.topics_per_run if self.curate else 0):
            topics, id_ = review.claim_next_topic(topics)
            if id_ is None:
                break
            row = topics.where(F.col("id") == id_).select("topic", "attempts").first()
            try:
                g, status, error = self.curate(g, row["topic"]), "done", None
            except Exception as e:  # whatever a model or a service raises ends this topic only
                error = str(e)
                status = after_failure(error, row["attempts"])
            topics = review.finish_topic(topics, id_, status, error)
            worked.append((id_, status))
        if self.judge is None:
            return g, topics, worked, None
        batch = review.review_batch(g, self.claims_per_run).select("id")
        outcomes = review.review_claims(g, batch, *self.judge(g, batch))
        return apply_review(g, outcomes), topics, worked, outcomes


def apply_review(g: Graph, outcomes: DataFrame) -> Graph:
    """The graph with the statuses and certainties that a review gave."""
    o = outcomes.select(F.col("claim").alias("_o"), F.col("status").alias("_status"), F.col("certainty").alias("_certainty"))
    rows = g.claim.join(o, F.col("id") == F.col("_o"), "left")
    put = {"status": F.coalesce("_status", "status"), "certainty": F.coalesce("_certainty", "certainty")}
    return g.with_(claim=rows.select(*[put.get(c, F.col(c)).alias(c) for c in g.claim.columns]))


def still_unmapped(g: Graph) -> DataFrame:
    """How many nodes of each type lack a code."""
    return unmapped(g).groupBy("type").agg(F.count("*").alias("n"))
