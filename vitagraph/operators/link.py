"""Record linkage: node resolution, title matching, vocabulary codes, duplicate edges.

Fuzzy joins are blocked: an equality branch on canonical names, and a token branch whose
candidates share a token.  No bare theta join is planned.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..graph import Graph

NODE_THRESHOLD = 0.82
TITLE_THRESHOLD = 0.6


def _forms(df: DataFrame, *ids: Column) -> DataFrame:
    """ids, type, canon for the name and each alias; empty ones are dropped."""
    all_ = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda f: F.coalesce(f, F.lit("")) != "")
    rows = df.select(*ids, "type", F.explode(all_).alias("form"))
    return rows.withColumn("canon", text.canonical(F.col("form"))).drop("form")


#: How many tokens make a key, by how many of its own the longer of two sets may have beyond those in common; one beyond these.
KEY_TOKENS = {0: 6, 1: 5, 2: 4, 3: 3, 4: 2, 5: 2, 6: 2}


def _shapes() -> list[tuple[int, int, list[int]]]:
    """The ways to take ``x`` tokens of the ``first`` ones of a set: (first, x, places), for all keys of more than one token."""
    return [(d + x, x, list(c)) for x in range(2, max(KEY_TOKENS.values()) + 1) for d in KEY_TOKENS if KEY_TOKENS[d] >= x for c in combinations(range(d + x), x)]


def _keyed(ranked: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """key, type, toks, n, m, picked: sets under each key that they may share with a set of m tokens, if ``other`` has any of that size."""
    small = 1e-9  # what rounding may add
    sizes = F.sequence(F.ceil(F.col("n") * threshold - small).cast("int"), F.floor(F.col("n") / threshold + small).cast("int"))
    there = F.broadcast(other.select(F.col("type").alias("_type"), F.size("toks").alias("_m")).distinct())  # types and sizes
    met = ranked.select("key", "type", "toks", "n", F.explode(sizes).alias("m")).join(there, (F.col("type") == F.col("_type")) & (F.col("m") == F.col("_m")), "left_semi")
    met = met.withColumn("need", F.ceil((F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - small).cast("int"))
    x = F.lit(1)
    for beyond, tokens in KEY_TOKENS.items():
        x = F.when(F.greatest("n", "m") - F.col("need") == beyond, tokens).otherwise(x)
    met = met.withColumn("x", F.least(x, "need")).withColumn("first", F.col("n") - F.col("need") + F.col("x"))
    shapes = F.broadcast(ranked.sparkSession.createDataFrame(_shapes(), "_first int, _x int, places array<int>"))
    many = met.join(shapes, (F.col("first") == F.col("_first")) & (F.col("x") == F.col("_x")))
    many = many.withColumn("picked", F.transform("places", lambda i: F.get("toks", i)))
    one = met.where("x = 1").withColumn("picked", F.explode(F.transform(F.slice("toks", F.lit(1), F.col("first")), lambda t: F.array(t))))
    cols = ["key", "type", "toks", "n", "m", "picked"]
    return many.select(cols).unionByName(one.select(cols))


def meetings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """l, l_toks, r, r_toks: rows of one type that share a key, among them all pairs of ``near_pairs``; a pair once for each key."""
    rows = left.select(F.lit(0).alias("side"), "key", "type", "toks").unionByName(right.select(F.lit(1).alias("side"), "key", "type", "toks"))
    each = rows.select("side", "key", "type", F.explode("toks").alias("tok"))
    often = each.groupBy("tok").agg(F.count("*").alias("often")).withColumnRenamed("tok", "_tok")
    ranked = each.join(often, F.col("tok") == F.col("_tok")).groupBy("side", "key", "type").agg(F.array_sort(F.collect_list(F.struct("often", "tok"))).alias("s"))
    ranked = ranked.withColumn("toks", F.transform("s", lambda x: x["tok"])).withColumn("n", F.size("s"))
    # the hash stands for the key: pairs that it brings together by chance are no near ones
    a = _keyed(ranked.where("side = 0"), right, threshold).select(F.xxhash64("type", "n", "m", "picked").alias("k"), F.col("type").alias("l_type"), F.col("key").alias("l"), F.col("toks").alias("l_toks"))
    b = _keyed(ranked.where("side = 1"), left, threshold).select(F.xxhash64("type", "m", "n", "picked").alias("_k"), F.col("type").alias("r_type"), F.col("key").alias("r"), F.col("toks").alias("r_toks"))
    return a.join(b, (F.col("k") == F.col("_k")) & (F.col("l_type") == F.col("r_type"))).select("l", "l_toks", "r", "r_toks")


def near_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """l, r, sim: the pairs of rows (key, type, toks) of one type whose token sets have a Jaccard of ``threshold`` or more.

    Sets of a and b tokens that are this similar share at least ``need(a, b)`` of them, so in any one order of
    tokens they share x among the first a - need + x of the one and the first b - need + x of the other, for
    every x up to need.  All choices of x of these tokens are the keys of a set.  The order is rarest first, and
    sizes are part of a key: a word that most names have joins nothing, nor does one that many have, as a key is
    as many tokens as keep their number small.  Empty sets are near nothing.
    """
    both = meetings(left, right, threshold)
    pairs = both.select("l", "r", text.jaccard(F.col("l_toks"), F.col("r_toks")).alias("sim")).where(F.col("sim") >= threshold)
    return pairs.distinct()


def best_nodes(names: DataFrame, nodes: DataFrame, threshold: float = NODE_THRESHOLD) -> DataFrame:
    """type, canon, best (minus score, ord, id, inexact) for the names (type, canon) that a node has or is near to.

    Each distinct name of a node is compared once: it stands for the first node that bears it, which wins
    all ties among them.  Ties between names: the first node.
    """
    n = _forms(nodes, F.col("ord"), F.col("id"))
    nt = n.groupBy(F.col("type").alias("n_type"), F.col("canon").alias("n_canon")).agg(F.min(F.struct("ord", "id")).alias("n"))
    ct = names.select(F.col("type").alias("c_type"), F.col("canon").alias("c_canon")).distinct()
    exact = ct.join(nt, (F.col("c_type") == F.col("n_type")) & (F.col("c_canon") == F.col("n_canon")))
    exact = exact.select("c_type", "c_canon", "n", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    keyed = lambda df, t, c: df.select(F.col(c).alias("key"), F.col(t).alias("type"), text.token_set(F.col(c)).alias("toks"))
    # the type goes along, as names of several types may be equal
    struct = lambda df: df.withColumn("key", F.struct("type", "key"))
    pairs = near_pairs(struct(keyed(ct, "c_type", "c_canon")), struct(keyed(nt, "n_type", "n_canon")), threshold)
    near = pairs.join(nt, (F.col("r.type") == F.col("n_type")) & (F.col("r.key") == F.col("n_canon")))
    near = near.select(F.col("l.type").alias("c_type"), F.col("l.key").alias("c_canon"), "n", F.col("sim").alias("score"), F.lit(False).alias("exact"))
    # the least is the best: by score, then the first node, then exact before not
    rank = F.struct((-F.col("score")).alias("minus"), F.col("n.ord"), F.col("n.id"), (~F.col("exact")).alias("inexact"))
    return exact.unionByName(near).groupBy(F.col("c_type").alias("type"), F.col("c_canon").alias("canon")).agg(F.min(rank).alias("best"))


def best_match(candidates: DataFrame, nodes: DataFrame, threshold: float = NODE_THRESHOLD) -> DataFrame:
    """cand_id, node_id, score, exact: the best node of the same type for each candidate, if any.

    ``candidates`` has cand_id, name, type, aliases; ``nodes`` has ord, id, name, type, aliases.
    Equal canonical names score 1; two names that both come out empty are equal too.  Else the
    score is the greatest Jaccard of token sets over all pairs of forms.  Ties: the first node.
    However many candidates bear a name, it is compared once.
    """
    c = _forms(candidates, F.col("cand_id"))
    best = best_nodes(c, nodes, threshold).withColumnsRenamed({"type": "c_type", "canon": "c_canon"})
    each = c.join(best, (F.col("type") == F.col("c_type")) & (F.col("canon") == F.col("c_canon")))
    top = each.groupBy("cand_id").agg(F.min("best").alias("best"))
    return top.select("cand_id", F.col("best.id").alias("node_id"), F.round(-F.col("best.minus"), 4).alias("score"), (~F.col("best.inexact")).alias("exact"))


def resolve_or_create(candidates: DataFrame, g: Graph, threshold: float = NODE_THRESHOLD) -> DataFrame:
    """cand_id, node_id, how: a known explicit id (column ``id``), else the best match, else a new node.

    Set-based: candidates see the nodes as they are, and candidates that would create a node of
    the same type and canonical name share the new one (the first by ``cand_id`` names it).
    """
    known = g.node.select(F.col("id").alias("_k"))
    by_id = candidates.join(known, F.col("id") == F.col("_k"), "left_semi").select("cand_id", F.col("id").alias("node_id"), F.lit("id").alias("how"))
    rest = candidates.join(by_id.select(F.col("cand_id").alias("_c")), F.col("cand_id") == F.col("_c"), "left_anti")
    matched = best_match(rest, g.node, threshold).select("cand_id", "node_id", F.lit("match").alias("how"))
    new = rest.join(matched.select(F.col("cand_id").alias("_c")), F.col("cand_id") == F.col("_c"), "left_anti")
    new = new.withColumn("_canon", text.canonical(F.col("name")))
    first = F.first("name").over(Window.partitionBy("type", "_canon").orderBy("cand_id"))
    new = new.withColumn("_first", first).select("cand_id", text.node_id(F.col("_first")).alias("node_id"), F.lit("new").alias("how"))
    return by_id.unionByName(matched).unionByName(new)


def best_title(wanted: DataFrame, candidates: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """want_id, id, title, score: the candidate whose title is most similar, the first on ties.

    ``wanted`` has want_id, title; ``candidates`` has want_id (whom it was found for), ord, id, title.
    """
    w = wanted.select("want_id", text.token_set(text.canonical(F.col("title"))).alias("w_toks")).where(F.size("w_toks") >= 2)
    c = candidates.withColumn("c_toks", text.token_set(text.canonical(F.col("title"))))
    both = c.join(w, "want_id").withColumn("score", F.round(text.title_similarity(F.col("w_toks"), F.col("c_toks")), 4))
    rank = F.row_number().over(Window.partitionBy("want_id").orderBy(F.desc("score"), "ord"))
    return both.where(F.col("score") >= threshold).withColumn("rn", rank).where("rn = 1").select("want_id", "id", "title", "score")


def resolve_citations(wanted: DataFrame, pubmed: DataFrame, crossref: DataFrame) -> DataFrame:
    """want_id, source_id, matched_title, score, via: from PubMed records if one matches, else Crossref.

    ``pubmed``: want_id, ord, pmid, title, pubtypes; ``crossref``: want_id, ord, doi, title, type.
    Errata and records that are no articles are left out.
    """
    none = F.array().cast("array<string>")
    p = pubmed.where(~text.is_erratum(F.col("title"), F.col("pubtypes"))).select("want_id", "ord", F.col("pmid").alias("id"), "title")
    c = crossref.where(~text.is_erratum(F.col("title"), none) & ~text.is_artifact(F.col("doi"), F.col("type")))
    c = c.select("want_id", "ord", F.col("doi").alias("id"), "title")
    first = best_title(wanted, p).select("want_id", F.concat(F.lit("PMID:"), "id").alias("source_id"), F.col("title").alias("matched_title"), "score", F.lit("pubmed").alias("via"))
    second = best_title(wanted, c).select("want_id", F.col("id").alias("source_id"), F.col("title").alias("matched_title"), "score", F.lit("crossref").alias("via"))
    return first.unionByName(second.join(first.select("want_id"), "want_id", "left_anti"))


# Fixed vocabularies that nodes of a type are looked up in, in order.
TARGETS = {
    "disease": ("MONDO", "MESH"),
    "symptom": ("HP", "MESH"),
    "outcome": ("MESH",),
    "intervention": ("MESH",),
    "exercise": ("MESH",),
    "nutrition": ("CHEBI", "FOODON", "MESH"),
    "drug": ("RXNORM", "CHEBI", "MESH"),
    "mechanism": ("GO", "MESH"),
    "scale": ("MESH",),
    "tool": ("MESH",),
    "technology": ("MESH",),
    "organization": ("ROR",),
    "expert": ("ORCID",),
}


def unmapped(g: Graph) -> DataFrame:
    """Nodes of a type with vocabularies and without any code."""
    return g.node.where(F.col("type").isin(*TARGETS) & (F.size(F.coalesce("external_ids", F.array().cast("array<string>"))) == 0))


def unmapped_report(g: Graph, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(items in the vocabulary's order of types, then by name; counts by type)."""
    rows = unmapped(g)
    order = g.vocab.where("vocab = 'nodeTypes'").select(F.col("value").alias("_v"), "ordinal")
    items = rows.join(F.broadcast(order), F.col("type") == F.col("_v"), "left").orderBy("ordinal", "name", "id")
    by_type = rows.groupBy("type").agg(F.count("*").alias("n"))
    return items.limit(max(1, min(2000, limit))).select("ordinal", "id", "type", "name"), by_type


def resolve_codes(nodes: DataFrame, terms: DataFrame, again: bool = False) -> DataFrame:
    """id, external_ids after looking up ``terms`` (prefix, ord, curie, labels) by label equality.

    One code for each target vocabulary of the node's type: an existing one is kept unless
    ``again``; a miss keeps what was there.  Codes of other vocabularies come first.
    """
    none = F.array().cast("array<string>")
    targets = F.coalesce(F.create_map(*[x for k, v in TARGETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("type")], none)
    base = nodes.select("id", "type", F.coalesce("external_ids", none).alias("codes"), text.name_variants(F.col("name"), F.coalesce("aliases", none)).alias("names"), targets.alias("targets"))
    each = base.select("id", F.posexplode("targets").alias("slot", "prefix"), "codes", "names")
    have = F.filter("codes", lambda c: F.upper(F.substring_index(c, ":", 1)) == F.col("prefix"))
    each = each.withColumn("have", have)
    ask = each if again else each.where(F.size("have") == 0)
    names = ask.select("id", "slot", "prefix", F.explode(F.array_distinct(F.transform("names", text.norm_term))).alias("norm")).where("norm <> ''")
    labels = terms.select("prefix", F.col("ord").alias("t_ord"), "curie", F.explode(F.array_distinct(F.transform("labels", text.norm_term))).alias("norm"))
    found = names.join(labels, ["prefix", "norm"]).groupBy(F.col("id").alias("_f"), F.col("slot").alias("_s")).agg(F.min_by("curie", "t_ord").alias("curie"))
    all_ = each.join(found, (F.col("id") == F.col("_f")) & (F.col("slot") == F.col("_s")), "left")
    code = F.when(F.col("curie").isNotNull(), F.array("curie")).otherwise(F.col("have"))
    made = all_.groupBy(F.col("id").alias("_m")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", code.alias("c")))), lambda x: x["c"])).alias("made"))
    other = F.filter("codes", lambda c: ~F.array_contains("targets", F.upper(F.substring_index(c, ":", 1))))
    out = base.join(made, F.col("id") == F.col("_m"), "left")
    return out.select("id", text.merge_codes(other, F.coalesce("made", none)).alias("external_ids"))


# --- duplicate edges ---------------------------------------------------------


def _edge_key() -> list[Column]:
    return [F.col("subject"), F.col("object"), F.col("type"), F.col("direction")]


def duplicate_groups(g: Graph) -> DataFrame:
    """subject, object, type, direction, n: edges that more than one claim states; a null direction is a value."""
    return g.claim.groupBy(*_edge_key()).agg(F.count("*").alias("n")).where("n > 1")


def keepers(g: Graph) -> DataFrame:
    """dup, keeper: each other claim of a duplicate group, and the one that stays: curated first, then oldest."""
    w = Window.partitionBy(*_edge_key()).orderBy((F.col("status") == "curated").desc_nulls_last(), F.col("created_at").asc_nulls_last(), "id")
    rows = g.claim.withColumn("keeper", F.first("id").over(w))
    return rows.where("id <> keeper").select(F.col("id").alias("dup"), "keeper")


def _moves(g: Graph, merged: DataFrame) -> DataFrame:
    """Evidence of duplicates: id, keeper, on_keeper (its source is cited there already), nth with that source."""
    ev = g.evidence.join(merged, F.col("claim") == F.col("dup")).select("id", "claim", "ev_ord", "source_id", "keeper")
    have = g.evidence.select(F.col("claim").alias("_c"), F.col("source_id").alias("_s")).distinct()
    ev = ev.join(have, (F.col("keeper") == F.col("_c")) & (F.col("source_id") == F.col("_s")), "left")
    nth = F.row_number().over(Window.partitionBy("keeper", "source_id").orderBy("claim", "ev_ord", "id"))
    return ev.withColumn("on_keeper", F.col("_c").isNotNull()).withColumn("nth", nth).select("id", "keeper", "source_id", "on_keeper", "nth")


def dedup_summary(g: Graph, apply: bool = False) -> DataFrame:
    """One row of counts.  A dry run compares with the keeper only; applied, the first of a source moves."""
    merged = keepers(g)
    gone = F.col("on_keeper") | (F.col("nth") > 1) if apply else F.col("on_keeper")
    moves = _moves(g, merged).agg(F.count_if(~gone).alias("evidence_moved"), F.count_if(gone).alias("evidence_dropped"))
    groups = merged.agg(F.countDistinct("keeper").alias("duplicate_groups"), F.count("*").alias("claims_deleted"))
    return groups.crossJoin(moves)


def dedup_apply(g: Graph) -> Graph:
    """The graph with duplicate edges merged into their keepers."""
    merged = keepers(g)
    moves = _moves(g, merged)
    dropped = moves.where("on_keeper or nth > 1").select(F.col("id").alias("_x"))
    moved = moves.where("not on_keeper and nth = 1").select(F.col("id").alias("_x"), "keeper")
    last = g.evidence.groupBy(F.col("claim").alias("_k")).agg(F.max("ev_ord").alias("last"))
    names = g.evidence.columns
    ev = g.evidence.join(dropped, F.col("id") == F.col("_x"), "left_anti").join(moved, F.col("id") == F.col("_x"), "left").join(last, F.col("keeper") == F.col("_k"), "left")
    nth = F.row_number().over(Window.partitionBy("keeper").orderBy("claim", "ev_ord", "id"))
    ev = ev.withColumn("_nth", F.when(F.col("keeper").isNotNull(), nth))
    ev = ev.withColumn("ev_ord", F.when(F.col("keeper").isNotNull(), F.coalesce("last", F.lit(0)) + F.col("_nth")).otherwise(F.col("ev_ord")))
    ev = ev.withColumn("claim", F.coalesce("keeper", "claim")).select(names)
    rel = g.relation
    for c in ("subject_claim", "object_claim"):
        m = merged.select(F.col("dup").alias("_d"), F.col("keeper").alias("_to"))
        rel = rel.join(m, F.col(c) == F.col("_d"), "left").withColumn(c, F.coalesce("_to", c)).drop("_d", "_to")
    rel = rel.where("subject_claim <> object_claim")
    claim = g.claim.join(merged.select(F.col("dup").alias("_d")), F.col("id") == F.col("_d"), "left_anti")
    from ..graph import listed_from

    return g.with_(claim=claim, evidence=ev, relation=rel, listed=listed_from(ev))


def existing_claims(candidates: DataFrame, g: Graph) -> DataFrame:
    """cand_id, claim: the claim that states a candidate's edge (subject, object, type, direction), if any."""
    c = g.claim.select("id", "status", "created_at", *[F.col(k).alias(f"_{k}") for k in ("subject", "object", "type", "direction")])
    same = [F.col(k) == F.col(f"_{k}") for k in ("subject", "object", "type")] + [F.col("direction").eqNullSafe(F.col("_direction"))]
    both = candidates.join(c, same)
    w = Window.partitionBy("cand_id").orderBy((F.col("status") == "curated").desc_nulls_last(), F.col("created_at").asc_nulls_last(), "id")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cand_id", F.col("id").alias("claim"))
