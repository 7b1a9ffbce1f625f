"""Resolution of a run's candidates in their order: each sees what those before it became.

A candidate with the id of a node that is there, or was made before it, is that node.  Else it joins
the node with the most similar name or alias, and its name becomes an alias of it; else it becomes a
node of its own, a leader.  Taken one by one that is a loop over all candidates.  Here it is done in
rounds: a candidate can be decided as soon as all earlier ones are that it is similar to, or that may
make a node of its id.  Of these the earliest undecided one never has to wait, so each round decides
some, and candidates without anything in common all in one round.  There are as many rounds as the
longest chain of candidates has members of which each must wait for the one before: few, but for
runs whose names drift step by step.

Of candidates without an id that bear one name only the first two are looked at; the others become what these do.
Names of one type with the same set of tokens are one class.  Whatever its first member becomes all
others do, however many there are, so only classes are joined, by ``near_pairs``.

Edge cases: blank ids are none; ids that are no CURIE are known or of no account; names that come out
empty are equal within their type; a new node whose id is taken goes by that id and adds nothing; a
repeated candidate joins its first one; without candidates nothing happens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..graph import Graph, conform
from ..runtime import keeping, materialize, ship
from ..schema import NODE
from .link import NODE_THRESHOLD, best_nodes, near_pairs
from .writes import placed_after


@dataclass(frozen=True)
class Resolution:
    """``found``: cand_id, node_id, how (id, match or new); ``nodes``: pos, id, name, type of new ones;
    ``aliases``: id, pos, alias of new names for nodes, in the order in which they were met."""

    found: DataFrame
    nodes: DataFrame
    aliases: DataFrame


def _place(kind: Column, pos: Column) -> Column:
    """Where an entry stands: nodes that were there first (0), then leaders (1)."""
    return F.struct(kind.cast("int").alias("kind"), pos.cast("long").alias("pos"))


def _classes(candidates: DataFrame) -> DataFrame:
    """Candidates (cand_id, pos, id, name, type) with canon, toks, cls, given (id) and would (the id of a node it makes)."""
    given = F.when(F.trim(F.coalesce("id", F.lit(""))) != "", F.trim("id"))
    rows = candidates.select("cand_id", F.col("pos").cast("long").alias("pos"), given.alias("given"), "name", "type")
    rows = rows.withColumn("canon", text.canonical(F.col("name"))).withColumn("toks", F.array_sort(text.token_set(F.col("canon"))))
    rows = rows.withColumn("cls", F.concat_ws("\u0001", "type", F.array_join("toks", " ")))
    return rows.withColumn("would", F.when(text.is_curie(F.col("given")), F.col("given")).otherwise(text.node_id(F.col("name"))))


def _some_of_each(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, type, pos of the first candidate of each name without an id, and the candidates that tell what all become.

    These are those with ids, and the first two of each name: all of a name are one node, made by the first at most, and
    the second is the first that may bring an alias.
    """
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    plain = candidates.where(blank).select(F.col("pos").cast("long").alias("pos"), "name", "type")
    first = materialize(plain.groupBy("name", "type").agg(F.min("pos").alias("pos")), "first-of-names")
    again = first.select(F.col("name").alias("_n"), F.col("type").alias("_t"), F.col("pos").alias("_p"))
    same = F.col("name").eqNullSafe(F.col("_n")) & F.col("type").eqNullSafe(F.col("_t"))
    second = plain.join(again, same).where("pos > _p").groupBy("name", "type").agg(F.min("pos").alias("pos"))
    at = first.select("pos").unionByName(second.select("pos")).select(F.col("pos").alias("_at"))
    return first, candidates.where(~blank).unionByName(candidates.where(blank).join(at, F.col("pos") == F.col("_at"), "left_semi"))


def _found(candidates: DataFrame, first: DataFrame, resolved: DataFrame) -> DataFrame:
    """cand_id, node_id, how of all candidates, from those that were resolved."""
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    led = first.join(resolved.select(F.col("pos").alias("_pos"), "node_id", F.col("how").alias("_how")), F.col("pos") == F.col("_pos"))
    led = led.select(F.col("name").alias("_n"), F.col("type").alias("_t"), "_pos", "node_id", "_how")
    same = F.col("name").eqNullSafe(F.col("_n")) & F.col("type").eqNullSafe(F.col("_t"))
    plain = candidates.where(blank).join(led, same).select("cand_id", "node_id", F.when(F.col("pos") == F.col("_pos"), F.col("_how")).otherwise("match").alias("how"))
    own = candidates.where(~blank).select(F.col("pos").cast("long").alias("_own"))
    return plain.unionByName(resolved.join(own, F.col("pos") == F.col("_own"), "left_semi").select("cand_id", "node_id", "how"))


def resolve_in_order(candidates: DataFrame, g: Graph, threshold: float = NODE_THRESHOLD) -> Resolution:
    """Candidates (cand_id, pos, id, name, type), ``pos`` without ties, resolved as if one by one in order of ``pos``."""
    ship(candidates.sparkSession)
    with keeping() as kept:
        opening, some = _some_of_each(candidates)
        rows = materialize(_classes(some), "candidates")
        there = g.node.groupBy(F.col("id").alias("_id")).agg(F.min("ord").alias("_ord"))
        asked = rows.where(F.col("given").isNotNull()).select("cand_id", "given").join(there, F.col("given") == F.col("_id")).select(F.col("cand_id").alias("_c"))
        asked = materialize(asked, "known-ids")
        free = materialize(rows.join(asked, F.col("cand_id") == F.col("_c"), "left_anti"), "candidates")
        decided = _rounds(free, g, there, threshold)
        # every candidate by the id that it names, if there is or was such a node, else by its class
        first = decided.where("lead").groupBy(F.col("node_id").alias("_made")).agg(F.min("since").alias("_since"))
        all_ = rows.join(asked, F.col("cand_id") == F.col("_c"), "left").join(first, F.col("given") == F.col("_made"), "left")
        by_id = F.col("_c").isNotNull() | F.coalesce(F.col("_since") < F.col("pos"), F.lit(False))
        by_class = decided.select(F.col("cls").alias("_cls"), "since", F.col("node_id").alias("_node"), "lead")
        all_ = all_.withColumn("_by_id", by_id).join(by_class, F.col("cls") == F.col("_cls"), "left")
        how = F.when(F.col("_by_id"), "id").when(F.col("lead") & (F.col("since") == F.col("pos")), "new").otherwise("match")
        all_ = all_.select("cand_id", "pos", "name", "type", "canon", F.when(F.col("_by_id"), F.col("given")).otherwise(F.col("_node")).alias("node_id"), how.alias("how"))
        all_ = materialize(all_, "resolved")
        made = all_.where("how = 'new'").groupBy(F.col("node_id").alias("id")).agg(F.min_by(F.struct("pos", "name", "type"), "pos").alias("r")).select("r.pos", "id", "r.name", "r.type")
        made = materialize(made.join(there, F.col("id") == F.col("_id"), "left_anti"), "new-nodes")
        # of new names with one canonical form the first counts, unless the node has that form
        names = all_.where("how = 'match' and trim(name) <> ''").groupBy(F.col("node_id").alias("id"), "canon").agg(F.min_by(F.struct("pos", "name"), "pos").alias("r"))
        own = g.node.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("form")).unionByName(made.select("id", F.col("name").alias("form")))
        own = own.join(names.select(F.col("id").alias("_n")).distinct(), F.col("id") == F.col("_n"), "left_semi")
        own = own.select(F.col("id").alias("_i"), text.canonical(F.col("form")).alias("_f"))
        aliases = names.join(own, (F.col("id") == F.col("_i")) & (F.col("canon") == F.col("_f")), "left_anti").select("id", "r.pos", F.trim("r.name").alias("alias"))
        aliases = materialize(aliases, "new-aliases")
        found = materialize(_found(candidates, opening, all_), "found-nodes")
        kept += [found, made, aliases]
    return Resolution(found, made, aliases)


def _rounds(free: DataFrame, g: Graph, there: DataFrame, threshold: float) -> DataFrame:
    """cls, since (the place of the member that decides), node_id, lead, place, home (where the first entry of the id stands)."""
    # who may open a class: members with an id of their own until the first one without
    plain = free.where("given is null").groupBy("cls").agg(F.min("pos").alias("_plain")).withColumnRenamed("cls", "_k")
    opens = free.groupBy("cls", "given").agg(F.min_by(F.struct("pos", "given", "name", "would"), "pos").alias("o")).join(plain, F.col("cls") == F.col("_k"), "left")
    opens = opens.where(F.col("_plain").isNull() | (F.col("o.pos") <= F.col("_plain")))
    classes = opens.groupBy("cls").agg(F.array_sort(F.collect_list("o")).alias("openers"))
    some = free.groupBy("cls").agg(F.min(F.struct("type", "canon", "toks")).alias("s")).select("cls", "s.*")
    classes = materialize(classes.join(some, "cls"), "classes")
    ids = materialize(classes.select("cls", F.explode(F.array_distinct(F.transform("openers", lambda o: o["would"]))).alias("would")), "ids")
    best = best_nodes(classes, g.node, threshold).withColumnsRenamed({"type": "_type", "canon": "_canon"})
    old = classes.join(best, (F.col("type") == F.col("_type")) & (F.col("canon") == F.col("_canon")))
    old = materialize(old.select(F.col("cls").alias("a"), F.col("best.minus").alias("minus"), _place(F.lit(0), F.col("best.ord")).alias("place"), F.col("best.id").alias("id")), "near-nodes")
    sets = classes.select(F.col("cls").alias("key"), "type", "toks")
    edges = materialize(near_pairs(sets, sets, threshold).where("l <> r").select(F.col("l").alias("a"), F.col("r").alias("b"), "sim"), "near-names")
    due = materialize(classes.select("cls", F.lit(0).alias("turn"), "openers"), "undecided")
    decided = None
    while not due.isEmpty():
        now = due.select("cls", "turn", "openers", F.col("openers")[F.col("turn")].alias("o")).select("cls", "turn", "openers", "o.*")
        at = lambda k, p: now.select(F.col("cls").alias(k), F.col("pos").alias(p))
        waits = edges.join(at("_a", "_pa"), F.col("a") == F.col("_a")).join(at("_b", "_pb"), F.col("b") == F.col("_b")).where("_pb < _pa").select("_a")
        earliest = ids.join(at("_a", "_pa"), F.col("cls") == F.col("_a")).groupBy(F.col("would").alias("_would")).agg(F.min("_pa").alias("_least"))
        waits = waits.unionByName(now.join(earliest, F.col("would") == F.col("_would")).where("_least < pos").select(F.col("cls").alias("_a"))).distinct()
        ready = materialize(now.join(waits, F.col("cls") == F.col("_a"), "left_anti"), "ready")
        if decided is None:
            decided = materialize(ready.limit(0).select("cls", F.col("pos").alias("since"), F.col("would").alias("node_id"), F.lit(True).alias("lead"), _place(F.lit(0), F.col("pos")).alias("place"), _place(F.lit(0), F.col("pos")).alias("home")), "decided")
        leaders = decided.where("lead").groupBy(F.col("node_id").alias("_made")).agg(F.min("since").alias("_since"))
        named = ready.join(leaders, F.col("given") == F.col("_made")).where("_since < pos").select(F.col("cls").alias("_x"))
        opening = ready.join(named, F.col("cls") == F.col("_x"), "left_anti")
        near = edges.join(decided, F.col("b") == F.col("cls")).select("a", (-F.col("sim")).alias("minus"), "place", F.col("node_id").alias("id"), "home", "since")
        near = opening.join(near, (F.col("cls") == F.col("a")) & (F.col("since") < F.col("pos"))).select("a", "minus", "place", "id", "home")
        options = near.unionByName(old.withColumn("home", F.col("place")))
        chosen = options.groupBy("a").agg(F.min(F.struct("minus", "place", "id", "home")).alias("best"))
        made = opening.join(chosen, F.col("cls") == F.col("a"), "left").join(there, F.col("would") == F.col("_id"), "left").join(leaders, F.col("would") == F.col("_made"), "left")
        lead = F.col("a").isNull()
        own = _place(F.lit(1), F.col("pos"))
        home = F.when(F.col("_ord").isNotNull(), _place(F.lit(0), F.col("_ord"))).when(F.col("_since").isNotNull(), _place(F.lit(1), F.col("_since"))).otherwise(own)
        made = made.select(
            "cls", F.col("pos").alias("since"), F.coalesce("best.id", "would").alias("node_id"), lead.alias("lead"),
            F.when(lead, own).otherwise(F.col("best.home")).alias("place"), F.when(lead, home).otherwise(F.col("best.home")).alias("home"),
        )
        decided = materialize(decided.unionByName(made), "decided")
        later = ready.join(named, F.col("cls") == F.col("_x"), "left_semi").where(F.col("turn") + 1 < F.size("openers")).select("cls", (F.col("turn") + 1).alias("turn"), "openers")
        rest = due.join(ready.select(F.col("cls").alias("_r")), F.col("cls") == F.col("_r"), "left_anti")
        due = materialize(rest.unionByName(later), "undecided")
    return decided if decided is not None else materialize(classes.select("cls", F.lit(0).cast("long").alias("since"), F.col("cls").alias("node_id"), F.lit(True).alias("lead"), _place(F.lit(0), F.lit(0)).alias("place"), _place(F.lit(0), F.lit(0)).alias("home")), "decided")


def fold_aliases(g: Graph, aliases: DataFrame) -> Graph:
    """Nodes with new aliases (id, alias), but those that equal the name or an alias but for case; sorted."""
    more = aliases.groupBy(F.col("id").alias("_a")).agg(F.collect_set("alias").alias("_more"))
    names = g.node.columns
    rows = g.node.join(more, F.col("id") == F.col("_a"), "left")
    lower = F.transform(F.concat(F.array("name"), "aliases"), F.lower)
    new = F.filter("_more", lambda a: ~F.array_contains(F.col("_lower"), F.lower(a)) & (a != ""))
    rows = rows.withColumn("_lower", lower).withColumn("_new", F.coalesce(new, F.array().cast("array<string>")))
    merged = F.when(F.size("_new") > 0, F.array_sort(F.array_distinct(F.concat("aliases", "_new")))).otherwise(F.col("aliases"))
    return g.with_(node=rows.withColumn("aliases", merged).select(names))


def grown(g: Graph, r: Resolution) -> Graph:
    """The graph with a run's new nodes, in their order, and aliases."""
    new = conform(placed_after(g.node, r.nodes, "pos"), NODE)
    return fold_aliases(g.with_(node=g.node.unionByName(new)), r.aliases)
