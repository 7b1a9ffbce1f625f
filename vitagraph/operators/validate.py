"""Validation rules: each gives rows (severity, entity, id, message); all are one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import is_curie
from ..graph import Graph

COLUMNS = ("rule", "severity", "entity", "id", "message")


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("undefined")) for p in parts])


def _rows(df: DataFrame, rule: str, severity: str, entity: str, message: Column, id_: str = "id") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(entity).alias("entity"), F.col(id_).alias("id"), message.alias("message"))


def _not_in(c: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def validate(g: Graph) -> DataFrame:
    """All problems of a graph."""
    lists = {r["vocab"]: tuple(r["v"]) for r in g.vocab.groupBy("vocab").agg(F.collect_list("value").alias("v")).collect()}
    words = {k: lists.get(k, ()) for k in schema.VOCABULARIES}
    n, c, e, r = g.node, g.claim, g.evidence, g.relation
    out = [_rows(n.where(_not_in("type", words["nodeTypes"])), "V1", "error", "node", _say("node ", F.col("id"), ": unknown type '", F.col("type"), "'"))]
    d = n.select("id", F.explode("domains").alias("d")).where(_not_in("d", words["domains"]))
    out.append(_rows(d, "V2", "warning", "node", _say("node ", F.col("id"), ": unknown domain '", F.col("d"), "'")))
    x = n.select("id", F.explode("external_ids").alias("x"))
    out.append(_rows(x.where(~is_curie(F.col("x"))), "V3", "error", "node", _say("node ", F.col("id"), ": malformed CURIE '", F.col("x"), "'")))
    x = x.where(is_curie(F.col("x"))).withColumn("p", F.substring_index("x", ":", 1)).where(_not_in("p", words["knownCuriePrefixes"]))
    out.append(_rows(x, "V3", "warning", "node", _say("node ", F.col("id"), ": unknown CURIE prefix in '", F.col("x"), "'")))
    bad = c.where(_not_in("type", words["relationshipTypes"]))
    out.append(_rows(bad, "V4", "error", "claim", _say("claim ", F.col("id"), ": unknown relationship type '", F.col("type"), "'")))
    # the four node references of every claim meet the nodes in one join
    refs = c.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(k).alias("ref")) for k in ("subject", "object", "population", "mechanism")])).alias("r"))
    refs = refs.select("id", "r.*").where("ref is not null")
    types = n.select(F.col("id").alias("_n"), F.col("type").alias("_type"))
    refs = refs.join(types, F.col("ref") == F.col("_n"), "left")
    out.append(_rows(refs.where("_n is null"), "V5", "error", "claim", _say("claim ", F.col("id"), ".", F.col("role"), ": references unknown node '", F.col("ref"), "'")))
    wrong = refs.where(F.col("role").isin("population", "mechanism") & (F.col("ref") != "") & ~F.col("role").eqNullSafe(F.col("_type")))
    out.append(_rows(wrong, "V6", "warning", "claim", _say("claim ", F.col("id"), ": ", F.col("role"), " '", F.col("ref"), "' is not a ", F.col("role"), " node")))
    for column, vocab in (("direction", "directions"), ("certainty", "certainties"), ("setting", "settings")):
        bad = c.where(_given(column) & _not_in(column, words[vocab]))
        out.append(_rows(bad, "V7", "error", "claim", _say("claim ", F.col("id"), f": bad {column} '", F.col(column), "'")))
    out.append(_rows(c.where(_not_in("status", words["statuses"])), "V7", "error", "claim", _say("claim ", F.col("id"), ": bad status '", F.col("status"), "'")))
    bad = c.where(_given("rec_strength") & ~F.col("type").eqNullSafe(F.lit("recommends")))
    out.append(_rows(bad, "V8", "error", "claim", _say("claim ", F.col("id"), ": rec_strength only allowed on 'recommends' claims")))
    listed = g.listed.select(F.col("claim").alias("_c"))
    bare = c.where((F.col("status") == "curated") & _not_in("type", words["definitionalRelationships"])).join(listed, F.col("id") == F.col("_c"), "left_anti")
    out.append(_rows(bare, "V9", "error", "claim", _say("claim ", F.col("id"), ": curated non-definitional claim has no evidence")))
    owner = e.select(F.col("id").alias("_e"), F.col("claim").alias("owner"))
    ev = g.listed.join(c.select(F.col("id").alias("_k")), F.col("claim") == F.col("_k"), "left_semi").join(owner, F.col("evidence") == F.col("_e"), "left")
    out.append(_rows(ev.where("_e is null"), "V10", "error", "claim", _say("claim ", F.col("claim"), ": references unknown evidence '", F.col("evidence"), "'"), "claim"))
    ev = ev.where(F.col("_e").isNotNull() & ~F.col("owner").eqNullSafe(F.col("claim")))
    out.append(_rows(ev, "V10", "error", "claim", _say("claim ", F.col("claim"), ": evidence '", F.col("evidence"), "' points to a different claim '", F.col("owner"), "'"), "claim"))
    ids = c.select(F.col("id").alias("_c"))
    bad = e.join(ids, F.col("claim") == F.col("_c"), "left_anti")
    out.append(_rows(bad, "V11", "error", "evidence", _say("evidence ", F.col("id"), ": references unknown claim '", F.col("claim"), "'")))
    bad = e.where(~is_curie(F.col("source_id")))
    out.append(_rows(bad, "V11", "error", "evidence", _say("evidence ", F.col("id"), ": source_id should be a CURIE (DOI:/PMID:/URL...), got '", F.col("source_id"), "'")))
    bad = e.where(_given("study_design") & _not_in("study_design", words["studyDesigns"]))
    out.append(_rows(bad, "V11", "error", "evidence", _say("evidence ", F.col("id"), ": bad study_design '", F.col("study_design"), "'")))
    out.append(_rows(e.where("confidence < 0 or confidence > 1"), "V11", "error", "evidence", _say("evidence ", F.col("id"), ": confidence out of [0,1]")))
    for side in ("subject_claim", "object_claim"):
        bad = r.join(ids, F.col(side) == F.col("_c"), "left_anti")
        out.append(_rows(bad, "V12", "error", "contradiction", _say("contradiction ", F.col("id"), ": unknown claim '", F.col(side), "'")))
    out.append(_rows(r.where("subject_claim = object_claim"), "V12", "error", "contradiction", _say("contradiction ", F.col("id"), ": self-contradiction")))
    return reduce(DataFrame.unionByName, out)


def candidate_errors(rows: DataFrame) -> DataFrame:
    """Adds ``errors``: problems of proposed claims (subject_name, subject_type, object_name, object_type,
    relationship, direction, certainty, citation_title)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        F.when(blank("subject_name"), "subject.name missing"),
        F.when(blank("object_name"), "object.name missing"),
        F.when(_not_in("subject_type", schema.NODE_TYPES), _say("bad subject.type '", F.col("subject_type"), "'")),
        F.when(_not_in("object_type", schema.NODE_TYPES), _say("bad object.type '", F.col("object_type"), "'")),
        F.when(_not_in("relationship", schema.RELATIONSHIPS), _say("bad relationship '", F.col("relationship"), "'")),
        F.when(_given("direction") & _not_in("direction", schema.DIRECTIONS), _say("bad direction '", F.col("direction"), "'")),
        F.when(_given("certainty") & _not_in("certainty", schema.CERTAINTIES), _say("bad certainty '", F.col("certainty"), "'")),
        F.when(
            F.length(F.trim(F.coalesce("citation_title", F.lit("")))) < 8, "citation.title (the paper's full title) is required"
        ),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def contact_error(name: Column, email: Column, message: Column) -> Column:
    """The first problem of a contact message, or null.  Limits: 120, 160 and 4000 characters."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(t(message) == "", "message is required")
        .when(F.length(t(message)) > 4000, "message is too long (max 4000 characters)")
        .when(F.length(t(name)) > 120, "name is too long")
        .when(F.length(t(email)) > 160, "email is too long")
        .when((t(email) != "") & ~t(email).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email address looks invalid")
    )
