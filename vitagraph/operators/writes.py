"""Writes as copy-on-write transforms: tables in, new tables out.

A batch of inputs is validated row by row in columns; good rows go in, and every input has
a result with its errors.  Nothing is read and overwritten in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schema
from ..functions.text import is_curie, paper_node
from ..graph import Graph, conform, listed_from
from ..runtime import in_order

EVIDENCE_INPUT = T.ArrayType(
    T.StructType([T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in ("source_id", "source_node", "quote", "study_design", "confidence", "extracted_by")])
)


# Fixed texts of errors, as callers of the write operations know them, stand in the checks below.


def _in(c: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _errors(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def _known(df: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    k = ids.select(F.col("id").alias("_k")).distinct()
    return df.join(k, F.col(column) == F.col("_k"), "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def _first_of_batch(df: DataFrame) -> Column:
    """True for rows of a batch whose id came before in it."""
    return F.row_number().over(Window.partitionBy("id").orderBy("row")) > 1


def check_nodes(g: Graph, rows: DataFrame) -> DataFrame:
    """Inputs (row, id, type, name, ...) with ``status`` 200, 400 or 409 and ``errors``."""
    rows = rows.withColumn("id", F.trim("id")).withColumn("name", F.trim("name"))
    ext = F.coalesce("external_ids", F.array().cast("array<string>"))
    bad = F.transform(F.filter(ext, lambda c: ~is_curie(c)), lambda c: F.concat(F.lit("malformed CURIE '"), c, F.lit("'")))
    made = F.concat(
        _errors(
            F.when(~_given("id"), "id is required"),
            F.when(~_in("type", schema.NODE_TYPES), "type must be one of: " + ", ".join(schema.NODE_TYPES)),
            F.when(~_given("name"), "name is required"),
        ),
        bad,
    )
    rows = _known(rows.withColumn("errors", made), g.node, "id", "_there")
    taken = F.col("_there") | _first_of_batch(rows)
    return _finish(rows, [(taken, 409, F.concat(F.lit("node '"), "id", F.lit("' already exists")))])


def _finish(rows: DataFrame, later: list[tuple[Column, int, Column]]) -> DataFrame:
    """Status and errors: the input's own problems first, else the first of the later checks."""
    own = F.size("errors") > 0
    status, errors = F.lit(200), F.array().cast("array<string>")
    for test, code, message in reversed(later):
        status, errors = F.when(test, code).otherwise(status), F.when(test, F.array(message)).otherwise(errors)
    return rows.withColumn("status_code", F.when(own, 400).otherwise(status)).withColumn("errors", F.when(own, F.col("errors")).otherwise(errors))


def placed_after(table: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """New rows with ``ord``: the places after the last one of the table, in the order given."""
    top = table.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).first()["m"]
    return in_order(new.drop("ord"), *map(F.col, order), name="_nth").withColumn("ord", F.lit(top) + F.col("_nth")).drop("_nth")


def create_nodes(g: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    checked = check_nodes(g, rows)
    good = placed_after(g.node, checked.where("status_code = 200"), "row")
    return g.with_(node=g.node.unionByName(conform(good, schema.NODE))), checked


def check_claims(g: Graph, rows: DataFrame, update: bool = False) -> DataFrame:
    """Inputs (row, id, type, subject, object, ..., evidence).  An update asks for an existing claim and
    checks neither the evidence rule nor the population and mechanism."""
    rows = rows.withColumn("id", F.trim("id"))
    rows = rows.withColumn("status", F.coalesce("status", F.lit("curated")))
    n_ev = F.coalesce(F.size("evidence"), F.lit(0)) if "evidence" in rows.columns else F.lit(0)
    n_ev = F.greatest(n_ev, F.lit(0))
    own = [
        F.when(~_given("id"), "id is required"),
        F.when(~_in("type", schema.RELATIONSHIPS), "type must be one of: " + ", ".join(schema.RELATIONSHIPS)),
        F.when(~_in("status", schema.STATUSES), "status must be one of: " + ", ".join(schema.STATUSES)),
    ]
    for c, values in (("direction", schema.DIRECTIONS), ("certainty", schema.CERTAINTIES), ("setting", schema.SETTINGS)):
        own.append(F.when(_given(c) & ~_in(c, values), F.concat(F.lit(f"bad {c} '"), c, F.lit("'"))))
    own.append(F.when(_given("rec_strength") & (F.col("type") != "recommends"), "rec_strength only allowed on 'recommends' claims"))
    if not update:
        bare = (F.col("status") == "curated") & ~_in("type", schema.DEFINITIONAL) & (n_ev == 0)
        own.append(F.when(bare, "a curated, non-definitional claim needs at least one evidence record"))
    rows = rows.withColumn("errors", _errors(*own))
    roles = ("subject", "object") if update else ("subject", "object", "population", "mechanism")
    later = []
    for role in roles:
        rows = _known(rows, g.node, role, f"_{role}")
        asked = F.lit(True) if role in ("subject", "object") else _given(role)
        later.append((asked & ~F.col(f"_{role}"), 400, F.concat(F.lit(f"{role} node '"), F.coalesce(role, F.lit("")), F.lit("' does not exist"))))
    rows = _known(rows, g.claim, "id", "_there")
    if update:
        later.insert(0, (~F.col("_there"), 404, F.concat(F.lit("claim '"), "id", F.lit("' not found"))))
    else:
        later.append((F.col("_there") | _first_of_batch(rows), 409, F.concat(F.lit("claim '"), "id", F.lit("' already exists"))))
        if "evidence" in rows.columns:
            odd = F.exists(F.coalesce("evidence", F.array().cast(EVIDENCE_INPUT)), lambda e: ~is_curie(e["source_id"]))
            later.append((odd, 400, F.lit("each evidence needs a CURIE source_id (DOI:/PMID:/URL)")))
    return _finish(rows, later)


def create_claims(g: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Claims with their evidence, whose ids are ``<claim>-e1``, ``-e2``, and so on."""
    checked = check_claims(g, rows)
    good = placed_after(g.claim, checked.where("status_code = 200"), "row")
    claim = g.claim.unionByName(conform(good, schema.CLAIM))
    if "evidence" not in rows.columns:
        return g.with_(claim=claim), checked
    ev = good.select(F.col("id").alias("claim"), F.posexplode("evidence").alias("i", "e")).select("claim", "i", "e.*")
    ev = ev.withColumn("id", F.concat("claim", F.lit("-e"), F.col("i") + 1)).withColumn("ev_ord", (F.col("i") + 1).cast("long"))
    ev = conform(ev.withColumn("extracted_by", F.coalesce("extracted_by", F.lit("human"))), schema.EVIDENCE)
    return g.with_(claim=claim, evidence=g.evidence.unionByName(ev), listed=g.listed.unionByName(listed_from(ev))), checked


def create_evidence(g: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Single evidence records (row, id, claim, source_id, ...)."""
    rows = rows.withColumn("id", F.trim("id"))
    own = _errors(
        F.when(~_given("id"), "id is required"),
        F.when(~_given("claim"), "claim is required"),
        F.when(~is_curie(F.col("source_id")), "source_id must be a CURIE (DOI:/PMID:/URL)"),
        F.when(_given("study_design") & ~_in("study_design", schema.DESIGNS), F.concat(F.lit("bad study_design '"), "study_design", F.lit("'"))),
    )
    rows = _known(_known(rows.withColumn("errors", own), g.claim, "claim", "_claim"), g.evidence, "id", "_there")
    checked = _finish(
        rows,
        [
            (~F.col("_claim"), 400, F.concat(F.lit("claim '"), "claim", F.lit("' does not exist"))),
            (F.col("_there") | _first_of_batch(rows), 409, F.concat(F.lit("evidence '"), "id", F.lit("' already exists"))),
        ],
    )
    good = checked.where("status_code = 200")
    last = g.evidence.groupBy(F.col("claim").alias("_c")).agg(F.max("ev_ord").alias("last"))
    nth = F.row_number().over(Window.partitionBy("claim").orderBy("row"))
    good = good.join(last, F.col("claim") == F.col("_c"), "left").withColumn("ev_ord", F.coalesce("last", F.lit(0)) + nth)
    new = conform(good, schema.EVIDENCE)
    return g.with_(evidence=g.evidence.unionByName(new), listed=g.listed.unionByName(listed_from(new))), checked


def _overwrite(table: DataFrame, good: DataFrame, to: T.StructType, keep: tuple[str, ...]) -> DataFrame:
    """Rows of ``table`` replaced by those of ``good`` with the same id; ``keep`` stays as it was."""
    old = table.select(F.col("id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in keep])
    new = good.drop(*keep).join(old, F.col("id") == F.col("_i"))
    for c in keep:
        new = new.withColumn(c, F.col(f"_{c}"))
    rest = table.join(good.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    return rest.unionByName(conform(new, to))


def update_nodes(g: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Full overwrite: what an input lacks becomes null or empty."""
    own = _errors(
        F.when(~_in("type", schema.NODE_TYPES), "type must be one of: " + ", ".join(schema.NODE_TYPES)),
        F.when(~_given("name"), "name is required"),
    )
    rows = _known(rows.withColumn("errors", own), g.node, "id", "_there")
    checked = _finish(rows, [(~F.col("_there"), 404, F.concat(F.lit("node '"), "id", F.lit("' not found")))])
    return g.with_(node=_overwrite(g.node, checked.where("status_code = 200"), schema.NODE, ("ord", "created_at"))), checked


def update_claims(g: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    checked = check_claims(g, rows, update=True)
    return g.with_(claim=_overwrite(g.claim, checked.where("status_code = 200"), schema.CLAIM, ("ord", "created_at"))), checked


def _ids(g: Graph, ids: list[str] | DataFrame) -> DataFrame:
    """Distinct ids as a table (id): of a list, or of a table with such a column."""
    if isinstance(ids, DataFrame):
        return ids.select("id").distinct()
    return g.node.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")


def _without(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return table.join(ids.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def node_references(g: Graph, ids: list[str] | DataFrame) -> DataFrame:
    """id, refs: claims that touch a node (one each) and evidence that names it."""
    ends = g.claim.select(F.explode(F.array_distinct(F.array("subject", "object", "population", "mechanism"))).alias("id"))
    both = ends.unionByName(g.evidence.select(F.col("source_node").alias("id")))
    both = both.join(_ids(g, ids).select(F.col("id").alias("_asked")), F.col("id") == F.col("_asked"), "left_semi")
    return both.groupBy("id").agg(F.count("*").alias("refs"))


def delete_nodes(g: Graph, ids: list[str] | DataFrame) -> tuple[Graph, DataFrame]:
    """Nodes go unless something refers to them; results hold id and status_code."""
    asked = _ids(g, ids)
    rows = _known(asked, g.node, "id", "_there").join(node_references(g, ids).withColumnRenamed("id", "_r"), F.col("id") == F.col("_r"), "left")
    rows = rows.select("id", F.when(~F.col("_there"), 404).when(F.coalesce("refs", F.lit(0)) > 0, 409).otherwise(200).alias("status_code"))
    return g.with_(node=_without(g.node, "id", rows.where("status_code = 200"))), rows


def delete_claims(g: Graph, ids: list[str] | DataFrame) -> Graph:
    """Claims with their evidence and contradictions."""
    gone = _ids(g, ids)
    return g.with_(
        claim=_without(g.claim, "id", gone),
        evidence=_without(g.evidence, "claim", gone),
        listed=_without(g.listed, "claim", gone),
        relation=_without(_without(g.relation, "subject_claim", gone), "object_claim", gone),
    )


def delete_evidence(g: Graph, ids: list[str] | DataFrame) -> Graph:
    gone = _ids(g, ids)
    return g.with_(evidence=_without(g.evidence, "id", gone), listed=_without(g.listed, "evidence", gone))


def add_alias(g: Graph, id: str, alias: str) -> Graph:
    """Adds an alias unless the name or an alias equals it but for case; aliases come out sorted."""
    new = F.lit(alias.strip())
    known = (F.lower("name") == F.lower(new)) | F.exists("aliases", lambda a: F.lower(a) == F.lower(new))
    add = (F.col("id") == id) & ~known & (new != "")
    return g.with_(node=g.node.withColumn("aliases", F.when(add, F.array_sort(F.array_distinct(F.array_append("aliases", new)))).otherwise(F.col("aliases"))))


def import_batch(g: Graph, nodes: DataFrame | None = None, claims: DataFrame | None = None, evidence: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """Nodes, then claims, then evidence; each row stands alone.  Results: entity, row, id, ok, errors."""
    done = []
    for entity, rows, act in (("node", nodes, create_nodes), ("claim", claims, create_claims), ("evidence", evidence, create_evidence)):
        if rows is not None:
            g, checked = act(g, rows)
            done.append(checked.select(F.lit(entity).alias("entity"), "row", "id", (F.col("status_code") == 200).alias("ok"), "errors"))
    return g, reduce(DataFrame.unionByName, done)


def import_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("created"), F.count_if(~F.col("ok")).alias("failed"))


def upsert(table: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """Rows by id: new ones win, or existing ones if ``replace`` is false; others stay."""
    if replace:
        return table.join(new.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti").unionByName(new)
    return table.unionByName(new.join(table.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti"))


def load_seed(g: Graph, seed: Graph) -> Graph:
    """The seed's nodes, claims and evidence over the graph's; contradictions are only added."""
    ev = upsert(g.evidence, seed.evidence)
    gone = seed.listed.select(F.col("claim").alias("_c")).distinct()
    return g.with_(
        node=upsert(g.node, seed.node),
        claim=upsert(g.claim, seed.claim),
        evidence=ev,
        listed=g.listed.join(gone, F.col("claim") == F.col("_c"), "left_anti").unionByName(seed.listed),
        relation=upsert(g.relation, seed.relation, replace=False),
    )


def set_setting(settings: DataFrame, key: str, value: str | None) -> DataFrame:
    """Sets a key, or removes it if the value is null."""
    rest = settings.where(F.col("key") != key)
    if value is None:
        return rest
    return rest.unionByName(settings.sparkSession.createDataFrame([(key, value)], schema.SETTING))


def get_setting(settings: DataFrame, key: str, *fallbacks: str | None) -> str | None:
    """The stored value, else the first fallback that isn't blank."""
    row = settings.where(F.col("key") == key).select("value").first()
    return next((v.strip() for v in ((row["value"] if row else None), *fallbacks) if v and v.strip()), None)


def enrich(g: Graph, meta: DataFrame) -> Graph:
    """Paper nodes for the sources that exist; evidence refers to them and gets a design where it has none."""
    papers = paper_node(meta)
    distinct = papers.drop("source_id").dropDuplicates(["id"])
    fresh = distinct.join(g.node.select(F.col("id").alias("_n")), F.col("id") == F.col("_n"), "left_anti")
    new = placed_after(g.node, fresh, "id")
    ids = papers.select(F.col("source_id").alias("_s"), F.col("id").alias("_p"))
    design = meta.select(F.col("source_id").alias("_m"), F.col("study_design").alias("_d"))
    names = g.evidence.columns
    ev = g.evidence.join(ids, F.col("source_id") == F.col("_s"), "left").join(design, F.col("source_id") == F.col("_m"), "left")
    ev = ev.withColumn("source_node", F.coalesce("_p", "source_node")).withColumn("study_design", F.coalesce("study_design", "_d"))
    return g.with_(node=g.node.unionByName(conform(new, schema.NODE)), evidence=ev.select(names))
