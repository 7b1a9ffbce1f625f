"""Documents from web pages and files, and answers of vocabulary services."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.article import article
from ..functions.text import html_to_text, norm_term

@F.pandas_udf(StringType())
def article_text(html: pd.Series) -> pd.Series:
    """The text of a page's article, in one pass over Arrow batches of pages; null if there is none, or little."""
    return html.map(article)


def page_text(html: Column) -> Column:
    """Article text where there is enough of it, else all text without scripts, styles and tags."""
    return F.coalesce(article_text(html), html_to_text(html))


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """Text of PDF bytes with white space collapsed; null where no PDF library is installed or it fails."""
    try:
        import pypdf
    except ImportError:
        return content.map(lambda _: None)
    import io

    def read(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            pages = pypdf.PdfReader(io.BytesIO(data)).pages
            return re.sub(r"\s+", " ", " ".join(p.extract_text() or "" for p in pages)).strip()
        except Exception:  # noqa: BLE001  a broken file is a null, not a failed job
            return None

    return content.map(read)


def documents(files: DataFrame) -> DataFrame:
    """path, kind, text of fetched files (path, content, content_type): PDF by type or ending, else HTML."""
    pdf = F.coalesce(F.lower("content_type").contains("pdf"), F.lit(False)) | F.lower("path").endswith(".pdf")
    text = F.when(pdf, pdf_text(F.col("content"))).otherwise(page_text(F.decode("content", "UTF-8")))
    return files.select("path", F.when(pdf, "pdf").otherwise("html").alias("kind"), text.alias("text"))


# --- answers of vocabulary services, as JSON text -------------------------------


def parse_ols(rows: DataFrame, prefix: str) -> DataFrame:
    """term, ord, curie, labels, def: hits whose id is of the wanted vocabulary (rows: term, body)."""
    shape = "struct<response:struct<docs:array<struct<obo_id:string,label:string,synonym:array<string>,description:string>>>>"
    docs = rows.select("term", F.posexplode(F.from_json("body", shape)["response"]["docs"]).alias("ord", "d"))
    docs = docs.where(F.upper(F.substring_index("d.obo_id", ":", 1)) == prefix.upper())
    labels = F.filter(F.concat(F.array("d.label"), F.coalesce("d.synonym", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    about = F.coalesce(F.get_json_object("d.description", "$[0]"), F.col("d.description"))
    return docs.select("term", "ord", F.lit(prefix).alias("prefix"), F.col("d.obo_id").alias("curie"), labels.alias("labels"), about.alias("def"))


def parse_mesh(rows: DataFrame) -> DataFrame:
    hits = rows.select("term", F.posexplode(F.from_json("body", "array<struct<resource:string,label:string>>")).alias("ord", "d"))
    ui = F.substring_index("d.resource", "/", -1)
    hits = hits.where((F.coalesce(ui, F.lit("")) != "") & (F.coalesce("d.label", F.lit("")) != ""))
    return hits.select("term", "ord", F.lit("MESH").alias("prefix"), F.concat(F.lit("MESH:"), ui).alias("curie"), F.array("d.label").alias("labels"))


def parse_rxnorm(rows: DataFrame) -> DataFrame:
    ids = rows.select("term", F.posexplode(F.from_json("body", "struct<idGroup:struct<rxnormId:array<string>>>")["idGroup"]["rxnormId"]).alias("ord", "i"))
    return ids.select("term", "ord", F.lit("RXNORM").alias("prefix"), F.concat(F.lit("RXNORM:"), "i").alias("curie"), F.array("term").alias("labels"))


def parse_ror(rows: DataFrame) -> DataFrame:
    """The first five organisations."""
    shape = "struct<items:array<struct<id:string,name:string,aliases:array<string>,acronyms:array<string>>>>"
    hits = rows.select("term", F.posexplode(F.slice(F.from_json("body", shape)["items"], 1, 5)).alias("ord", "d"))
    none = F.array().cast("array<string>")
    labels = F.concat(F.array("d.name"), F.coalesce("d.aliases", none), F.coalesce("d.acronyms", none))
    local = F.regexp_replace(F.coalesce("d.id", F.lit("")), r"^https?://ror\.org/", "")
    full = F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != "")
    return hits.where(local != "").select("term", "ord", F.lit("ROR").alias("prefix"), F.concat(F.lit("ROR:"), local).alias("curie"), full.alias("labels"))


def parse_orcid(rows: DataFrame) -> DataFrame:
    """A person only if exactly one record has the wanted full name."""
    shape = "struct<`expanded-result`:array<struct<`orcid-id`:string,`given-names`:string,`family-names`:string>>>"
    each = F.from_json("body", shape)["expanded-result"]
    full = lambda r: F.trim(F.concat_ws(" ", F.coalesce(r["given-names"], F.lit("")), F.coalesce(r["family-names"], F.lit(""))))
    same = F.filter(each, lambda r: (norm_term(full(r)) == norm_term(F.col("term"))) & (F.coalesce(r["orcid-id"], F.lit("")) != ""))
    one = rows.withColumn("hit", same).where(F.size("hit") == 1).withColumn("r", F.col("hit")[0])
    return one.select("term", F.lit(0).alias("ord"), F.lit("ORCID").alias("prefix"), F.concat(F.lit("ORCID:"), F.col("r")["orcid-id"]).alias("curie"), F.array(full(F.col("r"))).alias("labels"))


def source_meta(wanted: DataFrame, pubmed: DataFrame, crossref: DataFrame) -> DataFrame:
    """source_id, exists, lookup_failed, title, ... of citations, from tables of looked-up records.

    ``pubmed`` has pmid, ``crossref`` has doi, both with found, title, journal, year, authors, pubtypes,
    type; a record that is absent altogether means that the lookup failed.  URLs exist, others don't.
    """
    from ..functions.text import citation_kind, study_design

    kind = citation_kind(F.col("source_id"))
    key = F.when(kind == "PMID", F.trim(F.regexp_replace("source_id", "(?i)^pmid:", ""))).when(kind == "DOI", F.lower(F.trim(F.regexp_replace("source_id", "(?i)^doi:", ""))))
    rows = wanted.select("source_id").distinct().withColumn("kind", kind).withColumn("key", key)
    cols = ("found", "title", "journal", "year", "authors", "pubtypes", "type")
    p = pubmed.select(F.lit("PMID").alias("_k"), F.col("pmid").alias("_id"), *cols)
    c = crossref.select(F.lit("DOI").alias("_k"), F.lower("doi").alias("_id"), *cols)
    out = rows.join(p.unionByName(c), (F.col("kind") == F.col("_k")) & (F.col("key") == F.col("_id")), "left")
    digits = (F.col("kind") != "PMID") | F.col("key").rlike(r"^\d+$")
    looked = F.col("kind").isin("PMID", "DOI") & digits
    return out.select(
        "source_id",
        F.when(F.col("kind") == "URL", True).otherwise(F.coalesce("found", F.lit(False))).alias("exists"),
        (looked & F.col("_id").isNull()).alias("lookup_failed"),
        F.when(F.col("kind") == "PMID", F.col("key")).alias("pmid"),
        F.when(F.col("kind") == "DOI", F.regexp_replace("source_id", "(?i)^doi:", "")).alias("doi"),
        "title", "journal", F.substring("year", 1, 4).alias("year"), "authors", "pubtypes", "type",
        study_design(F.col("pubtypes"), F.col("title"), F.col("type")).alias("study_design"),
    )
