"""Text functions: vectors, names, identifiers, citations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DIMENSION = 256
# Fixed words that names are compared without.
STOP = ("the", "a", "an", "of", "in", "for", "and", "to", "with", "on", "or")
CURIE = r"^[A-Za-z0-9.]+:.+$"


# --- rendering -------------------------------------------------------------


def node_text() -> Column:
    """Name, aliases, domains and description of a node row, joined by a space."""
    return F.concat_ws(" ", "name", "aliases", "domains", F.coalesce("description", F.lit("")))


def claim_text(subject: Column, kind: Column, obj: Column, population: Column, direction: Column, comparator: Column) -> Column:
    full = lambda c: F.when(c != "", c)
    return F.concat_ws(
        " ",
        full(subject),
        full(F.replace(kind, F.lit("_"), F.lit(" "))),
        full(obj),
        F.concat(F.lit("in "), full(population)),
        full(direction),
        full(comparator),
    )


# --- hashing and vectors ---------------------------------------------------


def fnv32(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, as an unsigned 32-bit number."""
    units = F.encode(text, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 - 1, 2)), 16, 10).cast("bigint")
    places = F.when(F.length(units) > 0, F.sequence(F.lit(1), (F.length(units) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places,
        F.lit(2166136261).cast("bigint"),
        lambda h, i: (h.bitwiseXOR(unit(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, each followed by the 3-grams of ``#word#``."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    grams = lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("#"), w, F.lit("#")), i, F.lit(3))
    )
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), grams(w))))


def ascii_hash(text: Column) -> Column:
    """``fnv32`` of a token, which is ASCII: one byte is one code unit."""
    return F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint")),
        F.lit(2166136261).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )


class WordBuckets(dict):
    """A lower-case ASCII word to the buckets of its tokens, an array: the word and the 3-grams of ``#word#``; bounded."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= 100_000:
            self.clear()
        padded = f"#{word}#"
        made = []
        for token in (word, *(padded[i : i + 3] for i in range(len(word)))):
            h = 2166136261
            for c in token.encode():
                h = (h ^ c) * 16777619 & 0xFFFFFFFF
            made.append(h % DIMENSION)
        self[word] = np.array(made)
        return self[word]


#: Texts and words that are counted at a time.
TEXTS, WORDS = 512, 65_536


def _bucket_counts(texts: pa.Array, known: WordBuckets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts that have a word, and their counts by bucket (a row for each), some texts at a time."""
    words = re.compile("[a-z0-9]+")
    rows, found = [], []

    def counted():
        arrays = [known[w] for f in found for w in f]
        row = np.repeat(np.repeat(np.arange(len(found)), [len(f) for f in found]), [len(a) for a in arrays])
        return np.array(rows), np.bincount(row * DIMENSION + np.concatenate(arrays), minlength=len(found) * DIMENSION).reshape(-1, DIMENSION)

    n = 0
    for k, t in ((k, t) for at in range(0, len(texts), TEXTS) for k, t in enumerate(texts.slice(at, TEXTS).to_pylist(), at)):
        here = words.findall(t or "")
        if here:
            rows.append(k)
            found.append(here)
            n += len(here)
        if len(rows) >= TEXTS or n >= WORDS:
            yield counted()
            rows, found, n = [], [], 0
    if rows:
        yield counted()


def _counted(df: DataFrame, keys: list[str], text: str, columns: str, made: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """keys, what ``made`` makes of counts (``columns`` says what), norm2: the squares' sum.

    One pass over the texts, without a shuffle; a text without tokens has no row.
    """
    from ..runtime import ship

    ship(df.sparkSession)
    rows = df.select(*keys, F.lower(F.col(text).cast("string")).alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    names = [*keys, *(c.split()[0] for c in columns.split(", ")), "norm2"]

    def run(batches):
        known = WordBuckets()
        for batch in batches:
            for at, counts in _bucket_counts(batch.column(len(keys)), known):
                own = batch.select(keys).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *made(counts), pa.array((counts * counts).sum(axis=1), pa.int64())], names=names)

    return rows.mapInArrow(run, f"{kinds}, {columns}, norm2 bigint")


def _ends(counts: np.ndarray, each: int = 1) -> np.ndarray:
    return (np.concatenate([[0], np.cumsum(counts)]) * each).astype(np.int32)


def term_lists(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, buckets, tfs, norm2: token counts of each row folded into DIMENSION buckets, those that are there, and their squares' sum."""

    def lists(counts):
        ends = pa.array(_ends(np.count_nonzero(counts, axis=1)), pa.int32())
        row, bucket = np.nonzero(counts)
        return [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((bucket, pa.int32()), (counts[row, bucket], pa.int64()))]

    return _counted(df, keys, text, "buckets array<int>, tfs array<bigint>", lists)


def packed_terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, terms, norm2: ``term_lists`` as one binary: a byte for the bucket and one for the count, of a count above 255 as often as it takes."""

    def packed(counts):
        row, bucket = np.nonzero(counts)
        n = counts[row, bucket]
        times = (n + 254) // 255
        row, bucket, rest = np.repeat(row, times), np.repeat(bucket, times), np.repeat(n - 255 * (times - 1), times)
        last = np.zeros(len(row), bool)
        last[np.cumsum(times) - 1] = True
        pairs = np.stack([bucket, np.where(last, rest, 255)], axis=1).astype(np.uint8)
        ends = _ends(np.bincount(row, minlength=len(counts)), 2)
        return [pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())])]

    return _counted(df, keys, text, "terms binary", packed)


def unpacked(terms: pa.Array) -> np.ndarray:
    """The counts by bucket of ``packed_terms``, a row for each."""
    if not len(terms):
        return np.zeros((0, DIMENSION))
    terms = terms.cast(pa.binary())
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    pairs = np.frombuffer(terms.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 2)
    row = np.repeat(np.arange(len(terms)), np.diff(ends) // 2)
    flat = np.bincount(row * DIMENSION + pairs[:, 0], weights=pairs[:, 1], minlength=len(terms) * DIMENSION)
    return flat.reshape(-1, DIMENSION)


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, bucket, tf, norm2: ``term_lists`` with a row for each bucket."""
    each = term_lists(df, keys, text).select(*keys, F.explode(F.arrays_zip("buckets", "tfs")).alias("t"), "norm2")
    return each.select(*keys, F.col("t.buckets").alias("bucket"), F.col("t.tfs").alias("tf"), "norm2")


def sparse_vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, bucket, weight: token counts folded into DIMENSION buckets, rows scaled to length 1."""
    return term_counts(df, keys, text).select(*keys, "bucket", (F.col("tf") / F.sqrt("norm2")).alias("weight"))


def l2_normalize(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays.  The norm is worked out once: it is the
    single element that an outer transform hands to the inner one."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has cosine 0 with everything."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    safe = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot / (safe(length(a)) * safe(length(b)))


# --- names -----------------------------------------------------------------


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, which has no built-in; accents become characters of their own."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def decomposed(text: Column) -> Column:
    """``nfkd``, which is asked for other texts than ASCII only, as these stay as they are."""
    return F.coalesce(nfkd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def canonical(text: Column) -> Column:
    """Words of a name: lower case, without parentheses, punctuation and stop words."""
    bare = F.regexp_replace(decomposed(F.lower(F.coalesce(text, F.lit("")))), r"\([^)]*\)", " ")
    words = F.split(F.regexp_replace(bare, "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP)), " ")


def stem(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def token_set(canon: Column) -> Column:
    """Distinct stems of a canonical name."""
    return F.array_distinct(F.transform(F.filter(F.split(canon, " "), lambda w: w != ""), stem))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def title_similarity(a: Column, b: Column) -> Column:
    """Of token sets: Jaccard or a little less than the share of the smaller set, whichever is more."""
    least = F.least(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / least
    return F.when(least == 0, 0.0).otherwise(F.greatest(jaccard(a, b), share * 0.95))


def norm_term(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def de_paren(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s+", " "))


def paren_parts(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def uniq_by_norm(values: Column) -> Column:
    """Keeps the first of the values whose normal forms are equal, and drops empty ones."""
    full = F.filter(F.transform(values, lambda x: F.trim(x)), lambda v: norm_term(v) != "")
    normal = F.transform(full, norm_term)
    return F.filter(full, lambda v, i: F.array_position(normal, norm_term(v)) == i + 1)


def name_variants(name: Column, aliases: Column) -> Column:
    """The name, it without parentheses, what these hold, and the aliases."""
    return uniq_by_norm(F.concat(F.array(name, de_paren(name)), paren_parts(name), aliases))


def search_terms(name: Column, aliases: Column) -> Column:
    """At most three terms to look a name up by: without parentheses, as it is, the first alias."""
    bare = F.when(de_paren(name) != "", de_paren(name)).otherwise(name)
    return F.slice(uniq_by_norm(F.concat(F.array(bare, name), F.slice(aliases, 1, 1))), 1, 3)


def accept_label(labels: Column, names: Column) -> Column:
    return F.arrays_overlap(F.transform(labels, norm_term), F.transform(names, norm_term))


# --- identifiers -----------------------------------------------------------


def slug(text: Column, length: int, empty: str) -> Column:
    """Lower-case words joined by dashes, cut to ``length``; ``empty`` if nothing is left."""
    dashed = F.regexp_replace(decomposed(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, length)
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def topic_id(text: Column) -> Column:
    return F.concat(F.lit("t:"), slug(text, 60, "x"))


def node_id(name: Column) -> Column:
    return F.concat(F.lit("ga:"), slug(name, 48, "node"))


def claim_id(subject: Column, kind: Column, obj: Column, population: Column) -> Column:
    """Stable id of an edge: base 36 of the hash of its parts."""
    key = F.concat_ws("|", subject, kind, obj, F.coalesce(population, F.lit("")))
    return F.concat(F.lit("gc:"), F.lower(F.conv(fnv32(key).cast("string"), 10, 36)))


def citation_kind(source: Column) -> Column:
    return (
        F.when(source.rlike("(?i)^pmid:"), "PMID")
        .when(source.rlike("(?i)^doi:"), "DOI")
        .when(source.rlike("(?i)^https?://"), "URL")
        .otherwise("OTHER")
    )


def normalize_source_id(source: Column) -> Column:
    s = F.trim(source)
    return (
        F.when(s.rlike("(?i)^(pmid|doi|url):") | s.rlike("(?i)^https?://"), s)
        .when(s.rlike(r"^\d+$"), F.concat(F.lit("PMID:"), s))
        .when(s.rlike(r"^10\.\d{4,}/"), F.concat(F.lit("DOI:"), s))
        .otherwise(s)
    )


def guideline_source_id(doi: Column, url: Column) -> Column:
    """A DOI if there is one, else a web address, as a CURIE; null without either."""
    d, u = F.trim(F.coalesce(doi, F.lit(""))), F.trim(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(d, r"(?i)^https?://(dx\.)?doi\.org/", "")
    return (
        F.when(d.rlike("(?i)^doi:"), d)
        .when(d != "", F.concat(F.lit("DOI:"), bare))
        .when(u.rlike("(?i)^url:"), u)
        .when(u.rlike("(?i)^https?://"), F.concat(F.lit("URL:"), u))
    )


def is_curie(text: Column) -> Column:
    return F.coalesce(text.rlike(CURIE), F.lit(False))


# Fixed addresses of codes, by prefix: what comes before the id, and after it.
CODE_URLS = {
    "MESH": ("https://meshb.nlm.nih.gov/record/ui?ui=", ""),
    "MONDO": ("http://purl.obolibrary.org/obo/MONDO_", ""),
    "HP": ("http://purl.obolibrary.org/obo/HP_", ""),
    "GO": ("http://purl.obolibrary.org/obo/GO_", ""),
    "CHEBI": ("http://purl.obolibrary.org/obo/CHEBI_", ""),
    "FOODON": ("http://purl.obolibrary.org/obo/FOODON_", ""),
    "MAXO": ("http://purl.obolibrary.org/obo/MAXO_", ""),
    "BCIO": ("http://purl.obolibrary.org/obo/BCIO_", ""),
    "DOI": ("https://doi.org/", ""),
    "PMID": ("https://pubmed.ncbi.nlm.nih.gov/", "/"),
    "PMCID": ("https://www.ncbi.nlm.nih.gov/pmc/articles/", "/"),
    "ROR": ("https://ror.org/", ""),
    "ORCID": ("https://orcid.org/", ""),
    "RXNORM": ("https://mor.nlm.nih.gov/RxNav/search?searchBy=RXCUI&searchTerm=", ""),
    "LOINC": ("https://loinc.org/", ""),
}
ESCAPED = ("MESH", "RXNORM", "LOINC")


def code_url(code: Column) -> Column:
    """Address of a code, or null without a known prefix or an id."""
    at = F.instr(code, ":")
    prefix, rest = F.upper(F.substring_index(code, ":", 1)), F.substr(code, at + 1)
    shown = F.when(prefix.isin(*ESCAPED), F.replace(F.url_encode(rest), F.lit("+"), F.lit("%20"))).otherwise(rest)
    ends = lambda k: F.create_map(*[F.lit(x) for p, v in CODE_URLS.items() for x in (p, v[k])])[prefix]
    return F.when((at > 0) & (rest != ""), F.concat(ends(0), shown, ends(1)))


def merge_codes(existing: Column, found: Column) -> Column:
    """Existing codes first, then new ones, trimmed, each once."""
    return F.array_distinct(F.filter(F.transform(F.concat(existing, found), lambda x: F.trim(x)), lambda c: c != ""))


# --- citations and pages ---------------------------------------------------


def cited_ids(answer: Column) -> Column:
    """Distinct ids in brackets, such as ``[PMID: 12]``, in order, without inner spaces."""
    found = F.regexp_extract_all(answer, F.lit(r"(?i)\[(PMID:\s*\d+|DOI:\s*[^\]\s]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def html_to_text(html: Column) -> Column:
    """Text of a page without scripts, styles and its head."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|head)\b[^>]*>.*?</\1\s*>", " ")
    return strip_tags(bare)


# Fixed patterns of errata and of records that are parts of an article.
def is_erratum(title: Column, pubtypes: Column) -> Column:
    listed = F.exists(F.coalesce(pubtypes, F.array().cast("array<string>")), lambda p: p.rlike("(?i)erratum|correction|retraction"))
    return listed | F.coalesce(F.trim(title).rlike(r"(?i)^(erratum|correction|author correction|retraction)\b"), F.lit(False))


def is_artifact(doi: Column, kind: Column) -> Column:
    """Whether a record is a review report or another part of an article instead of the article."""
    bare = F.trim(F.regexp_replace(F.coalesce(doi, F.lit("")), "(?i)^doi:", ""))
    return F.coalesce(kind.rlike("(?i)^(peer-review|component|grant|dataset|other)$"), F.lit(False)) | bare.rlike(
        r"(?i)/(v\d+/)?review\d*$"
    )


# Fixed rules, in order: what a publication type contains, what a title matches.
DESIGN_BY_PUBTYPE = (
    ("meta-analysis", "systematic_review_or_meta_analysis"),
    ("systematic review", "systematic_review_or_meta_analysis"),
    ("randomized controlled trial", "rct"),
    ("case-control", "case_control"),
    ("cross-sectional", "cross_sectional"),
    ("cohort", "cohort"),
    ("observational study", "cohort"),
    ("case reports", "case_report"),
    ("guideline", "guideline"),
)
DESIGN_BY_TITLE = (
    (r"meta-analysis|systematic review", "systematic_review_or_meta_analysis"),
    (r"randomi[sz]ed|\brct\b", "rct"),
    (r"case-control", "case_control"),
    (r"cross-sectional", "cross_sectional"),
    (r"cohort|longitudinal|prospective study", "cohort"),
    (r"\bguideline", "guideline"),
)


def study_design(pubtypes: Column, title: Column, kind: Column) -> Column:
    """Design by publication types, else by the title, else by the record's type."""
    types = F.transform(F.coalesce(pubtypes, F.array().cast("array<string>")), F.lower)
    holds = lambda w: F.exists(types, lambda p: p.contains(w))
    rules = [(holds(w), d) for w, d in DESIGN_BY_PUBTYPE]
    rules += [(F.coalesce(F.lower(title).rlike(w), F.lit(False)), d) for w, d in DESIGN_BY_TITLE]
    rules += [(F.coalesce(kind.isin("standard", "guideline"), F.lit(False)), "guideline")]
    out = F.lit(None).cast("string")
    for test, design in reversed(rules):
        out = F.when(test, design).otherwise(out)
    return out


def paper_node(meta: DataFrame) -> DataFrame:
    """Nodes for the papers that exist and have a title and an id."""
    pmid, doi = F.when(F.col("pmid") != "", F.col("pmid")), F.when(F.col("doi") != "", F.col("doi"))
    bare = F.regexp_replace(doi, "(?i)^doi:", "")
    ident = F.coalesce(F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("doi:"), bare))
    codes = F.array_compact(F.array(F.concat(F.lit("PMID:"), pmid), F.when(doi.rlike("(?i)^doi:"), doi).otherwise(F.concat(F.lit("DOI:"), doi))))
    authors = F.array_join(F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 3), ", ")
    about = F.concat_ws(" · ", *[F.when(c != "", c) for c in (F.col("journal"), F.col("year"), authors)])
    real = F.col("exists") & (F.coalesce("title", F.lit("")) != "") & ident.isNotNull()
    return meta.where(real).select(
        "source_id",
        ident.alias("id"),
        F.lit("paper").alias("type"),
        F.substring("title", 1, 300).alias("name"),
        codes.alias("external_ids"),
        F.when(about != "", about).alias("description"),
    )


def multi(cell: Column) -> Column:
    """Values of a cell separated by ``;`` or ``|``."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def sql_quote(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """The first balanced JSON object or array in a text, aware of strings and escapes; null if there is none."""

    def first(t: str | None) -> str | None:
        if t is None:
            return None
        start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
        if start < 0:
            return None
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(t)):
            c = t[i]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    return t[start : i + 1]
        return None

    return text.map(first)
