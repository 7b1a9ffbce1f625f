"""URL filtering: fixed host and path rules, and association rules mined by FP-growth.

A fixed rule fits its host and all subdomains of it if the path starts with the rule's
path; the longest fitting rule decides.  The URLs that fixed rules decide are labelled by
them, and FP-growth mines which combinations of URL tokens go with a label.  Rules that
hold often enough (support) and reliably enough (confidence), and that say more than each
shorter rule inside them, judge the other URLs.

Tokens that stand in exactly the same labelled URLs (the parts of one site's template, say) say
the same; each such class is one item, so that they don't multiply into itemsets.  Mined rules
have at most ``max_tokens`` classes.

Matching is by inverted index: a rule stands under the rarest of its tokens only, a URL
meets it there by an equi-join, and the other tokens are then looked up in the URL's own.
A URL takes the verdict of its most confident rule (then the best supported, then block);
without any it takes the more frequent label.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no fixed
rule, has no tokens and takes the default; repeated rows are judged alike, each for
itself; only ``page_id`` and ``url`` are read; an empty table gives an empty result, and
without any labelled URL the default is ``allow``.  DataFrame operations and Spark's own
FP-growth only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABELS = ("block", "allow")


@dataclass(frozen=True)
class Mining:
    """Least share of the labelled URLs, least confidence, and most tokens of a rule.

    At least ``1 / min_support`` rows stand behind every frequent token, so there are at
    most ``tokens a URL / min_support`` of these, whatever the number of URLs.
    """

    min_support: float = 0.01
    min_confidence: float = 0.8
    max_tokens: int = 3
    #: Rules, and verdicts on distinct token sets, up to these numbers are broadcast; more are joined by shuffle.
    broadcast_rules: int = 5_000
    broadcast_sets: int = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return host, path


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, digits folded: scheme, host suffixes, host labels, path parts, query keys."""
    fold = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    tag = lambda kind, c: F.concat(F.lit(kind), c)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    made = F.concat(
        F.array(tag("scheme=", F.lower(F.substring_index(url, "://", 1)))),
        F.array(tag("tld=", F.element_at(labels, -1))),
        F.array(tag("domain=", F.concat_ws(".", F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2)))),
        F.transform(labels, lambda x: tag("host=", fold(x))),
        F.transform(parts, lambda x: tag("path=", fold(x))),
        F.transform(keys, lambda x: tag("query=", fold(x))),
        F.when(extension != "", F.array(tag("ext=", F.lower(extension)))).otherwise(F.array().cast("array<string>")),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        F.when(path.endswith("/"), F.array(F.lit("slash"))).otherwise(F.array().cast("array<string>")),
    )
    none = F.array().cast("array<string>")
    return F.when(url.contains("://"), F.array_distinct(made)).otherwise(none)


def same_tokens(rows: DataFrame) -> DataFrame:
    """tok, item: the class of each token of the labelled rows (row_id, toks), named by its least token.

    Tokens of a class have the same number of rows and the same sum of the rows' hashes.
    """
    each = rows.select(F.explode("toks").alias("tok"), F.xxhash64("row_id").cast("decimal(38,0)").alias("h"))
    marks = each.groupBy("tok").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    least = marks.groupBy(F.col("n").alias("_n"), F.col("h").alias("_h")).agg(F.min("tok").alias("item"))
    return marks.join(least, (F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h"))).select("tok", "item")


def mine(labelled: DataFrame, how: Mining) -> DataFrame:
    """Rules (antecedent array<string>, verdict, confidence, support) from rows (toks, verdict)."""
    from pyspark.ml.fpm import FPGrowth

    label = F.concat(F.lit("label="), F.col("verdict"))
    baskets = labelled.select(F.array_append("toks", label).alias("items"))
    model = FPGrowth(
        itemsCol="items", minSupport=how.min_support, minConfidence=how.min_confidence
    ).fit(baskets)
    rules = model.associationRules.where(
        F.col("consequent")[0].startswith("label=")
        & ~F.exists("antecedent", lambda x: x.startswith("label="))
        & (F.size("antecedent") <= how.max_tokens)
    ).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring(F.col("consequent")[0], len("label=") + 1, 100).alias("verdict"),
        "confidence",
        "support",
    )
    rules = materialize(rules, "url-rules")
    # a rule goes if a shorter one inside it, for the same verdict, is as confident: they share a subset key
    parts = F.explode(F.filter(F.transform(F.col("antecedent"), lambda x: F.array_remove("antecedent", x)), lambda x: F.size(x) > 0))
    inside = rules.select("antecedent", "verdict", "confidence", parts.alias("sub"))
    two = inside.select("antecedent", "verdict", "confidence", F.explode(F.transform("sub", lambda x: F.array_remove("sub", x))).alias("sub"))
    inside = inside.unionByName(two.where(F.size("sub") > 0)).alias("a")
    weaker = inside.join(
        rules.alias("b"),
        (F.col("a.sub") == F.col("b.antecedent"))
        & (F.col("a.verdict") == F.col("b.verdict"))
        & (F.col("b.confidence") >= F.col("a.confidence")),
        "left_semi",
    ).select("antecedent", "verdict")
    return rules.join(weaker.distinct(), ["antecedent", "verdict"], "left_anti")


@scoped("url-judged")
def judge(pages: DataFrame, rules=RULES, how: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (antecedent of the mined rule that decided, if any)."""
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(url)
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("toks", tokens(url, F.col("host"), F.col("path")))
    rows = rows.select("page_id", "host", "path", "fixed", "toks", F.xxhash64("url").alias("row_id"))
    rows = materialize(rows, "url-rows")
    labelled = rows.where("fixed is not null").select("toks", F.col("fixed.verdict").alias("verdict"), "row_id")
    counts = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    default = "block" if counts.get("block", 0) > counts.get("allow", 0) else "allow"
    done = rows.where("fixed is not null").select(
        "page_id", "host", "path", "fixed.rule", "fixed.verdict", F.lit(None).cast("string").alias("mined")
    )
    # the same tokens get the same verdict: each distinct set is matched once
    open_rows = rows.where("fixed is null")
    if counts:
        # only tokens that are frequent enough can be in a rule: a bounded number (see Mining)
        frequent = labelled.select(F.explode("toks").alias("tok")).groupBy("tok").count()
        frequent = frequent.where(F.col("count") >= math.floor(how.min_support * sum(counts.values()))).select("tok")
        items = materialize(same_tokens(labelled).join(frequent, "tok", "left_semi"), "url-items")

        def itemized(sets: DataFrame) -> DataFrame:
            """Adds to distinct token sets ``items``: the classes of their frequent tokens."""
            named = sets.select("toks", F.explode("toks").alias("tok")).join(F.broadcast(items), "tok")
            return named.groupBy("toks").agg(F.collect_set("item").alias("items"))

        # each distinct set of tokens once: baskets are as many as the URLs, but their sets few
        seen = itemized(labelled.select("toks").distinct()).withColumnRenamed("toks", "_toks")
        items_of = F.coalesce("items", F.array().cast("array<string>"))
        baskets = labelled.join(seen, F.col("toks") == F.col("_toks"), "left").select(items_of.alias("toks"), "verdict")
        mined = materialize(mine(baskets, how), "url-mined")
        sets = itemized(open_rows.select("toks").distinct())
        # how often each token stands in the rules: a rule is filed under its rarest one
        filed = mined.withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
        single = filed.select("rule_id", F.explode("antecedent").alias("tok"))
        rarity = baskets.select(F.explode("toks").alias("tok")).groupBy("tok").count()
        rarest = single.join(rarity, "tok").groupBy("rule_id").agg(F.min_by("tok", F.struct("count", "tok")).alias("tok"))
        index = filed.join(rarest, "rule_id").select("tok", "antecedent", "verdict", "confidence", "support")
        if mined.count() <= how.broadcast_rules:
            index = F.broadcast(index)
        hits = (
            sets.select("toks", "items", F.explode("items").alias("tok"))
            .join(index, "tok")
            .where(F.size(F.array_except("antecedent", "items")) == 0)
        )
        best = hits.groupBy("toks").agg(
            F.max_by(
                F.struct("verdict", F.concat_ws(" ", "antecedent").alias("mined")),
                F.struct("confidence", "support", F.col("verdict") == "block", F.concat_ws(" ", "antecedent")),
            ).alias("best")
        )
        # written first, so that a set which very many URLs share can be split in the join
        best = materialize(best.withColumnRenamed("toks", "set"), "url-verdicts")
        if best.count() <= how.broadcast_sets:
            best = F.broadcast(best)
        open_rows = open_rows.join(best, F.col("toks") == F.col("set"), "left")
    else:
        open_rows = open_rows.withColumn("best", F.lit(None).cast("struct<verdict:string,mined:string>"))
    rest = open_rows.select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.mined").alias("mined"),
    )
    return done.unionByName(rest)
