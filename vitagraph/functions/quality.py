"""Evidence strength of a claim: design, replication, sample size, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed scores and labels of the study designs.
DESIGN_BASE = {
    "systematic_review_or_meta_analysis": 80,
    "rct": 70,
    "guideline": 60,
    "cohort": 50,
    "case_control": 40,
    "cross_sectional": 35,
    "case_report": 20,
    "expert_opinion": 20,
}
DESIGN_LABEL = {
    "systematic_review_or_meta_analysis": "systematic review / meta-analysis",
    "rct": "randomized controlled trial",
    "guideline": "clinical guideline",
    "cohort": "cohort study",
    "case_control": "case-control study",
    "cross_sectional": "cross-sectional study",
    "case_report": "case report/series",
    "expert_opinion": "expert opinion",
}
NO_DESIGN = 15
# Fixed pattern of what a quote says about its sample.
SAMPLE = (
    r"\b[nN]\s*=\s*([\d][\d,]{1,})"
    r"|\b([\d][\d,]{2,})\s+(?:participants|patients|subjects|adults|individuals|men|women|people)\b"
)


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def design_base(design: Column) -> Column:
    return F.coalesce(lookup(DESIGN_BASE, design), F.lit(NO_DESIGN))


def sample_size(quote: Column) -> Column:
    """Largest positive number of participants that a quote reports, or null."""
    found = F.concat(F.regexp_extract_all(quote, F.lit(SAMPLE), F.lit(1)), F.regexp_extract_all(quote, F.lit(SAMPLE), F.lit(2)))
    numbers = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"))
    return F.array_max(F.filter(numbers, lambda n: n > 0))


def tier(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 55, "moderate").when(score >= 35, "low").otherwise("very_low")


def evidence_per_claim(listed: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim, sources (in evidence order), base, best_design, n_sources, sample_size.

    One partial aggregation over the listed evidence; an unknown id shows itself as its source.
    """
    e = evidence.select(
        F.col("id").alias("_id"),
        F.col("source_id"),
        F.when(F.col("study_design") != "", F.col("study_design")).alias("design"),
        sample_size(F.col("quote")).alias("n"),
    )
    both = listed.join(e, F.col("evidence") == F.col("_id"), "left")
    return both.groupBy("claim").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ev_ord", F.coalesce("source_id", "evidence").alias("s")))), lambda x: x["s"]
        ).alias("sources"),
        F.max(F.when(F.col("design").isNotNull(), design_base(F.col("design")))).alias("base"),
        F.max_by("design", F.when(F.col("design").isNotNull(), F.struct(design_base(F.col("design")), F.col("ev_ord")))).alias(
            "best_design"
        ),
        F.countDistinct(F.when(F.col("source_id") != "", F.col("source_id"))).alias("n_sources"),
        F.max("n").alias("sample_size"),
    )


def scored(df: DataFrame) -> DataFrame:
    """Add score, tier and reasons to rows with base, best_design, n_sources, sample_size, conflicted."""
    base = F.coalesce("base", F.lit(NO_DESIGN))
    n = F.coalesce("n_sources", F.lit(0)).cast("bigint")
    size = F.col("sample_size")
    conflicted = F.coalesce("conflicted", F.lit(False))
    replication = F.when(n >= 3, 14).when(n == 2, 8).otherwise(0)
    sample = F.when(size >= 1000, 6).when(size >= 100, 3).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), base + replication + sample - F.when(conflicted, 20).otherwise(0)))
    label = F.coalesce(lookup(DESIGN_LABEL, F.col("best_design")), F.col("best_design"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("best_design").isNotNull(), text("strongest design: ", label, " (", base, ")")).otherwise(
                text("no study design recorded (", base, ")")
            ),
            F.when(replication > 0, text(n, " independent sources (+", replication, ")")).otherwise(
                F.when(n == 1, F.lit("1 source")).otherwise(text(n, " sources"))
            ),
            F.when(
                size.isNotNull(),
                F.when(sample > 0, text("reported sample ~", size, " (+", sample, ")")).otherwise(text("reported sample ~", size)),
            ),
            F.when(conflicted, F.lit("conflicts with other evidence (−20)")),
        )
    )
    return (
        df.withColumn("score", score.cast("int"))
        .withColumn("tier", tier(F.col("score")))
        .withColumn("n_sources", n)
        .withColumn("conflicted", conflicted)
        .withColumn("reasons", reasons)
    )
