"""Small document tables with awkward rows."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, sources=None, langs=None, first=0, extra=True):
    rows = []
    for i, t in enumerate(texts):
        s = sources[i] if sources else f"s{i % 3}"
        rows.append((first + i, t, langs[i] if langs else "en", s, None if t is None else len(t)))
    df = spark.createDataFrame(rows, DOC)
    if extra:  # names that operators use inside
        df = df.selectExpr("*", "1 AS size", "'x' AS h", "2 AS bucket", "'y' AS txt", "3 AS n", "'z' AS body", "4 AS _t")
    return df


AWKWARD = [None, "", " \n\t ", "one", "one two three", "one two three", "a" * 200_000, "word " * 3000, "\x00 \U0001f600 ¼ naïve space"]


def nullified(df):
    """The same rows, one of them with nulls in every column."""
    from pyspark.sql import functions as F

    nulls = df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(nulls)
