import pytest

#: Names that operators use inside; tables may have them too.
CLASHING = "component id key s1 n size at row mixed sid chunk seg host phrase lo hi cuts words parts text_ score"


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHING.split():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(f"clash-{c}"))
    return df


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source]) as a documents table with other columns beside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return with_clashes(df)

    return make


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
