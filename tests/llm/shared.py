"""Small tables for the text operators."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long text, repeated rows, case, odd spaces.
ODD = [
    (1, "The cat sat on the mat", "en", "b"),
    (2, "the CAT sat on the mat", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "der hund und die katze", "de", "b"),
    (5, "der hund und die katze", "de", "b"),
    (6, "ÀB", "fr", "c"),
    (7, "àb", "fr", None),
    (8, "word " * 9000, "en", "c"),
    (None, "no id", "en", "a"),
    (None, None, None, None),
    (9, "  two  spaces \n\n and\tlines\r\n ", "en", "b"),
    (10, "1234 5678", "en", "a"),
]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """The table with columns named as the operators' own."""
    names = "part seq size shard digest copies sequence_id offset fingerprint rate target slot key term w n stratum tilt kept"
    return df.selectExpr("*", *[f"'x' as {x}" for x in names.split()])
