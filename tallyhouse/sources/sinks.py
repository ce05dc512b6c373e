"""Report sinks and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.
    Only where none is named, as in local tests, a temporary folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if root is None and current is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if root is None:
        root = current or tempfile.mkdtemp(prefix="tallyhouse-")
    if current is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text keeps its blanks, as it does on reading."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, the form the web answers had."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_export(lines: DataFrame, summary: DataFrame, path: str) -> None:
    """The two sheets of the sales export as two data sets."""
    write_csv(lines, f"{path}/lines")
    write_csv(summary, f"{path}/summary")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. For what a round hands to the next: unlike a
    checkpoint it carries no constraints of the plan it came from, which grow from round to round."""
    path = scratch_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
