"""What the text operators share: reading, saved tables, row numbers."""

from __future__ import annotations

import string
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where pandas would turn ids into floats; below every other id.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) of every row, other columns left behind."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where Spark runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tallyhouse-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lost executors cost no lineage."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid4().hex}/{what}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_id() -> int:
    return TaskContext.get().partitionId()


def with_rank(df: DataFrame, group: list[str], order: list[Column], name: str, spread: Column, spreads: int) -> DataFrame:
    """Gapless numbers from 0 within ``group``, ordered by ``spread`` and then ``order``.

    ``spread`` cuts each group into ``spreads`` stretches that are ordered on their own; the counts
    of earlier stretches are added, so that no group of rows meets in one task.
    """
    df = df.withColumn("_spread", spread)
    sizes = df.groupBy(*group, "_spread").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_spread", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy(*group, "_spread").orderBy(*order))
    ranked = df.withColumn("_place", place).join(offsets, [*group, "_spread"])
    return ranked.withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_spread", "_place", "_before")


Query = Callable[[SparkSession, str], DataFrame]
