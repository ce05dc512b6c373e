"""Stock intake from CSV files and from JSON batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip
from tallyhouse.sources.schemas import INTAKE_COLUMNS, INTAKE_JSON, INTAKE_REQUIRED

PREVIEW_ROWS = 5


def is_allowed_file(path: Column) -> Column:
    """csv, xlsx and xls by extension, in any case."""
    return F.lower(path).rlike(r"[.](csv|xlsx|xls)$")


def standardize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def check_required(df: DataFrame) -> DataFrame:
    """Fail with the missing and the found columns, else return ``df``."""
    missing = [c for c in INTAKE_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}. Found: {df.columns}")
    return df


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every ``*.csv`` (any case) under a file or folder, all columns as text.

    Headers are checked file by file, so a file whose columns are in another
    order fails instead of being read under wrong names.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .csv(path)
    )


def read_stock_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return intake_columns(read_csv_text(spark, path, multi_line))


def intake_columns(df: DataFrame) -> DataFrame:
    """Standard headers, required columns present, supplier defaulted to ''."""
    df = check_required(standardize_headers(df))
    if "supplier" not in df.columns:
        df = df.withColumn("supplier", F.lit(""))
    return df.select(
        strip(F.col("name")).alias("name"),
        strip(F.col("category")).alias("category"),
        *[F.col(c) for c in INTAKE_COLUMNS[2:5]],
        F.coalesce("supplier", F.lit("")).alias("supplier"),
    )


def explode_intake_json(df: DataFrame, column: str) -> DataFrame:
    """One row per object of the JSON array in ``column``; other columns and
    the position inside the array (``line``) are kept. Text that is not a JSON
    array gives one row without a line and without values, which screening
    rejects; an empty array gives none. A quantity or price left out is 0,
    a name left out is empty."""
    keep = [c for c in df.columns if c != column]
    item = F.col("item")

    def number(field: str) -> Column:
        left_out = item.isNotNull() & ~F.map_contains_key(item, field)
        return F.when(left_out, "0").otherwise(item[field]).alias(field)

    parsed = df.select(*keep, F.from_json(column, INTAKE_JSON).alias("_items"))
    return (
        parsed.select(*keep, "_items", F.posexplode_outer("_items").alias("line", "item"))
        .filter("line IS NOT NULL OR _items IS NULL")
        .select(
            *keep,
            "line",
            strip(F.when(item.isNotNull() & ~F.map_contains_key(item, "name"), "").otherwise(item["name"])).alias("name"),
            item["category_id"].try_cast("bigint").alias("category_id"),
            *map(number, ("quantity", "buying_price", "selling_price")),
            F.coalesce(item["supplier"], F.lit("")).alias("supplier"),
        )
    )


@dataclass(frozen=True)
class Preview:
    head: DataFrame
    columns: list[str]
    rows: DataFrame


def preview(df: DataFrame) -> Preview:
    """First rows, column list and a one-row count, none of them run yet."""
    return Preview(
        df.limit(PREVIEW_ROWS), df.columns, df.agg(F.count(F.lit(1)).alias("row_count"))
    )
