"""A folder of stock files read in one go: CSV files and workbooks, every row in order, every failure told.

CSV rows have no number of their own. Their order is that of (file, start of the split in the file, place in
the split); splits are cut differently on every cluster, the order they add up to is not. Rows are numbered
over all files by a range sort, so later rows of a name win wherever they were read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip
from tallyhouse.operators.ranking import number_rows
from tallyhouse.sources.intake import is_allowed_file
from tallyhouse.sources.schemas import INTAKE_COLUMNS, INTAKE_REQUIRED
from tallyhouse.sources.workbooks import parse_workbooks

ROWS = "path string, block bigint, at bigint, " + ", ".join(f"{c} string" for c in INTAKE_COLUMNS) + ", _error string"


@dataclass(frozen=True)
class Folder:
    """``rows``: seq (from 1, in order), path and the intake columns. ``rejects``: path, and seq for a row,
    with the reason; a file that can't be read is one reject."""

    rows: DataFrame
    rejects: DataFrame


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header fields; one line a file reaches the driver, which lists the files anyway."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    first = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("value"))
    parsed = first.select("path", F.from_csv("value", ", ".join(f"c{k} string" for k in range(64)), {"escape": '"'}).alias("c"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in parsed.collect():
        fields = list(r.c) if r.c else []
        while fields and fields[-1] is None:
            fields.pop()
        out.setdefault(tuple((f or "").replace("﻿", "").lower().strip() for f in fields), []).append(r.path)
    return out


def _csv_rows(spark: SparkSession, paths: list[str], header: tuple[str, ...]) -> DataFrame:
    fields = [f"_c{k}" for k in range(len(header))]
    schema = ", ".join(f"{f} string" for f in [*fields, "_corrupt"])
    read = spark.read.schema(schema).option("header", True).option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt")
    rows = read.csv(paths)
    text = {name: F.col(f) for name, f in zip(header, fields, strict=True)}
    # short rows have their last fields empty; text after the last field has no column to go to
    long = F.size(F.split(F.col("_corrupt"), ",")) > len(header)
    columns = [text.get(c, F.lit("")).cast("string").alias(c) for c in INTAKE_COLUMNS]
    error = F.when(F.col("_corrupt").isNotNull() & long, F.concat(F.lit("row does not fit the header: "), "_corrupt")).alias("_error")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), *columns, error)


def _workbook_rows(files: DataFrame) -> DataFrame:
    found = parse_workbooks(files.filter(F.lower("path").endswith(".xlsx")))
    return found.select("path", F.lit(0).cast("bigint").alias("block"), F.col("line").cast("bigint").alias("at"), *INTAKE_COLUMNS, F.col("error").alias("_error"))


def read_stock_folder(spark: SparkSession, path: str) -> Folder:
    """All stock files below ``path``; what is no such file, or can't be read as one, is a reject.

    A CSV file's rows break at line ends; files of no bytes hold nothing and are not told. Names and categories are stripped, a supplier left out is empty.
    """
    files = _files(spark, path)
    listed = files.select("path")
    allowed = is_allowed_file(F.col("path"))
    refused = listed.filter(~allowed).select("path", F.lit("File type not allowed").alias("reason"))
    old = listed.filter(F.lower("path").endswith(".xls")).select("path", F.lit("old workbooks can't be read").alias("reason"))
    paths = [r.path for r in listed.filter(F.lower("path").endswith(".csv")).collect()]
    headers = _headers(spark, paths) if paths else {}
    broken: list[tuple[str, str]] = []
    rows = _workbook_rows(files)
    for header, own in headers.items():
        missing = [c for c in INTAKE_REQUIRED if c not in header]
        if missing:
            broken += [(p, f"Missing columns: {', '.join(missing)}. Found: {list(header)}") for p in own]
        else:
            rows = rows.unionByName(_csv_rows(spark, own, header))
    rows = number_rows(rows, [F.col("path"), F.col("block"), F.col("at")], "seq")
    failed = rows.filter("_error is not null").select("path", F.when(F.col("at").isNotNull(), F.col("seq")).alias("seq"), F.col("_error").alias("reason"))
    told = refused.unionByName(old).unionByName(spark.createDataFrame(broken, "path string, reason string"))
    rejects = failed.unionByName(told.withColumn("seq", F.lit(None).cast("bigint")))
    good = rows.filter("_error is null").withColumns(
        {"name": strip(F.col("name")), "category": strip(F.col("category")), "supplier": F.coalesce("supplier", F.lit(""))}
    )
    return Folder(good.select("seq", "path", *INTAKE_COLUMNS), rejects)
