"""Versions of the stored tables, published by one pointer.

Under ``root`` a fact table lies in ``<table>/month=<month>/v=<tag>``, any other in ``<table>/v=<tag>``.
A folder is written once and not touched again. ``versions/<number>`` is a version's manifest: its
table, month and tag triples, as many as there are folders. It is written aside and renamed into place, so
readers see the version before or the one after, and keep the one they opened; what a failed batch
wrote belongs to no version. Renaming must refuse an existing target, as HDFS and local disks do: of
two batches that start from one version the second fails with ``VersionTaken``. Batches of one root
run one after another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.hot_keys import left_by_merge
from tallyhouse.sources import schemas
from tallyhouse.sources.sinks import written
from tallyhouse.sources.tables import MONTH_OF, UNKNOWN, RetailTables, conform, month_of, with_months

BY_MONTH = ("sales", "sale_items", "stock_entries", "payments")
MANIFEST = "table string, month string, tag string"

#: Table, month (empty where a table has none) and tag.
Folder = tuple[str, str, str]


class VersionTaken(RuntimeError):
    """Another batch published its version first."""


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, none where the folder is absent."""
    fs, path = _file_system(spark, pattern)
    return [str(status.getPath().toUri().getPath()) for status in fs.globStatus(path) or ()]


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The published versions, oldest first."""
    names = (path.rsplit("/", 1)[1] for path in paths(spark, f"{root}/versions/*"))
    return sorted(int(name) for name in names if name.isdigit())


def manifest(spark: SparkSession, root: str, number: int) -> set[Folder]:
    """Folders of a version; version 0 has none."""
    if number == 0:
        return set()
    rows = spark.read.schema(MANIFEST).json(f"{root}/versions/{number}").collect()
    return {tuple(row) for row in rows}


def latest(spark: SparkSession, root: str) -> int:
    return max(numbers(spark, root), default=0)


def read_folders(spark: SparkSession, root: str, name: str, folders: Iterable[Folder]) -> DataFrame:
    """Rows of those of the folders that belong to table ``name``."""
    columns = {**schemas.TABLES[name], **({"month": "string"} if name in BY_MONTH else {})}
    stored = [
        f"{root}/{name}/" + (f"month={month}/" if month else "") + f"v={tag}"
        for table, month, tag in sorted(folders)
        if table == name
    ]
    if not stored:
        return spark.createDataFrame([], schemas.ddl(columns))
    reader = spark.read.schema(schemas.ddl({**columns, "v": "string"}))
    return reader.option("basePath", f"{root}/{name}").parquet(*stored).drop("v")


def load_version(spark: SparkSession, root: str, number: int | None = None) -> RetailTables:
    """The tables of a version, the newest where none is named."""
    number = latest(spark, root) if number is None else number
    folders = manifest(spark, root, number)
    return RetailTables(
        **{name: partial(read_folders, spark, root, name, folders) for name in RetailTables.NAMES}
    )


def changed_rows(spark: SparkSession, root: str, name: str, old: int, new: int) -> DataFrame:
    """Rows that lead from one version of a table to another: ``sign`` is 1 for rows to add and -1
    for rows to take off. Only folders that one of the two versions lacks are read, so rows
    that a rewritten month kept come with both signs."""
    before, after = manifest(spark, root, old), manifest(spark, root, new)
    gone = read_folders(spark, root, name, before - after).withColumn("sign", F.lit(-1))
    return read_folders(spark, root, name, after - before).withColumn("sign", F.lit(1)).unionByName(gone)


def _write(df: DataFrame, root: str, name: str, tag: str) -> set[Folder]:
    """Write rows under a new tag; the folders that came of it."""
    spark, months = df.sparkSession, ("month",) if name in BY_MONTH else ()
    out = conform(df, name, months).withColumn("v", F.lit(tag))
    out = out.hint("rebalance", *months) if months else out
    out.write.mode("append").partitionBy(*months, "v").parquet(f"{root}/{name}")
    if not months:
        return {(name, "", tag)} if paths(spark, f"{root}/{name}/v={tag}") else set()
    found = paths(spark, f"{root}/{name}/month=*/v={tag}")
    return {(name, path.split("/")[-2].removeprefix("month="), tag) for path in found}


def _publish(spark: SparkSession, root: str, number: int, folders: set[Folder]) -> int:
    staged, final = f"{root}/staged-{uuid.uuid4().hex}", f"{root}/versions/{number}"
    spark.createDataFrame(sorted(folders), MANIFEST).coalesce(1).write.json(staged)
    fs, home = _file_system(spark, f"{root}/versions")
    fs.mkdirs(home)
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(hadoop.Path(staged)), fs.makeQualified(hadoop.Path(final)), options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise VersionTaken(f"version {number} exists") from error
        raise
    return number


def _next(spark: SparkSession, root: str, base: int | None) -> tuple[int, int, str]:
    base = latest(spark, root) if base is None else base
    return base, base + 1, f"{base + 1:08d}-{uuid.uuid4().hex[:8]}"


def publish(tables: RetailTables, root: str, base: int | None = None) -> int:
    """All tables as the version after ``base`` (after the newest where none is named)."""
    spark = tables.sales.sparkSession
    _, number, tag = _next(spark, root, base)
    folders: set[Folder] = set()
    for name, df in with_months(tables).items():
        folders |= _write(df, root, name, tag)
    return _publish(spark, root, number, folders)


def _moves(now: RetailTables, sales: DataFrame, lines: DataFrame) -> DataFrame:
    """Every sale that a batch names: ``stored`` is the month of its header (null for a new one),
    ``source`` and ``target`` are the months of its lines before and after; ``headed`` and
    ``relined`` tell whether the batch has its header and its lines."""
    headed = sales.select(F.col("id").alias("sale_id"), month_of("sale_date").alias("dated"))
    asked = (
        headed.withColumns({"headed": F.lit(True), "relined": F.lit(False)})
        .unionByName(
            lines.select("sale_id").withColumns(
                {"dated": F.lit(None).cast("string"), "headed": F.lit(False), "relined": F.lit(True)}
            )
        )
        .groupBy("sale_id")
        .agg(F.max("dated").alias("dated"), F.max("headed").alias("headed"), F.max("relined").alias("relined"))
    )
    stored = now.sales.select(F.col("id").alias("sale_id"), F.col("month").alias("stored"))
    return left_by_merge(asked, stored, "sale_id").select(
        "sale_id",
        "stored",
        "headed",
        "relined",
        F.coalesce("stored", F.lit(UNKNOWN)).alias("source"),
        F.coalesce("dated", "stored", F.lit(UNKNOWN)).alias("target"),
    )


def _months(df: DataFrame, column: str) -> set[str]:
    """Distinct months: as many as a table has folders, whatever its rows."""
    return {row[0] for row in df.select(column).distinct().collect() if row[0] is not None}


def publish_changes(
    spark: SparkSession, root: str, base: int | None = None, **batch: DataFrame
) -> int:
    """The version after ``base`` (the newest where none is named), from a batch of rows by table.

    ``sales``: headers by unique id, in place of stored ones or new. ``sale_items``: lines in place of
    all stored lines of the sales they name. ``stock_entries``, ``payments``: new rows. Other
    tables are given whole. When the month of a sale changes, its lines move along; lines of
    a sale that is not there lie under the month ``unknown`` until it comes.

    Only months that lose rows are written anew; rows for other months go to one more folder. The sales
    that a batch names grow with it, so joins with them are merged and never broadcast.
    """
    if unknown := set(batch) - set(RetailTables.NAMES):
        raise TypeError(f"no table {', '.join(sorted(unknown))}")
    base, number, tag = _next(spark, root, base)
    now, folders = load_version(spark, root, base), manifest(spark, root, base)
    sales = written(conform(batch.pop("sales", now.sales.limit(0)), "sales"))
    lines = written(conform(batch.pop("sale_items", now.sale_items.limit(0)), "sale_items"))
    moves = written(_moves(now, sales, lines))

    def rewrite(name: str, months: set[str]) -> DataFrame:
        """Rows of the months, whose folders leave the version."""
        nonlocal folders
        old = {f for f in folders if f[0] == name and f[1] in months}
        folders = folders - old
        return read_folders(spark, root, name, old)

    kept = rewrite("sales", _months(moves.filter("headed"), "stored")).join(sales.hint("merge"), "id", "left_anti")
    new_sales = kept.unionByName(sales.withColumn("month", month_of("sale_date")))

    taken = moves.filter("relined or source <> target").select("sale_id", "relined", "source", "target")
    staying = (
        left_by_merge(rewrite("sale_items", _months(taken, "source")), taken.drop("source"), "sale_id")
        .filter(~F.coalesce("relined", F.lit(False)))
        .withColumn("month", F.coalesce("target", "month"))
        .drop("relined", "target")
    )
    given = left_by_merge(lines, moves.select("sale_id", F.col("target").alias("month")), "sale_id")
    new_lines = staying.unionByName(given.fillna(UNKNOWN, "month"))

    wrote = _write(new_sales, root, "sales", tag) | _write(new_lines, root, "sale_items", tag)
    for name, df in batch.items():
        if name in BY_MONTH:
            df = df.withColumn("month", month_of(MONTH_OF[name]))
        else:
            folders = {f for f in folders if f[0] != name}
        wrote |= _write(df, root, name, tag)
    return _publish(spark, root, number, folders | wrote)

