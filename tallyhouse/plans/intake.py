"""Bulk stock intake: validation, rejects, and merging into the product list."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip
from tallyhouse.functions.validation import intake_reject_reason, whole_count
from tallyhouse.operators.ranking import number_rows
from tallyhouse.sources.sinks import shared_root, written

# Defaults of a product created by intake.
NEW_REORDER_LEVEL = 5


class RejectedIntake(ValueError):
    """A strict batch held at least one row that could not be converted."""


@dataclass(frozen=True)
class Screened:
    accepted: DataFrame
    rejects: DataFrame


def screen_intake(intake: DataFrame, mode: str = "skip", batch: str | None = None) -> Screened:
    """Split text rows into typed accepted rows and rejects with a reason.

    ``skip`` (file import) leaves bad rows aside and cuts decimals of a quantity
    off. ``strict`` (batch form) refuses a whole batch when one of its rows fails
    conversion: with ``batch``, the column that names the batch, all its rows are
    rejects and other batches go on; without it the frame is one batch and the
    refusal is raised. A row whose name or category has no value counts as one that
    could not be converted. Rows with a quantity or buying price that is not positive
    are passed over in both modes.
    """
    quantity = F.col("quantity")
    count = quantity.try_cast("int") if mode == "strict" else whole_count(quantity)
    category = F.col("category") if "category" in intake.columns else None
    reason = intake_reject_reason(
        count, F.col("buying_price"), F.col("selling_price"), F.col("name"), category
    )
    checked = intake.withColumn("reason", reason)
    if mode == "strict":
        bad = checked.filter(F.col("reason").startswith("bad"))
        if batch is not None:
            refused = bad.select(F.col(batch).alias("_refused")).distinct()
            checked = (
                checked.join(
                    refused.withColumn("_bad", F.lit(True)),
                    checked[batch].eqNullSafe(F.col("_refused")),
                    "left",
                )
                .withColumn("reason", F.coalesce("reason", F.when(F.col("_bad"), "batch refused")))
                .drop("_refused", "_bad")
            )
        elif not bad.isEmpty():
            raise RejectedIntake("batch refused: a row could not be converted")
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return Screened(
        accepted.withColumns(
            {
                **{c: strip(F.col(c)) for c in ("name", "category") if c in intake.columns},
                "quantity": count,
                "buying_price": F.col("buying_price").try_cast("decimal(18,2)"),
                "selling_price": F.col("selling_price").try_cast("decimal(18,2)"),
            }
        ),
        checked.filter(F.col("reason").isNotNull()),
    )


def next_ids(df: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """New surrogate ids above the highest existing one, in the given order."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    numbered = number_rows(df, order, "_new")
    return numbered.withColumn("id", (F.col("_new") + top).cast("bigint")).drop("_new")


def merge_categories(categories: DataFrame, intake: DataFrame, seq: str = "seq") -> DataFrame:
    """All categories, with those first named by the intake added at the end."""
    named = intake.groupBy(strip(F.col("category")).alias("name")).agg(F.min(seq).alias("_first"))
    missing = named.join(categories.select("name"), "name", "left_anti")
    added = next_ids(missing, categories, [F.col("_first"), F.col("name")]).drop("_first")
    return categories.unionByName(added, allowMissingColumns=True)


def _by_name(intake: DataFrame, seq: str) -> DataFrame:
    """One row for each product name: quantities add up, the last prices win,
    the first row decides the category of a new product."""
    first = [c for c in ("category", "category_id") if c in intake.columns]
    return intake.groupBy("name").agg(
        F.sum("quantity").alias("in_quantity"),
        F.max_by("buying_price", seq).alias("in_buying"),
        F.max_by("selling_price", seq).alias("in_selling"),
        F.min(seq).alias("_first"),
        *[F.min_by(c, seq).alias(f"in_{c}") for c in first],
    )


def _first_by_name(products: DataFrame) -> DataFrame:
    """Product names are not unique; an intake row goes to the smallest id."""
    return products.groupBy("name").agg(F.min("id").alias("id"))


def merge_stock_intake(
    products: DataFrame,
    categories: DataFrame,
    intake: DataFrame,
    seq: str = "seq",
    at: datetime | None = None,
) -> DataFrame:
    """Product list after an accepted intake. With ``at``, products that took
    something in carry it as ``updated_at``, if the list has that column.

    ``intake`` holds typed rows with a unique ``seq`` that gives their order,
    and either a ``category`` name or a ``category_id``. ``categories`` must
    already contain the intake's categories.
    """
    shared_root(products.sparkSession)
    # The batch is folded once; both halves below read it from the checkpoint.
    target = _by_name(intake, seq).join(_first_by_name(products), "name", "left").checkpoint()
    known = target.filter(F.col("id").isNotNull()).drop("name", "_first")
    # A cast would overflow silently outside ANSI mode; stock stays bigint.
    merged = products.join(known, "id", "left").withColumns(
        {
            "current_stock": F.col("current_stock").cast("bigint")
            + F.coalesce("in_quantity", F.lit(0)),
            "buying_price": F.coalesce("in_buying", "buying_price"),
            "selling_price": F.coalesce("in_selling", "selling_price"),
        }
    )
    if at is not None and "updated_at" in products.columns:
        stamp = F.lit(at).cast(products.schema["updated_at"].dataType)
        touched = F.when(F.col("in_quantity").isNotNull(), stamp).otherwise(F.col("updated_at"))
        merged = merged.withColumn("updated_at", touched)
    fresh = next_ids(
        target.filter(F.col("id").isNull()).drop("id"),
        products,
        [F.col("_first"), F.col("name")],
    )
    if "in_category" in fresh.columns:
        kinds = categories.select(
            F.col("id").alias("category_id"), F.col("name").alias("in_category")
        )
        fresh = fresh.join(kinds, "in_category", "left")
    else:
        fresh = fresh.withColumnRenamed("in_category_id", "category_id")
    created = fresh.select(
        "id",
        "name",
        "category_id",
        F.col("in_quantity").alias("current_stock"),
        F.lit(NEW_REORDER_LEVEL).alias("reorder_level"),
        F.col("in_buying").alias("buying_price"),
        F.col("in_selling").alias("selling_price"),
        F.lit(True).alias("is_active"),
    )
    return merged.select(*products.columns).unionByName(created, allowMissingColumns=True)


def stock_entries_from_intake(
    merged_products: DataFrame, intake: DataFrame, seq: str = "seq"
) -> DataFrame:
    """One ledger row for each accepted intake row, against the merged list."""
    ids = _first_by_name(merged_products).withColumnRenamed("id", "product_id")
    extra = [c for c in ("entry_date", "user_id") if c in intake.columns]
    return intake.join(ids, "name").select(
        seq, "product_id", "quantity", "buying_price", "selling_price", "supplier", *extra
    )


def refuse_new_without_category(
    products: DataFrame, screened: Screened, batch: str | None, seq: str = "seq"
) -> Screened:
    """Refuse batches that would create a product without a category id.

    The row that creates a product is the first of its name in a batch that is taken.
    Refusing a batch hands that part to a later row, so batches are refused in
    rounds until every creating row has an id; a round refuses only batches that
    one batch after another would refuse too.
    """
    accepted, rejects = screened.accepted, screened.rejects
    unit = F.lit(True) if batch is None else F.col(batch)
    new = accepted.join(products.select("name").distinct(), "name", "left_anti")
    while True:
        first = F.min_by(F.struct(seq, unit.alias("_unit"), "category_id"), seq).alias("_first")
        bad = new.groupBy("name").agg(first).select("_first.*").filter("category_id is null")
        bad = written(bad.select(F.col(seq).alias("_seq"), "_unit"))
        if bad.isEmpty():
            return Screened(accepted, rejects)
        if batch is None:
            raise RejectedIntake("batch refused: a new product has no category id")
        units = bad.select("_unit").distinct()
        of = F.col(batch).eqNullSafe(F.col("_unit"))
        out = accepted.join(units, of, "left_semi").join(bad.select("_seq"), F.col(seq) == F.col("_seq"), "left")
        reason = F.when(F.col("_seq").isNotNull(), "bad category id").otherwise("batch refused")
        out = out.withColumn("reason", reason).drop("_seq")
        text = [F.col(c).cast(t).alias(c) for c, t in rejects.dtypes]
        rejects = rejects.unionByName(out.select(text))
        accepted, new = accepted.join(units, of, "left_anti"), new.join(units, of, "left_anti")


@dataclass(frozen=True)
class Imported:
    products: DataFrame
    categories: DataFrame
    entries: DataFrame
    rejects: DataFrame


def import_intake(
    products: DataFrame,
    categories: DataFrame,
    intake: DataFrame,
    mode: str = "skip",
    seq: str = "seq",
    batch: str | None = None,
) -> Imported:
    """A whole import of text rows: screen, add categories, merge products,
    write the ledger. Accepted rows are cut off from their files once."""
    shared_root(products.sparkSession)
    screened = screen_intake(intake, mode, batch)
    if mode == "strict" and "category_id" in intake.columns:
        screened = refuse_new_without_category(products, screened, batch, seq)
    accepted = screened.accepted.checkpoint()
    kinds = categories
    if "category" in accepted.columns:
        kinds = merge_categories(categories, accepted, seq)
    merged = merge_stock_intake(products, kinds, accepted, seq)
    return Imported(
        merged, kinds, stock_entries_from_intake(merged, accepted, seq), screened.rejects
    )
