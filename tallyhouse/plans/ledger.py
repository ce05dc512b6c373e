"""Batch ledger operations: pricing, adjustments, payments and audits.

Each takes tables and a batch of events and returns new tables; nothing is
updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import pricing
from tallyhouse.functions.money import MONEY, TOTAL, cents, from_cents
from tallyhouse.operators.running import by_hour_or_sale, running_total
from tallyhouse.operators.sequential import accept_in_order
from tallyhouse.sources.schemas import PAYMENTS


def price_sales(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Totals of each sale from its lines, and whether it may be closed.

    ``headers``: ``sale_id, payment_method, amount_paid, discount_type,
    discount_value``. ``lines``: ``sale_id, quantity, selling_price,
    price_override``. Sales without lines are refused, as an empty cart is.
    """
    price = pricing.effective_price(F.col("price_override"), F.col("selling_price"))
    subtotals = lines.groupBy("sale_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.col("quantity") * price).cast(TOTAL).alias("subtotal"),
    )
    method, paid = F.col("payment_method"), F.col("amount_paid")
    discount = pricing.discount_amount(
        F.col("subtotal"), F.col("discount_type"), F.col("discount_value")
    )
    return (
        headers.join(subtotals, "sale_id", "left")
        .withColumns(
            {
                "line_count": F.coalesce("line_count", F.lit(0)),
                "subtotal": F.coalesce("subtotal", F.lit(0)).cast(TOTAL),
            }
        )
        .withColumn("discount", discount)
        .withColumn("final_amount", pricing.final_amount(F.col("subtotal"), F.col("discount")))
        .withColumn("balance", pricing.credit_balance(method, F.col("final_amount"), paid))
        .withColumn(
            "accepted",
            (F.col("line_count") > 0)
            & pricing.payment_acceptable(method, F.col("final_amount"), paid),
        )
    )


def price_lines(lines: DataFrame) -> DataFrame:
    price = pricing.effective_price(F.col("price_override"), F.col("selling_price"))
    return lines.withColumn("price_at_sale", price).withColumn(
        "total", (F.col("quantity") * F.col("price_at_sale")).cast(TOTAL)
    )


def movements(stock_entries: DataFrame, sale_items: DataFrame, sales: DataFrame) -> DataFrame:
    """Signed stock movements in time: intake first at equal times."""
    received = stock_entries.select(
        "product_id",
        F.col("entry_date").alias("at"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("sale_id"),
        F.lit(None).cast(MONEY).alias("price_at_sale"),
        F.col("quantity").cast("bigint").alias("moved"),
    )
    dated = sales.select(F.col("id").alias("sale_id"), F.col("sale_date").alias("at"))
    sold = sale_items.join(dated, "sale_id").select(
        "product_id",
        "at",
        F.lit(1).alias("kind"),
        "sale_id",
        "price_at_sale",
        (-F.col("quantity").cast("bigint")).alias("moved"),
    )
    return received.unionByName(sold)


def oversell_audit(
    stock_entries: DataFrame, sale_items: DataFrame, sales: DataFrame
) -> DataFrame:
    """Sale lines larger than the stock there was. Reports breaches;
    ``replay.replay_sales`` plays out what refusing them would have changed."""
    levels = running_total(
        movements(stock_entries, sale_items, sales),
        ["product_id"],
        by_hour_or_sale("at", "kind", "sale_id"),
        [F.col(c) for c in ("at", "kind", "sale_id", "moved", "price_at_sale")],
        F.col("moved"),
        "stock_after",
    )
    return levels.filter((F.col("kind") == 1) & (F.col("stock_after") < 0)).select(
        "product_id",
        "sale_id",
        "at",
        (-F.col("moved")).alias("quantity"),
        (F.col("stock_after") - F.col("moved")).alias("available"),
        "stock_after",
    )


def extract_debtors(sales: DataFrame) -> DataFrame:
    """Receivables of credit sales that were not paid in full."""
    keep = [c for c in ("customer_name", "customer_phone", "due_date", "notes") if c in sales.columns]
    owing = (F.col("payment_method") == "credit") & (F.col("balance") > 0)
    return sales.filter(owing).select(
        F.col("id").alias("sale_id"),
        *keep,
        F.col("final_amount").alias("total_owed"),
        "amount_paid",
        "balance",
        F.lit("pending").alias("status"),
        F.col("sale_date").alias("created_at"),
    )


def duplicate_receipts(sales: DataFrame) -> DataFrame:
    """Receipt numbers given out more than once."""
    return (
        sales.groupBy("receipt_number")
        .agg(F.count(F.lit(1)).alias("sales_count"), F.min("id").alias("first_id"))
        .filter(F.col("sales_count") > 1)
    )


def _refused(events: DataFrame, reason: str) -> DataFrame:
    return events.select(
        "*", F.lit(False).alias("accepted"), F.lit(reason).alias("reject_reason")
    )


@dataclass(frozen=True)
class Adjusted:
    products: DataFrame
    entries: DataFrame
    rejects: DataFrame
    log: DataFrame


def adjustment_log(
    products: DataFrame, adjustments: DataFrame, seq: str, bucket: str, **sizes: int
) -> DataFrame:
    """Every adjustment with its outcome.

    ``adjustments``: ``product_id, adjustment_type, quantity, reason`` and a
    ``seq`` that orders them; ``bucket`` rises with ``seq``. Anything but
    ``remove`` adds.
    """
    listed = products.select(F.col("id").alias("product_id"))
    known = adjustments.join(listed, "product_id", "left_semi")
    unknown = adjustments.join(listed, "product_id", "left_anti")
    count = F.col("quantity").cast("bigint")
    signed = F.when(F.col("adjustment_type") == "remove", -count).otherwise(count)
    positive = known.filter(F.col("quantity") > 0).withColumn("delta", signed)
    openings = products.select(
        F.col("id").alias("product_id"), F.col("current_stock").cast("bigint").alias("opening")
    )
    order = [bucket, seq] if bucket != seq else [seq]
    settled = accept_in_order(
        positive, openings, "product_id", order, "delta", bucket, **sizes
    ).withColumn("reject_reason", F.when(~F.col("accepted"), "exceeds stock"))
    useless = known.filter(~(F.coalesce(F.col("quantity"), F.lit(0)) > 0))
    refused = _refused(useless, "quantity not positive").unionByName(
        _refused(unknown, "unknown product")
    )
    return settled.unionByName(refused, allowMissingColumns=True)


def apply_adjustments(
    products: DataFrame, adjustments: DataFrame, seq: str, bucket: str, **sizes: int
) -> Adjusted:
    """Manual stock corrections applied in order; a removal larger than the
    stock at that moment is refused."""
    log = adjustment_log(products, adjustments, seq, bucket, **sizes).checkpoint()
    done = log.filter("accepted")
    moved = done.groupBy(F.col("product_id").alias("id")).agg(F.sum("delta").alias("_moved"))
    stock = F.col("current_stock").cast("bigint") + F.coalesce("_moved", F.lit(0))
    removed = F.col("delta") < 0
    note = F.concat(
        F.when(removed, "REMOVED: ").otherwise("ADDED: "),
        F.abs("delta").cast("string"),
        F.lit(" items. Reason: "),
        F.coalesce("reason", F.lit("")),
    )
    prices = products.select(F.col("id").alias("product_id"), "buying_price", "selling_price")
    entries = done.join(prices, "product_id").select(
        "product_id",
        F.col("delta").alias("quantity"),
        "buying_price",
        "selling_price",
        F.lit("MANUAL_ADJUSTMENT").alias("supplier"),
        note.alias("notes"),
        seq,
    )
    return Adjusted(
        products.join(moved, "id", "left").withColumn("current_stock", stock).drop("_moved"),
        entries,
        log.filter(~F.col("accepted")),
        log,
    )


def stock_balance(stock_entries: DataFrame, sale_items: DataFrame) -> DataFrame:
    """Stock by product as its ledger tells: received less sold."""
    received = stock_entries.select("product_id", F.col("quantity").cast("bigint").alias("moved"))
    sold = sale_items.select("product_id", (-F.col("quantity").cast("bigint")).alias("moved"))
    return received.unionByName(sold).groupBy("product_id").agg(F.sum("moved").alias("ledger_stock"))


def stock_drift(products: DataFrame, stock_entries: DataFrame, sale_items: DataFrame) -> DataFrame:
    """Products whose stored stock differs from their ledger, and ledger rows
    of products that are not listed."""
    return drift_of(products, stock_balance(stock_entries, sale_items))


def drift_of(products: DataFrame, ledgered: DataFrame) -> DataFrame:
    """Drift of the stored stock from balances by product."""
    stored = products.select(
        F.col("id").alias("product_id"), F.col("current_stock").cast("bigint").alias("stored_stock")
    )
    drift = F.coalesce("stored_stock", F.lit(0)) - F.coalesce("ledger_stock", F.lit(0))
    return (
        stored.join(ledgered, "product_id", "full")
        .withColumn("drift", drift)
        .filter(F.col("drift") != 0)
    )


def debt_balance(debtors: DataFrame, payments: DataFrame) -> DataFrame:
    """Debtors with the sum of their recorded payments."""
    paid = payments.groupBy(F.col("debtor_id").alias("id")).agg(
        F.sum("amount").cast(TOTAL).alias("recorded_payments")
    )
    return recorded(debtors, paid)


def recorded(debtors: DataFrame, paid: DataFrame) -> DataFrame:
    """Debtors with their sums of payments, 0 where there is none."""
    return debtors.join(paid, "id", "left").withColumn(
        "recorded_payments", F.coalesce("recorded_payments", F.lit(0)).cast(TOTAL)
    )


def debt_drift(debtors: DataFrame, payments: DataFrame, sales: DataFrame) -> DataFrame:
    """Debtors that break one of the ledger rules: what is owed less what was
    paid is the balance; recorded payments do not exceed what was paid; the
    sale carries the same balance (write-offs leave it behind)."""
    sale = sales.select(F.col("id").alias("sale_id"), F.col("balance").alias("sale_balance"))
    gap = F.col("total_owed") - F.col("amount_paid") - F.col("balance")
    over = F.greatest(F.col("recorded_payments") - F.col("amount_paid"), F.lit(0).cast(TOTAL))
    behind = F.coalesce("sale_balance", F.lit(0)).cast(TOTAL) - F.col("balance")
    return (
        debt_balance(debtors, payments)
        .join(sale, "sale_id", "left")
        .select(
            "id",
            gap.cast(TOTAL).alias("balance_gap"),
            over.cast(TOTAL).alias("unrecorded_gap"),
            behind.cast(TOTAL).alias("sale_gap"),
        )
        .filter("balance_gap != 0 or unrecorded_gap != 0 or sale_gap != 0")
    )


@dataclass(frozen=True)
class Paid:
    debtors: DataFrame
    sales: DataFrame
    rejects: DataFrame
    log: DataFrame
    payments: DataFrame


def payment_log(
    debtors: DataFrame, payments: DataFrame, order: Sequence[str], bucket: str, **sizes: int
) -> DataFrame:
    """Every payment with its outcome.

    ``order`` is total inside a debtor and ``bucket`` rises with it. A payment
    above the balance left at that moment is refused and does not count for
    later ones.
    """
    listed = debtors.select(F.col("id").alias("debtor_id"))
    known = payments.join(listed, "debtor_id", "left_semi")
    unknown = payments.join(listed, "debtor_id", "left_anti")
    positive = known.filter(F.col("amount") > 0).withColumn("delta", -cents(F.col("amount")))
    openings = debtors.select(
        F.col("id").alias("debtor_id"), cents(F.col("balance")).alias("opening")
    )
    settled = (
        accept_in_order(positive, openings, "debtor_id", order, "delta", bucket, **sizes)
        .withColumn("balance_after", from_cents(F.col("level_after")))
        .withColumn("reject_reason", F.when(~F.col("accepted"), "exceeds balance"))
        .drop("delta", "level_after")
    )
    useless = known.filter(~(F.coalesce(F.col("amount"), F.lit(0)) > 0))
    refused = _refused(useless, "amount not positive").unionByName(
        _refused(unknown, "unknown debtor")
    )
    return settled.unionByName(refused, allowMissingColumns=True)


def apply_payments(
    debtors: DataFrame,
    sales: DataFrame,
    payments: DataFrame,
    order: Sequence[str],
    bucket: str,
    paid_at: str | None = None,
    **sizes: int,
) -> Paid:
    """Payments applied to debtors; the sale behind each debt follows. ``paid_at`` names the column
    with the moment of a payment: it dates the accepted payments, and the latest is the debtor's ``updated_at``."""
    log = payment_log(debtors, payments, order, bucket, **sizes).checkpoint()
    taken = (
        log.filter("accepted")
        .groupBy(F.col("debtor_id").alias("id"))
        .agg(
            F.sum("amount").cast(TOTAL).alias("_taken"),
            F.max(F.col(paid_at) if paid_at else F.lit(None)).cast("timestamp_ntz").alias("_at"),
        )
    )
    now_paid = debtors.join(taken, "id", "left")
    left = F.col("balance") - F.col("_taken")
    touched = F.col("_taken").isNotNull()
    updated = now_paid.withColumns(
        {
            "amount_paid": F.when(touched, F.col("amount_paid") + F.col("_taken"))
            .otherwise(F.col("amount_paid"))
            .cast(MONEY),
            "balance": F.when(touched, left).otherwise(F.col("balance")).cast(MONEY),
            "status": F.when(touched & (left <= 0), "paid").otherwise(F.col("status")),
            **({"updated_at": _moment(debtors, F.col("_at"))} if paid_at else {}),
        }
    ).drop("_at")
    follow = updated.filter(touched).select(
        F.col("sale_id").alias("id"), "_taken", F.col("balance").alias("_left")
    )
    new_sales = (
        sales.join(follow, "id", "left")
        .withColumns(
            {
                "amount_paid": (
                    F.col("amount_paid") + F.coalesce("_taken", F.lit(0).cast(TOTAL))
                ).cast(MONEY),
                "balance": F.coalesce("_left", "balance"),
            }
        )
        .drop("_taken", "_left")
    )
    taken_in = log.filter("accepted")
    if paid_at:
        taken_in = taken_in.withColumn("payment_date", F.col(paid_at).cast("timestamp_ntz"))
    recorded_as = [c for c in PAYMENTS if c in taken_in.columns]
    return Paid(
        updated.drop("_taken"), new_sales, log.filter(~F.col("accepted")), log, taken_in.select(recorded_as)
    )


def _moment(df: DataFrame, at: Column) -> Column:
    """``updated_at`` after a change at ``at``, as it was where that is null."""
    before = F.col("updated_at") if "updated_at" in df.columns else F.lit(None)
    return F.coalesce(at, before.cast("timestamp_ntz"))


@dataclass(frozen=True)
class WrittenOff:
    debtors: DataFrame
    payments: DataFrame
    rejects: DataFrame


def write_off(
    debtors: DataFrame,
    ids: DataFrame,
    seq: str = "seq",
    at: datetime | None = None,
    user_id: int | None = None,
) -> WrittenOff:
    """Close the debts named in ``ids`` (``id, reason`` and a unique ``seq``) with a
    payment of the whole balance, dated ``at`` (the debtor's ``updated_at`` too) by ``user_id``.
    The sale is left as it is. The first request for an open debt closes it; every other request is
    in ``rejects`` with its reason, those of unknown or null ids too."""
    first = ids.groupBy("id").agg(
        F.min(seq).alias("_first"), F.min_by("reason", seq).alias("_reason")
    )
    marked = debtors.join(first, "id", "left")
    closing = F.col("_first").isNotNull() & (F.col("balance") > 0)
    closed = marked.filter(closing)
    updated = marked.withColumns(
        {
            "amount_paid": F.when(closing, F.col("amount_paid") + F.col("balance"))
            .otherwise(F.col("amount_paid"))
            .cast(MONEY),
            "status": F.when(closing, "written_off").otherwise(F.col("status")),
            "balance": F.when(closing, F.lit(0)).otherwise(F.col("balance")).cast(MONEY),
            **(
                {"updated_at": _moment(debtors, F.when(closing, F.lit(at).cast("timestamp_ntz")))}
                if at
                else {}
            ),
        }
    ).drop("_first", "_reason")
    entries = closed.select(
        F.col("id").alias("debtor_id"),
        F.col("balance").alias("amount"),
        F.lit("write_off").alias("payment_method"),
        F.concat(F.lit("WRITE OFF - Reason: "), F.coalesce("_reason", F.lit(""))).alias("notes"),
        F.lit(at).cast("timestamp_ntz").alias("payment_date"),
        F.lit(user_id).cast("bigint").alias("user_id"),
    )
    state = marked.filter(F.col("_first").isNotNull()).select("id", "_first", closing.alias("_closes"))
    refused = F.when(F.col("_closes").isNull(), "unknown debtor").when(
        ~F.col("_closes") | (F.col(seq) != F.col("_first")), "already paid"
    )
    rejects = (
        ids.join(state, "id", "left")
        .withColumn("reject_reason", refused)
        .filter(F.col("reject_reason").isNotNull())
        .select(*ids.columns, "reject_reason")
    )
    return WrittenOff(updated, entries, rejects)


def _latest(changes: DataFrame, wanted: Column, value: str, seq: str, name: str) -> DataFrame:
    return (
        changes.filter(wanted)
        .groupBy(F.col("product_id").alias("id"))
        .agg(F.max_by(value, seq).alias(name))
    )


def check_product_changes(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Each requested change with the reason it is refused, or null."""
    listed = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_listed"))
    reorder, level = F.col("action") == "reorder", F.col("reorder_level")
    known_action = F.coalesce(F.col("action").isin("reorder", "deactivate"), F.lit(False))
    reason = (
        F.when(F.col("_listed").isNull(), "unknown product")
        .when(~known_action, "unknown action")
        .when(reorder & level.isNull(), "reorder level missing")
        .when(reorder & (level < 0), "negative reorder level")
    )
    return changes.join(listed, "product_id", "left").select(
        *changes.columns, reason.alias("reject_reason")
    )


def apply_product_changes(products: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Reorder levels and soft deletes in bulk.

    ``changes``: ``product_id, action, reorder_level, seq`` with action
    ``reorder`` or ``deactivate``. The latest valid level wins; what is refused
    comes from ``rejected_product_changes``.
    """
    level_ok = (F.col("action") == "reorder") & (F.col("reorder_level") >= 0)
    levels = _latest(changes, level_ok, "reorder_level", seq, "_level")
    gone = (
        changes.filter(F.col("action") == "deactivate")
        .select(F.col("product_id").alias("id"), F.lit(False).alias("_active"))
        .distinct()
    )
    return (
        products.join(levels, "id", "left")
        .join(gone, "id", "left")
        .withColumns(
            {
                "reorder_level": F.coalesce("_level", "reorder_level"),
                "is_active": F.coalesce("_active", "is_active"),
            }
        )
        .drop("_level", "_active")
    )


def rejected_product_changes(products: DataFrame, changes: DataFrame) -> DataFrame:
    return check_product_changes(products, changes).filter(F.col("reject_reason").isNotNull())
