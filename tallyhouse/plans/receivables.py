"""Credit customers: lists, profiles, statements and totals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import debt, pricing, text
from tallyhouse.functions.money import total
from tallyhouse.operators import lines as L
from tallyhouse.operators.running import by_hour, running_total
from tallyhouse.sources.tables import RetailTables


def debt_summary(debtors: DataFrame, as_of: date) -> DataFrame:
    """Outstanding total over all rows, and counts of owing and overdue ones."""
    owing = F.col("balance") > 0
    return debtors.agg(
        total(F.col("balance")).alias("total_debt"),
        F.count_if(owing).alias("debtor_count"),
        F.count_if(debt.is_overdue(F.col("balance"), F.col("due_date"), as_of)).alias(
            "overdue_count"
        ),
    )


def debtors_list(
    debtors: DataFrame, as_of: date, status: str = "", search: str = ""
) -> DataFrame:
    """Owing debtors, largest balance first, with status and age."""
    balance, due = F.col("balance"), F.col("due_date")
    found = debtors.filter(debt.matches_status(status, balance, due, as_of))
    if search:
        found = found.filter(
            text.contains(F.col("customer_name"), search)
            | text.contains(F.col("customer_phone"), search)
        )
    return found.select(
        "id",
        "customer_name",
        "customer_phone",
        "created_at",
        "total_owed",
        "amount_paid",
        "balance",
        debt.aging_bucket(F.col("created_at"), as_of).alias("aging_category"),
        "due_date",
        debt.debt_status(balance, due, as_of).alias("debt_status"),
    ).orderBy(F.desc("balance"), "id")


def _credit_sales(t: RetailTables) -> DataFrame:
    """Sales behind the debts; only their lines are read."""
    return t.sales.join(t.debtors.select(F.col("sale_id").alias("id")), "id", "left_semi")


def debtor_profile(t: RetailTables, as_of: date) -> DataFrame:
    """One row for each debtor: progress, its sale, and totals of the lines and
    payments. The lines and payments themselves are ``debtor_lines`` and
    ``debtor_payments``, so no debtor is gathered into one value."""
    paid = t.payments.groupBy(F.col("debtor_id").alias("id")).agg(
        F.count(F.lit(1)).alias("payment_count"), total(F.col("amount")).alias("payment_total")
    )
    bought = L.of_sales(t.sale_items, _credit_sales(t)).groupBy("sale_id").agg(
        F.count(F.lit(1)).alias("line_count"), total(F.col("total")).alias("line_total")
    )
    sale = t.sales.select(
        F.col("id").alias("sale_id"), "receipt_number", F.col("total_amount").alias("sale_total")
    )
    return (
        t.debtors.join(sale, "sale_id", "left")
        .join(bought, "sale_id", "left")
        .join(paid, "id", "left")
        .select(
            "id",
            "customer_name",
            text.initial(F.col("customer_name")).alias("initial"),
            "receipt_number",
            "sale_total",
            "total_owed",
            "amount_paid",
            "balance",
            pricing.repayment_pct(F.col("amount_paid"), F.col("total_owed")).alias("paid_pct"),
            debt.debt_status(F.col("balance"), F.col("due_date"), as_of).alias("debt_status"),
            F.coalesce("line_count", F.lit(0)).alias("line_count"),
            F.coalesce("line_total", F.lit(0)).alias("line_total"),
            F.coalesce("payment_count", F.lit(0)).alias("payment_count"),
            F.coalesce("payment_total", F.lit(0)).alias("payment_total"),
        )
    )


def debtor_lines(t: RetailTables) -> DataFrame:
    """What each debtor bought on credit."""
    owing = t.debtors.select(F.col("id").alias("debtor_id"), "sale_id")
    names = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    return (
        L.of_sales(t.sale_items, _credit_sales(t))
        .join(owing, "sale_id")
        .join(names, "product_id", "left")
        .select("debtor_id", "product", "quantity", "price_at_sale", "total")
    )


def debtor_payments(t: RetailTables) -> DataFrame:
    """Payments with the name of the person who recorded them."""
    staff = t.users.select(F.col("id").alias("user_id"), "username")
    known = t.debtors.select(F.col("id").alias("debtor_id"))
    return (
        t.payments.join(known, "debtor_id", "left_semi")
        .join(staff, "user_id")
        .select(
            "debtor_id",
            F.col("id").alias("payment_id"),
            "payment_date",
            "amount",
            "payment_method",
            "username",
            F.coalesce("notes", F.lit("—")).alias("notes"),
        )
    )


def debtor_statement(t: RetailTables) -> DataFrame:
    """Payments oldest first, with the sum paid and the balance left after each.

    The stored balance has every recorded payment in it, and the deposit taken at the sale. So the
    opening is the balance with the payments added back, and the last balance is the stored one. The
    running sum is cut by the hour, so one debtor's history needs no single task.
    """
    recorded = t.payments.groupBy("debtor_id").agg(F.sum("amount").alias("recorded"))
    owed = t.debtors.select(F.col("id").alias("debtor_id"), "customer_name", "balance")
    owed = owed.join(recorded, "debtor_id")
    paid = running_total(
        t.payments,
        ["debtor_id"],
        by_hour("payment_date"),
        [F.col("payment_date"), F.col("id")],
        F.col("amount"),
        "paid_to_date",
    )
    return paid.join(owed, "debtor_id").select(
        "debtor_id",
        "customer_name",
        F.col("id").alias("payment_id"),
        "payment_date",
        "amount",
        "payment_method",
        F.col("paid_to_date").cast("decimal(38,2)").alias("paid_to_date"),
        (F.col("balance") + F.col("recorded") - F.col("paid_to_date")).cast("decimal(38,2)").alias("left_to_pay"),
    )
