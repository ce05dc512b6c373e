"""Profit, margin, discount and payment rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.money import percent, percent_label
from tallyhouse.functions.text import format_currency


def unit_profit(buying: Column, selling: Column) -> Column:
    return selling - buying


def total_profit(buying: Column, selling: Column, quantity: Column) -> Column:
    return (selling - buying) * F.coalesce(quantity, F.lit(0))


def margin_pct(buying: Column, selling: Column) -> Column:
    """Profit as a percentage of the selling price; 0 without a positive price."""
    return F.when(selling > 0, percent(selling - buying, selling)).otherwise(F.lit(0.0))


def margin_band(pct: Column, good_from: float = 15) -> Column:
    """``loss`` below 0, ``thin`` below ``good_from``, else ``good``."""
    return F.when(pct < 0, "loss").when(pct < good_from, "thin").otherwise("good")


def below_cost(buying: Column, selling: Column) -> Column:
    return selling < buying


def below_cost_warning(buying: Column, selling: Column) -> Column:
    """Warning text for a loss-making price, else null."""
    return F.when(
        below_cost(buying, selling),
        F.concat(
            F.lit("Selling price ("), format_currency(selling),
            F.lit(") is below buying price ("), format_currency(buying),
            F.lit(")! This will result in loss."),
        ),
    )


def discount_amount(subtotal: Column, kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "percentage", subtotal * value / 100)
        .when(kind == "fixed", value)
        .otherwise(F.lit(0))
        .cast("decimal(38,2)")
    )


def final_amount(subtotal: Column, discount: Column, clamp: bool = False) -> Column:
    """Subtotal less discount; may be negative unless ``clamp`` is set."""
    final = subtotal - discount
    return F.greatest(final, F.lit(0).cast("decimal(38,2)")) if clamp else final


def credit_balance(method: Column, final: Column, paid: Column) -> Column:
    return F.when(method == "credit", final - paid).otherwise(F.lit(0)).cast("decimal(38,2)")


def payment_acceptable(method: Column, final: Column, paid: Column) -> Column:
    return (method == "credit") | (paid >= final)


def effective_price(override: Column, selling: Column) -> Column:
    """The override unless it is missing or 0, else the list price."""
    return F.coalesce(F.nullif(override, F.lit(0).cast("decimal(18,2)")), selling)


def repayment_pct(paid: Column, owed: Column) -> Column:
    """Share repaid with one decimal; null when nothing was owed."""
    return F.when(owed > 0, percent_label(paid, owed))
