"""Checks on stock intake rows whose fields arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip


def _price_error(price: Column, label: str) -> Column:
    number = price.try_cast("double")
    return (
        F.when(number.isNull(), f"{label} price must be a valid number")
        .when(number < 0, f"{label} price cannot be negative")
    )


def stock_entry_errors(name: Column, quantity: Column, buying: Column, selling: Column) -> Column:
    """All complaints about one form entry; an empty array means valid."""
    count = quantity.try_cast("bigint")
    return F.array_compact(
        F.array(
            F.when(
                F.coalesce(F.length(strip(name)), F.lit(0)) < 2,
                "Product name must be at least 2 characters",
            ),
            F.when(count.isNull(), "Quantity must be a valid number").when(
                count <= 0, "Quantity must be greater than 0"
            ),
            _price_error(buying, "Buying"),
            _price_error(selling, "Selling"),
        )
    )


def whole_count(quantity: Column) -> Column:
    """A count from a file, where numbers may carry decimals: cut off towards zero."""
    return quantity.try_cast("decimal(38,6)").try_cast("int")


def intake_reject_reason(
    count: Column, buying: Column, selling: Column, name: Column, category: Column | None = None
) -> Column:
    """Why a batch or import row is not taken in; null for accepted rows.

    ``count`` is the converted quantity. A cell without a value can't be a name or
    category, an empty text can. Failures come in the order in which fields are
    read, then the rule that quantity and buying price must both be positive.
    """
    cost = buying.try_cast("decimal(18,2)")
    price = selling.try_cast("decimal(18,2)")
    reason = F.when(name.isNull(), "bad name")
    if category is not None:
        reason = reason.when(category.isNull(), "bad category")
    return (
        reason.when(count.isNull(), "bad quantity")
        .when(cost.isNull(), "bad buying price")
        .when(price.isNull(), "bad selling price")
        .when((count <= 0) | (cost <= 0), "not positive")
    )
