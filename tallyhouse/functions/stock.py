"""Stock level classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of cover reported for a product that did not sell in the window.
NO_SALES_DAYS = 999


def stock_status(stock: Column, reorder: Column) -> Column:
    return (
        F.when(stock <= 0, "out_of_stock")
        .when(stock <= reorder, "critical")
        .when(stock <= reorder * 2, "low")
        .otherwise("healthy")
    )


def stock_status_info(stock: Column, reorder: Column) -> Column:
    """Status with its display colour and text."""
    status = stock_status(stock, reorder)
    color = (
        F.when(status.isin("out_of_stock", "critical"), "danger")
        .when(status == "low", "warning")
        .otherwise("success")
    )
    text = F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))
    text = F.when(status == "out_of_stock", "Out of Stock").otherwise(text)
    return F.struct(status.alias("status"), color.alias("color"), text.alias("text"))


def days_remaining(stock: Column, daily: Column) -> Column:
    """Whole days of cover: 0 without stock, 999 without sales."""
    cover = F.floor(F.try_divide(stock.cast("double"), daily.cast("double"))).cast("bigint")
    return (
        F.when(stock <= 0, F.lit(0))
        .when(F.coalesce(daily, F.lit(0)) <= 0, F.lit(NO_SALES_DAYS))
        .otherwise(cover)
        .cast("bigint")
    )


def days_band(days: Column, red: int = 3, amber: int = 7, inclusive: bool = True) -> Column:
    """List pages use ``<= 3 / <= 7``; the detail page ``< 7 / < 14``."""
    if inclusive:
        return F.when(days <= red, "red").when(days <= amber, "amber").otherwise("green")
    return F.when(days < red, "red").when(days < amber, "amber").otherwise("green")


def suggested_restock(reorder: Column) -> Column:
    return reorder * 2


def stock_dot(stock: Column, low: Column | int = 5) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    return F.when(stock == 0, "out").when(stock <= low, "low").otherwise("ok")


def is_low(stock: Column, reorder: Column, active: Column) -> Column:
    return (stock <= reorder) & active


def is_critical_dashboard(stock: Column, active: Column) -> Column:
    """The dashboard counts stock of exactly 0."""
    return (stock == 0) & active


def is_critical_listing(stock: Column) -> Column:
    """The low-stock page counts 0 and below."""
    return stock <= 0


def is_sellable(stock: Column, active: Column) -> Column:
    return (stock > 0) & active


def value_at_risk(stock: Column, buying: Column) -> Column:
    return stock * buying
