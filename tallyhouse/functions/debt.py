"""Receivable status and ageing, relative to an explicit ``as_of`` date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DUE_SOON_DAYS = 3
STATUS_FILTERS = ("", "overdue", "due_soon", "pending")


def debt_status(balance: Column, due: Column, as_of: date) -> Column:
    soon = as_of + timedelta(days=DUE_SOON_DAYS)
    return (
        F.when(balance <= 0, "paid")
        .when(due < F.lit(as_of), "overdue")
        .when(due <= F.lit(soon), "due_soon")
        .otherwise("pending")
    )


def aging_bucket(created: Column, as_of: date) -> Column:
    days = F.datediff(F.lit(as_of), created.cast("date"))
    return F.when(days <= 3, "0-3 days").when(days <= 14, "4-14 days").otherwise("15+ days")


def is_overdue(balance: Column, due: Column, as_of: date) -> Column:
    """Owing and past due; a debt without due date is never overdue."""
    return (due < F.lit(as_of)) & (balance > 0)


def matches_status(option: str, balance: Column, due: Column, as_of: date) -> Column:
    """List filter. ``pending`` keeps everything due today or later, so it also
    returns debts due soon and leaves out debts without a due date."""
    soon = as_of + timedelta(days=DUE_SOON_DAYS)
    owing = balance > 0
    if option == "overdue":
        return owing & (due < F.lit(as_of))
    if option == "due_soon":
        return owing & (due >= F.lit(as_of)) & (due <= F.lit(soon))
    if option == "pending":
        return owing & (due >= F.lit(as_of))
    return owing
