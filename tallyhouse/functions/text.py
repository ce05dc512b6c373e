"""Formatting, search and clean-up of text and dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_currency(amount: Column) -> Column:
    return F.concat(F.lit("KSh "), F.format_number(amount, 2))


def receipt_number(ts: Column) -> Column:
    return F.date_format(ts, "'INV-'yyyyMMdd-HHmmss")


def sanitize_text(text: Column) -> Column:
    """Keep word characters, white space and hyphens of any script."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s-]", "")


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends; ``trim`` takes blanks only."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_date(text: Column, as_of: date) -> Column:
    """Year, month and day with or without leading zeros, or ``as_of`` where the text is no date."""
    return F.coalesce(F.try_to_date(text, "yyyy-M-d"), F.lit(as_of))


def walk_in(customer: Column) -> Column:
    return F.coalesce(F.nullif(customer, F.lit("")), F.lit("Walk-in"))


def signed_label(quantity: Column) -> Column:
    return F.concat(F.when(quantity > 0, "+").otherwise(""), quantity.cast("string"))


def initial(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def stamp_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def contains(text: Column, term: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the term stay wildcards."""
    escaped = term.replace("\\", "\\\\")
    return text.ilike(f"%{escaped}%")
