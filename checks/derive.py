"""Batches of intake, adjustments, payments and changes, all derived by Spark
from the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.money import cents, from_cents
from tallyhouse.sources import mapped
from tallyhouse.sources.schemas import INTAKE_COLUMNS


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return mapped.star(spark, sf, "events")


def _kind(*names: str):
    return F.col("event_type").isin(*names)


def intake_text(spark: SparkSession, sf: str) -> DataFrame:
    """One intake row for each event, all fields as text. Sign-ups name new
    products under new categories, errors carry a fractional quantity."""
    part = mapped.star(spark, sf, "part")
    rows = _events(spark, sf).join(part, F.col("user_id") == F.col("p_partkey"))
    price = cents(F.col("value"))
    new = _kind("signup")
    known = F.concat("p_name", F.lit(" #"), "p_partkey")
    name = F.when(new, F.concat(F.lit("NEW "), known)).otherwise(known)
    return rows.select(
        F.col("event_id").alias("seq"),
        F.when(_kind("click"), F.concat(F.lit("  "), name)).otherwise(name).alias("name"),
        F.when(new, F.col("p_brand")).otherwise(F.col("p_type")).alias("category"),
        F.when(_kind("error"), from_cents(price).cast("string"))
        .otherwise(F.floor("value").cast("string"))
        .alias("quantity"),
        from_cents(price).cast("string").alias("buying_price"),
        from_cents(F.expr("cast(rint(value * 100) as bigint) * 6 div 5"))
        .cast("string")
        .alias("selling_price"),
        F.concat(F.lit("Supplier "), F.col("event_id") % 7).alias("supplier"),
    )


def intake_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The intake with cells left empty: some names, some categories."""
    left_out = lambda c, n: F.when(F.col("seq") % n != 0, F.col(c))
    return intake_text(spark, sf).withColumns({"name": left_out("name", 97), "category": left_out("category", 89)})


def intake_folder(spark: SparkSession, sf: str, path: str) -> None:
    """The same rows as CSV files of a folder, in order of their names."""
    rows = intake_rows(spark, sf).orderBy("seq").drop("seq")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)


def intake_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON batch of two objects for each intake row."""
    row = F.struct(
        "name",
        F.col("seq").cast("string").alias("category_id"),
        "quantity",
        "buying_price",
        "selling_price",
        "supplier",
    )
    twin = F.struct(
        F.lit("twin").alias("name"),
        F.lit("none").alias("category_id"),
        "quantity",
        "buying_price",
        "selling_price",
        F.lit(None).cast("string").alias("supplier"),
    )
    return intake_text(spark, sf).select("seq", F.to_json(F.array(row, twin)).alias("batch"))


def product_list(spark: SparkSession, sf: str) -> DataFrame:
    """The products as an intake file; every third name holds a bare quote."""
    p = mapped.products(spark, sf)
    kinds = mapped.categories(spark, sf).select(
        F.col("id").alias("category_id"), F.col("name").alias("category")
    )
    inch = F.when(F.col("id") % 3 == 0, '"').otherwise("")
    return p.join(kinds, "category_id").select(
        F.concat("name", inch).alias(" Name "),
        F.col("category").alias("CATEGORY"),
        F.col("current_stock").cast("string").alias("Quantity"),
        F.col("buying_price").cast("string").alias("buying_price"),
        F.col("selling_price").cast("string").alias("Selling_Price"),
        F.concat(F.lit("Supplier "), F.col("id") % 9).alias("supplier"),
    )


def _workbook(rows: pd.DataFrame) -> bytes:
    def cell(value: str) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = [list(rows.columns), *rows.itertuples(index=False)]
    body = "".join(f"<row>{''.join(cell(v) for v in line)}</row>" for line in lines)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>'
            '<sheet name="Stock" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{rels}">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        )
    return out.getvalue()


WORKBOOK_ROWS = 500


def workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """The product list as many workbooks of at most 500 products."""
    rows = mapped.products(spark, sf).join(
        mapped.categories(spark, sf).select(
            F.col("id").alias("category_id"), F.col("name").alias("category")
        ),
        "category_id",
    )
    texts = rows.select(
        F.expr(f"id div {WORKBOOK_ROWS}").alias("book"),
        "name",
        "category",
        F.col("current_stock").cast("string").alias("quantity"),
        F.col("buying_price").cast("string").alias("buying_price"),
        F.col("selling_price").cast("string").alias("selling_price"),
        F.concat(F.lit("Supplier "), F.col("id") % 9).alias("supplier"),
    )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        path = f"products-{rows['book'].iloc[0]}.xlsx"
        return pd.DataFrame(
            {"path": [path], "content": [_workbook(rows[list(INTAKE_COLUMNS)])]}
        )

    return texts.groupBy("book").applyInPandas(pack, "path string, content binary")


def adjustments(spark: SparkSession, sf: str) -> DataFrame:
    """One stock correction for each event; the user id names the product."""
    return _events(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.expr("event_id div 1024").alias("slot"),
        F.col("user_id").alias("product_id"),
        F.when(_kind("purchase", "click", "error"), "remove").otherwise("add").alias(
            "adjustment_type"
        ),
        F.floor("value").cast("int").alias("quantity"),
        F.col("event_type").alias("reason"),
    )


def late_payments(spark: SparkSession, sf: str) -> DataFrame:
    """One payment for each event; the user id names the debtor."""
    return _events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("debtor_id"),
        from_cents((cents(F.col("value")) - 100) * 50).alias("amount"),
        F.when(_kind("click"), "mpesa").otherwise("cash").alias("payment_method"),
        F.col("ts").alias("payment_date"),
        F.col("ts").cast("date").alias("paid_on"),
    )


def product_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("product_id"),
        F.when(_kind("error") & (F.col("value") > 300), "deactivate")
        .otherwise("reorder")
        .alias("action"),
        (F.floor("value") - 20).cast("int").alias("reorder_level"),
    )


def shelf_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The categories, and every brand as one without products."""
    kinds = mapped.categories(spark, sf).select("id", "name")
    brands = mapped.star(spark, sf, "part").select("p_brand").distinct()
    place = F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint")
    return kinds.unionByName(brands.select((place + 1_000_000).alias("id"), F.col("p_brand").alias("name")))


def category_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in six waves over all categories: many hang on the answers to earlier ones.

    Types are renamed, their old names asked for by a new category and by the next brand, renamed back
    and dropped; brands swap names by way of a free one, are dropped and renamed once more.
    """
    shelf = shelf_categories(spark, sf)
    brand = F.col("id") >= 1_000_000
    none, wave = F.lit(None), lambda k: F.col("id") + k * 10_000_000

    def asked(rows: DataFrame, action: str, number: Column, name: Column, k: int) -> DataFrame:
        return rows.select(F.lit(action).alias("action"), number.cast("bigint").alias("id"), name.cast("string").alias("name"), wave(k).alias("seq"))

    kinds, brands = shelf.filter(~brand), shelf.filter(brand)
    away = F.concat(F.lit("  old "), "name")
    parts = [
        asked(kinds, "add", none, F.col("name"), 0),
        asked(kinds.filter("id % 2 = 0"), "rename", F.col("id"), away, 1),
        asked(kinds, "add", none, F.concat("name", F.lit(" ")), 2),
        asked(kinds, "rename", F.col("id"), F.col("name"), 3),
        asked(kinds, "delete", F.col("id"), none, 4),
        asked(kinds, "rename", F.col("id"), F.when(F.col("id") % 3 == 0, " "), 5),
        asked(brands, "rename", F.col("id"), away, 0),
        asked(brands, "rename", F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1), F.col("name"), 1),
        asked(brands, "add", none, away, 2),
        asked(brands, "delete", F.col("id"), none, 3),
        asked(brands, "add", none, F.col("name"), 4),
        asked(brands, "rename", F.col("id"), F.col("name"), 5),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def checkout_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Every sale as an open checkout with a discount."""
    key = F.col("id")
    return mapped.sales(spark, sf).select(
        key.alias("sale_id"),
        "payment_method",
        "amount_paid",
        F.when(key % 3 == 0, "percentage").when(key % 3 == 1, "fixed").otherwise("none").alias(
            "discount_type"
        ),
        (key % 20).cast("decimal(18,2)").alias("discount_value"),
    )


def checkout_lines(spark: SparkSession, sf: str) -> DataFrame:
    price = cents(F.col("price_at_sale"))
    override = (
        F.when(F.col("product_id") % 7 == 0, F.lit(0).cast("bigint"))
        .when(F.col("product_id") % 5 == 0, F.floor(price * 9 / 10))
        .cast("bigint")
    )
    return mapped.sale_items(spark, sf).select(
        "sale_id",
        "product_id",
        "quantity",
        F.col("price_at_sale").alias("selling_price"),
        from_cents(override).alias("price_override"),
    )


#: Ids of sales that a batch adds start here.
LATE_SALES = 1_000_000_000_000


def late_batch(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Changes of the stored tables, by kind of event: errors redate the sale of their number,
    purchases are new sales of one line, clicks replace the lines of the sale of their number,
    sign-ups receive stock. Every event is a payment as well; the user id names product and debtor."""
    events, price = _events(spark, sf), from_cents(cents(F.col("value")))
    late = (F.col("event_id") + LATE_SALES).alias("id")
    redated = mapped.sales(spark, sf).join(
        events.filter(_kind("error")).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz")), "id"
    )
    made = events.filter(_kind("purchase")).select(
        late,
        F.concat(F.lit("LATE-"), "event_id").alias("receipt_number"),
        price.alias("final_amount"),
        F.lit("cash").alias("payment_method"),
        F.col("ts").cast("timestamp_ntz").alias("sale_date"),
    )
    lines = events.filter(_kind("purchase", "click")).select(
        F.when(_kind("purchase"), late).otherwise(F.col("event_id")).alias("sale_id"),
        F.col("user_id").alias("product_id"),
        F.when(_kind("purchase"), F.floor("value") % 5 + 1).otherwise(1).alias("quantity"),
        price.alias("price_at_sale"),
    )
    entries = events.filter(_kind("signup")).select(
        F.col("user_id").alias("product_id"),
        F.floor("value").alias("quantity"),
        F.col("ts").alias("entry_date"),
    )
    return {
        "sales": redated.withColumn("sale_date", F.col("ts")).unionByName(made, allowMissingColumns=True),
        "sale_items": lines,
        "stock_entries": entries,
        "payments": late_payments(spark, sf),
    }


def best_seller_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The sale lines, with one product on all lines of every second sale."""
    best = F.when(F.col("sale_id") % 2 == 0, F.lit(1).cast("bigint")).otherwise(F.col("product_id"))
    return mapped.sale_items(spark, sf).withColumn("product_id", best)
