"""Declared columns and types of the retail tables; readers never infer types."""

from __future__ import annotations


def _columns(text: str) -> dict[str, str]:
    return dict(column.strip().split(" ", 1) for column in text.split(", "))


CATEGORIES = _columns("id bigint, name string, description string, created_at timestamp_ntz")

USERS = _columns(
    "id bigint, username string, full_name string, is_active boolean, created_at timestamp_ntz"
)

PRODUCTS = _columns(
    "id bigint, name string, category_id bigint, current_stock int, reorder_level int,"
    " buying_price decimal(18,2), selling_price decimal(18,2), unit_type string,"
    " unit_conversion int, image_filename string, is_active boolean,"
    " created_at timestamp_ntz, updated_at timestamp_ntz"
)

PRODUCT_VARIANTS = _columns(
    "id bigint, product_id bigint, variant_name string, sku string, current_stock int,"
    " extra_cost decimal(18,2)"
)

STOCK_ENTRIES = _columns(
    "id bigint, product_id bigint, quantity int, buying_price decimal(18,2),"
    " selling_price decimal(18,2), supplier string, notes string,"
    " entry_date timestamp_ntz, user_id bigint"
)

SALES = _columns(
    "id bigint, receipt_number string, total_amount decimal(18,2), discount decimal(18,2),"
    " final_amount decimal(18,2), payment_method string, amount_paid decimal(18,2),"
    " balance decimal(18,2), customer_name string, customer_phone string, notes string,"
    " sale_date timestamp_ntz, user_id bigint"
)

SALE_ITEMS = _columns(
    "id bigint, sale_id bigint, product_id bigint, quantity int,"
    " price_at_sale decimal(18,2), total decimal(18,2), variant_id bigint"
)

DEBTORS = _columns(
    "id bigint, sale_id bigint, customer_name string, customer_phone string,"
    " total_owed decimal(18,2), amount_paid decimal(18,2), balance decimal(18,2),"
    " due_date date, status string, notes string, created_at timestamp_ntz,"
    " updated_at timestamp_ntz"
)

PAYMENTS = _columns(
    "id bigint, debtor_id bigint, amount decimal(18,2), payment_method string,"
    " notes string, payment_date timestamp_ntz, user_id bigint"
)

TABLES = {
    "categories": CATEGORIES,
    "users": USERS,
    "products": PRODUCTS,
    "product_variants": PRODUCT_VARIANTS,
    "stock_entries": STOCK_ENTRIES,
    "sales": SALES,
    "sale_items": SALE_ITEMS,
    "debtors": DEBTORS,
    "payments": PAYMENTS,
}

def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


# One object of the batch intake form; every value arrives as text.
# As maps, so that a field left out differs from one that is null.
INTAKE_JSON = "array<map<string,string>>"

INTAKE_REQUIRED = ("name", "category", "quantity", "buying_price", "selling_price")
INTAKE_COLUMNS = INTAKE_REQUIRED + ("supplier",)
