import tracemalloc
import zipfile
from datetime import date
from decimal import Decimal
from types import SimpleNamespace

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks.derive import _workbook
from tallyhouse.plans import intake as plans
from tallyhouse.plans import sales
from tallyhouse.sources import intake, sinks, workbooks
from tallyhouse.sources.tables import RetailTables, load_tables, write_tables
from tallyhouse.sources.workbooks import read_stock_workbooks

HEADER = " Name ,CATEGORY,quantity,Buying_Price,selling_price,supplier"
LINES = ['Cola,Drinks,50,45,70,Acme', 'Old TV 43",Electronics,5,25000,35000,Tele', "Tie,Clothes,1,1,2,"]


def test_csv_with_bare_quote_and_any_extension_case(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("\n".join([HEADER, *LINES[:2]]))
    (tmp_path / "b.csv").write_text("\n".join([HEADER, LINES[2]]))
    (tmp_path / "c.txt").write_text("not,a,list")
    got = intake.read_stock_csv(spark, str(tmp_path))
    assert got.columns == [
        "name", "category", "quantity", "buying_price", "selling_price", "supplier",
    ]
    assert sorted(rows(got, "name", "quantity", "supplier")) == [
        ("Cola", "50", "Acme"), ('Old TV 43"', "5", "Tele"), ("Tie", "1", ""),
    ]


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,quantity\nCola,5")
    with pytest.raises(ValueError, match="Missing columns: category, buying_price, selling_price"):
        intake.read_stock_csv(spark, str(tmp_path))


def test_supplier_is_optional(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "name,category,quantity,buying_price,selling_price\nCola,Drinks,1,2,3"
    )
    assert rows(intake.read_stock_csv(spark, str(tmp_path)), "supplier") == [("",)]


def test_preview(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *LINES * 3]))
    shown = intake.preview(intake.read_csv_text(spark, str(tmp_path)))
    assert shown.head.count() == 5 and rows(shown.rows) == [(9,)]
    assert [c.strip().lower() for c in shown.columns][:2] == ["name", "category"]


def test_allowed_files(spark):
    df = spark.createDataFrame([("a.csv",), ("b.XLSX",), ("c.xls",), ("d.txt",), ("csv",)], "p string")
    assert [r[0] for r in df.select(intake.is_allowed_file(F.col("p"))).collect()] == [
        True, True, True, False, False,
    ]


def test_workbooks_in_parallel(spark, tmp_path):
    columns = ["Name ", "CATEGORY", "quantity", "buying_price", "selling_price"]
    for i in range(3):
        table = pd.DataFrame([[f"P{i} <&>", "Drinks", 5, 1.5, 2]], columns=columns)
        (tmp_path / f"book{i}.XLSX").write_bytes(_workbook(table))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    short = pd.DataFrame([["x"]], columns=["name"])
    (tmp_path / "short.xlsx").write_bytes(_workbook(short))
    got = read_stock_workbooks(spark, str(tmp_path)).collect()
    good = sorted((r.name, r.quantity, r.buying_price) for r in got if r.error is None)
    assert good == [(f"P{i} <&>", "5", "1.5") for i in range(3)]
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in got if r.error}
    assert set(errors) == {"broken.xlsx", "short.xlsx"}
    assert errors["short.xlsx"].startswith("Missing columns: category")


def test_workbook_with_shared_strings_and_gaps(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    words = ["name", "category", "quantity", "buying_price", "selling_price", "Cola", "Drinks"]
    head = "".join(f'<c r="{"ABCDEF"[i + (i > 2)]}1" t="s"><v>{i}</v></c>' for i in range(5))
    body = (
        '<c r="A2" t="s"><v>5</v></c><c r="B2" t="s"><v>6</v></c>'
        '<c r="C2"><v>7</v></c><c r="E2"><v>1.25</v></c><c r="F2"><v>2</v></c>'
    )
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{office}"><sheets>'
            '<sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/s.xml"/>'
            "</Relationships>",
        )
        book.writestr(
            "xl/sharedStrings.xml",
            f"<sst {main}>{''.join(f'<si><t>{w}</t></si>' for w in words)}</sst>",
        )
        book.writestr(
            "xl/worksheets/s.xml",
            f"<worksheet {main}><sheetData><row>{head}</row><row>{body}</row>"
            "</sheetData></worksheet>",
        )
    got = read_stock_workbooks(spark, str(tmp_path))
    assert rows(got, "name", "category", "quantity", "buying_price", "selling_price") == [
        ("Cola", "Drinks", "7", "1.25", "2")
    ]


def _long_book(path, count, tail="</sheetData></worksheet>"):
    """A book of ``count`` products, every name a shared text of its own."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    heads = ["name", "category", "quantity", "buying_price", "selling_price"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{office}"><sheets>'
            '<sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        )
        with book.open("xl/sharedStrings.xml", "w") as part:
            part.write(f"<sst {main}>".encode())
            for text in [*heads, "Drinks"]:
                part.write(f"<si><t>{text}</t></si>".encode())
            for i in range(count):
                part.write(f"<si><r><t>Cola é </t></r><r><t>{i}</t></r></si>".encode())
            part.write(b"</sst>")
        with book.open("xl/worksheets/s.xml", "w") as part:
            cells = "".join(f'<c t="s"><v>{i}</v></c>' for i in range(5))
            part.write(f"<worksheet {main}><sheetData><row>{cells}</row>".encode())
            for i in range(count):
                part.write(
                    f'<row><c t="s"><v>{i + 6}</v></c><c t="s"><v>5</v></c><c><v>{i}</v></c>'
                    "<c><v>1.5</v></c><c><v>2</v></c></row>".encode()
                )
            part.write(tail.encode())


def test_a_long_workbook_is_read_whole(spark, tmp_path):
    _long_book(tmp_path / "long.xlsx", 25_000)
    _long_book(tmp_path / "torn.xlsx", 25_000, "<row>")
    got = read_stock_workbooks(spark, str(tmp_path))
    torn = got.filter("path like '%torn.xlsx'")
    assert torn.count() == 1 and torn.filter("error is not null and name is null").count() == 1
    long = got.filter("path like '%long.xlsx'")
    right = "name = concat('Cola é ', line) and quantity = string(line) and category = 'Drinks' and error is null"
    assert long.count() == 25_000 == long.filter(right).select("line").distinct().count()


def test_memory_of_a_sheet_does_not_grow_with_its_rows(tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "SPOOLED_BYTES", 1 << 16)
    peaks = []
    for count in (4_000, 24_000):
        path = tmp_path / f"{count}.xlsx"
        _long_book(path, count)
        content = path.read_bytes()
        tracemalloc.start()
        assert sum(1 for _ in workbooks.sheet_rows(content)) == count + 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_a_shared_text_that_is_not_there_is_an_error(spark, tmp_path):
    _long_book(tmp_path / "bad.xlsx", 3, '<row><c t="s"><v>99</v></c></row></sheetData></worksheet>')
    got = read_stock_workbooks(spark, str(tmp_path))
    assert rows(got, "line", "name", "error") == [(None, None, "no shared text 99")]


def test_json_batches(spark):
    batch = '[{"name":" Cola ","category_id":"4","quantity":"5","buying_price":"1"},{"name":"Tie"}]'
    df = spark.createDataFrame([(1, batch), (2, "broken"), (3, "[]")], "id int, batch string")
    got = rows(
        intake.explode_intake_json(df, "batch"), "id", "line", "name", "category_id", "supplier"
    )
    assert got == [(1, 0, "Cola", 4, ""), (1, 1, "Tie", None, ""), (2, None, None, None, "")]
    nulls = spark.createDataFrame([(1, '[{"name":"Tie","quantity":null}]')], "id int, batch string")
    found = intake.explode_intake_json(nulls, "batch")
    assert rows(found, "quantity", "buying_price", "selling_price") == [(None, "0", "0")]


def test_csv_sink_keeps_blanks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(' a "b", c ', 1)], "t string, n int")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert rows(back) == [(' a "b", c ', "1")]
    assert rows(sinks.as_json(df)) == [('{"t":" a \\"b\\", c ","n":1}',)]


@pytest.mark.parametrize(
    "named, current, want",
    [("/shared", None, "/shared"), ("/shared", "/x", "/shared"), (None, "/x", "/x")],
)
def test_shared_root_follows_the_session(named, current, want):
    chosen = []
    context = SimpleNamespace(getCheckpointDir=lambda: current, setCheckpointDir=chosen.append)
    conf = SimpleNamespace(get=lambda key, default: named or default)
    assert sinks.shared_root(SimpleNamespace(conf=conf, sparkContext=context)) == want
    assert chosen == ([] if current else [want])


def text_rows(spark, data):
    return spark.createDataFrame(
        data,
        "seq bigint, name string, category string, quantity string, buying_price string,"
        " selling_price string, supplier string",
    )


INTAKE = [
    (1, " Cola ", "Drinks", "10", "50", "75", "A"),
    (2, "Kite", "Toys", "4", "5", "9", "B"),
    (3, "Kite", "Games", "6", "6", "10", "C"),
    (4, "Cola", "Toys", "1", "48", "80", "A"),
    (5, "Bad", "Toys", "x", "1", "2", "A"),
    (6, "Bad", "Toys", "1", "", "2", "A"),
    (7, "Zero", "Void", "0", "1", "2", "A"),
    (8, "Free", "Void", "1", "0", "2", "A"),
    (9, "Ball", "Drinks", "2", "1", "2", "A"),
]


def test_import_intake(spark, shop):
    done = plans.import_intake(shop.products, shop.categories, text_rows(spark, INTAKE))
    assert sorted(rows(done.rejects, "seq", "reason")) == [
        (5, "bad quantity"), (6, "bad buying price"), (7, "not positive"), (8, "not positive"),
    ]
    assert sorted(rows(done.categories.filter("id > 4"), "id", "name")) == [
        (5, "Toys"), (6, "Games"),
    ]
    got = {r.name: r for r in done.products.collect()}
    assert len(got) == 9
    cola, kite, ball = got["Cola"], got["Kite"], got["Ball"]
    assert (cola.current_stock, cola.buying_price, cola.selling_price) == (61, 48, 80)
    assert cola.category_id == 4
    assert (kite.id, kite.category_id, kite.current_stock) == (8, 5, 10)
    assert (kite.buying_price, kite.selling_price, kite.reorder_level) == (6, 10, 5)
    assert kite.is_active and ball.id == 9
    ledger_rows = sorted(rows(done.entries, "seq", "product_id", "quantity"))
    assert ledger_rows == [(1, 1, 10), (2, 8, 4), (3, 8, 6), (4, 1, 1), (9, 9, 2)]


@pytest.mark.parametrize("mode, want", [("skip", [(1, 10), (2, 7)]), ("strict", [])])
def test_quantities_with_decimals(spark, mode, want):
    given = [(1, "Tie", "A", "10.0", "1", "2", ""), (2, "Tie", "A", "7.9", "1", "2", "")]
    got = plans.screen_intake(text_rows(spark, given).withColumn("b", F.lit(1)), mode, "b")
    assert rows(got.accepted, "seq", "quantity") == want
    assert got.rejects.count() == 2 - len(want)


def test_strict_batch_is_refused_whole(spark):
    with pytest.raises(plans.RejectedIntake):
        plans.screen_intake(text_rows(spark, INTAKE), "strict")
    forms = text_rows(spark, INTAKE).withColumn("form", F.expr("if(seq < 5, null, seq div 7)"))
    by_form = plans.screen_intake(forms, "strict", "form")
    assert sorted(rows(by_form.rejects, "seq", "reason")) == [
        (5, "bad quantity"), (6, "bad buying price"), (7, "not positive"), (8, "not positive"),
    ]
    one = plans.screen_intake(forms.withColumn("form", F.lit("a")), "strict", "form")
    assert one.accepted.isEmpty() and one.rejects.count() == len(INTAKE)
    fine = [r for r in INTAKE if r[0] not in (5, 6)]
    done = plans.screen_intake(text_rows(spark, fine), "strict")
    assert done.accepted.count() == 5 and done.rejects.count() == 2


def test_repeated_product_names_go_to_the_smallest_id(spark, shop):
    twin = shop.products.filter("id = 1").withColumn("id", F.lit(99).cast("bigint"))
    done = plans.import_intake(
        shop.products.unionByName(twin), shop.categories, text_rows(spark, INTAKE[:1])
    )
    stock = {r.id: r.current_stock for r in done.products.collect()}
    assert (stock[1], stock[99]) == (60, 50)
    assert rows(done.entries, "product_id", "buying_price") == [(1, float(Decimal(50)))]


def test_malformed_batches_give_a_row_to_reject(spark):
    df = spark.createDataFrame([(1, '[{"name": " Cola\\t"}]'), (2, "not json"), (3, "[]"), (4, None)], "batch int, body string")
    got = {(r.batch, r.line, r.name) for r in intake.explode_intake_json(df, "body").collect()}
    assert got == {(1, 0, "Cola"), (2, None, None), (4, None, None)}


def test_flat_tables_answer_as_those_stored_by_month(spark, shop, tmp_path):
    write_tables(shop, f"{tmp_path}/by_month")
    for name in RetailTables.NAMES:
        getattr(load_tables(spark, f"{tmp_path}/by_month"), name).drop("month").write.parquet(f"{tmp_path}/flat/{name}")
    flat, by_month = load_tables(spark, f"{tmp_path}/flat"), load_tables(spark, f"{tmp_path}/by_month")
    assert "month" in by_month.sale_items.columns and "month" not in flat.sale_items.columns
    day = date(2024, 3, 13)
    assert sales.daily_summary(flat, day).collect() == sales.daily_summary(by_month, day).collect()
    assert flat.sale_items.count() == by_month.sale_items.count() > 0
