import pytest
from pyspark.sql import functions as F

from checks import derive
from tallyhouse.plans import intake as plans
from tallyhouse.sources import folder

HEAD = "name,category,quantity,buying_price,selling_price,supplier\n"


@pytest.fixture
def stock(tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "".join(f"P{k % 7},C{k % 3},{k + 1},{k + 1}.5,{k + 2},S\n" for k in range(300)))
    (tmp_path / "b.CSV").write_text("Supplier, Quantity ,SELLING_PRICE,buying_price,category,name\nS,4,9,7,C9,  P1 \n,2,3,1,,P9\nS,2,3,1,C1,\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv").write_text(HEAD + "Short,C1,5,2\nLong,C1,5,2,3,S,extra\nFine,C1,5,2,3\n")
    (tmp_path / "d.csv").write_text("name,quantity\nx,1\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.xls").write_text("old")
    (tmp_path / "g.txt").write_text("text")
    (tmp_path / "h.xlsx").write_bytes(b"no workbook")
    return tmp_path


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_every_file_and_row_is_accepted_or_a_reject(spark, stock, shop):
    read = folder.read_stock_folder(spark, str(stock))
    rows = [(name_of(r.path), r.name, r.quantity) for r in read.rows.orderBy("seq").collect()]
    assert [r for r in rows if r[0] == "a.csv"] == [("a.csv", f"P{k % 7}", str(k + 1)) for k in range(300)]
    assert [r[1:] for r in rows if r[0] == "b.CSV"] == [("P1", "4"), ("P9", "2"), (None, "2")]
    assert [r[1:] for r in rows if r[0] == "c.csv"] == [("Short", "5"), ("Fine", "5")]
    rejects = {(name_of(r.path), r.reason.split(":")[0], r.seq is not None) for r in read.rejects.collect()}
    assert {x for x in rejects if x[0] != "h.xlsx"} == {
        ("c.csv", "row does not fit the header", True), ("d.csv", "Missing columns", False),
        ("f.xls", "old workbooks can't be read", False), ("g.txt", "File type not allowed", False),
    }
    assert [x[2] for x in rejects if x[0] == "h.xlsx"] == [False]
    done = plans.import_intake(shop.products, shop.categories, read.rows)
    accepted = done.entries.count()
    assert accepted + done.rejects.count() == read.rows.count() == 305
    assert sorted(r.reason for r in done.rejects.collect()) == ["bad category", "bad name", "bad selling price"]
    assert done.entries.filter("product_id is null").count() == 0


def test_order_is_the_same_for_any_split(spark, stock):
    def read():
        return [tuple(r) for r in folder.read_stock_folder(spark, str(stock)).rows.orderBy("seq").collect()]

    want = read()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert read() == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r[0] for r in want] == sorted(r[0] for r in want)


def test_workbooks_stand_among_the_files(spark, tmp_path):
    pages = derive._workbook(derive.pd.DataFrame([("Z", "C", "1", "2", "3", "S"), ("Y", "C", "1", "2", "3", "S")], columns=HEAD.strip().split(",")))
    (tmp_path / "b.xlsx").write_bytes(pages)
    (tmp_path / "a.csv").write_text(HEAD + "X,C,1,2,3,S\n")
    (tmp_path / "c.csv").write_text(HEAD + "W,C,1,2,3,S\n")
    read = folder.read_stock_folder(spark, str(tmp_path))
    assert [r.name for r in read.rows.orderBy("seq").collect()] == ["X", "Z", "Y", "W"]
    assert read.rejects.count() == 0


def test_batches_that_create_products_without_category(spark, shop):
    rows = [
        (1, "a", "New", None), (2, "a", "Cola", None),  # creates New without an id: refused as a whole
        (3, "b", "New", 1), (4, "b", "Other", 2),  # creates New
        (5, "c", "New", None), (6, "c", "Cola", None),  # finds New
        (7, "d", "Third", None),
        (8, "e", None, 1), (9, "e", "Fourth", 4),  # no name
        (10, "f", "Fourth", None),  # would have found Fourth
    ]
    batch = spark.createDataFrame(rows, "seq bigint, form string, name string, category_id bigint").withColumns(
        {"quantity": F.lit("2"), "buying_price": F.lit("3"), "selling_price": F.lit("4"), "supplier": F.lit("")}
    )
    done = plans.import_intake(shop.products, shop.categories, batch, "strict", batch="form")
    assert sorted((r.seq, r.reason) for r in done.rejects.collect()) == [
        (1, "bad category id"), (2, "batch refused"), (7, "bad category id"), (8, "bad name"), (9, "batch refused"), (10, "bad category id"),
    ]
    assert sorted(r.seq for r in done.entries.collect()) == [3, 4, 5, 6]
    with pytest.raises(plans.RejectedIntake):
        plans.import_intake(shop.products, shop.categories, batch.filter("seq = 7"), "strict")
