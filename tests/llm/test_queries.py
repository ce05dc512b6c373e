import duckdb
import pytest

import corpus_pipeline
from checks.compare import difference
from tallyhouse.llm import queries
from tests.llm.shared import ODD, clashing, frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    days = {x: lambda df, x=x: df[x].astype("datetime64[s]").astype(str) for x in got.columns if x == "fetched_on"}
    assert difference(got.assign(**days), want.assign(**days)) is None


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage leaves of the smallest documents and some odd rows."""
    docs = frame(spark, [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in ODD])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(docs.columns).union(docs)
    out = [("documents", corpus_pipeline.saved(docs, "documents"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, corpus_pipeline.saved(stage(spark, out[-1][1], SF), name.replace(" ", "-"))))
    return dict(out)


def test_stages_keep_the_columns_of_documents(kept):
    columns = kept["documents"].columns
    assert [x.columns == columns for x in kept.values()] == [True] * 5 + [False]


def test_decisions_take_effect(kept):
    rows = {name: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for name, df in kept.items() if name != "packing"}
    gone = {i for i, _ in rows["documents"]} - {i for i, _ in rows["language ID"]}
    assert gone == {10_003, 10_004, 10_010}
    low = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    texts = {low(t) for _, t in rows["language ID"]}
    assert sorted(low(t) for _, t in rows["exact dedup"]) == sorted(texts)
    near = rows["SimHash near-dedup"]
    assert len({i for i, _ in near}) == len(near) and set(near) <= set(rows["exact dedup"])
    assert 0.9 * len(texts) < len(near) <= len(texts)
    assert {x for x in rows["mixing"]} <= set(near) and max(rows["mixing"].count(x) for x in near) <= 3


def test_packed_pieces_cover_the_mix(kept):
    pieces = kept["packing"].collect()
    assert len({r.doc_id for r in pieces}) == kept["mixing"].select("doc_id").distinct().count()
    ends = {}
    for r in pieces:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert max(ends.values()) <= 2048


def test_stages_on_an_empty_table(spark, kept):
    empty = clashing(kept["documents"].limit(0)).select(kept["documents"].columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
