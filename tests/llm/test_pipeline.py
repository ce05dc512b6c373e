import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.shared import ODD, frame


@pytest.mark.parametrize("lang", [None, ""])
def test_unlabelled_documents_pass_the_language_stage(spark, lang):
    df = frame(spark, ODD).withColumn("lang", F.lit(lang).cast("string"))
    got = corpus_pipeline.language_id(spark, df, "")
    assert got.columns == df.columns
    want = [r for r in ODD if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(r.text for r in got.collect()) == sorted(r[1] for r in want)


def test_labels_that_are_all_held_out_teach_nothing_and_drop_nothing(spark):
    df = frame(spark, [(k, "some words", "en", "a") for k in range(40)]).filter(corpus_pipeline.language_held_out())
    assert df.count() and corpus_pipeline.language_id(spark, df, "").count() == df.count()


@pytest.mark.parametrize("stage", [corpus_pipeline.language_id, corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mixed])
def test_columns_named_as_the_stages_own_are_carried(spark, stage):
    names = ["_id", "_hash", "_copies", "_Copy", "_own", "doc_id_", "hash", "root", "copies"]
    df = frame(spark, [*ODD, *[(20 + k, f"some other words {k}", "en", "a") for k in range(10)]])
    wide = df.withColumns({x: F.lit(f"own {x}") for x in names})
    got = stage(spark, wide, "")
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[x] == f"own {x}" for r in rows for x in names)
    plain = sorted(map(repr, stage(spark, df, "").collect()))
    assert plain and sorted(repr(r) for r in got.select(df.columns).collect()) == plain
