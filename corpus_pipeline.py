"""Corpus cleaning: language ID, exact dedup, near dedup, mixing and packing, one stage after another.

Each stage reads what the one before it kept, as written. The filtering stages and the mix return the
columns of ``documents``, the last one the pieces of packed sequences. Rows are told apart by doc_id
and text; rows that repeat both share one decision. In every stage a null text is empty, a null doc_id
is an id like any other, an empty table gives no rows, and further columns are carried by the stages
before the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bytecnn, cuckoo, mixing, packing, simhash
from tallyhouse.llm.common import documents, lower_ascii, saved
from tallyhouse.llm.queries import language_held_out, tokenizer

#: Not expressible in SQL: a trained network, Newton steps and a tokenizer.
ORACLE_SQL = None


def free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {x.lower() for x in docs.columns}
    while name in taken:
        name += "_"
    return name


def chosen(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """The documents whose doc_id (null included) and text's hash are among ``picks``."""
    picks = picks.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    return docs.join(picks, docs["doc_id"].eqNullSafe(picks["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == picks["_hash"]), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go.

    Which language is predicted, and how surely, decides nothing. Without labelled rows to learn from
    there is no network, and every text with a letter is kept all the same.
    """
    net = bytecnn.fit(docs, ~language_held_out())
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = saved(bytecnn.identify(docs, net), "languages")
    return chosen(docs, found.filter(F.col("lang_pred") != bytecnn.UNDETERMINED))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lowered: the one with the largest doc_id."""
    digest = free(docs, "_own")
    kept = cuckoo.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256"))
    own = docs.withColumn(digest, F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    left = own.join(kept, own["doc_id"].eqNullSafe(kept["_id"]) & (own[digest] == kept["_sha256"]), "left_semi")
    return left.dropDuplicates(["doc_id", digest]).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints: the one with the smallest doc_id."""
    found = simhash.near_dedup(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    return chosen(docs, found.groupBy("root").agg(first).select("first.doc_id", "first.hash"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies."""
    id_, hash_, copies, copy = (free(docs, x) for x in ("_id", "_hash", "_copies", "_copy"))
    plan = mixing.mix(docs).groupBy("doc_id", "hash").agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    plan = plan.withColumnsRenamed({"doc_id": id_, "hash": hash_})
    joined = docs.join(plan, docs["doc_id"].eqNullSafe(plan[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == plan[hash_]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.harmonic_pack(docs, tokenizer()).drop("ids")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
