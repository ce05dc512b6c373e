"""Changes of categories, answered in the order of their requests.

Whether a request is accepted depends on earlier ones by two keys: the category it is about and the
name it wants, which an earlier rename or deletion may have freed. Requests that share neither key with
another are answered at once. The others are answered in rounds: each round takes the answers of the
round before for granted, works out what every request finds (its category's name, who holds the wanted
name) and answers again. A request's answer rests on earlier requests alone, so the first is right after
one round and every round settles at least one more; where a round changes nothing, all are right. The
number of rounds is the length of the longest chain of answers that hang on each other, not the number
of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip
from tallyhouse.operators.running import running_last
from tallyhouse.plans.intake import next_ids
from tallyhouse.sources.sinks import shared_root, written

#: Stretches of the batch in which a key's requests are ordered.
STRETCHES = 1024

REQUIRED, UNKNOWN = "name is required", "unknown category"
TAKEN, USED = "name already exists", "category has products"


def check_category_changes(
    categories: DataFrame, products: DataFrame, changes: DataFrame, seq: str = "seq"
) -> DataFrame:
    """Each request with ``reject_reason``: null where it is accepted.

    ``changes``: ``action`` (``add``, ``rename``, ``delete``), ``id``, ``name`` and ``seq``, which is
    unique and gives the order. Ids are those of ``categories``; what the batch adds gets its id
    afterwards. A category with products stays. Names are stripped; a null name is an empty one.
    Requests with another action are refused.
    """
    shared_root(changes.sparkSession)
    asked = written(_asked(categories, products, changes, seq))
    alone = _uncontested(asked)
    judged = _judge(asked.join(alone, "_seq", "left_semi"), None)
    contested = asked.join(alone, "_seq", "left_anti")
    answers = written(contested.select("_seq", F.lit(None).cast("string").alias("_reason")))
    if not answers.isEmpty():
        ends = contested.agg(F.min("_seq").alias("low"), F.max("_seq").alias("high")).first()
        step = (ends.high - ends.low) // STRETCHES + 1
        bucket = F.expr(f"(_seq - {ends.low}L) div {step}L")
        while True:
            before = contested.join(answers, "_seq")
            new = written(_judge(before, bucket).select("_seq", "_reason"))
            old = answers.withColumnRenamed("_reason", "_old")
            changed = new.join(old, "_seq").filter(~F.col("_reason").eqNullSafe(F.col("_old")))
            answers = new
            if changed.isEmpty():
                break
        judged = judged.select("_seq", "_reason").unionByName(answers)
    return changes.join(judged.select(F.col("_seq").alias(seq), F.col("_reason").alias("reject_reason")), seq).select(
        *changes.columns, "reject_reason"
    )


def _asked(categories: DataFrame, products: DataFrame, changes: DataFrame, seq: str) -> DataFrame:
    """Requests with what the stored tables say: the category's name, its products, the wanted name's holder."""
    asked = changes.select(
        F.col(seq).cast("bigint").alias("_seq"),
        F.col("action").alias("_action"),
        F.when(F.col("action") != "add", F.col("id")).alias("_id"),
        F.when(F.col("action") != "delete", strip(F.coalesce("name", F.lit("")))).alias("_wanted"),
    )
    used = products.select(F.col("category_id").alias("_id"), F.lit(True).alias("_used")).distinct()
    stored = categories.select(F.col("id").alias("_id"), F.col("name").alias("_stored"), F.lit(True).alias("_present"))
    holders = categories.groupBy(F.col("name").alias("_wanted")).agg(F.min("id").alias("_holder"))
    return asked.join(stored, "_id", "left").join(used, "_id", "left").join(holders, "_wanted", "left")


def _uncontested(asked: DataFrame) -> DataFrame:
    """``_seq`` of the requests whose category, its stored name and wanted name no other request touches."""
    keys = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(F.col("_id").isNotNull(), F.struct(F.lit("id").alias("kind"), F.col("_id").cast("string").alias("key"))),
                F.when(F.col("_wanted").isNotNull(), F.struct(F.lit("name").alias("kind"), F.col("_wanted").alias("key"))),
                F.when(F.col("_stored").isNotNull(), F.struct(F.lit("name").alias("kind"), F.col("_stored").alias("key"))),
            )
        )
    )
    touched = asked.select("_seq", F.explode_outer(keys).alias("_key"))
    busy = touched.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _key is not null")
    return asked.select("_seq").join(touched.join(busy.select("_key"), "_key", "left_semi").select("_seq"), "_seq", "left_anti")


def _judge(asked: DataFrame, bucket: Column | None) -> DataFrame:
    """Requests with ``_reason``; with ``bucket``, earlier requests count as their ``_reason`` so far says."""
    if bucket is None:
        known = asked.withColumns({"_gone": F.lit(False), "_name": F.col("_stored"), "_by": F.col("_holder"), "_held": F.col("_holder").isNotNull()})
    else:
        known = _found(asked, bucket).drop("_reason")
    action = F.col("_action")
    names = action.isin("add", "rename")
    missing = action.isin("rename", "delete") & (F.col("_present").isNull() | F.col("_gone"))
    taken = names & F.col("_held") & ((action == "add") | ~F.col("_by").eqNullSafe(F.col("_id")))
    return known.withColumn(
        "_reason",
        F.when(~action.isin("add", "rename", "delete") | action.isNull(), "unknown action")
        .when(missing, UNKNOWN)
        .when(names & (F.col("_wanted") == ""), REQUIRED)
        .when(taken, TAKEN)
        .when((action == "delete") & F.col("_used"), USED),
    )


def _found(asked: DataFrame, bucket: Column) -> DataFrame:
    """What each request finds: whether its category is gone, its name, and who holds the wanted name."""
    good = F.col("_reason").isNull()
    past = {
        "_renamed": F.when(good & (F.col("_action") == "rename"), F.col("_wanted")),
        "_dropped": F.when(good & (F.col("_action") == "delete"), F.lit(True)),
    }
    # an added category is no request's own: each add has a key of its own here
    owner = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("+"), F.col("_seq").cast("string")))
    rows = running_last(asked.withColumn("_owner", owner), ["_owner"], bucket, [F.col("_seq")], past)
    rows = rows.withColumns({"_gone": F.coalesce("_dropped", F.lit(False)), "_name": F.coalesce("_renamed", "_stored")})
    rows = rows.drop("_renamed", "_dropped", "_owner").transform(written)
    # a name's history: who asks for it, who lets it go and who takes it
    moved = good & ((F.col("_action") == "delete") | ((F.col("_action") == "rename") & (F.col("_name") != F.col("_wanted"))))
    event = lambda kind, held, by: F.struct(F.lit(held).alias("held"), by.alias("by")).alias("_event")
    nothing = F.lit(None).cast("struct<held:boolean,by:bigint>").alias("_event")
    asks = rows.filter("_wanted is not null").select(F.col("_wanted").alias("_key"), "_seq", F.lit(0).alias("_kind"), nothing)
    frees = rows.filter(moved).select(F.col("_name").alias("_key"), "_seq", F.lit(1).alias("_kind"), event("free", False, F.lit(None).cast("bigint")))
    takes = rows.filter(good & F.col("_wanted").isNotNull()).select(
        F.col("_wanted").alias("_key"), "_seq", F.lit(2).alias("_kind"), event("take", True, F.col("_id").cast("bigint"))
    )
    history = asks.unionByName(frees).unionByName(takes)
    last = running_last(history, ["_key"], bucket, [F.col("_seq"), F.col("_kind")], {"_last": F.col("_event")})
    last = last.filter("_kind = 0").select("_seq", "_last")
    return rows.join(last, "_seq", "left").withColumns(
        {
            "_held": F.coalesce(F.col("_last.held"), F.col("_holder").isNotNull()),
            "_by": F.when(F.col("_last").isNull(), F.col("_holder")).otherwise(F.col("_last.by")),
        }
    )


def apply_category_changes(
    categories: DataFrame, checked: DataFrame, seq: str = "seq"
) -> DataFrame:
    """Categories after the accepted changes; new ones follow in order of their requests.

    With a ``description`` among the requests, an accepted add or rename sets it (null: empty).
    """
    described = "description" in checked.columns and "description" in categories.columns
    text = strip(F.coalesce("description", F.lit(""))) if described else F.lit(None).cast("string")
    good = checked.filter(F.col("reject_reason").isNull()).withColumns({"name": strip(F.col("name")), "_text": text})
    last = F.max_by(F.struct("name", "_text"), seq).alias("_last")
    renamed = good.filter(F.col("action") == "rename").groupBy("id").agg(last)
    deleted = good.filter(F.col("action") == "delete").select("id")
    kept = categories.join(deleted, "id", "left_anti").join(renamed, "id", "left")
    kept = kept.withColumn("name", F.coalesce("_last.name", "name"))
    if described:
        kept = kept.withColumn("description", F.coalesce("_last._text", "description"))
    added = good.filter(F.col("action") == "add").select("name", F.col("_text").alias("description"), F.col(seq).alias("_first"))
    added = added if described else added.drop("description")
    added = next_ids(added, categories, [F.col("_first")]).drop("_first")
    return kept.drop("_last").unionByName(added, allowMissingColumns=True)
