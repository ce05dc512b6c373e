"""URL filters whose list entries come and go: an as-of join of captures with dated entries.

A list is a log of entries (key, category, action, listed_on). The latest entry of a key and category
up to a capture's fetch day decides whether it is active then. Entries become validity intervals; the
intervals are laid over epochs of ``EPOCH`` days, so that captures meet only the intervals of their own
key and epoch. Captures are folded to distinct (host, path, day) before they are matched: a host with a
third of all captures sends as many rows as it has paths and days. A capture is matched by its host, by
every parent domain, and by host and first path segment.

Defined results: null or malformed URLs have host '' and match nothing; null fetch days match nothing;
entries with a null in any column are passed over; of entries of one day the last in order of action
('remove' after 'add') holds; repeated captures are rows of their own; empty lists and tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = 64
RESULTS = ("host", "n_active", "categories", "blocked")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def segment_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))


def keys_of(host: Column, segment: Column) -> Column:
    """The list keys that speak of a capture: parent domains of two labels or more, and host/segment."""
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(parents, path))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which a key is listed; an open end is null."""
    entries = entries.select("key", "category", "action", "listed_on").dropna()
    last = entries.groupBy("key", "category", "listed_on").agg(F.max("action").alias("action"))
    by_day = Window.partitionBy("key", "category").orderBy("listed_on")
    spans = last.withColumn("valid_to", F.lead("listed_on").over(by_day)).filter("action = 'add'")
    return spans.select("key", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def epoch_of(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / EPOCH).cast("int")


def temporal_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (url, fetched_on, ...) with host, n_active, categories and blocked.

    Other columns of a capture are carried whatever their names, but for those named like one of the four
    results, which give way to it. Captures without a host or a day are under no entry and meet no list.
    """
    at = {name.lower(): f"c{k}" for k, name in enumerate(captures.columns)}
    own = captures.toDF(*[f"c{k}" for k in range(len(captures.columns))])
    url = F.col(at["url"])
    urls = own.withColumns({"host": host_of(url), "segment": segment_of(url), "day": F.col(at["fetched_on"])})
    listable = (F.col("host") != "") & F.col("day").isNotNull()
    asked = urls.filter(listable).select("host", "segment", "day").distinct()
    until = asked.agg(F.max("day").alias("day")).first()["day"]
    spans = validity(entries).filter(F.col("valid_from") <= F.lit(until))
    last = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(until)), F.lit(until))
    spans = spans.withColumn("epoch", F.explode(F.sequence(epoch_of(F.col("valid_from")), epoch_of(last))))
    keyed = asked.select("*", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("key"), epoch_of(F.col("day")).alias("epoch"))
    active = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    hits = keyed.join(spans, ["key", "epoch"]).filter(active)
    verdicts = hits.groupBy("host", "segment", "day").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )
    joined = urls.filter(listable).join(verdicts, ["host", "segment", "day"], "left")
    joined = joined.unionByName(urls.filter(~listable), allowMissingColumns=True)
    carried = [F.col(f"c{k}").alias(x) for k, x in enumerate(captures.columns) if x.lower() not in RESULTS]
    return joined.select(
        *carried,
        "host",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.col("n_active").isNotNull().alias("blocked"),
    )
