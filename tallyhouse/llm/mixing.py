"""Mixing sources to target weights by entropy balancing.

The rates of documents stay as close to 1 as the token constraints allow: of all rates between 0 and
``MOST`` they minimise the sum of r ln r - r subject to sum(r * size) = target for every source. The
solution tilts documents exponentially, r = min(MOST, exp(tilt * size / scale)), and the tilts of the
sources solve a convex dual. Its gradient and curvature are sums over (source, size) classes, so each
Newton step is one aggregation of the saved classes; a bracket guards the steps.

Rates are rounded into copies within strata of a source, largest documents first, each carrying its
remainder on to the next, so that a stratum misses its share by about half its smallest document.

Defined results: null text has size 0; null source is a source of its own, last in order; documents of
size 0 take nothing; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, partition_id, saved

#: Copies that a document may have, and so the largest rate.
MOST = 3
WEIGHTS = (5, 2, 1)
STEPS = 40
#: Rows of a stratum, which one task rounds.
STRATUM_ROWS = 2_000
#: A source is balanced when its rates give its target up to this share.
CLOSE = 1e-9
SIZED = "doc_id long, hash long, source string, size long, part int, seq long"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, hash of the text, source, words and position of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = partition_id(), 0
        for batch in batches:
            n = batch.num_rows
            size = np.fromiter((len(x.as_buffer().to_pybytes().split()) for x in batch.column("text")), np.int64, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), batch.column("source"), pa.array(size), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int64))],
                ["doc_id", "hash", "source", "size", "part", "seq"],
            )
            seq += n

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"),
    )
    return rows.mapInArrow(counted, SIZED)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``target`` of each source: shares by weight, none above ``most`` times its ``source_size``.

    Sources in falling need (``most * size / weight``) stop one after the other; what the others
    share is fixed by the first that does not: the largest such level. One row per source, so one task orders them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("stop", F.col("source_size") * most / F.col("weight"))
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / F.sum("weight").over(on)
    levels = ranked.withColumn("level", level)
    shared = F.max(F.when(F.col("stop") > F.col("level"), F.col("level"))).over(everything)
    return levels.select(
        "source", "source_size", F.least(F.col("source_size") * float(most), F.coalesce(shared, F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def tilts(classes: DataFrame, wanted: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """``tilt`` of each source by Newton steps on the dual; null where the target is ``most`` times the size."""
    spark = classes.sparkSession
    classes = classes.filter("size > 0")
    state = wanted.filter((F.col("source_size") > 0)).withColumns(
        {
            "done": F.col("target") >= F.col("source_size") * most * (1 - CLOSE),
            "scale": F.col("source_size") / F.col("docs"),
            "tilt": F.lit(0.0),
            "low": F.lit(-float("inf")),
            "high": F.lit(float("inf")),
        }
    )
    state = saved(state, "tilts")
    for _ in range(steps):
        open_ = state.filter("not done")
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        terms = classes.join(open_, classes["source"].eqNullSafe(open_["source"])).select(
            open_["source"], (F.col("n") * F.col("size") * rate).alias("mass"), (F.col("n") * F.col("size") * x * F.when(rate < most, rate).otherwise(0.0)).alias("bend")
        )
        sums = terms.groupBy("source").agg(F.sum("mass").alias("mass"), F.sum("bend").alias("bend"))
        new = state.join(sums.withColumnRenamed("source", "_source"), state["source"].eqNullSafe(F.col("_source")), "left")
        gap = F.col("mass") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("bend")
        middle = F.when((low > -float("inf")) & (high < float("inf")), (low + high) / 2).when(gap > 0, 2 * F.col("tilt") - 1).otherwise(2 * F.col("tilt") + 1)
        step = F.when((F.col("bend") > 0) & (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 8), newton).otherwise(middle)
        close = F.abs(gap) <= F.col("target") * CLOSE
        updated = {
            "low": F.when(F.col("done"), F.col("low")).otherwise(low),
            "high": F.when(F.col("done"), F.col("high")).otherwise(high),
            "tilt": F.when(F.col("done") | close, F.col("tilt")).otherwise(step),
            "done": F.col("done") | close,
        }
        state = saved(new.select(*[c for c in state.columns if c not in updated], *[v.alias(k) for k, v in updated.items()]).select(state.columns), "tilts")
    full = F.col("target") >= F.col("source_size") * most * (1 - CLOSE)
    return state.select("source", F.when(~full, F.round("tilt", 10)).alias("tilt"), "scale")


def round_copies(rates: pd.DataFrame, most: int = MOST) -> np.ndarray:
    """Copies of documents in the given order; what is lost or gained is carried on."""
    carry, out = 0.0, []
    for size, rate in zip(rates["size"].tolist(), rates["rate"].tolist(), strict=True):
        wanted = size * rate + carry
        copies = min(most, max(0, int(wanted / size + 0.5))) if size else 0
        carry = wanted - copies * size
        out.append(copies)
    return np.array(out, np.int64)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, hash, source, size, source_size, target, rate, copies, taken, part, seq of every row."""
    rows = saved(sized(docs, id_col, text_col, source_col), "sized")
    classes = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    wanted = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    wanted = saved(
        sizes.join(wanted.drop("source_size"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "targets"
    )
    tilt = tilts(classes, wanted, most).withColumnRenamed("source", "_source")
    plan = wanted.join(tilt, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    plan = plan.withColumnRenamed("source", "_source")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    exponent = F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))
    rated = joined.withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(float(most)), F.exp(exponent)), F.lit(float(most)))))
    # by id and text, so that neither partitions nor their order decide; sums of doubles differ in the last digits alone
    strata = F.ceil(F.col("docs") / STRATUM_ROWS)
    rated = rated.withColumn("stratum", F.pmod(F.xxhash64("doc_id", "hash", F.when(F.col("size") == 0, F.col("seq"))), strata))
    schema = "doc_id long, hash long, source string, size long, source_size long, target double, rate double, copies long, taken long, part int, seq long"

    def rounded(stratum: pd.DataFrame) -> pd.DataFrame:
        stratum = stratum.sort_values(["size", "doc_id", "hash"], ascending=[False, True, True])
        copies = round_copies(stratum, most)
        return stratum.assign(copies=copies, taken=copies * stratum["size"])[[x.split()[0] for x in schema.split(", ")]]

    columns = ["hash", "source", "size", "source_size", "target", "rate", "part", "seq", "stratum"]
    rated = rated.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), *columns)
    taken = rated.groupBy("source", "stratum").applyInPandas(rounded, schema)
    return taken.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
