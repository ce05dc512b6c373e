"""Row-level joins with a side where a few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.sinks import written

#: A key is heavy from this share of an even task's rows on, and is cut into pieces far below it.
HEAVY_SHARE = 4
PIECE_SHARE = 16
#: Keys the frequency sketch tracks for each task: its error stays well below a heavy key's count.
TRACKED = 64
TRACKED_MOST = 1_000_000
#: Pieces of the rows without key.
NULL_PIECES = 1 << 20


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than a quarter of an even task's rows, by a frequency sketch, and the number of
    ``pieces`` to cut each into. At most four for each shuffle partition, whatever the rows."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = HEAVY_SHARE * tasks
    tracked = min(TRACKED * tasks, TRACKED_MOST)
    counted = rows.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {max(tracked, most)})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    share = F.col("top.count") * F.lit(tasks) / F.col("total")
    return (
        counted.select(F.explode("top").alias("top"), "total")
        .filter(share * HEAVY_SHARE > 1)
        .select(F.col("top.item").alias(key), F.ceil(share * PIECE_SHARE).cast("int").alias("pieces"))
    )


def salted_join(
    rows: DataFrame, listed: DataFrame, key: str, spread: str, heavy: DataFrame, how: str = "inner"
) -> DataFrame:
    """Inner or left join of ``rows`` with ``listed`` on ``key``. Rows of a heavy key are dealt by the
    hash of ``spread`` to its pieces, and the listed rows of that key are repeated once for each
    piece; all other keys join as ever. Rows without key match nothing and are dealt as well. The
    result does not depend on which keys count as heavy. ``heavy`` is broadcast: it has a few
    rows for each shuffle partition (see ``heavy_keys``)."""
    if how not in ("inner", "left"):
        raise ValueError(f"no salted {how} join")
    few, dice = F.broadcast(heavy), F.xxhash64(spread)
    piece = (
        F.when(F.col(key).isNull(), F.pmod(dice, F.lit(NULL_PIECES)))
        .when(F.col("pieces").isNotNull(), F.pmod(dice, F.col("pieces")))
        .otherwise(0)
    )
    dealt = rows.join(few, key, "left").withColumn("_piece", piece.cast("int")).drop("pieces")
    pieces = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
    repeated = listed.join(few, key, "left").withColumn("_piece", F.explode(pieces)).drop("pieces")
    return dealt.join(repeated, [key, "_piece"], how).drop("_piece")


def left_by_merge(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Left join where rows without key pass by: they match nothing, and the join would gather them on
    one task. ``listed`` is never broadcast: files of ids and few texts are far smaller than their rows."""
    keyed = rows.filter(F.col(key).isNotNull()).join(listed.hint("merge"), key, "left")
    return keyed.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def even_join(rows: DataFrame, listed: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``salted_join`` by the keys that are heavy in ``rows``, which are written once and read twice."""
    rows = written(rows)
    return salted_join(rows, listed, key, spread, heavy_keys(rows, key), how)
