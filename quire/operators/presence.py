"""How many ids were seen in the last 45 seconds: batch windows and request outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS = 45_000
ID_SHAPE = r"\A[0-9a-f]{32}\z"


def online(checkins: DataFrame, window_ms: int = WINDOW_MS, *keys: str) -> DataFrame:
    """checkins (keys..., id, ms, row_id) with `online`: distinct ids in (ms - window, ms], peers included; null without ms.

    An id comes online at a check-in that the window before does not hold and leaves a window after one that no other
    follows in time. The count at a time is the sum of these changes up to it: summed inside blocks of time, with
    what the blocks before add up to. So no task holds sets of ids, and a task needs one block of a key.
    """
    seen = checkins.where("id is not null and ms is not null").select(*keys, "id", "ms").distinct()
    own = Window.partitionBy(*keys, "id").orderBy("ms")
    seen = seen.withColumn("since", F.col("ms") - F.lag("ms").over(own)).withColumn("until", F.lead("ms").over(own) - F.col("ms"))
    comes = F.when(F.coalesce(F.col("since") >= window_ms, F.lit(True)), F.struct(F.col("ms").alias("at"), F.lit(1).alias("change")))
    goes = F.when(F.coalesce(F.col("until") >= window_ms, F.lit(True)), F.struct((F.col("ms") + window_ms).alias("at"), F.lit(-1).alias("change")))
    changes = seen.select(*keys, F.explode(F.array_compact(F.array(comes, goes))).alias("c")).groupBy(*keys, F.col("c.at").alias("at")).agg(F.sum("c.change").alias("change"))
    changes = changes.withColumn("_block", F.floor(F.col("at") / window_ms))
    blocks = changes.groupBy(*keys, "_block").agg(F.sum("change").alias("total"))
    # a row for every block of check-ins too, so that each finds what came before it
    blocks = blocks.unionByName(checkins.select(*keys, F.floor(F.col("ms") / window_ms).alias("_block"), F.lit(0).cast("long").alias("total")).distinct()).groupBy(*keys, "_block").agg(F.sum("total").alias("total"))
    before = F.sum("total").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", F.struct(F.coalesce(before, F.lit(0)).alias("before")).alias("_base"))
    named = F.struct(*checkins.columns)
    rows = checkins.select(*keys, F.floor(F.col("ms") / window_ms).alias("_block"), F.col("ms").alias("_at"), F.lit(0).cast("long").alias("change"), named.alias("_row"))
    moves = changes.select(*keys, "_block", F.col("at").alias("_at"), "change", F.lit(None).cast(dict(rows.dtypes)["_row"]).alias("_row"))
    running = F.sum("change").over(Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.unionByName(moves).withColumn("_online", running).where("_row is not null")
    same = [rows[k].eqNullSafe(blocks[k]) for k in (*keys, "_block")]
    count = F.when(F.col("_at").isNotNull(), (F.col("_online") + F.col("_base.before")).cast("int"))
    return rows.join(blocks, same).select("_row.*", count.alias("online"))


def status(method: Column, configured: Column, store_up: Column, count: Column) -> Column:
    """struct(status, online) of a request: no number is ever made up."""
    code = F.when(method != "GET", 405).when(~configured, 503).when(~store_up | count.isNull(), 502).otherwise(200)
    return F.struct(code.alias("status"), F.when(code == 200, count).alias("online"))
