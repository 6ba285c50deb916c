"""Queries of presence with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.folders import new_folder
from quire.operators import presence as P
from quire.plans import models as M
from quire.ship import ship
from quire.streaming import presence as S


def _ms(ts: F.Column) -> F.Column:
    """The nearest whole millisecond, halves away from zero (as DuckDB's epoch_ms rounds)."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000)).cast("long")


def presence_online(spark: SparkSession, sf: str) -> DataFrame:
    e = M.read(spark, sf, "events").select(F.col("user_id").alias("id"), _ms(F.col("ts")).alias("ms"), F.col("event_id").alias("row_id"))
    return P.online(e).select("row_id", "ms", "online")


def presence_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    count = F.when(k % 13 != 0, k % 50)
    s = P.status(F.when(k % 5 == 0, "POST").otherwise("GET"), k % 7 != 0, k % 11 != 0, count)
    shaped = F.rlike(F.lower(F.md5(k.cast("string"))), F.lit(P.ID_SHAPE)) & (k % 3 != 0)
    return M.read(spark, sf, "events").select("event_id", s.alias("s"), shaped.alias("counted")).select("event_id", "s.status", "s.online", "counted")


def presence_stream(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    schema = M.read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = events.select(F.col("event_type").alias("room"), F.col("user_id").cast("string").alias("id"), _ms(F.col("ts")).alias("ms"), F.col("event_id").alias("row_id"))
    base = new_folder(spark, "presence")
    return S.run_to_table(S.online_stream(rows), f"{base}/rows", f"{base}/checkpoint")


QUERIES = {f.__name__: f for f in (presence_online, presence_status, presence_stream)}

ORACLE = {
    "presence_online": """
        with e as (select event_id as row_id, epoch_ms(ts) as ms, user_id from events)
        select a.row_id, a.ms, count(distinct b.user_id)::int as online from e a join e b on b.ms > a.ms - 45000 and b.ms <= a.ms group by all""",
    "presence_status": """
        with r as (select event_id, case when event_id % 5 = 0 then 405 when event_id % 7 = 0 then 503 when event_id % 11 = 0 or event_id % 13 = 0 then 502 else 200 end as status from events)
        select event_id, status, case when status = 200 then event_id % 50 end as online, event_id % 3 <> 0 as counted from r""",
    "presence_stream": """
        with e as (select event_id as row_id, event_type as room, epoch_ms(ts) as ms, user_id from events)
        select a.room, a.row_id, a.ms, count(distinct b.user_id)::int as online from e a join e b on b.room = a.room and b.ms > a.ms - 45000 and b.ms <= a.ms group by all""",
}
