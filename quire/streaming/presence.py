"""Live presence as a stream: per room, the distinct ids of the last 45 seconds at every check-in."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.presence import WINDOW_MS

ROWS = "room string, row_id long, ms long, online int"
#: Event times are put off by this (69 years), as a watermark starts at 0 and drops what is not after it.
LATER_MS = 1 << 41
STATE = "ids array<string>, last array<bigint>"


def counter(window_ms: int = WINDOW_MS):
    """State function: id -> time last seen, in that order; what left the window is dropped before each check-in is counted.

    A room's state goes when the watermark has passed the window of its last check-in.
    """

    def step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen: OrderedDict[str, int] = OrderedDict(zip(*state.get)) if state.exists else OrderedDict()
        rows = pd.concat(list(frames)).sort_values(["ms", "row_id"], kind="stable")
        out = []
        times = rows["ms"].to_numpy()
        ids = rows["id"].to_numpy()
        at = 0
        while at < len(rows):
            now = times[at]
            end = at
            while end < len(rows) and times[end] == now:
                seen[str(ids[end])] = int(now)
                seen.move_to_end(str(ids[end]))
                end += 1
            while seen and next(iter(seen.values())) <= now - window_ms:
                seen.popitem(last=False)
            out += [len(seen)] * (end - at)
            at = end
        leaves = max(seen.values(), default=0) + window_ms + LATER_MS
        if leaves > state.getCurrentWatermarkMs():
            state.update((list(seen), list(seen.values())))
            state.setTimeoutTimestamp(leaves)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"room": key[0], "row_id": rows["row_id"].to_numpy(), "ms": times, "online": out})

    return step


def online_stream(checkins: DataFrame, window_ms: int = WINDOW_MS, late: str = "10 minutes") -> DataFrame:
    """Streaming checkins (room, id, ms, row_id) -> ROWS. What comes later than `late` after later check-ins is not counted."""
    timed = checkins.withColumn("at", F.timestamp_millis(F.col("ms") + LATER_MS)).withWatermark("at", late)
    return timed.groupBy("room").applyInPandasWithState(counter(window_ms), ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, exactly once, into files under path; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
