"""Running jobs that can be watched and cancelled, and counts that are kept between searches."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def run_tagged(spark: SparkSession, tag: str, work: Callable[[], T]) -> tuple[T | None, str]:
    """The result of work and done, or None and cancelled if its tag was cancelled meanwhile; other errors are raised."""
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        return work(), "done"
    except Exception as error:
        if "cancel" in str(error).lower() or "interrupt" in str(error).lower():
            return None, "cancelled"
        raise
    finally:
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop all work under a tag, whatever thread it runs in; what was written before stays."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and tasks in all of the stages that run now: a measure of real work."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


class Finder:
    """Searches in one set of runs, which is kept on the executors (and their disks) until close()."""

    def __init__(self, items: DataFrame):
        self.items = items.persist(StorageLevel.MEMORY_AND_DISK)
        self.counted: dict[str, DataFrame] = {}

    def counts(self, needle: str) -> DataFrame:
        """(file_id, page, matches) of pages with a match; asked again, the counts are there already."""
        from pyspark.sql import functions as F

        from quire.operators.text import count_matches

        if needle not in self.counted:
            rows = self.items.select("file_id", "page", count_matches(F.col("text"), needle).alias("n")).groupBy("file_id", "page").agg(F.sum("n").alias("matches"))
            self.counted[needle] = rows.where("matches > 0").persist(StorageLevel.MEMORY_AND_DISK)
        return self.counted[needle]

    def close(self) -> None:
        for df in (self.items, *self.counted.values()):
            df.unpersist()
        self.counted = {}
