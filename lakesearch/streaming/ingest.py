"""Streams: new addresses into the frontier, new pages into the index, crawls as managed queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakesearch.functions import urls
from lakesearch.operators import index


def fresh_addresses(entries: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """A stream's entries, each address once while its state is kept: `late` behind the newest `time`."""
    rows = entries.withColumn("norm", urls.normalize(F.col("url"))).where("norm <> ''").withColumn("fp", urls.fingerprint(F.col("norm")))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["fp"])


def windowed_counts(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling window, put out once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def index_pages(pages: DataFrame, path: str, checkpoint: str, words: Sequence[tuple[str, int | None]] = (), **trigger: object) -> StreamingQuery:
    """Merge each micro-batch into the index under `path`, a version of it per batch: a page fetched again replaces the one
    of its url, and a batch that is run again after a failure gives the same version. `words` is the dictionary for
    Chinese text (`index.assembled`)."""

    def write(batch: DataFrame, number: int) -> None:
        newest = index.upsert(batch, F.col("url"), [F.col("fetch_time"), F.col("doc_id")]) if "fetch_time" in batch.columns else batch
        docs = index.assembled(newest, words)
        index.merged(batch.sparkSession, path, f"batch-{number:09d}", docs.drop("tokens"), index.postings(index.occurrences(docs)))

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class CrawlManager:
    """One crawl at a time: stopped, running, finished or error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.query = spark, None

    def start(self, make: Callable[[], StreamingQuery]) -> bool:
        """Start a query unless one is running."""
        if self.status == "running":
            return False
        self.query = make()
        return True

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    @property
    def status(self) -> str:
        if self.query is None:
            return "stopped"
        if self.query.exception() is not None:
            return "error"
        return "running" if self.query.isActive else "finished"
