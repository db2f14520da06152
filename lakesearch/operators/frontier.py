"""The crawl frontier: which addresses wait, in which order and when they may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.functions import urls
from lakesearch.operators.ranking import ranked

# Content types of pages.
PAGE_TYPES = ["text/html", "text/plain", "application/xhtml+xml"]


def accepted(entries: DataFrame, max_depth: int = 5, max_length: int = 2048) -> DataFrame:
    """Entries worth fetching, with `norm` their normalised address: http(s), no file of another kind, not too long, not
    deeper than `max_depth` (a null depth counts as 0)."""
    # a generator keeps the optimizer from computing the address again for each condition on it
    rows = entries.select("*", F.explode(F.array(urls.normalize(F.col("url")))).alias("norm")).where("norm <> ''")
    return rows.where(~urls.should_skip(F.col("norm"), max_length) & (F.coalesce("depth", F.lit(0)) <= max_depth))


def fresh(entries: DataFrame, order: list[Column], seen: DataFrame | None = None) -> DataFrame:
    """One entry per address (`norm`), the first in `order`, with `fp` its fingerprint; addresses whose fp is in `seen`
    are left out. The least row is found by partial aggregation, so an address queued a billion times is no hot spot."""
    rows = entries.withColumn("fp", urls.fingerprint(F.col("norm")))
    if seen is not None:
        rows = rows.join(seen.select("fp"), "fp", "left_anti")
    columns = [c for c in rows.columns if c != "fp"]
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy("fp").agg(first.alias("e")).select("e.*", "fp")


def scheduled(entries: DataFrame, order: list[Column], delay: float = 1.0) -> DataFrame:
    """Entries with `slot`, their place in their domain's queue from 0, and `start_s`, the second at which politeness
    lets them go. A null domain is one queue. Ranks come from one global sort, so no task holds a domain's queue."""
    placed = ranked(entries, F.coalesce("domain", F.lit("")), order, entries.columns).withColumnRenamed("_rank", "slot")
    return placed.withColumn("start_s", F.col("slot") * F.lit(float(delay)))


def wave(entries: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The next `budget` entries over all domains."""
    return entries.orderBy(*order).limit(budget)


def children(pages: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth, referer) of the links of pages that are not yet at the deepest level."""
    rows = pages.where(F.col("depth") < max_depth).select(F.explode("outlinks").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("referer"))
    return rows.where("url is not null and url <> ''")


def domain_counts(entries: DataFrame, limit: int = 30) -> DataFrame:
    """(domain, n) of the longest queues."""
    return entries.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(limit)


def usable_fetches(fetches: DataFrame, max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """Fetches that brought a page: status 200, no error, an allowed or unknown content type, a size within bounds."""
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    fine = F.col("content_type").isNull() | (kind == "") | kind.isin(PAGE_TYPES)
    return fetches.where((F.col("status") == 200) & (F.coalesce("error", F.lit("")) == "") & fine & (F.coalesce("body_bytes", F.lit(0)) <= max_bytes))


def save(path: str, seen: DataFrame, queue: DataFrame, total_added: int, total_crawled: int) -> None:
    """Write a frontier to resume from: fingerprints seen, the queue with its order, and the two counters."""
    spark = queue.sparkSession
    seen.select("fp").distinct().write.mode("overwrite").parquet(f"{path}/seen")
    queue.select("url", "depth", "anchor_text", "priority").write.mode("overwrite").parquet(f"{path}/queue")
    counts = spark.createDataFrame([(total_added, total_crawled)], "total_added bigint, total_crawled bigint")
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counters")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(seen, queue, total_added, total_crawled) as saved; a crawl's budget goes on from total_crawled."""
    counts = spark.read.schema("total_added bigint, total_crawled bigint").json(f"{path}/counters").first()
    return spark.read.parquet(f"{path}/seen"), spark.read.parquet(f"{path}/queue"), counts.total_added, counts.total_crawled
