"""Views of a running or finished crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, order: list[Column], limit: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def trend(events: DataFrame, time: str, minutes: int, *keys: str) -> DataFrame:
    """(window_start, keys, n) counts in tumbling windows; rows without a time are left out."""
    start = F.window(time, f"{minutes} minutes")["start"]
    return events.where(F.col(time).isNotNull()).groupBy(start.alias("window_start"), *keys).agg(F.count(F.lit(1)).alias("n"))


def counters(fetches: DataFrame) -> DataFrame:
    """(status_class, n, n_errors, mb) of all fetches, repeated rows counted once."""
    rows = fetches.dropDuplicates(["fetch_id"])
    kind = F.when(F.col("status").isNull(), "none").otherwise(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    failed = F.coalesce("error", F.lit("")) != ""
    return rows.groupBy(kind.alias("status_class")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("n_errors"), F.round(F.sum("body_bytes") / 1e6, 3).alias("mb"))


def task_rates(tasks: DataFrame) -> DataFrame:
    """(id, status, seconds, rate): pages per second of each task, null while unfinished."""
    seconds = F.coalesce(F.col("duration"), (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)
    return tasks.select("id", "status", F.round(seconds, 3).alias("seconds"), F.round(F.col("crawled") / F.nullif(seconds, F.lit(0.0)), 6).alias("rate"))


def task_history(tasks: DataFrame, limit: int = 100) -> DataFrame:
    return tasks.orderBy(F.desc("started_at"), "id").limit(limit)


def recorded(history: DataFrame, task: DataFrame, keep: int = 100) -> DataFrame:
    """The history with a finished task in front, the newest `keep` kept; a task recorded again replaces its row."""
    return task_history(history.join(task.select("id").distinct(), "id", "left_anti").select(*task.columns).unionByName(task), keep)


def downloads(fetches: DataFrame) -> DataFrame:
    """One row (requests, success, errors, robots_blocked) of all fetches, repeated rows counted once: pages that came with
    status 200 and no error, addresses that robots rules forbade, and all else."""
    rows = fetches.dropDuplicates(["fetch_id"])
    error = F.lower(F.coalesce("error", F.lit("")))
    blocked, fine = error.contains("robots"), F.coalesce((F.col("status") == 200) & (error == ""), F.lit(False))

    def n(x: Column) -> Column:
        return F.coalesce(F.sum(x.cast("long")), F.lit(0))

    return rows.agg(F.count(F.lit(1)).alias("requests"), n(fine).alias("success"), n(~fine & ~blocked).alias("errors"), n(blocked).alias("robots_blocked"))


def log_tail(lines: DataFrame, level: str | None, last: int) -> DataFrame:
    """The last `last` (10 to 500) lines (line_no, value), of a level only if one is given."""
    if level:
        lines = lines.where(F.col("value").contains(f"[{level}]") | F.col("value").contains(f"{level}:"))
    return lines.orderBy(F.desc("line_no")).limit(min(500, max(10, last)))
