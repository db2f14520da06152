"""Exact positions in sorted groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.sources.shared import materialize


def ranked(df: DataFrame, group: Column, order: list[Column], columns: list[str]) -> DataFrame:
    """`columns` and `_rank`, a row's place from 0 in its group by `order` (ascending keys); rows of a null group are left out.

    One global range sort by (group, order). The sizes of the partitions before turn a row's place in its partition into
    its global position; less the position at which its group starts, that is its rank. A group of any size is spread
    over partitions. `order` must be total on distinct rows; exact copies of a row are interchangeable.
    """
    spark = df.sparkSession
    names = [f"_order{i}" for i in range(len(order))]
    rows = df.select(group.alias("_group"), *[c.alias(n) for c, n in zip(order, names, strict=True)], *columns).where("_group is not null")
    ranged = rows.repartitionByRange("_group", *names).sortWithinPartitions("_group", *names)
    at = F.monotonically_increasing_id()
    placed = materialize(ranged.select("_group", *columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "ranks")
    # a row per partition
    sizes = sorted((r._part, r.n) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, before = [], 0
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _before bigint"))
    exact = placed.join(offsets, "_part").withColumn("_position", F.col("_before") + F.col("_place"))
    # written first, so that Spark knows its bytes when it chooses the join
    begins = materialize(exact.groupBy("_group").agg(F.min("_position").alias("_begin")), "begins")
    return exact.join(begins, "_group").select(*columns, (F.col("_position") - F.col("_begin")).alias("_rank"))
