"""Frequency of every distinct term, kept by signed deltas.

State: one row (field_name, term, n_occurrences, n_records) per live term, Parquet in hash buckets of the term, and one
number per field, its records. A change set is aggregated to signed differences per term and merged, so that a batch
costs its own size plus the buckets it touches.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.sources.shared import materialize

#: Terms that a bucket is meant to hold.
BUCKET_ROWS = 2_000_000
KEYS = ["field_name", "term"]
STATE = "field_name string, term string, n_occurrences bigint, n_records bigint"


def from_arrays(df: DataFrame, record: str, field: str) -> DataFrame:
    """(field_name, term, record, occurrences) of an array column.

    Null arrays, null record ids and null or empty terms give no row. A record's repeated rows add to its
    occurrences, and it stays one record.
    """
    rows = df.select(F.col(record).alias("record"), F.explode(field).alias("term")).where("record is not null and term <> ''")
    seen = rows.groupBy("term", "record").agg(F.count(F.lit(1)).alias("occurrences"))
    return seen.select(F.lit(field).alias("field_name"), "term", "record", "occurrences")


def from_postings(df: DataFrame, name: str = "posting") -> DataFrame:
    """The same of postings: rows of one (term, doc_id) are versions of one posting, of which the largest term_freq
    counts; a posting whose every term_freq is null counts as a record with 0 occurrences."""
    return versions(df, name).drop("first")


def versions(df: DataFrame, name: str = "posting") -> DataFrame:
    """`from_postings` with `first`, the occurrences of the version that was indexed first: the least term_freq."""
    rows = df.where("doc_id is not null and term <> ''").groupBy("term", F.col("doc_id").alias("record"))
    seen = rows.agg(F.coalesce(F.max("term_freq").cast("long"), F.lit(0)).alias("occurrences"), F.coalesce(F.min("term_freq").cast("long"), F.lit(0)).alias("first"))
    return seen.select(F.lit(name).alias("field_name"), "term", "record", "occurrences", "first")


def delta(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Signed change per term. A changed record stands in `removed` as it was and in `added` as it is."""
    parts = [
        seen.groupBy(*KEYS).agg((F.sum("occurrences") * sign).alias("n_occurrences"), (F.count(F.lit(1)) * sign).alias("n_records"))
        for seen, sign in ((added, 1), (removed, -1))
        if seen is not None
    ]
    return parts[0] if len(parts) == 1 else merge(*parts, keep_zero=True)


def merge(*parts: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Sum of states and deltas; terms whose record count falls to 0 are gone unless `keep_zero`."""
    total = reduce(DataFrame.unionByName, parts).groupBy(*KEYS)
    total = total.agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
    return total if keep_zero else total.where("n_records > 0")


def totals(df: DataFrame, record: str, *names: str, sign: int = 1) -> DataFrame:
    """(field_name, n_total): the distinct records of a table, once for each field taken from it."""
    n = df.agg(F.countDistinct(record).alias("n_total"))
    return n.select(F.explode(F.array(*map(F.lit, names))).alias("field_name"), (F.col("n_total") * sign).alias("n_total"))


def marked(counts: DataFrame, total: DataFrame, rare_below: int = 3, common_percent: int = 5) -> DataFrame:
    """Counts with mark 'rare', 'common' or null; where both hold, 'rare'. `total` has one row per field."""
    joined = counts.join(F.broadcast(total), "field_name")
    common = F.col("n_records") * 100 > F.col("n_total") * common_percent
    mark = F.when(F.col("n_records") < rare_below, "rare").when(common, "common")
    return joined.select(*KEYS, "n_occurrences", "n_records", mark.alias("mark"))


class TermStore:
    """Term counts on disk, changed by deltas. An absent store is empty.

    A version is a small file that names, for each bucket, the folder that holds it, and the totals. It is written under
    another name and renamed when all its data is there: a reader sees the old version or the new, and a change that
    failed half-way can be applied again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def state(self) -> dict:
        """The current version: number, buckets (their count), folders (bucket -> folder), totals (field -> records)."""
        found = [s.getPath().getName() for s in self._fs.globStatus(self._at("version-*.json")) or []]
        if not found:
            return {"number": 0, "buckets": 0, "folders": {}, "totals": {}}
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/{max(found)}").first()[1])

    def _publish(self, state: dict) -> None:
        draft, final = self._at("draft.json"), self._at(f"version-{state['number']:09d}.json")
        out = self._fs.create(draft, True)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"version {state['number']} exists: another change was applied meanwhile")

    def _rows(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        """The counts in some buckets; files of other buckets aren't read."""
        parts = []
        for folder in sorted(set(state["folders"].values())):
            own = [int(b) for b, f in state["folders"].items() if f == folder and (buckets is None or int(b) in buckets)]
            if own:
                rows = self.spark.read.schema(STATE + ", bucket int").parquet(f"{self.path}/{folder}")
                parts.append(rows.where(F.col("bucket").isin(own)).drop("bucket"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], STATE)

    def counts(self) -> DataFrame:
        return self._rows(self.state())

    def totals(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.state()["totals"].items()), "field_name string, n_total bigint")

    def apply(self, change: DataFrame, total_change: DataFrame) -> TermStore:
        """Merge a delta: only the buckets that it touches are read and written, in a new folder of this version."""
        old = self.state()
        change = materialize(change, "delta")
        # the first change decides how many buckets there are
        buckets = old["buckets"] or max(1, -(-change.count() // BUCKET_ROWS))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        touched = {r.bucket for r in change.select(bucket.alias("bucket")).distinct().collect()}  # as many as buckets at most
        new = merge(self._rows(old, touched), change) if old["number"] else change.where("n_records > 0")
        number = old["number"] + 1
        folder = f"counts-{number:09d}"
        # a bucket's terms are spread evenly by their hash, so each is one task's work
        new.withColumn("bucket", bucket).repartition(len(touched) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        sums = dict(old["totals"])
        for r in total_change.groupBy("field_name").agg(F.sum("n_total").alias("n")).collect():  # a row per field
            sums[r.field_name] = sums.get(r.field_name, 0) + r.n
        self._publish({"number": number, "buckets": buckets, "folders": old["folders"] | {str(b): folder for b in touched}, "totals": sums})
        return self

    def marked(self, **limits: int) -> DataFrame:
        return marked(self.counts(), self.totals(), **limits)
