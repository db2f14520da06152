"""The positional inverted index as tables, and what is kept beside it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.functions.tokens import latin_tokens, segmented
from lakesearch.operators.ranking import ranked


def assembled(df: DataFrame, words: Sequence[tuple[str, int | None]] | None = ()) -> DataFrame:
    """`df` with `tokens` of title, description and body; pages of under 10 characters or 2 tokens are left out.

    `words` is the dictionary (word, freq) that Chinese text is cut along; without words its characters stand alone.
    None takes Latin tokens only and stays in the JVM, for rows that are compared with SQL.
    """
    text = F.concat_ws("\n", "title", "description", "body_text")
    rows = df.where(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) >= 10)
    if words is None:
        rows = rows.withColumn("tokens", latin_tokens(text))
    else:
        rows = segmented(rows.withColumn("_text", text), "_text", "tokens", list(words)).drop("_text")
    return rows.where(F.size("tokens") >= 2)


def occurrences(df: DataFrame) -> DataFrame:
    """(doc_id, term, pos) of `tokens`; title and description tokens that the text lacks get a place behind its end."""
    fields = F.concat(F.coalesce("title_tokens", F.array().cast("array<string>")), F.coalesce("desc_tokens", F.array().cast("array<string>")))
    extra = F.array_except(F.array_distinct(F.filter(fields, lambda t: t.isNotNull() & (t != ""))), F.col("tokens"))
    return df.select("doc_id", F.posexplode(F.concat("tokens", extra)).alias("pos", "term"))


def postings(places: DataFrame) -> DataFrame:
    """(term, doc_id, term_freq, positions) of occurrences; positions ascend."""
    found = places.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("term_freq"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.select("term", "doc_id", "term_freq", "positions")


def live_postings(segment: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per (term, doc_id) of a segment with repeated and re-indexed rows: the largest term_freq (1 if unknown) and
    positions; postings of pages that are gone are left out."""
    rows = segment.where("term <> ''").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("term", "doc_id")
    return rows.agg(F.coalesce(F.max("term_freq"), F.lit(1)).cast("bigint").alias("term_freq"), F.max("positions").alias("positions"))


def doc_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.sum("term_freq").alias("doc_length"))


def term_stats(places: DataFrame) -> DataFrame:
    """(term, df, first_doc, first_pos) of occurrences."""
    per_doc = places.groupBy("term", "doc_id").agg(F.min("pos").alias("pos"))
    first = F.min(F.struct("doc_id", "pos"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), first.alias("f")).select("term", "df", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"))


def corpus_stats(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row: total_docs, vocabulary_size, avg_doc_length (text, one decimal), total_word_count."""
    words = post.agg(F.count_distinct("term").alias("vocabulary_size"), F.coalesce(F.sum("term_freq"), F.lit(0)).alias("total_word_count"))
    n = docs.agg(F.count(F.lit(1)).alias("total_docs"))
    # one row each, joined on a constant
    both = n.withColumn("k", F.lit(1)).join(words.withColumn("k", F.lit(1)), "k")
    average = F.when(F.col("total_docs") > 0, F.col("total_word_count") / F.col("total_docs")).otherwise(F.lit(0.0))
    return both.select("total_docs", "vocabulary_size", F.format_string("%.1f", average).alias("avg_doc_length"), "total_word_count")


def without(post: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without the deleted documents of `gone` (doc_id)."""
    return post.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert(docs: DataFrame, key: Column, newest: list[Column]) -> DataFrame:
    """The row of each key that is greatest by `newest`, nulls least; rows of a null key are all kept. The row is found by
    partial aggregation, so a key with any number of versions is no hot spot."""
    rows = docs.withColumn("_key", key)
    last = F.max_by(F.struct(*docs.columns), F.struct(*newest))
    latest = rows.where("_key is not null").groupBy("_key").agg(last.alias("_row")).select("_row.*")
    return latest.unionByName(rows.where("_key is null").drop("_key"))


def with_ids(docs: DataFrame, order: list[Column]) -> DataFrame:
    """Documents that have no doc_id get the ids behind the greatest one, dense, in `order` (ascending, total on distinct
    rows); given ids stay."""
    known = docs.where("doc_id is not null")
    base = known.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
    rest = [c for c in docs.columns if c != "doc_id"]
    new = ranked(docs.where("doc_id is null"), F.lit(0), order, rest)
    return known.unionByName(new.withColumn("doc_id", F.col("_rank") + F.lit(base)).select(*docs.columns))


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    """The document of an id: one row, or none."""
    return docs.where(F.col("doc_id") == doc_id)


def listing(docs: DataFrame, page: int = 1, size: int = 10) -> tuple[DataFrame, int]:
    """(a page as `listed` gives it, number of all documents)."""
    return listed(docs, page, size), docs.count()


def listed(docs: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """A page of documents, newest id first; page and size are clamped to at least 1 and 1 to 50."""
    page, size = max(1, page), min(50, max(1, size))
    return docs.orderBy(F.desc("doc_id")).offset((page - 1) * size).limit(size)


def save(spark: SparkSession, path: str, version: str, **tables: DataFrame) -> None:
    """Write the tables under path/version, then point path/current to it: a reader sees the old index or the new.

    Postings are range-partitioned and sorted by term, so a scan for a query's terms reads few row groups.
    """
    for name, df in tables.items():
        df = df.repartitionByRange("term").sortWithinPartitions("term", "doc_id") if "term" in df.columns else df
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.schema("version string").json(f"{path}/current").first().version


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current_version(spark, path)}/{name}")


def merged(spark: SparkSession, path: str, version: str, docs: DataFrame, post: DataFrame, key: str = "url") -> None:
    """Publish a version of a saved index with `docs` and their `post`: documents replace those of the same `key`, whose
    postings go with them. A first version is just saved."""
    jvm = spark.sparkContext._jvm
    current = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(current):
        if current_version(spark, path) == version:
            return  # published before a failure
        old_docs, old_post = load(spark, path, "documents"), load(spark, path, "postings")
        gone = reduce(DataFrame.union, [old_docs.join(docs.select(c).distinct(), c, "left_semi").select("doc_id") for c in (key, "doc_id")]).distinct()
        docs = old_docs.join(gone, "doc_id", "left_anti").unionByName(docs)
        post = without(old_post, gone).unionByName(post)
    save(spark, path, version, documents=docs, postings=post)


class Snapshot:
    """The current version of a saved index; `changed` is called when another one has been published."""

    def __init__(self, spark: SparkSession, path: str, changed: Callable[[], object] = lambda: None):
        self.spark, self.path, self.changed, self.version = spark, path, changed, None

    def table(self, name: str) -> DataFrame:
        version = self.spark.read.schema("version string").json(f"{self.path}/current").first().version
        if version != self.version:
            self.version = version
            self.changed()
        return self.spark.read.parquet(f"{self.path}/{version}/{name}")
