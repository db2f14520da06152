"""Seed lists, dictionaries and other small files."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesearch.functions import urls
from lakesearch.sources.workers import ship


def split_seeds(text: Column) -> Column:
    """Addresses of a text parted by line ends and commas (also the full-width one), trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, "[\n,，]"), lambda x: F.trim(x)), lambda x: x != "")


def valid_seed(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """(url) of the store and the valid new ones, each once."""
    return store.select("url").union(new.select(F.trim("url").alias("url")).where(valid_seed(F.col("url")))).distinct()


def removed(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.select("url").distinct().join(gone.select("url"), "url", "left_anti")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file of one entry per line; blank lines and those that begin with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def read_dictionary(spark: SparkSession, path: str, longest: int = 8) -> DataFrame:
    """(word, freq, tag) of lines `word freq [tag]`; words of no or too many characters and bad numbers are left out."""
    parts = F.split("value", r"\s+")
    rows = read_lines(spark, path).select(parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("freq"), F.try_element_at(parts, F.lit(3)).alias("tag"))
    return rows.where(f"freq is not null and length(word) between 1 and {longest}")


def save_store(store: DataFrame, path: str) -> None:
    store.coalesce(1).write.mode("overwrite").json(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a stored list: texts only, each once, in the order stored."""
    rows = spark.read.schema("url string").json(path).where("url is not null").withColumn("at", F.monotonically_increasing_id())
    first = F.row_number().over(Window.partitionBy("url").orderBy("at"))
    return rows.withColumn("n", first).where("n = 1").orderBy("at").select("url")


def allowed_by_robots(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Pages that the robots.txt text of their origin, `robots` (origin, rules), lets an agent fetch; an origin without
    rules allows all."""
    ship(pages.sparkSession)

    @F.pandas_udf("boolean")
    def may(url: pd.Series, rules: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(u: str, r: str | None) -> bool:
            if not isinstance(r, str):
                return True
            if r not in parsed:
                parsed[r] = RobotFileParser()
                parsed[r].parse(r.splitlines())
            return parsed[r].can_fetch(agent, u)

        return pd.Series([one(u, r) for u, r in zip(url, rules, strict=True)])

    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")))
    rows = pages.withColumn("origin", origin).join(robots.select("origin", "rules"), "origin", "left")
    return rows.where(may("url", "rules")).drop("origin", "rules")
