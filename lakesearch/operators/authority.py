"""The link graph and its PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.functions import urls
from lakesearch.sources.shared import bucketed, materialize


def edges(docs: DataFrame, normalize_outlinks: bool = False) -> DataFrame:
    """(src, dst) distinct: outlinks that equal a document's url; of several documents of one url the last counts.
    Self-links are dropped; null links lead nowhere."""
    spell = urls.normalize if normalize_outlinks else (lambda c: c)
    targets = docs.where("url is not null").groupBy(spell(F.col("url")).alias("link")).agg(F.max("doc_id").alias("dst"))
    links = docs.select(F.col("doc_id").alias("src"), F.explode(F.array_distinct("outlinks")).alias("raw")).select("src", spell(F.col("raw")).alias("link"))
    return links.join(targets, "link").where("src <> dst").select("src", "dst").distinct()


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, iterations: int = 15, epsilon: float = 1e-6) -> DataFrame:
    """(doc_id, rank): uniform start, the mass of nodes without links spread evenly, stopped once the change falls
    below `epsilon`.

    The links are written once, bucketed by source with its out-degree, and never move again: a round brings the ranks,
    one row per node, to their buckets and sums what the links carry, partly before the shuffle by target. Each round is
    written to the shared folder, which also gives its change and its loose mass.
    """
    n = nodes.count()
    if not n:
        return nodes.select("doc_id", F.lit(0.0).alias("rank"))
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = bucketed(links.join(degree, "src"), "edges", "src")
    linked = links.select(F.col("src").alias("doc_id"), F.lit(True).alias("out")).distinct()
    start = nodes.select("doc_id").join(linked, "doc_id", "left").select("doc_id", F.coalesce("out", F.lit(False)).alias("out"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved"))
    ranks = materialize(start, "ranks")
    loose = ranks.where("not out").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(iterations):
        # a broadcast of the ranks would be no better, and they grow with the crawl
        sent = links.join(ranks.select(F.col("doc_id").alias("src"), "rank").hint("merge"), "src")
        share = sent.groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = F.lit((1 - damping) / n + damping / n * loose) + damping * F.coalesce("got", F.lit(0.0))
        ranks = ranks.join(share, "doc_id", "left").select("doc_id", "out", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved"))
        ranks = materialize(ranks, "ranks")
        loose, moved = ranks.agg(F.coalesce(F.sum(F.when(~F.col("out"), F.col("rank"))), F.lit(0.0)), F.sum("moved")).first()
        if moved < epsilon:
            break
    return ranks.select("doc_id", "rank")


def normalized(ranks: DataFrame) -> DataFrame:
    """(doc_id, authority): ranks scaled to 0..1, six decimals; all 1 if they don't differ."""
    low, high = ranks.agg(F.min("rank"), F.max("rank")).first()
    if low is None:
        return ranks.select("doc_id", F.col("rank").alias("authority"))
    value = F.round((F.col("rank") - low) / (high - low), 6) if high - low > 1e-12 else F.lit(1.0)
    return ranks.select("doc_id", value.alias("authority"))


def written_back(docs: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, summary): documents with `authority` replaced by the normalised rank, those without a rank unchanged, and one
    row (docs, example_max, example_min) of what was written."""
    scores = materialize(normalized(ranks), "authority")
    new = docs.join(scores.withColumnRenamed("authority", "_new"), "doc_id", "left")
    out = new.withColumn("authority", F.coalesce("_new", "authority")).drop("_new").select(*docs.columns)
    low, high = F.coalesce(F.min("authority"), F.lit(0.0)), F.coalesce(F.max("authority"), F.lit(0.0))
    return out, scores.agg(F.count(F.lit(1)).alias("docs"), high.alias("example_max"), low.alias("example_min"))


def rebuilt(docs: DataFrame, crawl: str) -> DataFrame:
    """Documents as they are after a crawl: a managed one (`crawl` = "managed", or "admin" on request) computes authority
    anew, any other leaves it."""
    return written_back(docs, pagerank(docs.select("doc_id"), edges(docs)))[0] if crawl in ("managed", "admin") else docs
