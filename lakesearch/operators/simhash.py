"""64-bit SimHash and near-duplicates. Fingerprints are BIGINT bit patterns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.sources.shared import materialize


def fingerprints(tokens: DataFrame) -> DataFrame:
    """(doc_id, simhash) of (doc_id, term): distinct terms vote with the first 8 bytes of their md5; a bit is set if the
    votes for it outweigh. The 64 counts are one aggregation with partial sums."""
    rows = tokens.where("term is not null").select("doc_id", "term").distinct().withColumn("m", F.md5("term"))
    half = [F.conv(F.substring("m", p, 8), 16, 10).cast("bigint") for p in (1, 9)]
    rows = rows.select("doc_id", half[0].alias("hi"), half[1].alias("lo"))
    n = F.count(F.lit(1))
    votes = [F.sum(F.shiftright(h, b).bitwiseAND(F.lit(1))).alias(f"{h}{b}") for h in ("hi", "lo") for b in range(32)]
    sums = rows.groupBy("doc_id").agg(n.alias("n"), *votes)

    def side(h: str):
        out = F.lit(0).cast("bigint")
        for b in range(32):
            out = out.bitwiseOR(F.when(F.col(f"{h}{b}") * 2 > F.col("n"), F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return out

    return sums.select("doc_id", F.shiftleft(side("hi"), 32).bitwiseOR(side("lo")).alias("simhash"))


def _classes(prints: DataFrame) -> DataFrame:
    """(simhash, class_id), class_id the least doc_id of a fingerprint. Zero and null fingerprints are left out."""
    return prints.where("simhash is not null and simhash <> 0").groupBy("simhash").agg(F.min("doc_id").alias("class_id"))


def near_classes(prints: DataFrame, distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc_id, class_id) with class_id the least doc_id of a fingerprint, and (class_a, class_b, distance)
    between fingerprints that differ in 1 to `distance` bits, class_a < class_b. Zero and null fingerprints are left out.

    Exact: the 64 bits are cut into d + 3 blocks, of which d differing bits leave three whole, so two such fingerprints
    agree on one of the choices of three blocks (20 for d = 3). Each choice is a key of some 32 bits, so that few others
    share it, and what does is verified. Equal fingerprints are one class: a group of copies costs one row in the join.

    The keys are joined by shuffle at any size: Spark's estimate has neither their explosion nor Parquet's compression in
    it, so the driver would be sent 20 rows for each class of a table that just seems small enough to broadcast.
    """
    rows = prints.where("simhash is not null and simhash <> 0").select("doc_id", "simhash")
    classes = _classes(prints)
    members = rows.join(classes, "simhash").select("doc_id", "class_id")
    blocks = distance + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def part(i: int):
        return F.shiftrightunsigned("simhash", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    keys = F.array(*[F.xxhash64(F.lit(n), *map(part, chosen)) for n, chosen in enumerate(combinations(range(blocks), 3))])
    keyed = classes.select("class_id", "simhash", F.explode(keys).alias("key"))
    a = keyed.select("key", F.col("class_id").alias("class_a"), F.col("simhash").alias("hash_a"))
    b = keyed.select("key", F.col("class_id").alias("class_b"), F.col("simhash").alias("hash_b"))
    apart = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    links = a.join(b.hint("merge"), "key").where((F.col("class_a") < F.col("class_b")) & (apart <= distance))
    return members, links.select("class_a", "class_b", apart.cast("int").alias("distance")).distinct()


def kept(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id) that a gate lets pass which takes documents in order of id and refuses one within `distance` bits of one
    already kept. Zero and null fingerprints always pass.

    Each round decides the classes all of whose earlier neighbours are decided; a link goes from a lower id to a higher,
    so the rounds are as many as the longest chain of undecided neighbours. They join by shuffle: written tables are a few
    bytes a row, many times that in a broadcast.
    """
    links = materialize(near_classes(prints, distance)[1], "links")
    state = materialize(_classes(prints).select("class_id").distinct().withColumn("keep", F.lit(None).cast("boolean")), "gate")
    while True:
        a = state.select(F.col("class_id").alias("class_a"), F.col("keep").alias("keep_a"))
        seen = links.join(a.hint("merge"), "class_a").groupBy(F.col("class_b").alias("class_id")).agg(
            F.max(F.coalesce("keep_a", F.lit(False))).alias("near_kept"), F.max(F.col("keep_a").isNull()).alias("open")
        )
        new = F.when(F.coalesce("near_kept", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = materialize(state.join(seen.hint("merge"), "class_id", "left").select("class_id", F.coalesce("keep", new).alias("keep")), "gate")
        if not state.where("keep is null").limit(1).count():
            break
    # of a class only its first document passes; the others are at distance 0 of it
    first = state.where("keep").select(F.col("class_id").alias("doc_id"))
    return first.union(prints.where("simhash is null or simhash = 0").select("doc_id"))
