"""Long verbatim spans shared between records.

Every window of k = least // 2 + 1 characters gets a rolling hash (Rabin-Karp). Of any `least - k + 1` windows in a row
the one of least hash is kept, so that two texts with a common span of `least` characters keep at least one common
window inside it; nothing is sampled away. Spark counts the kept windows; those of a single text end there.

Windows of few texts pair them up, once per run of common windows, and the pair's texts are compared around the window
for the maximal span. Windows of many texts (page furniture, say) are not paired: all windows of `least` characters
around them are hashed and counted instead, and only texts that agree on a whole such window meet.

Equal texts are one text with many records throughout; pairs are expanded to records at the end.
Texts are known by 64-bit hashes; two different texts of one hash would be taken for copies. What is joined is written
first and carries no broadcast hint, so that Spark broadcasts it only below its threshold in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.sources.shared import materialize
from lakesearch.sources.workers import ship, spread

LEAST = 120
#: A kept window in more rows than this is verified by whole windows instead of by pairs.
HOT = 40

_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, grown as texts need."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), n + 1, 1 << 14)
        made = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers = (made[0], made[1])
    return _powers


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(chars: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all windows of k characters."""
    n = len(chars)
    if n < k:
        return np.empty(0, np.uint64)
    power, inverse = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * inverse[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    return h


def _slide(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over each w values in a row, in linear time by blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], ahead[w - 1 : n])


def kept(h: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the least hash of some w in a row (all of them where hashes tie)."""
    if len(h) < w:
        return np.empty(0, np.int64)
    least = _slide(h, w, np.minimum, 2**64 - 1)
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(_slide(padded, w, np.maximum, 0) == h)


def _texts(df: DataFrame, record: str, text: str, least: int) -> DataFrame:
    rows = df.select(F.col(record).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    return rows.where(F.length("text") >= least).withColumn("key", F.xxhash64("text"))


def _anchors(texts: DataFrame, least: int) -> DataFrame:
    k = least // 2 + 1
    w = least - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places = [], []
            for text in batch.column(2).to_pylist():
                h = rolling(codes(text), k)
                at = kept(h, w)
                hashes.append(h[at])
                places.append(at)
            if not places:
                continue
            sizes = [len(x) for x in places]
            doc, key = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(key), pa.array(doc), pa.array(np.concatenate(places).astype(np.int32))], names=["h", "key", "doc", "at"]
            )

    ship(texts.sparkSession)
    return spread(texts.select("doc", "key", "text")).mapInArrow(run, "h bigint, key bigint, doc bigint, at int")


def _of_docs(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text) of the listed docs: a text moves only if its doc is listed."""
    return texts.select("doc", "text").join(materialize(docs.distinct(), "docs"), "doc", "left_semi")


def _cold(hits: DataFrame, texts: DataFrame, least: int, whole: bool) -> DataFrame:
    """Spans (key_a, key_b, doc_a, doc_b, start_a, start_b, length) from windows of few texts: maximal if `whole`, else cut
    off at `least - k` characters beyond the window, which is enough to tell whether they reach `least`; then only
    slices of that size are moved instead of texts."""
    k = least // 2 + 1
    reach = least - k
    order = Window.partitionBy("key").orderBy("at")
    rows = hits.withColumn("h0", F.lag("h").over(order)).withColumn("gap", F.col("at") - F.lag("at").over(order))
    rows = materialize(rows.select("h", "key", "doc", "at", "h0", "gap"), "cold")
    a = rows.select("h", *[F.col(c).alias(f"{c}_a") for c in ("key", "doc", "at", "h0", "gap")])
    b = rows.select("h", *[F.col(c).alias(f"{c}_b") for c in ("key", "doc", "at", "h0", "gap")])
    # a pair whose windows before this one agree too, and touch it, was emitted there
    goes_on = (F.col("h0_a") == F.col("h0_b")) & (F.col("gap_a") == F.col("gap_b")) & (F.col("gap_a") <= k)
    pairs = a.join(b, "h").where((F.col("key_a") < F.col("key_b")) & ~F.coalesce(goes_on, F.lit(False)))
    pairs = materialize(pairs.select("key_a", "key_b", "doc_a", "doc_b", "at_a", "at_b"), "pairs")
    wanted = pairs.select(F.col("doc_a").alias("doc"), F.col("at_a").alias("at")).union(pairs.select("doc_b", "at_b"))
    if whole:
        on = ["doc"]
        pool = _of_docs(texts, wanted.select("doc")).withColumn("base", F.lit(0))
    else:
        on = ["doc", "at"]
        places = materialize(wanted.groupBy("doc").agg(F.collect_set("at").alias("places")), "places")
        pool = texts.select("doc", "text").join(places, "doc").select("doc", "text", F.explode("places").alias("at"))
        base = F.greatest(F.lit(0), F.col("at") - reach)
        pool = pool.select("doc", "at", base.alias("base"), F.substr("text", base + 1, F.col("at") - base + k + reach).alias("text"))
    full = pairs
    for x in "ab":
        side = pool.select(*[F.col(c).alias(f"{c}_{x}") for c in (*on, "base", "text")])
        full = full.join(side, [f"{c}_{x}" for c in on])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = [[], [], []]
            at = {c: np.array(cols[f"at_{c}"], np.int64) for c in "ab"}
            base = {c: np.array(cols[f"base_{c}"], np.int64) for c in "ab"}
            for i, (s, t, p, q) in enumerate(zip(cols["text_a"], cols["text_b"], (at["a"] - base["a"]).tolist(), (at["b"] - base["b"]).tolist(), strict=True)):
                x, y = codes(s), codes(t)
                n = min(p, q)
                differ = np.flatnonzero(x[p - n : p][::-1] != y[q - n : q][::-1])
                left = int(differ[0]) if len(differ) else n
                n = min(len(x) - p, len(y) - q)
                differ = np.flatnonzero(x[p : p + n] != y[q : q + n])
                right = int(differ[0]) if len(differ) else n
                if left + right >= least:
                    for column, v in zip(out, (i, p - left, left + right), strict=True):
                        column.append(v)
            keep = np.array(out[0], np.int64)
            start, length = np.array(out[1], np.int64) + base["a"][keep], np.array(out[2], np.int64)
            shift = at["b"][keep] - at["a"][keep]
            ids = [pa.array(np.array(cols[c], np.int64)[keep]) for c in ("key_a", "key_b", "doc_a", "doc_b")]
            names = ["key_a", "key_b", "doc_a", "doc_b", "start_a", "start_b", "length"]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start), pa.array(start + shift), pa.array(length)], names=names)

    return full.select("key_a", "key_b", "doc_a", "doc_b", "at_a", "at_b", "base_a", "base_b", "text_a", "text_b").mapInArrow(
        run, "key_a bigint, key_b bigint, doc_a bigint, doc_b bigint, start_a bigint, start_b bigint, length bigint"
    )


def _hot(hits: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Repeated windows (h, key, doc, start, before) of `least` characters around windows of many texts."""
    k = least // 2 + 1
    places = materialize(hits.groupBy("key", "doc").agg(F.collect_list("at").alias("places")), "hot")
    pool = _of_docs(texts, places.select("doc")).join(places, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, at in zip(*(batch.column(n).to_pylist() for n in ("doc", "key", "text", "places")), strict=True):
                chars = codes(text)
                h = rolling(chars, least)
                near = np.zeros(len(h) + 1, np.int32)
                at = np.array(at)
                np.add.at(near, np.clip(at - (least - k), 0, len(h)), 1)
                np.add.at(near, np.clip(at + 1, 0, len(h)), -1)
                start = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                before = np.where(start > 0, chars[start - 1].astype(np.int64), -1)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[start].view(np.int64)), pa.array(np.full(n, key)), pa.array(np.full(n, doc)), pa.array(start), pa.array(before)], names=["h", "key", "doc", "start", "before"]
                )

    rows = pool.select("doc", "key", "text", "places").mapInArrow(run, "h bigint, key bigint, doc bigint, start bigint, before bigint")
    rows = materialize(rows, "windows")
    again = rows.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h")
    return rows.join(materialize(again, "again"), "h", "left_semi")


def _found(df: DataFrame, record: str, text: str, least: int, hot: int, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(texts, cold spans, hot windows or None)."""
    texts = _texts(df, record, text, least)
    anchors = materialize(_anchors(texts, least), "anchors")
    again = anchors.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    again = materialize(again.select("h", (F.col("n") > hot).alias("hot")), "repeated")
    hits = anchors.join(again, "h").groupBy("h", "hot", "key", "at").agg(F.min("doc").alias("doc"))
    hits = materialize(hits, "hits")
    cold = materialize(_cold(hits.where("not hot"), texts, least, whole), "spans")
    return texts, cold, materialize(_hot(hits.where("hot"), texts, least), "hotwindows") if hits.where("hot").limit(1).count() else None


def linked(df: DataFrame, record: str, text: str, least: int = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc, key) with the class of each record, its text's hash, and (key_a, key_b), key_a < key_b, of
    classes whose texts share a span of at least `least` code points, each pair once.

    Null texts and texts shorter than `least` are in no class. A repeated row (same record id) is the same record.
    """
    texts, cold, windows = _found(df, record, text, least, hot, whole=False)
    met = cold.select("key_a", "key_b")
    if windows is not None:
        a, b = (windows.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "before")]) for x in "ab")
        starts = (F.col("before_a") != F.col("before_b")) | (F.col("before_a") == -1)
        met = met.union(a.join(b, "h").where((F.col("key_a") < F.col("key_b")) & starts).select("key_a", "key_b"))
    return materialize(texts.select("doc", "key").distinct(), "members"), materialize(met.distinct(), "met")


def link_counts(df: DataFrame, record: str, text: str, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, n_links) of every record in a class: the least record of its text, and how many other records
    share a span with it. No pair of records is built: a class counts with its size."""
    members, met = linked(df, record, text, least, hot)
    classes = materialize(members.groupBy("key").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    both = met.union(met.select("key_b", "key_a")).toDF("key", "other")
    reached = both.join(classes.select(F.col("key").alias("other"), "n"), "other").groupBy("key").agg(F.sum("n").alias("reached"))
    per_class = classes.join(reached, "key", "left").select("key", "class_id", (F.coalesce("reached", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return members.join(per_class, "key").select(F.col("doc").alias("doc_id"), "class_id", "n_links")


def pairs(df: DataFrame, record: str, text: str, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: the classes' links expanded to records, and the records of one class to pairs."""
    members, met = linked(df, record, text, least, hot)
    for x in "ab":
        met = met.join(members.select(F.col("key").alias(f"key_{x}"), F.col("doc").alias(f"doc_{x}")), f"key_{x}")
    ends = [F.col("doc_a"), F.col("doc_b")]
    across = met.select(F.least(*ends).alias("doc_id_a"), F.greatest(*ends).alias("doc_id_b"))
    copied = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "copied")
    copies = members.join(copied, "key", "left_semi")
    inner = copies.select("key", F.col("doc").alias("doc_id_a")).join(copies.select("key", F.col("doc").alias("doc_id_b")), "key")
    return across.union(inner.where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b"))


def shared(df: DataFrame, record: str, text: str, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """One row per record: doc_id, n_chars, shared_chars, n_spans. Every record has one, of null text with nulls.

    shared_chars counts the characters inside spans of at least `least` that stand in another record's text, merged
    into n_spans maximal intervals. A text that has a copy is shared as a whole.
    """
    texts, cold, windows = _found(df, record, text, least, hot, whole=True)
    sides = [cold.select(F.col(f"key_{x}").alias("key"), F.col(f"start_{x}").alias("start"), (F.col(f"start_{x}") + F.col("length")).alias("end")) for x in "ab"]
    parts = sides[0].union(sides[1])
    if windows is not None:
        parts = parts.union(windows.select("key", "start", F.col("start") + least))
    parts = parts.groupBy("key", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("key").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before, F.lit(True))
    own = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))))
    per_text = parts.withColumn("own", own).withColumn("fresh", fresh.cast("long"))
    per_text = per_text.groupBy("key").agg(F.sum("own").alias("covered"), F.sum("fresh").alias("parts"))
    classes = texts.select("key", "doc").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    rows = df.select(F.col(record).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("key"), F.col(text).isNotNull().alias("there"))
    rows = rows.join(per_text, "key", "left").join(classes, "key", "left")
    copied = F.coalesce("copied", F.lit(False)) & F.col("there") & (F.col("n_chars") >= least)
    zero = F.when(F.col("there"), F.lit(0))
    return rows.select(
        "doc_id",
        "n_chars",
        F.when(copied, F.col("n_chars")).otherwise(F.when(F.col("n_chars") >= least, F.coalesce("covered", zero)).otherwise(zero)).alias("shared_chars"),
        F.when(copied, F.lit(1)).otherwise(F.when(F.col("n_chars") >= least, F.coalesce("parts", zero)).otherwise(zero)).alias("n_spans"),
    )
