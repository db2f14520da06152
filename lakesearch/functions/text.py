"""Result shaping: snippets, highlights, suggestions and corrections."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snippet_window(text: Column, terms: list[str], size: int = 200) -> Column:
    """The part of a text around the earliest occurrence of any term; '' for null or empty text."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, F.lit(t.lower())), F.lit(0)) for t in terms if t]
    at = (F.least(*places) if len(places) > 1 else places[0]) if places else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), at - 1 - size // 2)
    end = F.least(F.length(text), start + size)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(text, start + 1, F.lit(size)), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(at.isNull(), F.substr(text, F.lit(1), F.lit(size))).otherwise(cut)


def highlighted(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with every term, any case, replaced by the term in bold; one term after the other."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    for t in terms:
        shown = html.escape(t)
        text = F.regexp_replace(text, "(?iu)" + re.escape(shown), "<b>" + shown.replace("\\", "\\\\").replace("$", "\\$") + "</b>")
    return text


def suggestions(stats: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """(term, df) of the terms that begin with a prefix: most frequent first, then by term. None for a blank prefix."""
    prefix = prefix.strip().lower()
    rows = stats.where(F.col("term").startswith(prefix)) if prefix else stats.where(F.lit(False))
    return rows.select("term", "df").orderBy(F.desc("df"), "term").limit(limit)


def nearest(words: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, term): for each word the nearest term within 2 edits, the first seen of equally near ones.

    `stats` has (term, first_doc, first_pos). Two words within 2 edits have a string in common after at most two
    deletions from each, so words are joined by the hashes of what their deletions leave; long words, of which there
    would be too many, by one of three parts that two edits leave whole.
    """
    w = words.select("word").distinct()
    a = w.select("word", F.explode(_near_keys(F.col("word"), True)).alias("key"))
    b = stats.select("term", "first_doc", "first_pos", F.explode(_near_keys(F.col("term"), False)).alias("key"))
    near = a.join(b, "key").where(F.abs(F.length("word") - F.length("term")) <= 2)
    near = near.withColumn("d", F.levenshtein("word", "term", 2)).where("d >= 0")
    return near.groupBy("word").agg(F.min_by("term", F.struct("d", "first_doc", "first_pos")).alias("term"))


#: Words up to SHORT characters have deletion keys, from LONG on part keys: of two words within 2 edits both are short or
#: both are long.
SHORT, LONG = 22, 19


def _near_keys(x: Column, probe: bool) -> Column:
    """Hashed keys of which two strings within two edits share one."""
    n = F.length(x)

    def shorter(y: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(y)))
        return F.transform(places, lambda i: F.concat(F.substr(y, F.lit(1), i - 1), F.substr(y, i + 1)))

    none = F.array().cast("array<string>")
    one = F.array_distinct(shorter(x))
    left = F.array_distinct(F.concat(F.array(x), one, F.flatten(F.transform(one, shorter))))
    # the parts of a probe against every place where two edits may have moved them
    k = F.floor((n - 2) / 3).cast("int")
    if probe:
        parts = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.concat(k.cast("string"), F.lit(":"), F.substr(x, i * k + 1, k)))
    else:
        sizes = F.sequence(F.floor((n - 4) / 3).cast("int"), F.floor(n / 3).cast("int"))
        parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat(k.cast("string"), F.lit(":"), F.substr(x, i + 1, k)))))
    keys = F.concat(F.when(n <= SHORT, left).otherwise(none), F.when(n >= LONG, parts).otherwise(none))
    return F.array_distinct(F.transform(keys, lambda s: F.xxhash64(s)))


def corrected(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, corrected) of (query_id, tokens): each token unknown to `stats` that has an ASCII letter or digit becomes
    its nearest term; null if nothing changes."""
    rows = queries.select("query_id", F.posexplode("tokens").alias("at", "word"))
    known = stats.select(F.col("term").alias("word"), F.lit(True).alias("known"))
    rows = rows.join(known, "word", "left")
    lost = rows.where(F.col("known").isNull() & F.col("word").rlike("[A-Za-z0-9]"))
    fixed = rows.join(nearest(lost, stats).withColumnRenamed("term", "better"), "word", "left")
    token = F.when(F.col("known").isNull() & F.col("word").rlike("[A-Za-z0-9]"), F.coalesce("better", "word")).otherwise(F.col("word"))
    fixed = fixed.select("query_id", "at", "word", token.alias("token"))
    out = fixed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "token", "word"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: x.token), " ")
    return out.select("query_id", F.when(F.exists("x", lambda x: x.token != x.word), joined).alias("corrected"))


def external_snippet(raw: str | None, size: int) -> str:
    """A snippet of an external server for display: unescaped, cut with dots, its emphasis as bold."""
    if not raw:
        return ""
    plain = html.unescape(raw)
    return (plain if len(plain) <= size else plain[:size] + "...").replace("<em>", "<b>").replace("</em>", "</b>")
