"""Retrieval and ranking over an index: candidate sets, filters, BM25 with boosts, pages."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesearch.functions import text, urls
from lakesearch.operators.index import doc_lengths, load
from lakesearch.plans.query import QuerySpec, clamp, latin, parse
from lakesearch.sources.shared import materialize

#: Scored results kept at most; unscored lists are whole.
SCORED = 1000


@dataclass(frozen=True)
class Weights:
    k1: float = 1.5
    b: float = 0.75
    title: float = 2.5
    description: float = 1.5
    authority: float = 0.35
    decay_days: float = 0.0


class Index:
    """`docs` (doc_id, url, title, description, body_text, title_tokens, desc_tokens, authority, fetch_time) and
    `post` (term, doc_id, term_freq, positions), one row each per document and per term in a document."""

    def __init__(self, docs: DataFrame, post: DataFrame, lengths: DataFrame | None = None, size: tuple[int, float] | None = None):
        self.docs, self.post = docs, post
        self.lengths = lengths if lengths is not None else doc_lengths(post)
        if size is not None:
            self.size = size

    @classmethod
    def open(cls, spark: SparkSession, path: str, docs: DataFrame | None = None) -> Index:
        """An index that `index.save` wrote with its documents (or those given), postings, lengths and corpus row: a query reads the row groups
        of its terms and aggregates nothing over the index."""
        size = load(spark, path, "corpus").first()
        return cls(docs if docs is not None else load(spark, path, "documents"), load(spark, path, "postings"), load(spark, path, "lengths"), (size.total_docs, size.mean_length))

    def tables(self) -> dict[str, DataFrame]:
        """What `open` reads beside the documents, for `index.save`."""
        n, mean = self.size
        corpus = self.docs.sparkSession.createDataFrame([(n, mean)], "total_docs bigint, mean_length double")
        return {"postings": self.post, "lengths": self.lengths, "corpus": corpus}

    @cached_property
    def size(self) -> tuple[int, float]:
        """(documents, mean length): two numbers that every score needs."""
        n = self.docs.count()
        total = self.lengths.agg(F.coalesce(F.sum("doc_length"), F.lit(0))).first()[0]
        return n, (total / n if n else 0.0) or 1.0

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequency of a query's few terms."""
        rows = self.post.where(F.col("term").isin(terms)).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
        return {r.term: r.n for r in rows}

    def having_all(self, terms: list[str]) -> DataFrame:
        """(doc_id) of the documents that hold every term."""
        wanted = sorted(set(terms))
        rows = self.post.where(F.col("term").isin(wanted))
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc_id")

    def having_phrase(self, terms: list[str]) -> DataFrame:
        """(doc_id) of the documents that hold the terms side by side. A place minus its rank in the phrase is the
        same for all terms of one occurrence, so one grouping finds them, however long the phrase."""
        if not terms:
            return self.docs.select("doc_id").limit(0)
        if len(terms) == 1:
            return self.post.where(F.col("term") == terms[0]).select("doc_id").distinct()
        ranks = reduce(lambda acc, x: acc.when(F.col("term") == x[0], F.array(*[F.lit(i) for i in x[1]])), _places(terms).items(), F.when(F.lit(False), F.array(F.lit(0))))
        rows = self.post.where(F.col("term").isin(list(dict.fromkeys(terms)))).select("doc_id", F.explode("positions").alias("pos"), ranks.alias("ranks"))
        starts = rows.select("doc_id", "pos", F.explode("ranks").alias("i")).groupBy("doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        return starts.where(F.col("n") == len(terms)).select("doc_id").distinct()

    def candidates(self, spec: QuerySpec) -> DataFrame:
        """(doc_id): union of the groups' and phrases' documents, all documents for a plan without content."""
        if not spec.has_content:
            return self.docs.select("doc_id")
        parts = [self.having_all(g) for g in spec.or_groups] + [self.having_phrase(p) for p in spec.phrases]
        return reduce(DataFrame.union, parts).distinct() if len(parts) > 1 else parts[0]

    def filtered(self, spec: QuerySpec) -> DataFrame:
        """(doc_id) of the candidates that pass the filters."""
        found = self.candidates(spec)
        rules: list[Column] = []
        if spec.site:
            rules.append(urls.on_site(F.col("url"), spec.site))
        if spec.inurl:
            rules.append(F.col("url").contains(spec.inurl))
        if spec.intitle:
            rules.append(F.array_contains("title_tokens", spec.intitle))
        if rules:
            found = found.join(self.docs.where(reduce(Column.__and__, rules)).select("doc_id"), "doc_id", "left_semi")
        if spec.exclude:
            found = found.join(self.post.where(F.col("term").isin(sorted(spec.exclude))).select("doc_id"), "doc_id", "left_anti")
        return found

    def scores(self, terms: list[str], within: DataFrame, weights: Weights = Weights(), now: float = 0.0) -> DataFrame:
        """(doc_id, score) of BM25 times field boosts, authority and decay. A term listed twice counts twice."""
        n, mean = self.size
        freq = self.frequencies(terms)
        weight = {t: terms.count(t) * math.log((n - freq[t] + 0.5) / (freq[t] + 0.5) + 1) for t in dict.fromkeys(terms) if t in freq}
        # the candidates thin the postings before anything is joined to them
        rows = self.post.where(F.col("term").isin(list(weight))).select("doc_id", "term", "term_freq").join(within, "doc_id", "left_semi")
        per_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("term", "term_freq")).alias("hits"))  # at most one per query term
        docs = self.docs.select("doc_id", "title_tokens", "desc_tokens", "authority", "fetch_time")
        joined = per_doc.join(self.lengths, "doc_id").join(docs, "doc_id")
        length = F.when(F.col("doc_length") > 0, F.col("doc_length")).otherwise(F.lit(mean)).cast("double")
        idf = reduce(lambda acc, x: acc.when(F.col("h.term") == x[0], F.lit(x[1])), weight.items(), F.when(F.lit(False), F.lit(0.0)))
        one = joined.withColumn("h", F.explode("hits"))
        tf = F.col("h.term_freq").cast("double")
        value = idf * tf * F.lit(weights.k1 + 1) / (tf + F.lit(weights.k1) * (F.lit(1 - weights.b) + F.lit(weights.b) * length / F.lit(mean)))
        for tokens, factor in (("title_tokens", weights.title), ("desc_tokens", weights.description)):
            value = value * F.when(F.coalesce(F.array_contains(tokens, F.col("h.term")), F.lit(False)), F.lit(factor)).otherwise(F.lit(1.0))
        out = one.groupBy("doc_id").agg(F.sum(value).alias("score"), F.first("authority").alias("authority"), F.first("fetch_time").alias("fetch_time"))
        final = F.col("score") * (F.lit(1.0) + F.lit(weights.authority) * F.coalesce("authority", F.lit(1.0)))
        if weights.decay_days > 0:
            age = (F.lit(float(now)) - F.col("fetch_time")) / F.lit(86400.0)
            fading = F.greatest(F.lit(0.5), F.lit(1.0) / (F.lit(1.0) + age / F.lit(float(weights.decay_days))))
            final = final * F.when(F.coalesce("fetch_time", F.lit(0.0)) != 0, fading).otherwise(F.lit(1.0))
        return out.select("doc_id", final.alias("score"))

    def ranked(self, spec: QuerySpec, weights: Weights = Weights(), now: float = 0.0) -> DataFrame:
        """(doc_id, score), best first, ties by doc_id. Phrases add their own score to their documents. Without terms
        all documents that pass, newest id first, with score 0."""
        found = self.filtered(spec)
        if not spec.terms:
            return found.select("doc_id", F.lit(0.0).alias("score")).orderBy(F.desc("doc_id"))
        parts = [self.scores(spec.terms, found, weights, now)]
        for p in spec.phrases:
            parts.append(self.scores(p, self.having_phrase(p).join(found, "doc_id", "left_semi"), weights, now))
        total = reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.sum("score").alias("score")) if len(parts) > 1 else parts[0]
        return total.orderBy(F.desc("score"), "doc_id").limit(SCORED)

    def _shown(self, hits: DataFrame, spec: QuerySpec) -> DataFrame:
        """(doc_id, url, title, snippet, score, authority, word_count) of a page of hits; texts are fetched for it alone."""
        count = "word_count" if "word_count" in self.docs.columns else F.lit(None).cast("int").alias("word_count")
        rows = self.docs.select("doc_id", "url", "title", "description", "body_text", "authority", count).join(F.broadcast(hits), "doc_id")
        shown = F.coalesce(F.nullif("title", F.lit("")), "url")
        body = F.coalesce(F.nullif("body_text", F.lit("")), "description")
        snippet = text.highlighted(text.snippet_window(body, spec.terms), spec.terms)
        return rows.select("doc_id", "url", shown.alias("title"), snippet.alias("snippet"), "score", "authority", "word_count")

    def results(self, spec: QuerySpec, page: int = 1, size: int = 10, weights: Weights = Weights(), now: float = 0.0) -> DataFrame:
        """One page of (doc_id, url, title, snippet, score, authority), best first."""
        page, size = clamp(page, size)
        hits = self.ranked(spec, weights, now).offset((page - 1) * size).limit(size)
        order = (F.desc("score"), F.asc("doc_id")) if spec.terms else (F.desc("doc_id"),)
        return self._shown(hits, spec).drop("word_count").orderBy(*order)

    def answer(self, query: str, page: int = 1, size: int = 10, weights: Weights = Weights(), now: float = 0.0) -> DataFrame:
        """One row (query, total, page, page_size, suggestion, results): results as the API lists them, best first, of all
        that were ranked; the suggestion is a corrected query, null unless nothing was found and something is nearer."""
        page, size = clamp(page, size)
        spec = parse(query)
        ranked = materialize(self.ranked(spec, weights, now).withColumn("at", F.monotonically_increasing_id()), "ranked")
        hits = self._shown(ranked.orderBy("at").offset((page - 1) * size).limit(size).drop("at"), spec)
        order = [F.desc("score"), F.asc("doc_id")] if spec.terms else [F.desc("doc_id")]
        listed = hits.select(F.struct(F.row_number().over(Window.orderBy(*order)).alias("at"), F.struct("title", "url", "snippet", F.round("score", 4).alias("score"), "word_count").alias("hit")).alias("x"))
        results = listed.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.hit).alias("results"))  # a page: at most 50 rows
        total = ranked.count()
        better = None if total else self.suggestion(query)
        head = [F.lit(query).alias("query"), F.lit(total).cast("bigint").alias("total"), F.lit(page).alias("page"), F.lit(size).alias("page_size"), F.lit(better).cast("string").alias("suggestion")]
        return results.select(*head, "results")

    def suggestion(self, query: str) -> str | None:
        """The query with each unknown word replaced by its nearest term, null if nothing changes."""
        words = latin(query)
        if not words:
            return None
        spark = self.docs.sparkSession
        asked = spark.createDataFrame([(0, words)], "query_id int, tokens array<string>")
        return text.corrected(asked, self.vocabulary()).first().corrected

    def vocabulary(self) -> DataFrame:
        """(term, df, first_doc, first_pos) of the index."""
        first = F.min(F.struct("doc_id", F.coalesce(F.array_min("positions"), F.lit(0)).alias("pos")))
        rows = self.post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), first.alias("f"))
        return rows.select("term", "df", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"))

    def postings_of(self, term: str) -> DataFrame:
        """(doc_id, term_freq, positions) of a term: a scan of few row groups where the postings are saved by term."""
        return self.post.where(F.col("term") == term).select("doc_id", "term_freq", "positions")

    def length_of(self, doc_id: int) -> DataFrame:
        """(doc_length) of a document, one row or none."""
        return self.lengths.where(F.col("doc_id") == doc_id).select("doc_length")


def external_suggestions(hits: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """(term) of the title tokens of an external server's hits (rank, title_tokens) that begin with a prefix, each once in
    the order met."""
    rows = hits.select("rank", F.posexplode("title_tokens").alias("at", "term")).where(F.lower("term").startswith(prefix.strip().lower()) & (F.lit(bool(prefix.strip()))))
    return rows.groupBy("term").agg(F.min(F.struct("rank", "at")).alias("met")).orderBy("met").limit(limit).select("term")


def _places(terms: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        out.setdefault(t, []).append(i)
    return out


def external_filter(docs: DataFrame, site: str | None = None, intitle: str | None = None, inurl: str | None = None) -> DataFrame:
    """The filters of the external server's variant: the host equals `site` as written, the others are substrings in any
    case."""
    rows = docs
    if site:
        rows = rows.where(urls.host(F.col("url")) == site)
    if intitle:
        rows = rows.where(F.lower("title").contains(intitle.lower()))
    if inurl:
        rows = rows.where(F.lower("url").contains(inurl.lower()))
    return rows


def as_json(results: DataFrame) -> DataFrame:
    """(json): a result row as an API returns it, scores with four decimals."""
    return results.select(F.to_json(F.struct("title", "url", "snippet", F.round("score", 4).alias("score"))).alias("json"))


class ResultCache:
    """The last answers by (kind, query, page, size); cleared when the index changes."""

    def __init__(self, size: int = 256):
        self.size, self.kept = size, OrderedDict()

    def get(self, key: tuple, make: Callable[[], object]) -> object:
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        value = self.kept[key] = make()
        if len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return value

    def clear(self) -> None:
        self.kept.clear()
