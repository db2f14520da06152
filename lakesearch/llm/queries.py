"""The queries of the language-model problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.functions import urls
from lakesearch.llm import bpe, capping, counts, mainbody, mojibake, packing, residue, sitelines, spans, stuffing
from lakesearch.sources.shared import materialize, scratch
from lakesearch.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residues(table(spark, folder, "crawl_docs"), "doc_id", "title", "body_text", urls.site(F.col("url")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.heaps(table(spark, folder, "crawl_docs"), "doc_id", "title", "body_text", "outlinks")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_restored(spark, folder).select("doc_id", "field_name")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restore(table(spark, folder, "crawl_docs"), "doc_id", ["title", "body_text"])


def _terms(spark: SparkSession, folder: str) -> counts.TermStore:
    """A store that has followed the crawl: what was there first, then the pages fetched in the last tenth of its time as
    added records and the postings that were indexed again as changed ones."""
    docs, postings = table(spark, folder, "crawl_docs"), table(spark, folder, "postings")
    low, high = docs.agg(F.min("fetch_time"), F.max("fetch_time")).first()
    late = F.coalesce(F.col("fetch_time") > F.lit((low or 0.0) * 0.1 + (high or 0.0) * 0.9), F.lit(False))
    fields = ["title_tokens", "desc_tokens"]

    def terms(pages: DataFrame) -> DataFrame:
        return counts.from_arrays(pages, "doc_id", fields[0]).unionByName(counts.from_arrays(pages, "doc_id", fields[1]))

    posted = materialize(counts.versions(postings), "postings")
    changed = posted.where("first <> occurrences")
    was = posted.withColumn("occurrences", F.col("first")).drop("first")
    store = counts.TermStore(spark, scratch(spark, "terms"))
    store.apply(counts.delta(terms(docs.where(~late)).unionByName(was)), counts.totals(docs.where(~late), "doc_id", *fields).unionByName(counts.totals(postings, "doc_id", "posting")))
    added = terms(docs.where(late)).unionByName(changed.drop("first"))
    return store.apply(counts.delta(added, changed.withColumn("occurrences", F.col("first")).drop("first")), counts.totals(docs.where(late), "doc_id", *fields))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).marked().where("mark is not null").select("field_name", "term", "mark")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term's counts and mark."""
    return _terms(spark, folder).marked()


def _drop(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "crawl_docs")
    order = [F.coalesce(-F.col("authority"), F.lit(float("inf"))), F.col("authority").isNull(), F.col("doc_id")]
    return docs, capping.dropped(docs, urls.site(F.col("url")), order, capping.cap_of(docs.count(), 2), ["doc_id"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _drop(spark, folder)[1]


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    docs, gone = _drop(spark, folder)
    return docs.join(gone, "doc_id", "left_anti").select("doc_id", urls.site(F.col("url")).alias("site"), "authority")


def _without_residues(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """`rows` without the pages of problem 1, taken out behind the extraction so that no whole text is joined."""
    gone = materialize(p1_found(spark, folder), "residues")
    return rows.join(gone, "doc_id", "left_anti")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs")
    return _without_residues(spark, folder, mainbody.furniture_lines(docs, "doc_id", "title", "body_text", "outlinks"))


def p5_articles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs")
    return _without_residues(spark, folder, mainbody.main_text(docs, "doc_id", "title", "body_text", "outlinks"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs")
    return sitelines.found(docs, "doc_id", urls.site(F.col("url")), "body_text").withColumnRenamed("record", "doc_id")


def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "crawl_docs")
    return sitelines.cleaned(docs, "doc_id", urls.site(F.col("url")), "body_text")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    # a table of three rows by its definition
    targets = [(r.target_id, r.tokenizer, r.capacity) for r in table(spark, folder, "pack_targets").collect()]
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.pairs(table(spark, folder, "documents"), "doc_id", "text")


def p10_linked(spark: SparkSession, folder: str) -> DataFrame:
    return spans.link_counts(table(spark, folder, "documents"), "doc_id", "text")


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared(table(spark, folder, "documents"), "doc_id", "text")


SITE = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '')"
TERMS = """WITH o AS (
  SELECT 'title_tokens' AS field_name, term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(title_tokens) AS term FROM crawl_docs) GROUP BY 2, 3
  UNION ALL SELECT 'desc_tokens', term, doc_id, count(*) FROM (SELECT doc_id, unnest(desc_tokens) AS term FROM crawl_docs) GROUP BY 2, 3
  UNION ALL SELECT 'posting', term, doc_id, coalesce(max(term_freq), 0) FROM postings GROUP BY 2, 3
), c AS (
  SELECT field_name, term, CAST(sum(n) AS BIGINT) AS n_occurrences, count(*) AS n_records FROM o WHERE term <> '' AND doc_id IS NOT NULL GROUP BY 1, 2
), m AS (
  SELECT *, CASE WHEN n_records < 3 THEN 'rare'
    WHEN n_records * 100 > 5 * (CASE WHEN field_name = 'posting' THEN (SELECT count(DISTINCT doc_id) FROM postings) ELSE (SELECT count(DISTINCT doc_id) FROM crawl_docs) END) THEN 'common' END AS mark FROM c
) """

RANKED = f"""WITH s AS (SELECT doc_id, authority, CASE WHEN url IS NULL THEN NULL ELSE {SITE} END AS site FROM crawl_docs),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY authority DESC NULLS LAST, doc_id) AS rn FROM s),
c AS (SELECT greatest(1, count(*) * 2 // 100) AS c FROM crawl_docs) """

LINES = f"""WITH d AS (SELECT doc_id, {SITE} AS site, string_split(body_text, chr(10)) AS ls FROM crawl_docs WHERE url IS NOT NULL AND body_text IS NOT NULL),
l AS (SELECT doc_id, site, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS raw FROM d),
n AS (SELECT doc_id, site, line_no, raw, lower(trim(regexp_replace(raw, '[ \\t\\r' || chr(160) || ']+', ' ', 'g'))) AS line FROM l),
p AS (SELECT site, count(DISTINCT doc_id) AS pages FROM d GROUP BY 1),
r AS (SELECT n.site, n.line FROM n JOIN p USING (site) WHERE line <> '' GROUP BY 1, 2, pages HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 100 >= 5 * pages)
"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p3_found, p3_restored, p4_found, p4_counts, p5_found, p5_articles, p6_found, p6_cleaned, p7_found, p7_kept, p8_ids, p9_packed, p10_found, p10_linked, p10_shared)
}
SQL = {
    "p4_found": TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_counts": TERMS + "SELECT field_name, term, n_occurrences, n_records, mark FROM m",
    "p7_found": RANKED + "SELECT doc_id FROM r, c WHERE site IS NOT NULL AND rn > c",
    "p7_kept": RANKED + "SELECT doc_id, site, authority FROM r, c WHERE site IS NULL OR rn <= c",
    "p6_found": LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN r USING (site, line)",
    "p6_cleaned": LINES
    + "SELECT c.doc_id, CASE WHEN c.body_text IS NULL THEN NULL WHEN c.url IS NULL THEN c.body_text ELSE coalesce(k.body_text, '') END AS body_text FROM crawl_docs c LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS body_text FROM n LEFT JOIN (SELECT site, line, 1 AS gone FROM r) USING (site, line) WHERE gone IS NULL GROUP BY 1) k USING (doc_id)",
}
