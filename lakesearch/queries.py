"""The queries of the search engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.functions import html, text, tokens, urls
from lakesearch.operators import authority, frontier, index, monitor, simhash
from lakesearch.operators.search import Index, Weights, as_json, external_filter, external_suggestions
from lakesearch.plans.query import parse
from lakesearch.sources import seeds
from lakesearch.sources.shared import materialize, scratch
from lakesearch.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The moment that decay is measured from: the end of 2025.
NOW = 1767225600.0


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL shared by several queries

STOP = ", ".join(f"'{w}'" for w in tokens.STOP_WORDS)
TRACK = ", ".join(f"'{k}'" for k in urls.TRACKING_KEYS)


def tokens_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z0-9]+(?:\\.[a-zA-Z0-9]+)*'), lambda t: lower(t)), lambda t: t NOT IN ({STOP}))"


def scheme_sql(u: str) -> str:
    return f"lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def authority_sql(u: str) -> str:
    return f"lower(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"


def path_sql(u: str) -> str:
    return f"regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def clean_query_sql(q: str) -> str:
    enc = "replace(url_encode(url_decode({})), '%20', '+')"
    name = "CASE WHEN instr(p, '=') > 0 THEN split_part(p, '=', 1) ELSE p END"
    value = "CASE WHEN instr(p, '=') > 0 THEN substr(p, instr(p, '=') + 1) ELSE '' END"
    return f"array_to_string(list_transform(list_filter(string_split({q}, '&'), lambda p: p <> '' AND lower(url_decode(split_part(p, '=', 1))) NOT IN ({TRACK})), lambda p: {enc.format(name)} || '=' || {enc.format(value)}), '&')"


def normal_sql(u: str) -> str:
    s, a, p = scheme_sql(u), authority_sql(u), path_sql(u)
    q = clean_query_sql(f"regexp_extract(trim({u}), '^[^?#]*\\?([^#]*)', 1)")
    return f"""CASE WHEN {s} IN ('http', 'https') THEN {s} || '://' || CASE WHEN {s} = 'http' THEN regexp_replace({a}, ':80$', '') ELSE regexp_replace({a}, ':443$', '') END
      || CASE WHEN {p} = '' THEN '/' WHEN {p} = '/' THEN {p} ELSE regexp_replace({p}, '/+$', '') END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END ELSE '' END"""


SKIP = "(" + "|".join(e.replace(".", "\\.") for e in urls.SKIP_ENDINGS) + ")$"
HOST = "regexp_replace(regexp_replace({a}, '^.*@', ''), ':[0-9]*$', '')".format(a=authority_sql("url"))

PAGES = f"""WITH src AS (SELECT *, concat_ws(chr(10), title, description, body_text) AS text FROM crawl_docs),
tok AS (SELECT *, {tokens_sql("text")} AS tokens FROM src WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10),
kept AS (SELECT *, list_filter(list_concat(coalesce(title_tokens, []), coalesce(desc_tokens, [])), lambda t: t IS NOT NULL AND t <> '') AS fields FROM tok WHERE len(tokens) >= 2),
place AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM kept),
field AS (SELECT doc_id, term, min(i) AS i FROM (SELECT doc_id, unnest(fields) AS term, unnest(range(len(fields))) AS i FROM kept) GROUP BY 1, 2),
extra AS (SELECT f.doc_id, f.term, len(k.tokens) + row_number() OVER (PARTITION BY f.doc_id ORDER BY f.i) - 1 AS pos
  FROM field f JOIN kept k USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM place p WHERE p.doc_id = f.doc_id AND p.term = f.term)),
occ AS (SELECT * FROM place UNION ALL SELECT * FROM extra),
post AS (SELECT term, doc_id, count(*) AS term_freq, list_sort(list(CAST(pos AS INTEGER))) AS positions FROM occ GROUP BY 1, 2)
"""

LIVE = """WITH post AS (SELECT term, doc_id, CAST(coalesce(max(term_freq), 1) AS BIGINT) AS term_freq, max(positions) AS positions
  FROM postings WHERE term <> '' AND doc_id IN (SELECT doc_id FROM crawl_docs) GROUP BY 1, 2),
len AS (SELECT doc_id, sum(term_freq) AS dl FROM post GROUP BY 1),
n AS (SELECT count(*) AS n FROM crawl_docs), stat AS (SELECT n, (SELECT sum(dl) FROM len)::DOUBLE / n AS avgdl FROM n)
"""


def bm25_sql(name: str, terms: list[str], within: str, boost: bool = True, auth: str = "0.35", decay: str = "1.0") -> str:
    """A CTE of (doc_id, score); `within` is a condition on doc_id d."""
    listed = ", ".join(f"('{t}')" for t in terms)
    fields = "* CASE WHEN coalesce(list_contains(c.title_tokens, p.term), false) THEN 2.5 ELSE 1.0 END::DOUBLE * CASE WHEN coalesce(list_contains(c.desc_tokens, p.term), false) THEN 1.5 ELSE 1.0 END::DOUBLE" if boost else ""
    return f"""{name} AS (SELECT p.doc_id, sum(ln((s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE) + 1) * p.term_freq * 2.5::DOUBLE / (p.term_freq + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.avgdl)) {fields})
      * (1 + {auth}::DOUBLE * coalesce(any_value(c.authority), 1.0::DOUBLE)) * {decay} AS score
    FROM (VALUES {listed}) AS q(term) JOIN post p USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY 1) f USING (term) JOIN len l ON l.doc_id = p.doc_id JOIN crawl_docs c ON c.doc_id = p.doc_id, stat s
    WHERE p.doc_id IN ({within}) GROUP BY p.doc_id)"""


def all_sql(terms: list[str]) -> str:
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT doc_id FROM post WHERE term IN ({inside}) GROUP BY 1 HAVING count(*) = {len(set(terms))}"


def phrase_sql(terms: list[str]) -> str:
    listed = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"SELECT doc_id FROM (SELECT p.doc_id, unnest(p.positions) AS pos, q.i FROM post p JOIN (VALUES {listed}) AS q(i, term) USING (term)) GROUP BY doc_id, pos - i HAVING count(*) = {len(terms)}"


#: (application, folder) -> where the index of its tables was saved.
_saved: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, folder: str) -> Index:
    """The index of a folder's tables: built and saved by term at the first use, opened by each query."""
    docs = table(spark, folder, "crawl_docs")
    key = (spark.sparkContext.applicationId, folder)
    if key not in _saved:
        path = scratch(spark, "index")
        post = materialize(index.live_postings(table(spark, folder, "postings"), docs), "live")
        index.save(spark, path, "v1", **Index(docs, post).tables())
        _saved[key] = path
    return Index.open(spark, _saved[key], docs)


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _pages(spark: SparkSession, folder: str, mixed: bool = False) -> DataFrame:
    """The pages with tokens: Latin ones as in PAGES, or of the whole text by the dictionary."""
    return index.assembled(table(spark, folder, "crawl_docs"), tokens.lexicon_words(table(spark, folder, "lexicon")) if mixed else None)


def _built(spark: SparkSession, folder: str, mixed: bool = False) -> DataFrame:
    return index.occurrences(_pages(spark, folder, mixed))


# --- URLs


@query(f"SELECT entry_id, url, {normal_sql('url')} AS norm FROM frontier")
def url_normalize(spark, folder):
    return table(spark, folder, "frontier").select("entry_id", "url", urls.normalize(F.col("url")).alias("norm"))


@query(f"SELECT entry_id, {clean_query_sql(chr(114) + 'egexp_extract(trim(url), ' + chr(39) + '^[^?#]*' + chr(92) + '?([^#]*)' + chr(39) + ', 1)')} AS clean FROM frontier")
def url_clean_query(spark, folder):
    return table(spark, folder, "frontier").select("entry_id", urls.clean_query(urls.query(F.col("url"))).alias("clean"))


@query(f"SELECT doc_id, md5({normal_sql('url')}) AS fp FROM crawl_docs WHERE url IS NOT NULL")
def url_fingerprint(spark, folder):
    return table(spark, folder, "crawl_docs").where("url is not null").select("doc_id", urls.fingerprint(urls.normalize(F.col("url"))).alias("fp"))


@query(f"SELECT doc_id, {authority_sql('url')} AS domain, {HOST} AS host FROM crawl_docs")
def url_domain(spark, folder):
    return table(spark, folder, "crawl_docs").select("doc_id", urls.authority(F.col("url")).alias("domain"), urls.host(F.col("url")).alias("host"))


@query(f"SELECT entry_id, ({scheme_sql('url')} NOT IN ('http', 'https') OR regexp_matches(lower({path_sql('url')}), '{SKIP}') OR length(url) > 70) AS skip FROM frontier")
def url_skip(spark, folder):
    return table(spark, folder, "frontier").select("entry_id", urls.should_skip(F.col("url"), 70).alias("skip"))


# --- HTML, from pages made of the documents' own fields


def _html(spark, folder):
    def safe(c):
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    docs = table(spark, folder, "crawl_docs").where("url is not null")
    links = F.array_join(F.transform(F.filter("outlinks", lambda x: x.isNotNull()), lambda x: F.concat(F.lit('<a href="'), safe(x), F.lit('">go</a>'))), " ")
    paragraphs = F.concat(F.lit("<p>"), F.array_join(F.transform(F.split("body_text", "\n"), safe), "</p><p>"), F.lit("</p>"))
    parts = ["<html><head><title>", safe(F.col("title")), '</title><meta name="Description" content="', safe(F.col("description")), '"></head><body><nav><a href="/menu">menu</a></nav><article>', F.coalesce(paragraphs, F.lit("")), "</article><div>", F.coalesce(links, F.lit("")), "</div></body></html>"]
    page = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return html.parsed(docs.select("doc_id", "url", page.alias("html")))


WHITE = r"[\x{9}-\x{d}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


@query(f"SELECT doc_id, substr({strip_sql(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}, 1, 200) AS title, substr({strip_sql('coalesce(description, ' + chr(39) * 2 + ')')}, 1, 500) AS description FROM crawl_docs WHERE url IS NOT NULL")
def page_title(spark, folder):
    return _html(spark, folder).select("doc_id", "page.title", "page.description")


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(body_text, ''), chr(10)), lambda x: {strip_sql("x")}), lambda x: length(x) > 1) AS ls, list_transform(list_filter(coalesce(outlinks, []), lambda x: x IS NOT NULL), lambda x: 'go') AS go FROM crawl_docs WHERE url IS NOT NULL),
    t AS (SELECT *, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS n, list_filter(ls, lambda x: length(x) >= 20) AS blocks FROM l)
    SELECT doc_id, substr(array_to_string(CASE WHEN n >= 100 THEN ls WHEN len(blocks) >= 2 THEN blocks ELSE list_concat(ls, go) END, chr(10)), 1, 50000) AS body_text FROM t"""
)
def page_article_text(spark, folder):
    # every page: short articles take the text of their blocks, and those of fewer than two blocks the whole body
    return _html(spark, folder).select("doc_id", "page.body_text")


@query("SELECT doc_id, url AS page_url, link FROM (SELECT doc_id, url, unnest(list_distinct(outlinks)) AS link FROM crawl_docs WHERE url IS NOT NULL) WHERE link <> '' AND length(link) <= 2048 AND link LIKE 'http%'")
def page_links(spark, folder):
    rows = _html(spark, folder).select("doc_id", F.col("url").alias("page_url"), F.explode("page.links").alias("l"))
    return rows.select("doc_id", "page_url", F.col("l.url").alias("link"))


# --- tokens and index


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def tokenize_terms(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tokens.latin_tokens(F.col("text")).alias("tokens"))


@query()
def segment_mixed(spark, folder):
    words = tokens.lexicon_words(table(spark, folder, "lexicon"))
    whole = F.concat_ws("\n", "title", "description", "body_text")
    return tokens.segmented(table(spark, folder, "crawl_docs").select("doc_id", whole.alias("text")), "text", "tokens", words).select("doc_id", "tokens")


@query(PAGES + "SELECT term, doc_id, term_freq, positions FROM post")
def postings_build(spark, folder):
    return index.postings(_built(spark, folder))


@query(PAGES + "SELECT doc_id, CAST(sum(term_freq) AS BIGINT) AS doc_length FROM post GROUP BY 1")
def doc_length(spark, folder):
    return index.doc_lengths(index.postings(_built(spark, folder)))


@query(PAGES + ", m AS (SELECT term, doc_id, min(pos) AS pos FROM occ GROUP BY 1, 2) SELECT term, count(*) AS df, min(doc_id) AS first_doc, CAST(arg_min(pos, doc_id) AS INTEGER) AS first_pos FROM m GROUP BY 1")
def term_stats(spark, folder):
    return index.term_stats(_built(spark, folder))


@query(PAGES + "SELECT (SELECT count(*) FROM kept) AS total_docs, count(DISTINCT term) AS vocabulary_size, printf('%.1f', sum(term_freq)::DOUBLE / (SELECT count(*) FROM kept)) AS avg_doc_length, CAST(sum(term_freq) AS BIGINT) AS total_word_count FROM post")
def corpus_stats(spark, folder):
    docs = _pages(spark, folder)
    return index.corpus_stats(docs, index.postings(index.occurrences(docs)))


# the same of whole pages, Chinese text by the dictionary; DuckDB can't segment, so these have no SQL


@query()
def postings_mixed(spark, folder):
    return index.postings(_built(spark, folder, mixed=True))


@query()
def doc_length_mixed(spark, folder):
    return index.doc_lengths(index.postings(_built(spark, folder, mixed=True)))


@query()
def term_stats_mixed(spark, folder):
    return index.term_stats(_built(spark, folder, mixed=True))


@query()
def corpus_stats_mixed(spark, folder):
    # segmented once: the pages and the postings are both counted
    docs = materialize(_pages(spark, folder, mixed=True).select("doc_id", "tokens", "title_tokens", "desc_tokens"), "pages")
    return index.corpus_stats(docs, index.postings(index.occurrences(docs)))


@query(LIVE + "SELECT term, doc_id, term_freq FROM post WHERE doc_id NOT IN (SELECT doc_id FROM crawl_docs WHERE title IS NULL)")
def delete_doc(spark, folder):
    gone = table(spark, folder, "crawl_docs").where("title is null")
    return index.without(_index(spark, folder).post, gone).select("term", "doc_id", "term_freq")


@query("SELECT doc_id, url, title FROM crawl_docs ORDER BY doc_id DESC LIMIT 20 OFFSET 20")
def list_docs(spark, folder):
    return index.listed(table(spark, folder, "crawl_docs").select("doc_id", "url", "title"), 2, 20)


@query(f"WITH k AS (SELECT doc_id, CASE WHEN url IS NOT NULL THEN {normal_sql('url')} END AS norm, fetch_time FROM crawl_docs) SELECT doc_id, norm FROM (SELECT * FROM k WHERE norm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY norm ORDER BY fetch_time DESC NULLS LAST, doc_id DESC) = 1) UNION ALL SELECT doc_id, norm FROM k WHERE norm IS NULL")
def upsert_by_url(spark, folder):
    docs = table(spark, folder, "crawl_docs").select("doc_id", F.when(F.col("url").isNotNull(), urls.normalize(F.col("url"))).alias("norm"), "fetch_time")
    return index.upsert(docs, F.col("norm"), [F.col("fetch_time"), F.col("doc_id")]).select("doc_id", "norm")


@query("WITH k AS (SELECT doc_id AS old_id, CASE WHEN title IS NULL THEN NULL ELSE doc_id END AS doc_id, fetch_time FROM crawl_docs) SELECT old_id, doc_id FROM k WHERE doc_id IS NOT NULL UNION ALL SELECT old_id, row_number() OVER (ORDER BY fetch_time NULLS FIRST, old_id) + (SELECT max(doc_id) FROM k) AS doc_id FROM k WHERE doc_id IS NULL")
def assign_ids(spark, folder):
    docs = table(spark, folder, "crawl_docs").select(F.col("doc_id").alias("old_id"), F.when(F.col("title").isNotNull(), F.col("doc_id")).alias("doc_id"), "fetch_time")
    return index.with_ids(docs, [F.col("fetch_time"), F.col("old_id")]).select("old_id", "doc_id")


@query("WITH o AS (SELECT * FROM crawl_docs WHERE doc_id % 2 = 0), n AS (SELECT * FROM crawl_docs WHERE doc_id % 2 = 1) SELECT doc_id, url FROM o WHERE url IS NULL OR url NOT IN (SELECT url FROM n WHERE url IS NOT NULL) UNION ALL SELECT doc_id, url FROM n")
def index_merge(spark, folder):
    # a saved index of one half of the pages, then the other half merged into it
    docs, path = table(spark, folder, "crawl_docs"), scratch(spark, "merged")
    post = materialize(index.live_postings(table(spark, folder, "postings"), docs), "live")
    for version, odd in (("v1", 0), ("v2", 1)):
        half = docs.where(F.col("doc_id") % 2 == odd)
        index.merged(spark, path, version, half, post.join(half.select("doc_id"), "doc_id", "left_semi").select(*post.columns))
    return index.load(spark, path, "documents").select("doc_id", "url")


@query("SELECT doc_id, url, title FROM crawl_docs WHERE doc_id = 7")
def get_document(spark, folder):
    return index.document(table(spark, folder, "crawl_docs").select("doc_id", "url", "title"), 7)


# --- near-duplicates

PRINTS = """WITH t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_concat(coalesce(title_tokens, []), coalesce(desc_tokens, []))) AS term FROM crawl_docs) WHERE term <> ''),
h AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(term), 9, 8) AS BIGINT) AS lo FROM t),
b AS (SELECT doc_id, i, 2 * sum((hi >> i) & 1) > count(*) AS top, 2 * sum((lo >> i) & 1) > count(*) AS low FROM h, range(32) r(i) GROUP BY 1, 2),
v AS (SELECT doc_id, CAST(sum(CASE WHEN top THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN low THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS lo FROM b GROUP BY 1),
s AS (SELECT doc_id, hi, lo, CASE WHEN hi >= 2147483648 THEN (hi - 4294967296) * 4294967296 + lo ELSE hi * 4294967296 + lo END AS simhash FROM v)
"""


def _prints(spark, folder):
    docs = table(spark, folder, "crawl_docs")
    fields = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("title_tokens", "desc_tokens")])
    return simhash.fingerprints(docs.select("doc_id", F.explode(fields).alias("term")).where("term <> ''"))


@query(PRINTS + "SELECT doc_id, simhash FROM s")
def simhash_docs(spark, folder):
    return _prints(spark, folder)


# each fingerprint stands beside a copy in which up to four bits are turned
TURNED = PRINTS + """, m AS (SELECT doc_id, """ + ", ".join(
    "CAST(" + " + ".join(f"CASE WHEN {j} < doc_id % 5 AND (doc_id * 13 + {17 * j}) % 64 {op} THEN 1::BIGINT << CAST((doc_id * 13 + {17 * j}) % 64{less} AS INTEGER) ELSE 0 END" for j in range(4)) + f" AS BIGINT) AS {name}"
    for name, op, less in (("mh", ">= 32", " - 32"), ("ml", "< 32", ""))
) + """ FROM s), w AS (SELECT doc_id, hi, lo FROM s UNION ALL SELECT s.doc_id + 1000000000, xor(hi, mh), xor(lo, ml) FROM s JOIN m USING (doc_id) WHERE simhash <> 0),
c AS (SELECT hi, lo, min(doc_id) AS id FROM w WHERE hi <> 0 OR lo <> 0 GROUP BY 1, 2) """


def _turned(spark, folder):
    rows = materialize(_prints(spark, folder), "prints")
    flips = F.lit(0).cast("bigint")
    for j in range(4):
        bit = F.expr(f"shiftleft(1L, cast((doc_id * 13 + {17 * j}) % 64 as int))")
        flips = flips.bitwiseXOR(F.when(F.lit(j) < F.col("doc_id") % 5, bit).otherwise(F.lit(0).cast("bigint")))
    copies = rows.where("simhash <> 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.col("simhash").bitwiseXOR(flips).alias("simhash"))
    return rows.unionByName(copies)


@query(TURNED + "SELECT a.id AS class_a, b.id AS class_b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM c a JOIN c b ON a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3")
def hamming_pairs(spark, folder):
    return simhash.near_classes(_turned(spark, folder))[1]


@query(PRINTS + ", c AS (SELECT simhash, min(doc_id) AS id FROM s WHERE simhash <> 0 GROUP BY 1) SELECT doc_id, id AS class_id FROM s JOIN c USING (simhash)")
def hamming_members(spark, folder):
    return simhash.near_classes(materialize(_prints(spark, folder), "prints"))[0]


@query()
def duplicate_gate(spark, folder):
    return simhash.kept(materialize(_turned(spark, folder), "turned"))


# --- links

EDGES = """WITH RECURSIVE tgt AS (SELECT url AS link, max(doc_id) AS dst FROM crawl_docs WHERE url IS NOT NULL GROUP BY 1),
e AS MATERIALIZED (SELECT DISTINCT doc_id AS src, dst FROM (SELECT doc_id, unnest(outlinks) AS link FROM crawl_docs) JOIN tgt USING (link) WHERE doc_id <> dst),
"""
RANKS = EDGES + """deg AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM crawl_docs),
r0 AS MATERIALIZED (SELECT doc_id, 1.0::DOUBLE / n AS rank FROM crawl_docs, n)""" + "".join(
    f""", r{i} AS MATERIALIZED (SELECT r.doc_id, 0.15::DOUBLE / n.n + 0.85::DOUBLE / n.n * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE doc_id NOT IN (SELECT src FROM deg)) + 0.85::DOUBLE * coalesce(g.got, 0) AS rank
    FROM r{i - 1} r LEFT JOIN (SELECT dst, sum(rank / d) AS got FROM e JOIN deg USING (src) JOIN r{i - 1} ON doc_id = src GROUP BY 1) g ON g.dst = r.doc_id, n)""" for i in range(1, 16)
)


@query(EDGES + "x AS (SELECT 1) SELECT src, dst FROM e")
def edges_resolve(spark, folder):
    return authority.edges(table(spark, folder, "crawl_docs"))


def _ranks(spark, folder):
    docs = table(spark, folder, "crawl_docs")
    return authority.pagerank(docs.select("doc_id"), authority.edges(docs))


@query(RANKS + " SELECT doc_id, round(rank, 9) AS rank FROM r15")
def pagerank(spark, folder):
    return _ranks(spark, folder).select("doc_id", F.round("rank", 9).alias("rank"))


@query(RANKS + " SELECT doc_id, round((rank - (SELECT min(rank) FROM r15)) / ((SELECT max(rank) FROM r15) - (SELECT min(rank) FROM r15)), 6) AS authority FROM r15")
def authority_normalize(spark, folder):
    return authority.normalized(_ranks(spark, folder))


@query(RANKS + ", a AS (SELECT round((rank - (SELECT min(rank) FROM r15)) / ((SELECT max(rank) FROM r15) - (SELECT min(rank) FROM r15)), 6) AS authority FROM r15) SELECT count(*) AS docs, max(authority) AS example_max, min(authority) AS example_min FROM a")
def authority_summary(spark, folder):
    docs = table(spark, folder, "crawl_docs")
    return authority.written_back(docs, _ranks(spark, folder))[1]


@query(RANKS + " SELECT doc_id, url, round((rank - (SELECT min(rank) FROM r15)) / ((SELECT max(rank) FROM r15) - (SELECT min(rank) FROM r15)), 6) AS authority FROM r15 JOIN crawl_docs USING (doc_id)")
def authority_rebuilt(spark, folder):
    return authority.rebuilt(table(spark, folder, "crawl_docs"), "managed").select("doc_id", "url", "authority")


# --- retrieval and ranking

TWO = ["guide", "harbour"]


@query(LIVE + f"SELECT doc_id FROM ({all_sql(['also', 'known'])})")
def and_group(spark, folder):
    return _index(spark, folder).having_all(["also", "known"])


@query(LIVE + f"SELECT DISTINCT doc_id FROM ({all_sql(['also', 'known'])} UNION {all_sql(['harbour'])})")
def or_groups(spark, folder):
    return _index(spark, folder).candidates(parse("also known OR harbour"))


@query(LIVE + f"SELECT doc_id FROM ({all_sql(['guide'])}) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term IN ('harbour', 'maps'))")
def exclude_terms(spark, folder):
    return _index(spark, folder).filtered(parse("guide -harbour -maps"))


@query(LIVE + f"SELECT DISTINCT doc_id FROM ({phrase_sql(['also', 'known'])})")
def phrase_search(spark, folder):
    return _index(spark, folder).having_phrase(["also", "known"])


@query(r"SELECT doc_id, url FROM crawl_docs WHERE lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) = 'munport-journal.example' OR lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) LIKE '%.munport-journal.example'")
def site_filter(spark, folder):
    found = _index(spark, folder).filtered(parse("site:munport-journal.example"))
    return table(spark, folder, "crawl_docs").select("doc_id", "url").join(found, "doc_id")


@query("SELECT doc_id FROM crawl_docs WHERE contains(url, '/archive/')")
def inurl_filter(spark, folder):
    return _index(spark, folder).filtered(parse("inurl:/archive/"))


@query("SELECT doc_id FROM crawl_docs WHERE list_contains(title_tokens, 'harbour')")
def intitle_filter(spark, folder):
    return _index(spark, folder).filtered(parse("intitle:harbour"))


@query(f"SELECT doc_id FROM crawl_docs WHERE {HOST} = 'munport-journal.example' AND contains(lower(title), 'guide') AND contains(lower(url), 'archive')")
def external_filters(spark, folder):
    return external_filter(table(spark, folder, "crawl_docs"), "munport-journal.example", "Guide", "ARCHIVE").select("doc_id")


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM crawl_docs")
def all_docs_desc(spark, folder):
    return _index(spark, folder).ranked(parse("the"))


@query(LIVE + ", " + bm25_sql("b", TWO, "SELECT doc_id FROM post", False, "0.0") + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, folder):
    i = _index(spark, folder)
    return _scored(i.scores(TWO, i.docs.select("doc_id"), Weights(title=1.0, description=1.0, authority=0.0)).orderBy(F.desc("score"), "doc_id").limit(20))


@query(LIVE + ", " + bm25_sql("b", TWO, "SELECT doc_id FROM post", True, "0.0") + " SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_field_boost(spark, folder):
    i = _index(spark, folder)
    return _scored(i.scores(TWO, i.docs.select("doc_id"), Weights(authority=0.0)))


@query(LIVE + ", " + bm25_sql("b", ["guide"], all_sql(["guide"])) + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 1000")
def bm25_authority(spark, folder):
    return _scored(_index(spark, folder).ranked(parse("guide")))


DECAY = f"any_value(CASE WHEN coalesce(c.fetch_time, 0) <> 0 THEN greatest(0.5::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + ({NOW}::DOUBLE - c.fetch_time) / 86400.0::DOUBLE / 365.0::DOUBLE)) ELSE 1.0::DOUBLE END)"


@query(LIVE + ", " + bm25_sql("b", ["guide"], all_sql(["guide"]), decay=DECAY) + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 1000")
def bm25_time_decay(spark, folder):
    return _scored(_index(spark, folder).ranked(parse("guide"), Weights(decay_days=365.0), NOW))


@query(
    LIVE + f", ph AS ({phrase_sql(['also', 'known'])}), " + bm25_sql("a", ["also", "known"], "SELECT doc_id FROM ph") + " SELECT doc_id, round(2 * a.score, 6) AS score FROM a ORDER BY a.score DESC, doc_id LIMIT 1000"
)
def phrase_bonus(spark, folder):
    # the phrase is the only content: its documents get the score of its terms and the bonus of the same amount
    return _scored(_index(spark, folder).ranked(parse('"also known"')))


@query(LIVE + ", " + bm25_sql("b", ["notes"], all_sql(["notes"])) + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10 OFFSET 10")
def paged_results(spark, folder):
    return _scored(_index(spark, folder).results(parse("notes"), 2, 10))


@query()
def results_json(spark, folder):
    return as_json(_index(spark, folder).results(parse("guide -maps"), 1, 20))


@query(LIVE + "SELECT doc_id, term_freq, positions FROM post WHERE term = 'harbour'")
def postings_lookup(spark, folder):
    return _index(spark, folder).postings_of("harbour")


@query(LIVE + "SELECT CAST(dl AS BIGINT) AS doc_length FROM len WHERE doc_id = 3")
def length_lookup(spark, folder):
    return _index(spark, folder).length_of(3)


# --- snippets, suggestions, corrections

SNIP = """WITH t AS (SELECT doc_id, body_text AS x, lower(body_text) AS low FROM crawl_docs), p AS (SELECT *, least(nullif(instr(low, 'known'), 0), nullif(instr(low, 'guide'), 0)) AS loc FROM t), s AS (SELECT *, greatest(0, loc - 1 - 100) AS st FROM p), e AS (SELECT *, least(length(x), st + 200) AS en FROM s), w AS
(SELECT doc_id, CASE WHEN coalesce(x, '') = '' THEN '' WHEN loc IS NULL THEN substr(x, 1, 200) ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || substr(x, st + 1, 200) || CASE WHEN en < length(x) THEN '...' ELSE '' END END AS cut FROM e) """


@query(SNIP + "SELECT doc_id, cut FROM w")
def snippet(spark, folder):
    return table(spark, folder, "crawl_docs").select("doc_id", text.snippet_window(F.col("body_text"), ["known", "guide"]).alias("cut"))


@query(SNIP + "SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(cut, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), 'known', '<b>known</b>', 'gi'), 'guide', '<b>guide</b>', 'gi') AS marked FROM w")
def highlight(spark, folder):
    cut = text.snippet_window(F.col("body_text"), ["known", "guide"])
    return table(spark, folder, "crawl_docs").select("doc_id", text.highlighted(cut, ["known", "guide"]).alias("marked"))


VOCAB = LIVE + ", v AS (SELECT term, count(*) AS df, min(doc_id) AS first_doc, arg_min(coalesce(list_min(positions), 0), doc_id) AS first_pos FROM post GROUP BY 1)"


def _vocabulary(spark, folder):
    return materialize(_index(spark, folder).vocabulary(), "vocabulary")


@query(VOCAB + " SELECT term, df FROM v WHERE term LIKE 'ha%' ORDER BY df DESC, term LIMIT 8")
def suggest_prefix(spark, folder):
    return text.suggestions(_vocabulary(spark, folder), "Ha ")


# every title word of ASCII letters and digits, its third character changed (DuckDB's distance counts bytes)
WRONG = "(SELECT DISTINCT CASE WHEN length(term) > 2 THEN substr(term, 1, 2) || 'x' || substr(term, 4) ELSE term || 'x' END AS word FROM (SELECT unnest(title_tokens) AS term FROM crawl_docs) WHERE regexp_full_match(term, '[a-z0-9]+'))"


def _words(spark, folder):
    t = table(spark, folder, "crawl_docs").select(F.explode("title_tokens").alias("term")).where(F.col("term").rlike("^[a-z0-9]+$"))
    return t.select(F.expr("case when length(term) > 2 then concat(substr(term, 1, 2), 'x', substr(term, 4)) else concat(term, 'x') end").alias("word")).distinct()


@query(VOCAB + f" SELECT word, term FROM (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), first_doc, first_pos) AS k FROM {WRONG} w JOIN v ON abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 2) WHERE k = 1")
def nearest_term(spark, folder):
    return text.nearest(_words(spark, folder), _vocabulary(spark, folder))


@query(
    VOCAB + f""", q AS (SELECT w.word AS query_id, unnest(['guide', w.word]) AS word, unnest([0, 1]) AS loc FROM {WRONG} w), k AS (SELECT q.*, CASE WHEN v.term IS NOT NULL THEN q.word ELSE coalesce((SELECT arg_min(x.term, (levenshtein(q.word, x.term), x.first_doc, x.first_pos)) FROM v x WHERE abs(length(q.word) - length(x.term)) <= 2 AND levenshtein(q.word, x.term) <= 2), q.word) END AS token FROM q LEFT JOIN v ON v.term = q.word)
    SELECT query_id, CASE WHEN bool_or(token <> word) THEN string_agg(token, ' ' ORDER BY loc) END AS corrected FROM k GROUP BY 1"""
)
def correct_query(spark, folder):
    q = _words(spark, folder).select(F.col("word").alias("query_id"), F.array(F.lit("guide"), "word").alias("tokens"))
    return text.corrected(q, _vocabulary(spark, folder))


@query(
    VOCAB + f""", found AS (SELECT 'guide' AS query, count(*) AS total FROM ({all_sql(['guide'])}) UNION ALL SELECT 'guide -maps', count(*) FROM ({all_sql(['guide'])}) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'maps') UNION ALL SELECT 'guxde', count(*) FROM ({all_sql(['guxde'])}))
    SELECT query, least(total, 1000) AS total, CASE WHEN total = 0 THEN (SELECT arg_min(term, (levenshtein(query, term), first_doc, first_pos)) FROM v WHERE levenshtein(query, term) <= 2) END AS suggestion FROM found"""
)
def search_totals(spark, folder):
    i = _index(spark, folder)
    return reduce(DataFrame.union, [i.answer(q).select("query", "total", "suggestion") for q in ("guide", "guide -maps", "guxde")])


@query("WITH t AS (SELECT doc_id AS rank, unnest(title_tokens) AS term, unnest(range(len(title_tokens))) AS loc FROM crawl_docs) SELECT term FROM t WHERE starts_with(term, 'ha') GROUP BY term ORDER BY min((rank, loc)) LIMIT 8")
def external_suggest(spark, folder):
    return external_suggestions(table(spark, folder, "crawl_docs").select(F.col("doc_id").alias("rank"), "title_tokens"), "Ha")


# --- frontier, fetches, tasks


def _entries(spark, folder):
    return frontier.accepted(table(spark, folder, "frontier"))


FRONT = f"""WITH a AS (SELECT *, {normal_sql('url')} AS norm FROM frontier), b AS (SELECT * FROM a WHERE norm <> '' AND NOT regexp_matches(lower({path_sql('norm')}), '{SKIP}') AND length(norm) <= 2048 AND coalesce(depth, 0) <= 5),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY norm ORDER BY coalesce(priority, 1e9), entry_id, queued_at, url) = 1) """


def _order():
    return [F.coalesce("priority", F.lit(1e9)), F.col("entry_id"), F.col("queued_at"), F.col("url")]


def _fresh(spark, folder, seen=None):
    return frontier.fresh(_entries(spark, folder), _order(), seen)


@query(FRONT + "SELECT entry_id, norm, md5(norm) AS fp FROM f")
def frontier_dedup(spark, folder):
    return _fresh(spark, folder).select("entry_id", "norm", "fp")


@query(FRONT + f"SELECT entry_id, norm FROM f WHERE norm NOT IN (SELECT {normal_sql('url')} FROM crawl_docs WHERE url IS NOT NULL)")
def frontier_unseen(spark, folder):
    seen = table(spark, folder, "crawl_docs").where("url is not null").select(urls.fingerprint(urls.normalize(F.col("url"))).alias("fp")).distinct()
    return _fresh(spark, folder, seen).select("entry_id", "norm")


@query(FRONT + "SELECT entry_id, domain, row_number() OVER (PARTITION BY domain ORDER BY coalesce(priority, 1e9), entry_id) - 1 AS slot, (row_number() OVER (PARTITION BY domain ORDER BY coalesce(priority, 1e9), entry_id) - 1)::DOUBLE AS start_s FROM f")
def frontier_schedule(spark, folder):
    return frontier.scheduled(_fresh(spark, folder), _order()[:2]).select("entry_id", "domain", "slot", "start_s")


@query(FRONT + "SELECT entry_id, norm FROM f ORDER BY coalesce(priority, 1e9), entry_id LIMIT 500")
def frontier_wave(spark, folder):
    return frontier.wave(_fresh(spark, folder), _order()[:2], 500).select("entry_id", "norm")


@query("SELECT domain, count(*) AS n FROM frontier GROUP BY 1 ORDER BY n DESC, domain LIMIT 30")
def domain_counts(spark, folder):
    return frontier.domain_counts(table(spark, folder, "frontier"))


@query("SELECT entry_id, url, substr(anchor_text, 1, 40) AS anchor FROM frontier ORDER BY priority NULLS LAST, entry_id, queued_at, url LIMIT 200")
def queue_sample(spark, folder):
    rows = table(spark, folder, "frontier").orderBy(F.asc_nulls_last("priority"), "entry_id", "queued_at", "url").limit(200)
    return rows.select("entry_id", "url", F.substring("anchor_text", 1, 40).alias("anchor"))


@query("SELECT url AS referer, unnest(outlinks) AS url, 1 AS depth FROM crawl_docs")
def frontier_children(spark, folder):
    docs = table(spark, folder, "crawl_docs").withColumn("depth", F.lit(0))
    return frontier.children(docs, 1).select("referer", "url", "depth")


SQL["frontier_children"] = "SELECT * FROM (SELECT url AS referer, unnest(outlinks) AS url, 1 AS depth FROM crawl_docs) WHERE url <> ''"


@query("SELECT fetch_id, url, arrived_at FROM fetches WHERE status = 200 AND coalesce(error, '') = '' AND (content_type IS NULL OR lower(trim(split_part(content_type, ';', 1))) IN ('', 'text/html', 'text/plain', 'application/xhtml+xml')) AND coalesce(body_bytes, 0) <= 5242880")
def fetch_accept(spark, folder):
    return frontier.usable_fetches(table(spark, folder, "fetches")).select("fetch_id", "url", "arrived_at")


@query("WITH f AS (SELECT DISTINCT ON (fetch_id) * FROM fetches) SELECT CASE WHEN status IS NULL THEN 'none' ELSE CAST(floor(status / 100) AS INTEGER)::VARCHAR || 'xx' END AS status_class, count(*) AS n, CAST(sum(CASE WHEN coalesce(error, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, round(sum(body_bytes) / 1e6, 3) AS mb FROM f GROUP BY 1")
def fetch_counters(spark, folder):
    return monitor.counters(table(spark, folder, "fetches"))


@query("WITH f AS (SELECT DISTINCT ON (fetch_id) *, lower(coalesce(error, '')) AS e FROM fetches), g AS (SELECT *, coalesce(status = 200 AND e = '', false) AS fine FROM f) SELECT count(*) AS requests, count(*) FILTER (fine) AS success, count(*) FILTER (NOT fine AND NOT contains(e, 'robots')) AS errors, count(*) FILTER (contains(e, 'robots')) AS robots_blocked FROM g")
def download_counters(spark, folder):
    return monitor.downloads(table(spark, folder, "fetches"))


@query("SELECT doc_id, fetch_time FROM crawl_docs ORDER BY fetch_time DESC NULLS LAST, doc_id DESC LIMIT 50")
def recent_crawls(spark, folder):
    return monitor.recent(table(spark, folder, "crawl_docs").select("doc_id", "fetch_time"), [F.desc_nulls_last("fetch_time"), F.desc("doc_id")])


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def trend_window(spark, folder):
    return monitor.trend(table(spark, folder, "events"), "ts", 10, "event_type")


@query("SELECT id, status, round(s, 3) AS seconds, round(crawled / nullif(s, 0), 6) AS rate FROM (SELECT *, coalesce(duration, date_diff('microsecond', started_at, finished_at) / 1e6) AS s FROM tasks)")
def task_rates(spark, folder):
    return monitor.task_rates(table(spark, folder, "tasks"))


@query("SELECT id, status, crawled, errors FROM tasks ORDER BY started_at DESC, id LIMIT 100")
def task_history(spark, folder):
    return monitor.task_history(table(spark, folder, "tasks")).select("id", "status", "crawled", "errors")


@query("SELECT id, status, crawled FROM tasks ORDER BY started_at DESC, id LIMIT 40")
def task_record(spark, folder):
    # the finished tasks as the history, the others recorded in front of it
    tasks = table(spark, folder, "tasks").select("id", "status", "crawled", "started_at")
    return monitor.recorded(tasks.where("status = 'finished'"), tasks.where("status <> 'finished'"), 40).select("id", "status", "crawled")


@query("SELECT DISTINCT url FROM (SELECT unnest(CAST(json_extract_string(params, '$.seeds[*]') AS VARCHAR[])) AS url FROM tasks) WHERE url LIKE 'http://%' OR url LIKE 'https://%'")
def seed_store(spark, folder):
    # the seeds of finished tasks stored, those of the others typed in as one text and added
    found = table(spark, folder, "tasks").select("status", F.from_json("params", "seeds array<string>")["seeds"].alias("seeds"))
    path = scratch(spark, "seeds")
    seeds.save_store(found.where("status = 'finished'").select(F.explode("seeds").alias("url")), path)
    typed = found.where("status <> 'finished'").select(F.explode(seeds.split_seeds(F.array_join("seeds", " ,\n"))).alias("url"))
    return seeds.added(seeds.load_store(spark, path), typed)


@query("SELECT DISTINCT url FROM (SELECT unnest(CAST(json_extract_string(params, '$.seeds[*]') AS VARCHAR[])) AS url FROM tasks) WHERE url NOT IN (SELECT url FROM (SELECT unnest(CAST(json_extract_string(params, '$.seeds[*]') AS VARCHAR[])) AS url FROM tasks WHERE status = 'error'))")
def seed_remove(spark, folder):
    tasks = table(spark, folder, "tasks").select("status", F.explode(F.from_json("params", "seeds array<string>")["seeds"]).alias("url"))
    return seeds.removed(tasks, tasks.where("status = 'error'"))
