"""Lines repeated over one site's pages.

The texts are read once: each page becomes an array of hashes, one for each line, in the shared folder. Three passes over
those, none of which groups a site's rows in one task:
1. per site a mergeable frequent-items summary of line hashes (kept in the JVM, combined map-side);
2. exact page counts of the summary's candidates only;
3. the confirmed (site, hash) pairs mark or remove the lines.

Lines of one site are told apart by 64-bit hashes. What is joined is written first and carries no broadcast hint, so that
Spark broadcasts it only below its threshold in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.sources.shared import materialize

#: Counters of a site's summary. Its error is at most ERROR_FACTOR * (lines of the site) / TRACKED.
TRACKED = 16384
ERROR_FACTOR = 3.5


def normal_line(line: Column) -> Column:
    """Runs of blanks, tabs, carriage returns and no-break spaces as one blank, ends trimmed, letters lowered."""
    return F.lower(F.trim(F.regexp_replace(line, "[ \\t\\r\\u00A0]+", " ")))


def line_hash(line: Column) -> Column:
    """Hash of a normalised line, null for a blank one."""
    return F.transform(F.array(normal_line(line)), lambda x: F.when(x != "", F.xxhash64(x)))[0]


def hashed(df: DataFrame, record: str, site: Column, body: str) -> DataFrame:
    """(record, site, lines): the line hashes of each page with record, site and body, in order, null for blank lines."""
    rows = df.select(F.col(record).alias("record"), site.alias("site"), F.col(body).alias("body")).where("record is not null and site is not null and body is not null")
    return materialize(rows.select("record", "site", F.transform(F.split("body", "\n"), line_hash).alias("lines")), "lines")


def repeated(pages: DataFrame, least_pages: int = 4, percent: int = 5) -> DataFrame:
    """(site, h, n_pages) of the lines of `hashed` pages in at least `least_pages` pages and `percent` of their site's.

    The summary never misses such a line while its error stays below the limit; sites of so many lines a page that it
    might not (checked per site from exact sums) are counted exactly as a whole instead.
    """
    distinct = F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))
    sites = pages.groupBy("site").agg(F.countDistinct("record").alias("pages"), F.sum(F.size(distinct)).alias("n_lines"))
    # a site of fewer pages can have no such line
    sites = materialize(sites.where(F.col("pages") >= least_pages), "sites")
    entries = pages.join(sites.select("site"), "site", "left_semi").select("record", "site", F.explode(distinct).alias("h"))
    summary = entries.groupBy("site").agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("summary"))
    limit = F.greatest(F.lit(least_pages).cast("double"), F.col("pages") * F.lit(percent / 100))
    sure = F.col("n_lines") * F.lit(ERROR_FACTOR / TRACKED) < limit
    known = summary.join(sites.where(sure), "site").select("site", limit.alias("limit"), F.explode(F.expr(f"approx_top_k_estimate(summary, {TRACKED})")).alias("x"))
    # estimates are upper bounds, so a line at the limit always stays
    candidates = materialize(known.where("x.count >= limit - 1e-6").select("site", F.col("x.item").alias("h")), "candidates")
    checked = entries.join(candidates, ["site", "h"], "left_semi")
    if sites.where(~sure).limit(1).count():
        checked = checked.unionByName(entries.join(sites.where(~sure).select("site"), "site", "left_semi"))
    exact = checked.groupBy("site", "h", "record").agg(F.lit(1).alias("one")).groupBy("site", "h").agg(F.count("one").alias("n_pages"))
    return exact.join(sites, "site").where((F.col("n_pages") >= least_pages) & (F.col("n_pages") * 100 >= F.col("pages") * percent)).select("site", "h", "n_pages")


def found(df: DataFrame, record: str, site: Column, body: str, **limits: int) -> DataFrame:
    """(record, line_no) of every line that `repeated` confirms; lines count from 1, blank ones included."""
    pages = hashed(df, record, site, body)
    confirmed = materialize(repeated(pages, **limits).select("site", "h"), "confirmed")
    rows = pages.select("record", "site", F.posexplode("lines").alias("at", "h")).where("h is not null")
    return rows.join(confirmed, ["site", "h"], "left_semi").select("record", (F.col("at") + 1).alias("line_no"))


def cleaned(df: DataFrame, record: str, site: Column, body: str, **limits: int) -> DataFrame:
    """(record, body) with the confirmed lines taken out; records without url or body come out as they are.

    Lines and their order are otherwise kept, blank lines too. Confirmed lines reach a page as its site's array of hashes,
    whose size is bounded: a site has at most (lines a page) * 100 / percent of them.
    """
    confirmed = repeated(hashed(df, record, site, body), **limits).groupBy(F.col("site").alias("_site")).agg(F.collect_set("h").alias("_gone"))
    rows = df.select(F.col(record), site.alias("_site"), F.col(body)).join(materialize(confirmed, "confirmed"), "_site", "left")
    kept = F.filter(F.split(F.col(body), "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("_gone"), line_hash(x)), F.lit(False)))
    return rows.select(record, F.when(F.col("_gone").isNull(), F.col(body)).otherwise(F.array_join(kept, "\n")).alias(body))
