from lakesearch import queries

LONG = "A paragraph of the article that is clearly longer than all that a block of text needs, in fact so long that it is over the limit alone."
DOCS = "doc_id bigint, url string, title string, description string, body_text string, outlinks array<string>"
ROWS = [
    (0, "https://a.com/0", "t", "d", LONG + "\nx\nshort", ["https://a.com/1", None]),  # article
    (1, "https://a.com/1", "t", "d", "short\n  a block of twenty characters\nanother block of the same length ", ["https://a.com/0"]),  # blocks
    (2, "https://a.com/2", "t", "d", "one block of twenty characters & more\nx\nshort", ["https://a.com/0", "", None]),  # whole body
    (3, "https://a.com/3", "t", "d", None, ["https://a.com/0"]),
    (4, "https://a.com/4", "t", None, "", None),
    (5, None, "t", "d", LONG, []),
]
WANT = {
    0: LONG + "\nshort",
    1: "a block of twenty characters\nanother block of the same length",
    2: "one block of twenty characters & more\nshort\ngo\ngo",
    3: "go",
    4: "",
}


def test_every_page_has_its_tier(spark, tmp_path):
    import duckdb

    spark.createDataFrame(ROWS, DOCS).coalesce(1).write.parquet(str(tmp_path / "crawl_docs.parquet"))
    got = {r.doc_id: r.body_text for r in queries.QUERIES["page_article_text"](spark, str(tmp_path)).collect()}
    assert got == WANT
    c = duckdb.connect()
    c.sql(f"create view crawl_docs as select * from '{tmp_path}/crawl_docs.parquet/*.parquet'")
    assert dict(c.sql(queries.SQL["page_article_text"]).fetchall()) == WANT
