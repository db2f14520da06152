import datetime as dt

from lakesearch.operators import index
from lakesearch.streaming import ingest


def test_fresh_addresses(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [("https://a.com/x?utm_source=1", t), ("https://A.com/x", t), ("https://a.com/y", t), (None, t)]
    spark.createDataFrame(rows, "url string, queued_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, queued_at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.fresh_addresses(stream, "queued_at").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.norm for r in spark.table("fresh").collect()) == ["https://a.com/x", "https://a.com/y"]


def test_index_pages_and_manager(spark, tmp_path):
    schema = "doc_id bigint, title string, description string, body_text string, title_tokens array<string>, desc_tokens array<string>"
    spark.createDataFrame([(1, "red fish", "", "some text about fish", ["red", "fish"], [])], schema).write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    manager = ingest.CrawlManager(spark)
    assert manager.status == "stopped"
    assert manager.start(lambda: ingest.index_pages(pages, str(tmp_path / "out"), str(tmp_path / "cp")))
    manager.query.awaitTermination(60)
    assert manager.status == "finished"
    got = {r.term: r.term_freq for r in index.load(spark, str(tmp_path / "out"), "postings").collect()}
    assert got["fish"] == 2


def test_pages_fetched_again_replace_themselves(spark, tmp_path):
    schema = "doc_id bigint, url string, title string, description string, body_text string, title_tokens array<string>, desc_tokens array<string>, fetch_time double"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def fetched(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.index_pages(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)

    fetched([(1, "u", "red fish", "", "some text about fish", [], [], 1.0), (2, "v", "blue whale", "", "some text about whales", [], [], 1.0)])
    fetched([(3, "u", "green fish", "", "other text about fish", [], [], 2.0), (4, None, "lost page", "", "text of no address", [], [], None)])
    docs = index.load(spark, str(tmp_path / "out"), "documents")
    assert sorted(r.doc_id for r in docs.collect()) == [2, 3, 4]
    post = index.load(spark, str(tmp_path / "out"), "postings")
    assert sorted(r.doc_id for r in post.where("term = 'fish'").collect()) == [3]
