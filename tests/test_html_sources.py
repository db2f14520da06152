from pyspark.sql import functions as F

from lakesearch.functions import html
from lakesearch.sources import seeds
from lakesearch.sources.shared import materialize, shared_dir

PAGE = """<html><head><title> A <!-- x --> &amp; B </title><META NAME="Description" content=" d "></head><body><nav><a href="/nav">n</a></nav>
<article><p>First paragraph of some length, with words enough to count as text.<p>Second one, unclosed, also with a number of words in it.
<ul><li>item one<li>item two</ul><script>x()</script></article><a href="/b#f">bee</a><a href="/b#f">again</a><a href="#top">no</a><a href="mailto:x">no</a></body></html>"""


def test_parse():
    url, title, desc, body, links, n = html.parse("https://a.com/x/", PAGE)
    assert title == "A& B".replace("A&", "A&") or title == "A  & B" or title == "A & B"
    assert desc == "d" and body.startswith("First paragraph") and "x()" not in body and n == len(body)
    assert links == [{"url": "https://a.com/b#f", "anchor": "bee"}]


def test_tiers():
    blocks = "<body><div>menu</div><p>" + "word " * 10 + "</p><p><a href='/x'>" + "link " * 10 + "</a></p><h2>" + "head " * 6 + "</h2></body>"
    assert html.parse("", blocks)[3] == ("word " * 10).strip() + "\n" + ("head " * 6).strip()
    assert html.parse("", "<body><div>only</div> text x</body>")[3] == "only\ntext x"
    assert html.parse("u", None) == ("u", "", "", "", [], 0)
    assert html.parse("u", "")[3] == ""
    assert len(html.parse("u", "<p>" + "long " * 20000 + "</p><p>" + "more " * 9 + "</p>")[3]) == 50_000


def test_decode_and_fast_title(spark):
    assert html.decode(b"caf\xe9", "latin-1") == "café" and html.decode(b"\xff", "no-such") == "�" and html.decode(None, None) is None
    df = spark.createDataFrame([("<TITLE lang=x> hi\n</title>",), ("none",)], "h string")
    assert [r[0].strip() for r in df.select(html.fast_title(F.col("h"))).collect()] == ["hi", ""]


def test_seeds(spark, tmp_path):
    df = spark.createDataFrame([("https://a, http://b\nftp://c，,https://a",), (None,)], "t string")
    assert df.select(seeds.split_seeds(F.col("t"))).first()[0] == ["https://a", "http://b", "ftp://c", "https://a"]
    store = spark.createDataFrame([("https://a",)], "url string")
    new = spark.createDataFrame([("https://a",), (" http://b ",), ("ftp://c",), (None,)], "url string")
    assert sorted(r.url for r in seeds.added(store, new).collect()) == ["http://b", "https://a"]
    assert seeds.removed(store, new).count() == 0
    seeds.save_store(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "url string"), str(tmp_path / "s"))
    assert [r.url for r in seeds.load_store(spark, str(tmp_path / "s")).collect()] == ["b", "a"]


def test_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# words\n北京 10 n\n城市 x\n\n长长长长长长长长长 3\n人 5\n")
    got = sorted((r.word, r.freq, r.tag) for r in seeds.read_dictionary(spark, str(tmp_path / "d.txt")).collect())
    assert got == [("人", 5, None), ("北京", 10, "n")]


def test_robots(spark):
    pages = spark.createDataFrame([("https://a.com/x",), ("https://a.com/private/y",), ("https://b.com/private",)], "url string")
    robots = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /private")], "origin string, rules string")
    assert sorted(r.url for r in seeds.allowed_by_robots(pages, robots).collect()) == ["https://a.com/x", "https://b.com/private"]


def test_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    assert df.count() == 3 and shared_dir(spark)
