import pytest
from pyspark.sql import functions as F

from lakesearch.functions import urls

CASES = [
    ("https://a.com/page?utm_source=x&id=5&utm_campaign=c", "https://a.com/page?id=5"),
    ("https://A.com/Path/#frag", "https://a.com/Path"),
    ("https://a.com/x?fbclid=abc&ref=1&msclkid=m", "https://a.com/x"),
    ("https://a.com/?spm=1&source=app", "https://a.com/"),
    ("http://a.com:8080/", "http://a.com:8080/"),
    ("http://a.com:80", "http://a.com/"),
    ("https://a.com:443/b//", "https://a.com/b"),
    ("  https://a.com/b c?x=%20y&z  ", "https://a.com/b c?x=+y&z="),
    ("https://a.com/?q=~*%zz", "https://a.com/?q=~%2A%25zz"),
    ("ftp://a.com/", ""),
    ("nothing", ""),
    ("", ""),
    (None, None),
]


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").select("i", f(F.col("u")).alias("o"))
    return [r.o for r in sorted(rows.collect())]


def test_normalize(spark):
    got = run(spark, [a for a, _ in CASES], urls.normalize)
    assert [g or "" for g in got] == [b or "" for _, b in CASES]


def test_legacy_port(spark):
    assert run(spark, ["http://a.com:8080/"], lambda c: urls.normalize(c, legacy_port=True)) == ["http://a.com80/"]


def test_parts(spark):
    values = ["https://u:p@WWW.A.com:8443/x?y", "http://www.b.example", None]
    assert run(spark, values, urls.authority) == ["u:p@www.a.com:8443", "www.b.example", None]
    assert run(spark, values, urls.host) == ["www.a.com", "www.b.example", None]
    assert run(spark, values, urls.site) == ["a.com", "b.example", None]


@pytest.mark.parametrize(("url", "skip"), [("https://a.com/x.PDF", True), ("https://a.com/x.pdf?y", True), ("https://a.com/x", False), ("mailto:x", True), ("https://a.com/" + "x" * 2100, True)])
def test_skip(spark, url, skip):
    assert run(spark, [url], urls.should_skip) == [skip]


def test_on_site(spark):
    values = ["https://b.a.com/x", "https://a.com", "https://ba.com", "https://a.com:80/"]
    assert run(spark, values, lambda c: urls.on_site(c, " A.com ")) == [True, True, False, False]
    assert run(spark, values, lambda c: urls.on_site(c, " ")) == [True] * 4
