import math

import pytest
from pyspark.sql import functions as F

from lakesearch.operators import index
from lakesearch.operators.search import Index, Weights, as_json
from lakesearch.plans.query import parse

DOCS = "doc_id bigint, url string, title string, description string, body_text string, fetch_time double, title_tokens array<string>, desc_tokens array<string>, authority double"
ROWS = [
    (0, "https://a.com/0", "red fish", "", "a red fish and a blue fish swim", 100.0, ["red", "fish"], [], 1.0),
    (1, "https://b.a.com/1", "Python notes", "red", "fish of the red sea, a fish", 0.0, ["python", "notes"], ["red"], None),
    (2, "https://c.com/2", None, None, None, None, None, None, 0.0),
    (3, "https://c.com/3", "", "", "nothing here but green grass", 5.0, [None, ""], ["extra"], 0.5),
]


@pytest.fixture(scope="module")
def idx(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = index.assembled(docs)
    return Index(docs, index.postings(index.occurrences(kept)).cache())


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_postings(idx):
    rows = {(r.term, r.doc_id): (r.term_freq, r.positions) for r in idx.post.collect()}
    assert rows["fish", 0] == (3, [1, 3, 5])  # red fish | red fish blue fish swim
    assert rows["extra", 3] == (1, [4])  # nothing here green grass, then the field's own
    assert not any(d == 2 for _, d in rows)


def test_stats(spark, idx):
    docs = idx.docs.where("doc_id <> 2")
    r = index.corpus_stats(docs, idx.post).first()
    assert r.total_docs == 3 and r.avg_doc_length == f"{r.total_word_count / 3:.1f}"
    empty = index.corpus_stats(docs.limit(0), idx.post.limit(0)).first()
    assert (empty.total_docs, empty.vocabulary_size, empty.avg_doc_length, empty.total_word_count) == (0, 0, "0.0", 0)


def test_live_postings(spark):
    docs = spark.createDataFrame([(1,), (1,)], "doc_id bigint")
    seg = spark.createDataFrame([("a", 1, 2, [0, 1]), ("a", 1, 3, None), ("a", 9, 1, [0]), ("b", 1, None, None), (None, 1, 1, None), ("", 1, 1, None)], "term string, doc_id bigint, term_freq int, positions array<int>")
    got = {r.term: (r.term_freq, r.positions) for r in index.live_postings(seg, docs).collect()}
    assert got == {"a": (3, [0, 1]), "b": (1, None)}


def test_candidates(idx):
    assert ids(idx.filtered(parse("red fish"))) == [0, 1]
    assert ids(idx.filtered(parse("green OR python"))) == [1, 3]
    assert ids(idx.filtered(parse('"fish red swim"'))) == []
    assert ids(idx.filtered(parse('"red fish blue fish"'))) == [0]
    assert ids(idx.filtered(parse('"fish red sea"'))) == [1]  # over stop words
    assert ids(idx.filtered(parse("the"))) == [0, 1, 2, 3]
    assert ids(idx.filtered(parse("fish -blue"))) == [1]
    assert ids(idx.filtered(parse("site:a.com"))) == [0, 1]
    assert ids(idx.filtered(parse("inurl:B.a"))) == [] and ids(idx.filtered(parse("inurl:b.a"))) == [1]
    assert ids(idx.filtered(parse("intitle:Python"))) == [] and ids(idx.filtered(parse("intitle:python"))) == [1]
    assert ids(idx.filtered(parse("missing"))) == []


def test_scores_equal_the_formula(idx):
    rows = idx.post.collect()
    n, total = 4, sum(r.term_freq for r in rows)
    mean = total / n
    want = {}
    for d, title, desc, auth in ((0, ["red", "fish"], [], 1.0), (1, ["python", "notes"], ["red"], 1.0)):
        dl = sum(r.term_freq for r in rows if r.doc_id == d)
        s = 0.0
        for t in ("red", "fish"):
            tf = next(r.term_freq for r in rows if (r.term, r.doc_id) == (t, d))
            df = sum(r.term == t for r in rows)
            v = math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
            s += v * (2.5 if t in title else 1) * (1.5 if t in desc else 1)
        want[d] = s * (1 + 0.35 * auth)
    got = {r.doc_id: r.score for r in idx.ranked(parse("red fish")).collect()}
    assert got == pytest.approx(want) and list(got) == sorted(want, key=lambda d: -want[d])
    phrase = {r.doc_id: r.score for r in idx.ranked(parse('"red fish"')).collect()}
    assert phrase == pytest.approx({d: 2 * s for d, s in want.items()})  # in document 1 over the fields' border


def test_decay(idx):
    w = Weights(decay_days=1.0)
    plain = {r.doc_id: r.score for r in idx.ranked(parse("fish")).collect()}
    old = {r.doc_id: r.score for r in idx.ranked(parse("fish"), w, now=100.0 + 86400 * 9).collect()}
    assert old[0] == pytest.approx(plain[0] * 0.5) and old[1] == pytest.approx(plain[1])


def test_results(idx):
    rows = idx.results(parse("fish"), 1, 1).collect()
    assert len(rows) == 1 and "<b>fish</b>" in rows[0].snippet
    assert as_json(idx.results(parse("green"))).first().json.startswith('{"title":"https://c.com/3"')
    assert [r.doc_id for r in idx.ranked(parse("")).collect()] == [3, 2, 1, 0]


def test_upsert_delete_list_save(spark, idx, tmp_path):
    docs = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, None, 1.0), (4, None, 1.0), (5, "b", None)], "doc_id bigint, url string, t double")
    assert ids(index.upsert(docs, F.col("url"), [F.col("t"), F.col("doc_id")])) == [2, 3, 4, 5]
    assert 0 not in ids(index.without(idx.post, spark.createDataFrame([(0,), (0,)], "doc_id bigint")))
    assert [r.doc_id for r in index.listed(docs, 2, 2).collect()] == [3, 2]
    index.save(spark, str(tmp_path), "v1", postings=idx.post)
    index.save(spark, str(tmp_path), "v2", postings=idx.post.where("doc_id = 0"))
    assert set(ids(index.load(spark, str(tmp_path), "postings"))) == {0}


def test_ids_and_lookups(spark, idx, tmp_path):
    docs = spark.createDataFrame([(4, "a", 1), (None, "c", 2), (None, "b", 3), (None, None, 4)], "doc_id bigint, url string, rank int")
    got = {(r.url, r.rank): r.doc_id for r in index.with_ids(docs, [F.col("url"), F.col("rank")]).collect()}
    assert got == {("a", 1): 4, (None, 4): 5, ("b", 3): 6, ("c", 2): 7}
    empty = docs.limit(0)
    assert index.with_ids(empty, [F.col("url")]).collect() == [] and index.document(docs, 4).count() == 1 and index.listing(docs)[1] == 4
    assert {r.doc_id for r in idx.postings_of("fish").collect()} == {r.doc_id for r in idx.post.where("term = 'fish'").collect()} and idx.length_of(-1).collect() == []
    index.save(spark, str(tmp_path), "v1", documents=idx.docs, **idx.tables())
    opened = Index.open(spark, str(tmp_path))
    assert opened.size == pytest.approx(idx.size)
    assert [tuple(r) for r in opened.ranked(parse("red fish")).collect()] == [tuple(r) for r in idx.ranked(parse("red fish")).collect()]


def test_answers(idx):
    found = idx.answer("fish", 1, 1).first()
    assert (found.total, found.page, found.page_size, found.suggestion, len(found.results)) == (idx.ranked(parse("fish")).count(), 1, 1, None, 1)
    lost = idx.answer("fixh").first()
    assert (lost.total, lost.suggestion, lost.results) == (0, "fish", [])
    assert idx.answer("").first().total == 4 and idx.answer("zzzzzzzz").first().suggestion is None
