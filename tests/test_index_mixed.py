import itertools
import math
import re

from pyspark.sql import functions as F

from lakesearch import queries
from lakesearch.functions.tokens import HAN, LATIN, STOP_WORDS, Segmenter
from lakesearch.operators import index
from lakesearch.operators.search import Index
from lakesearch.plans.query import parse
from lakesearch.streaming import ingest

WORDS = [("渡船", 50), ("档案", 40), ("档案馆", 30), ("安静", 20), ("静", 9000), ("安", 9000)]
DOCS = "doc_id bigint, url string, title string, description string, body_text string, fetch_time double, title_tokens array<string>, desc_tokens array<string>, authority double"
ROWS = [
    (0, "https://a.com/0", "渡船 guide", "安静的档案馆", "青山说，一共有 12 座安静的档案馆 and red渡船", 1.0, ["渡船", "guide"], ["岸边"], 1.0),
    (1, "https://a.com/1", None, None, "结实的渡船已经记录渡船安静", 1.0, None, None, 1.0),  # Chinese only
    (2, "https://a.com/2", "red fish", "", "a red fish", 1.0, [], [], 1.0),
    (3, "https://a.com/3", "", None, "的的的的的的的的的的的渡", 1.0, [], [], 1.0),  # one token
]


def cuts(run):
    """The likeliest of all cuts into dictionary words, and single characters where none starts."""
    freq, total = dict(WORDS), sum(n for _, n in WORDS)
    best = None
    for ends in itertools.product([0, 1], repeat=len(run) - 1):
        parts = re.findall(r"[^|]+", "".join(c + "|" * e for c, e in zip(run, (*ends, 0), strict=True)))
        at, ok, value = 0, True, 0.0
        for part in parts:
            starts = any(run.startswith(w, at) for w in freq)
            ok &= part in freq if starts else len(part) == 1
            value += math.log(freq.get(part, 1) / total)
            at += len(part)
        if ok and (best is None or value > best[0] + 1e-9):
            best = (value, parts)
    return best[1]


def expected(rows):
    out = {}
    for doc, _, title, description, body, _, a, b, _ in rows:
        text = "\n".join(x for x in (title, description, body) if x is not None)
        tokens = [t for han, latin in re.findall(f"({HAN})|({LATIN})", text) for t in (cuts(han) if han else [latin.lower()])]
        tokens = [t for t in tokens if t not in STOP_WORDS]
        if len(text.strip()) >= 10 and len(tokens) >= 2:
            tokens += [t for t in dict.fromkeys((a or []) + (b or [])) if t not in tokens]
            for i, t in enumerate(tokens):
                out.setdefault((t, doc), []).append(i)
    return out


def places(post):
    assert all(r.term_freq == len(r.positions) for r in post.collect())
    return {(r.term, r.doc_id): r.positions for r in post.collect()}


def test_whole_pages_equal_brute_force(spark):
    want = expected(ROWS)
    assert want["渡船", 1] and {d for _, d in want} == {0, 1, 2}
    docs = index.assembled(spark.createDataFrame(ROWS, DOCS), WORDS)
    post = index.postings(index.occurrences(docs))
    assert places(post) == want
    assert {r.doc_id: r.doc_length for r in index.doc_lengths(post).collect()} == {d: sum(len(p) for (_, e), p in want.items() if e == d) for d in (0, 1, 2)}
    stats = {r.term: (r.df, r.first_doc, r.first_pos) for r in index.term_stats(index.occurrences(docs)).collect()}
    assert stats["渡船"] == (2, 0, 0) and stats["记"][:2] == (1, 1)
    one = index.corpus_stats(docs, post).first()
    assert (one.total_docs, one.vocabulary_size, one.total_word_count) == (3, len({t for t, _ in want}), sum(map(len, want.values())))


def test_search_in_chinese(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    found = Index(docs, index.postings(index.occurrences(index.assembled(docs, WORDS))))
    tokenize = Segmenter(WORDS).tokens
    assert sorted(r.doc_id for r in found.filtered(parse("渡船", tokenize)).collect()) == [0, 1]
    assert [r.doc_id for r in found.filtered(parse('"安静的档案馆"', tokenize)).collect()] == [0]


def test_without_dictionary_characters_stand_alone(spark):
    got = places(index.postings(index.occurrences(index.assembled(spark.createDataFrame(ROWS[1:2], DOCS)))))
    assert got["渡", 1] and ("渡船", 1) not in got


def test_stream_indexes_chinese(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DOCS)
    df.write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.index_pages(pages, str(tmp_path / "out"), str(tmp_path / "cp"), words=WORDS).awaitTermination(60)
    assert places(index.load(spark, str(tmp_path / "out"), "postings")) == expected(ROWS)


def test_registered_queries_hold_chinese_terms(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "crawl_docs.parquet"))
    spark.createDataFrame(WORDS, "word string, freq bigint").write.parquet(str(tmp_path / "lexicon.parquet"))
    want = expected(ROWS)
    q, folder = queries.QUERIES, str(tmp_path)
    assert places(q["postings_mixed"](spark, folder)) == want
    assert q["doc_length_mixed"](spark, folder).agg(F.sum("doc_length")).first()[0] == sum(map(len, want.values()))
    assert q["term_stats_mixed"](spark, folder).count() == q["corpus_stats_mixed"](spark, folder).first().vocabulary_size == len({t for t, _ in want})


def test_segment_mixed_covers_whole_pages(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "crawl_docs.parquet"))
    spark.createDataFrame(WORDS, "word string, freq bigint").write.parquet(str(tmp_path / "lexicon.parquet"))
    got = {r.doc_id: r.tokens for r in queries.QUERIES["segment_mixed"](spark, str(tmp_path)).collect()}
    assert got[0][:5] == ["渡船", "guide", "安", "静", "档案馆"] and got[0][-2:] == ["red", "渡船"]
    assert got[1].count("渡船") == 2 and got[3] == ["渡"] and set(got) == {0, 1, 2, 3}
