import math

import pytest

from lakesearch.config import Settings
from lakesearch.functions import text, tokens
from lakesearch.operators import frontier, index


def test_settings():
    s = Settings().with_changes({"ranking": {"title_weight": "3"}, "crawler": {"respect_robots": False}})
    assert s.weights().title == 3.0 and Settings.from_json(s.to_json()) == s
    for bad in ({"x": {}}, {"search": {"x": 1}}, {"search": {"page_size": 0}}, {"search": {"page_size": "a"}}, {"dedup": {"enabled": 1}}, {"search": {"page_size": True}}, {"crawler": {"user_agent": "x" * 201}}):
        with pytest.raises(ValueError):
            s.with_changes(bad)


def test_frontier_resumes(spark, tmp_path):
    queue = spark.createDataFrame([("https://a.com/page?id=5", 1, None, 1.0)], "url string, depth int, anchor_text string, priority double")
    seen = spark.createDataFrame([("x",), ("x",), ("y",)], "fp string")
    frontier.save(str(tmp_path / "f"), seen, queue, 3, 2)
    got_seen, got_queue, added, crawled = frontier.load(spark, str(tmp_path / "f"))
    assert sorted(r.fp for r in got_seen.collect()) == ["x", "y"] and got_queue.first().url.endswith("id=5") and (added, crawled) == (3, 2)


def test_snapshot(spark, tmp_path):
    seen = []
    snap = index.Snapshot(spark, str(tmp_path), lambda: seen.append(1))
    one = spark.createDataFrame([("a", 1)], "term string, doc_id bigint")
    index.save(spark, str(tmp_path), "v1", postings=one)
    assert snap.table("postings").count() == 1 and snap.table("postings").count() == 1 and len(seen) == 1
    index.save(spark, str(tmp_path), "v2", postings=one.limit(0))
    assert snap.table("postings").count() == 0 and len(seen) == 2


def test_external_snippet():
    assert text.external_snippet("a &lt; <em>b</em>", 50) == "a < <b>b</b>" and text.external_snippet(None, 5) == "" and text.external_snippet("abcdef", 3) == "abc..."


def test_viterbi():
    log = lambda d: {k: math.log(v) for k, v in d.items()}
    start, move = log({"B": 0.6, "S": 0.4}), {"B": log({"E": 0.9, "M": 0.1}), "M": log({"E": 1.0}), "E": log({"B": 0.5, "S": 0.5}), "S": log({"B": 0.5, "S": 0.5})}
    emit = {"B": log({"北": 0.5}), "E": log({"京": 0.5}), "S": log({"我": 0.5})}
    assert tokens.viterbi_cut("我北京", start, move, emit) == ["我", "北京"] and tokens.viterbi_cut("", start, move, emit) == []
