"""Problem 5 leaves out exactly the heaps of problem 2."""

import pytest

from lakesearch.llm import mainbody, stuffing
from lakesearch.sources import workers

SCHEMA = "doc_id bigint, title string, body_text string, outlinks array<string>"
#: Long lines of addresses that end like a sentence, every word another one.
HEAP = "\n".join(" ".join(f"https://shop.example/cheap-lamps-online/free-delivery/{a}{b}x" for b in range(8)) + "." for a in range(12))
STORY = """The keeper of the old lighthouse walked down to the harbour before sunrise, because the boats were due and nobody else had remembered the lamp oil.
On the way he met a girl who carried two baskets of bread, and she told him that the bakery would close at noon for the first time in eleven years.
He thought about that while the fog lifted, and by the time the first mast appeared he had decided to write a letter to the council about it.
Nothing came of the letter, which was lost between the post office and the town hall, but the bakery stayed open after all when her uncle returned.
Years later she still kept one of those baskets above the kitchen door, where visitors asked what it meant and were given a slice of rye instead of an answer."""


def test_long_lines_of_keywords_are_heaps(spark):
    df = spark.createDataFrame([(1, "t", HEAP, []), (2, "t", STORY, [])], SCHEMA)
    assert [r.doc_id for r in stuffing.heaps(df, "doc_id", "title", "body_text", "outlinks").collect()] == [1]
    assert {r.doc_id for r in mainbody.main_text(df, "doc_id", "title", "body_text", "outlinks").collect()} == {2}
    assert 1 not in {r.doc_id for r in mainbody.furniture_lines(df, "doc_id", "title", "body_text", "outlinks").collect()}


def test_null_links_do_not_count(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def look(df):
        if "links" not in df.columns:
            return workers.spread(df)
        seen.update({r.doc_id: r.links for r in df.collect()})
        raise Stop

    monkeypatch.setattr(mainbody, "spread", look)
    df = spark.createDataFrame([(1, "t", STORY, ["a", None, None]), (2, "t", STORY, None), (3, "t", STORY, [None])], SCHEMA)
    with pytest.raises(Stop):
        mainbody.main_text(df, "doc_id", "title", "body_text", "outlinks")
    assert seen == {1: 1, 2: 0, 3: 0}
