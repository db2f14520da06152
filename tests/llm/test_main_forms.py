"""Problem 5 learns from every form that recurs, also from those that are rare in a large table."""

import pytest

from lakesearch.llm import mainbody
from tests.llm.test_pages import corpus, votes_of

SCHEMA = "doc_id bigint, title string, body_text string, outlinks array<string>"
ARGS = ("doc_id", "title", "body_text", "outlinks")


def test_rare_forms_of_a_large_table(spark):
    """1.3 million places of one line: a line of four places and a notice of few bodies are still furniture."""
    paragraphs = [f"{w} walked down to the harbour before sunrise, because the boats were due and nobody else had remembered the lamp oil of the {w} house." for w in "Ada Ben Cleo Dora Emil Fay Gus Hal Ida".split()]
    notice = "No part of this journal may be copied, stored or passed on without the written consent of the publisher, who answers letters within two weeks."
    # the notice stands between paragraphs, the short line in the middle of one page and below the others
    rows = [(i, "t", "\n".join([p, notice, p.replace("lamp", "seed")]), None) for i, p in enumerate(paragraphs)]
    rows += [(20 + i, "t", "\n".join([p, "Seen twice elsewhere"]), None) for i, p in enumerate(paragraphs[:6])]
    rows += [(30, "t", "\n".join([paragraphs[7], "Seen twice elsewhere", paragraphs[8]]), None)]
    rows += [(40, "t", "\n".join(["Go"] * 700_000 + [paragraphs[0]]), None)]
    gone = {(r.doc_id, r.line_no) for r in mainbody.furniture_lines(spark.createDataFrame(rows, SCHEMA), *ARGS).where("doc_id <> 40").collect()}
    assert {(i, 2) for i in range(9)} <= gone
    assert (30, 2) in gone


@pytest.mark.parametrize(("most", "broadcast"), [(0, "10m"), (0, "-1"), (20, "10m"), (20, "-1"), (200, "-1")])
def test_joined_forms_say_the_same(spark, monkeypatch, most, broadcast):
    """However few forms go to every task, and whether the others are joined by broadcast or by shuffle."""
    pages = corpus()
    votes = votes_of(pages)
    lines = [[x for x, _ in page] for page in pages]
    want = {i: mainbody.furniture("\n".join(x), votes) for i, x in enumerate(lines)}
    rows = [(i, "t", "\n".join(x), None) for i, x in enumerate(lines)]
    df = spark.createDataFrame([*rows, (1002, None, None, []), (1003, "", " \n ", [])], SCHEMA)
    monkeypatch.setattr(mainbody, "MOST", most)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        form, said, rest = mainbody.learned(df, "body_text")
        assert len(form) <= most and rest is not None
        assert sorted([*form.tolist(), *(r.form for r in rest.collect())]) == sorted(votes.known)
        got = sorted((r.doc_id, r.line_no) for r in mainbody.furniture_lines(df, *ARGS).collect())
        texts = {r.doc_id: r.body for r in mainbody.main_text(df, *ARGS).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [(i, n) for i in want for n in want[i]]
    assert texts == {i: "\n".join(x for n, x in enumerate(lines[i], 1) if x and n not in want[i]) for i in want}


def test_equal_rows_and_null_ids_of_joined_forms(spark, monkeypatch):
    """Each row has its lines, also where it is repeated or has no id."""
    pages = corpus()
    rows = [(None if i % 3 == 0 else i, "t", "\n".join(x for x, _ in page), None) for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows + rows[:10], SCHEMA)
    plain = sorted((r.doc_id or -1, r.line_no) for r in mainbody.furniture_lines(df, *ARGS).collect())
    monkeypatch.setattr(mainbody, "MOST", 0)
    assert sorted((r.doc_id or -1, r.line_no) for r in mainbody.furniture_lines(df, *ARGS).collect()) == plain
