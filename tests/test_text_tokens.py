import math
import random

import pytest
from pyspark.sql import functions as F

from lakesearch.functions import text, tokens


def test_latin(spark):
    df = spark.createDataFrame([("The über foo_bar 3.14 Example.com, it's",), (None,), ("",), ("漢字",)], "t string")
    assert [r[0] for r in df.select(tokens.latin_tokens(F.col("t"))).collect()] == [["ber", "foo", "bar", "3.14", "example.com", "s"], None, [], []]


def test_segmenter():
    s = tokens.Segmenter([("北京", 10), ("城市", 5), ("人工", 3), ("人工智能", 8), ("智能", 4), ("旧", None)])
    assert s.tokens("人工智能在北京城市 Python3.9 旅游") == ["人工智能", "北京", "城市", "python3.9", "旅", "游"]
    assert s.tokens(None) is None and s.tokens("") == []
    assert s.cut("人工智") == ["人工", "智"]


def test_segmented(spark):
    words = tokens.lexicon_words(spark.createDataFrame([("北京", 5), ("北京", None), (None, 1), ("", 2)], "word string, freq bigint"))
    assert words == [("北京", 5)]
    df = spark.createDataFrame([(1, "北京 ok"), (2, None), (3, "")], "i int, t string")
    assert [r.x for r in tokens.segmented(df, "t", "x", words).orderBy("i").collect()] == [["北京", "ok"], None, []]


def test_snippets(spark):
    long = "x" * 150 + " Needle <b> " + "y" * 150
    df = spark.createDataFrame([(long,), ("short & needle",), (None,), ("",), ("nothing" * 50,)], "t string")
    got = [r[0] for r in df.select(text.snippet_window(F.col("t"), ["needle", "absent"])).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and len(got[0]) == 206 and got[2:4] == ["", ""] and got[4] == ("nothing" * 50)[:200]
    marked = df.select(text.highlighted(F.col("t"), ["Needle"])).collect()[1][0]
    assert marked == "short &amp; <b>Needle</b>"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(2))
def test_nearest_loses_nothing(spark, seed):
    random.seed(seed)
    word = lambda: "".join(random.choice("abc") for _ in range(random.randint(1, 12)))
    vocabulary = list(dict.fromkeys(word() for _ in range(60)))
    stats = spark.createDataFrame([(t, 1, i // 5, i % 5) for i, t in enumerate(vocabulary)], "term string, df int, first_doc bigint, first_pos int")
    wanted = list({word() for _ in range(60)})
    got = {r.word: r.term for r in text.nearest(spark.createDataFrame([(w,) for w in wanted], "word string"), stats).collect()}
    for w in wanted:
        near = sorted((distance(w, t), i, t) for i, t in enumerate(vocabulary) if distance(w, t) <= 2)
        assert got.get(w) == (near[0][2] if near else None)


def test_suggest_and_correct(spark):
    stats = spark.createDataFrame([("harbour", 5, 0, 0), ("hard", 5, 0, 1), ("hat", 9, 0, 2), ("city", 1, 1, 0)], "term string, df int, first_doc bigint, first_pos int")
    assert [r.term for r in text.suggestions(stats, " HA").collect()] == ["hat", "harbour", "hard"]
    assert text.suggestions(stats, " ").collect() == []
    q = spark.createDataFrame([(1, ["harbor", "city"]), (2, ["city"]), (3, ["旅", "hatt"]), (4, ["zzzzzzz"])], "query_id int, tokens array<string>")
    assert {r.query_id: r.corrected for r in text.corrected(q, stats).collect()} == {1: "harbour city", 2: None, 3: "旅 hat", 4: None}


@pytest.mark.parametrize("seed", range(2))
def test_nearest_is_exact(spark, seed):
    """Against brute force, over short, middle and long words, with ties by first place."""
    random.seed(seed)

    def changed(w):
        for _ in range(random.randrange(4)):
            i, c = random.randrange(len(w) + 1), random.choice("abcé")
            w = random.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]) or c
        return w

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    base = ["".join(random.choice("abcé") for _ in range(n)) for n in (1, 2, 3, 5, 8, 18, 19, 20, 21, 22, 23, 24, 40) for _ in range(3)]
    terms = sorted({changed(w) for w in base * 3})
    words = sorted({changed(w) for w in base * 3})
    stats = spark.createDataFrame([(t, i // 3, i % 3) for i, t in enumerate(terms)], "term string, first_doc int, first_pos int")
    got = {r.word: r.term for r in text.nearest(spark.createDataFrame([(w,) for w in words], "word string"), stats).collect()}
    want = {}
    for w in words:
        near = [(d, i, t) for i, t in enumerate(terms) if (d := distance(w, t)) <= 2]
        if near:
            want[w] = min(near)[2]
    assert got == want


def test_emissions():
    e = tokens.trained_emissions([("北京", 3), ("我", None), ("天安门", 1), ("", 5)])
    assert e["B"] == pytest.approx({"北": math.log(3 / 4), "天": math.log(1 / 4)}) and e["S"] == {"我": 0.0} and e["M"] == {"安": 0.0}
    assert tokens.viterbi_cut("我北京", tokens.HMM_START, tokens.HMM_MOVE, e) == ["我", "北京"]
