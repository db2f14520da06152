import random

import numpy as np
import pytest

from lakesearch.llm import spans


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def corpus(seed, least):
    """Texts that share spans just below, at and above `least`, copies, runs of one character, and furniture."""
    random.seed(seed)
    noise = lambda n: "".join(random.choice("abcdefgh 漢é🙂") for _ in range(n))
    shared = [noise(least - 1), noise(least), noise(3 * least)]
    furniture = noise(least - 4)
    texts = []
    for i in range(40):
        parts = [noise(random.randrange(60))]
        for s in random.sample(shared, random.randrange(3)):
            parts += [s, noise(random.randrange(1, 20))]
        if i % 2:
            parts += [furniture, noise(8)]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "x" * 2 * least, "x" * (least + 5), noise(least), "", None, "short"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "hot"), [(1, 40), (1, 0), (2, 5)])
def test_against_brute_force(spark, seed, hot):
    least = 30
    rows = corpus(seed, least)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, key string").repartition(3)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and longest_common(a, b) >= least}
    got = [tuple(r) for r in spans.pairs(df, "doc_id", "text", least, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.doc_id: r.n_links for r in spans.link_counts(df, "doc_id", "text", least, hot).collect()}
    assert {d: n for d, n in links.items() if n} == {d: sum(d in p for p in want) for d in {x for p in want for x in p}}
    whole = {r.doc_id: r for r in spans.shared(df, "doc_id", "text", least, hot).collect()}
    assert len(whole) == len(rows)
    for i, t in rows:
        if t is None:
            assert whole[i].shared_chars is None and whole[i].n_chars is None
            continue
        cover = np.zeros(len(t) + 1, int)
        for s in range(len(t) - least + 1):
            if any(j != i and u and t[s : s + least] in u for j, u in rows):
                cover[s] += 1
                cover[s + least :][:1] -= 1
        assert whole[i].shared_chars == int((np.cumsum(cover)[: len(t)] > 0).sum()), (i, t)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.pairs(df, "doc_id", "text").collect() == [] and spans.shared(df, "doc_id", "text").collect() == []
    df = spark.createDataFrame([(1, "a" * 500), (1, "a" * 500), (None, "a" * 500)], "doc_id bigint, text string")
    assert spans.pairs(df, "doc_id", "text").collect() == []  # one record, twice


def test_rolling_hash_depends_on_the_window_alone():
    a, b = spans.codes("xxabcdefgh"), spans.codes("yyyyabcdefgh")
    assert spans.rolling(a, 8)[2] == spans.rolling(b, 8)[4]
    assert len(spans.rolling(a, 11)) == 0


@pytest.mark.parametrize("w", [1, 2, 7])
def test_kept_places(w):
    rng = np.random.default_rng(w)
    h = rng.integers(0, 9, 60).astype(np.uint64)
    want = {j for i in range(len(h) - w + 1) for j in range(i, i + w) if h[j] == min(h[i : i + w])}
    assert set(spans.kept(h, w).tolist()) == want
