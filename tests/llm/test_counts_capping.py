import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesearch.llm import capping, counts


def observed(rows):
    occ, rec = Counter(), Counter()
    for _, terms in rows:
        for t in terms or []:
            if t:
                occ[t] += 1
        for t in {t for t in terms or [] if t}:
            rec[t] += 1
    return {t: (occ[t], rec[t]) for t in rec}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, title_tokens array<string>, term string")


def test_store_follows_changes(spark, tmp_path):
    random.seed(4)
    words = [f"w{i}" for i in range(30)] + ["", None]
    make = lambda ids: {i: [random.choice(words) for _ in range(random.randrange(6))] for i in ids}
    now = make(range(40)) | {99: None}
    store = counts.TermStore(spark, str(tmp_path / "store"))
    assert store.counts().count() == 0 and store.totals().count() == 0
    obs = lambda rows: counts.from_arrays(frame(spark, list(rows)), "doc_id", "title_tokens")
    totals = lambda rows, sign=1: counts.totals(frame(spark, list(rows)), "doc_id", "title_tokens", sign=sign)
    store.apply(counts.delta(obs(now.items())), totals(now.items()))
    for step in range(2):
        gone = set(list(now)[step * 5 : step * 5 + 3])
        changed = make(list(now)[20:26])
        new = make(range(100 + 10 * step, 104 + 10 * step))
        before = {k: now[k] for k in [*gone, *changed]}
        added = changed | new
        store.apply(counts.delta(obs(added.items()), obs(before.items())), totals(added.items()).union(totals(before.items(), -1)))
        now = {k: v for k, v in now.items() if k not in gone} | added
        got = {r.term: (r.n_occurrences, r.n_records) for r in store.counts().where("n_records > 0").collect()}
        assert got == observed(now.items())
        assert store.totals().first().n_total == len(now)


def test_marks(spark):
    rows = [(i, ["all", "rare" if i < 2 else "mid"] if i < 30 else ["other"]) for i in range(100)]
    df = frame(spark, rows)
    state = counts.merge(counts.delta(counts.from_arrays(df, "doc_id", "title_tokens")))
    got = {r.term: r.mark for r in counts.marked(state, counts.totals(df, "doc_id", "title_tokens")).collect()}
    assert got == {"all": "common", "rare": "rare", "mid": "common", "other": "common"}
    few = frame(spark, [(1, ["x"]), (2, ["y"])])  # both rules hold: rare wins
    got = {r.term: r.mark for r in counts.marked(counts.merge(counts.delta(counts.from_arrays(few, "doc_id", "title_tokens"))), counts.totals(few, "doc_id", "title_tokens")).collect()}
    assert got == {"x": "rare", "y": "rare"}


def test_postings_versions(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 5), ("a", 2, None), ("a", 2, None), (None, 1, 1), ("", 1, 1), ("b", None, 1)], "term string, doc_id bigint, term_freq int")
    got = {(r.term, r.record): r.occurrences for r in counts.from_postings(df).collect()}
    assert got == {("a", 1): 5, ("a", 2): 0}


def test_empty(spark):
    df = frame(spark, [])
    assert counts.merge(counts.delta(counts.from_arrays(df, "doc_id", "title_tokens"))).count() == 0


@pytest.mark.parametrize("cap", [1, 3, 1000])
def test_capping(spark, cap):
    random.seed(cap)
    rows = [(i, random.choice(["hot"] * 6 + ["a", "b", None]), random.choice([None, 0.1, 0.1, 0.5, -0.0, 0.0]), 7) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, who string, authority double, part int").repartition(7)
    order = [F.coalesce(-F.col("authority"), F.lit(float("inf"))), F.col("authority").isNull(), F.col("doc_id")]
    got = sorted(r.doc_id for r in capping.dropped(df, F.col("who"), order, cap, ["doc_id", "part"]).collect())
    want = []
    for w in ("hot", "a", "b"):
        own = sorted((r for r in rows if r[1] == w), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want += [r[0] for r in own[cap:]]
    assert got == sorted(want)


def test_capping_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, who string")
    assert capping.dropped(df, F.col("who"), [F.col("doc_id")], 1, ["doc_id"]).collect() == []
    assert capping.cap_of(0, 2) == 1 and capping.cap_of(199, 2) == 3


def test_failed_change_can_be_applied_again(spark, tmp_path, monkeypatch):
    store = counts.TermStore(spark, str(tmp_path / "s"))
    one = frame(spark, [(1, ["a", "b"]), (2, ["a"])])
    change = lambda: (counts.delta(counts.from_arrays(one, "doc_id", "title_tokens")), counts.totals(one, "doc_id", "title_tokens"))
    store.apply(*change())
    with monkeypatch.context() as m:
        m.setattr(counts.TermStore, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.apply(counts.delta(removed=counts.from_arrays(one, "doc_id", "title_tokens")), counts.totals(one, "doc_id", "title_tokens", sign=-1))
    assert {r.term: r.n_records for r in store.counts().collect()} == {"a": 2, "b": 1} and store.totals().first().n_total == 2
    store.apply(counts.delta(removed=counts.from_arrays(one, "doc_id", "title_tokens")), counts.totals(one, "doc_id", "title_tokens", sign=-1))
    assert store.counts().collect() == [] and store.totals().first().n_total == 0


def test_many_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "BUCKET_ROWS", 3)
    store = counts.TermStore(spark, str(tmp_path / "s"))
    rows = frame(spark, [(i, [f"w{i}"]) for i in range(20)])
    store.apply(counts.delta(counts.from_arrays(rows, "doc_id", "title_tokens")), counts.totals(rows, "doc_id", "title_tokens"))
    assert store.state()["buckets"] == 7
    store.apply(counts.delta(counts.from_arrays(frame(spark, [(50, ["w3"])]), "doc_id", "title_tokens")), counts.totals(frame(spark, [(50, ["w3"])]), "doc_id", "title_tokens"))
    state = store.state()
    assert sorted(state["folders"].values()).count("counts-000000002") == 1  # only the bucket of w3 was written
    assert {r.term: r.n_records for r in store.counts().collect()} == {f"w{i}": 2 if i == 3 else 1 for i in range(20)}
