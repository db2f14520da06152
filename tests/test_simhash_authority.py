import hashlib
import random

import pytest

from lakesearch.operators import authority, simhash


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain(tokens):
    votes = [0] * 64
    for t in set(tokens):
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return signed(sum(1 << i for i in range(64) if votes[i] > 0))


def test_fingerprints(spark):
    texts = {0: "人工智能 产业 大会 智能 计算 数据 大会 演讲".split(), 1: "美食 旅游 烤鸭 小吃".split(), 2: "alpha beta gamma delta x1 3.14".split()}
    rows = [(d, t) for d, ts in texts.items() for t in [*ts, None]]
    got = {r.doc_id: r.simhash for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, term string")).collect()}
    assert got == {d: plain(t) for d, t in texts.items()}
    assert got[0] == 0x34A3859A74C38DBF and got[2] == 0x09BECAB000089E18


def gate(prints, d):
    kept = []
    for i, p in sorted(prints):
        if not p or all(bin((p ^ q) & (2**64 - 1)).count("1") > d for _, q in kept if q):
            kept.append((i, p))
    return sorted(i for i, _ in kept)


@pytest.mark.parametrize("seed", range(3))
def test_gate_and_links(spark, seed):
    random.seed(seed)
    base = [random.getrandbits(64) for _ in range(4)]
    prints = [(0, 0x0F), (1, 0x3F), (2, 0xFF), (3, 0), (4, None), (5, 0x0F)]
    for i in range(6, 60):
        x = random.choice(base)
        for _ in range(random.randrange(5)):
            x ^= 1 << random.randrange(64)
        prints.append((i, signed(x)))
    df = spark.createDataFrame(prints, "doc_id bigint, simhash bigint")
    members, links = simhash.near_classes(df)
    first = {}
    for i, p in prints:
        if p:
            first.setdefault(p, i)
    want = {(min(a, b), max(a, b)) for p, a in first.items() for q, b in first.items() if a != b and bin((p ^ q) & (2**64 - 1)).count("1") <= 3}
    assert {(r.class_a, r.class_b) for r in links.collect()} == want
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[p] for i, p in prints if p}
    assert sorted(r.doc_id for r in simhash.kept(df).collect()) == gate(prints, 3)


def test_keys_are_not_broadcast(spark):
    """Of a table that seems small, 20 keys for each class must not be sent to the driver."""
    from lakesearch.sources.shared import materialize

    df = materialize(spark.createDataFrame([(1, 7), (2, 7), (3, 5), (4, 0), (5, -1), (6, -2)], "doc_id bigint, simhash bigint"), "prints")
    links = simhash.near_classes(df)[1]
    assert sorted(map(tuple, links.collect())) == [(1, 3, 1), (5, 6, 1)]
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_gate_broadcasts_nothing(spark, monkeypatch):
    """Tables that seem small are not sent to the driver: 20 keys for each class, and the state of each round."""
    plans = []
    written = simhash.materialize

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    prints = [(i, signed(0x9E3779B97F4A7C15 * (i // 3 + 1) % 2**64 ^ (1 << i % 3) - 1)) for i in range(60)]
    df = written(spark.createDataFrame(prints, "doc_id bigint, simhash bigint"), "prints")
    monkeypatch.setattr(simhash, "materialize", noted)
    assert sorted(r.doc_id for r in simhash.kept(df).collect()) == gate(prints, 3)
    assert {"links", "gate"} <= {name for name, _ in plans}
    assert {name for name, plan in plans if "Broadcast" in plan} == set()


def test_pagerank(spark):
    docs = spark.createDataFrame([(0, "a", ["b", "c", None, "a"]), (1, "b", ["c", "c"]), (2, "c", ["a", "nowhere"]), (3, None, None)], "doc_id bigint, url string, outlinks array<string>")
    e = authority.edges(docs)
    assert sorted(map(tuple, e.collect())) == [(0, 1), (0, 2), (1, 2), (2, 0)]
    r = {x.doc_id: x.rank for x in authority.pagerank(docs.where("doc_id < 3").select("doc_id"), e).collect()}
    assert r == pytest.approx({0: 0.38787060, 1: 0.21474832, 2: 0.39738108}, abs=1e-8)
    n = {x.doc_id: x.authority for x in authority.normalized(spark.createDataFrame(list(r.items()), "doc_id bigint, rank double")).collect()}
    assert n == pytest.approx({0: 0.947926, 1: 0.0, 2: 1.0}, abs=1e-6)


def test_pagerank_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, url string, outlinks array<string>")
    assert authority.pagerank(none.select("doc_id"), authority.edges(none)).collect() == []
    assert authority.normalized(spark.createDataFrame([], "doc_id bigint, rank double")).collect() == []
    flat = spark.createDataFrame([(1, 0.5), (2, 0.5)], "doc_id bigint, rank double")
    assert {r.authority for r in authority.normalized(flat).collect()} == {1.0}
    twice = spark.createDataFrame([(1, "u", None), (2, "u", None), (3, "v", ["u", "v#x"])], "doc_id bigint, url string, outlinks array<string>")
    assert [tuple(r) for r in authority.edges(twice).collect()] == [(3, 2)]


def test_authority_is_written_back(spark):
    docs = spark.createDataFrame([(0, "a", ["b", "c"], None), (1, "b", ["c"], 0.5), (2, "c", ["a"], 0.5)], "doc_id bigint, url string, outlinks array<string>, authority double")
    ranks = authority.pagerank(docs.select("doc_id"), authority.edges(docs))
    new, summary = authority.written_back(docs, ranks)
    want = {r.doc_id: r.authority for r in authority.normalized(ranks).collect()}
    assert {r.doc_id: r.authority for r in new.collect()} == want and new.columns == docs.columns
    assert tuple(summary.first()) == (3, max(want.values()), min(want.values()))
    assert {r.doc_id: r.authority for r in authority.rebuilt(docs, "cli").collect()} == {0: None, 1: 0.5, 2: 0.5}
    assert {r.doc_id: r.authority for r in authority.rebuilt(docs, "managed").collect()} == want
    assert tuple(authority.written_back(docs, ranks.limit(0))[1].first()) == (0, 0.0, 0.0)


def test_links_do_not_move_again(spark):
    """The join of ranks and links shuffles only the ranks."""
    from pyspark.sql import functions as F

    from lakesearch.sources.shared import bucketed

    links = bucketed(spark.range(1000).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst")), "links", "src")
    ranks = spark.range(50).select(F.col("id").alias("src"), F.lit(1.0).alias("rank"))
    plan = links.join(ranks.hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
