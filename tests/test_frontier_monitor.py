import datetime as dt

from pyspark.sql import functions as F

from lakesearch.operators import frontier, monitor

SCHEMA = "entry_id bigint, url string, domain string, priority double, depth int"


def entries(spark):
    rows = [
        (1, "https://a.com/x?utm_source=1", "a.com", 2.0, 1),
        (2, "https://A.com/x", "a.com", 1.0, 1),
        (2, "https://A.com/x", "a.com", 1.0, 1),
        (3, "https://a.com/deep", "a.com", 1.0, 9),
        (4, "https://a.com/f.zip", "a.com", 1.0, 1),
        (5, "https://b.com/", "b.com", None, None),
        (6, None, None, None, None),
        (7, "ftp://c.com/", "c.com", 0.0, 0),
        (8, "https://a.com/z", "a.com", 0.5, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


ORDER = lambda: [F.coalesce("priority", F.lit(1e9)), F.col("entry_id")]


def test_dedup_and_schedule(spark):
    one = frontier.fresh(frontier.accepted(entries(spark)), ORDER())
    assert sorted(r.entry_id for r in one.collect()) == [2, 5, 8]
    seen = one.where("entry_id = 2").select("fp")
    assert sorted(r.entry_id for r in frontier.fresh(frontier.accepted(entries(spark)), ORDER(), seen).collect()) == [5, 8]
    got = {r.entry_id: (r.slot, r.start_s) for r in frontier.scheduled(one, ORDER(), 2.0).collect()}
    assert got == {8: (0, 0.0), 2: (1, 2.0), 5: (0, 0.0)}
    assert [r.entry_id for r in frontier.wave(one, ORDER(), 2).collect()] == [8, 2]


def test_empty(spark):
    none = entries(spark).limit(0)
    assert frontier.fresh(frontier.accepted(none), ORDER()).collect() == [] and frontier.domain_counts(none).collect() == []


def test_children(spark):
    df = spark.createDataFrame([("u", 0, ["a", None, ""]), ("v", 3, ["b"]), ("w", 0, None)], "url string, depth int, outlinks array<string>")
    assert [tuple(r) for r in frontier.children(df, 3).collect()] == [("a", 1, "u")]


def test_fetches(spark):
    rows = [(1, 200, "TEXT/HTML; charset=x", 10, None), (2, 200, None, None, ""), (3, 200, "image/png", 1, None), (4, 404, "text/html", 1, None), (5, 200, "text/html", 6 << 20, None), (6, 200, "text/html", 1, "reset"), (1, 200, "TEXT/HTML; charset=x", 10, None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "fetch_id bigint, status int, content_type string, body_bytes bigint, error string")
    assert sorted({r.fetch_id for r in frontier.usable_fetches(df).collect()}) == [1, 2]
    assert {r.status_class: (r.n, r.n_errors) for r in monitor.counters(df).collect()} == {"2xx": (5, 1), "4xx": (1, 0), "none": (1, 0)}


def test_monitor(spark):
    t = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame([(t + dt.timedelta(minutes=m), "k") for m in (1, 2, 11)] + [(None, "k")], "ts timestamp, kind string")
    assert sorted(r.n for r in monitor.trend(ev, "ts", 10, "kind").collect()) == [1, 2]
    lines = spark.createDataFrame([(i, "[ERROR] x" if i % 2 else "INFO: y") for i in range(40)], "line_no int, value string")
    assert [r.line_no for r in monitor.log_tail(lines, "ERROR", 3).collect()] == list(range(39, 20, -2))
    tasks = spark.createDataFrame([("a", "x", t, None, None, 5), ("b", "x", t, t + dt.timedelta(seconds=10), None, 5)], "id string, status string, started_at timestamp, finished_at timestamp, duration double, crawled bigint")
    assert {r.id: r.rate for r in monitor.task_rates(tasks).collect()} == {"a": None, "b": 0.5}


def test_one_domain_is_ranked_in_many_tasks(spark):
    rows = spark.range(3000).select(F.col("id").alias("entry_id"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("domain"), (F.col("id") * 7919 % 3000).cast("double").alias("priority")).repartition(6)
    got = {r.entry_id: r.slot for r in frontier.scheduled(rows, ORDER()).collect()}
    want = {}
    for domain in (None, "b", "hot"):
        own = [r for r in rows.collect() if r.domain == domain]
        want |= {r.entry_id: i for i, r in enumerate(sorted(own, key=lambda r: (r.priority, r.entry_id)))}
    assert got == want


def test_downloads_and_records(spark):
    rows = [(1, 200, None), (1, 200, None), (2, 200, "Blocked by robots.txt"), (3, 500, ""), (4, None, None)]
    df = spark.createDataFrame(rows, "fetch_id bigint, status int, error string")
    assert tuple(monitor.downloads(df).first()) == (4, 1, 2, 1) and tuple(monitor.downloads(df.limit(0)).first()) == (0, 0, 0, 0)
    t = dt.datetime(2025, 1, 1)
    schema = "id string, status string, started_at timestamp"
    history = spark.createDataFrame([(f"t{i}", "finished", t + dt.timedelta(hours=i)) for i in range(5)], schema)
    new = spark.createDataFrame([("t9", "finished", t + dt.timedelta(hours=9)), ("t3", "error", t + dt.timedelta(hours=3))], schema)
    assert [(r.id, r.status) for r in monitor.recorded(history, new, 3).collect()] == [("t9", "finished"), ("t4", "finished"), ("t3", "error")]
