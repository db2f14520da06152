import random
import re

import pytest
from pyspark.sql import functions as F

from lakesearch.functions import urls
from lakesearch.llm import sitelines



def site():
    return urls.site(F.col("url"))


def normal(x):
    return re.sub("[ \t\r ]+", " ", x).strip(" ").lower()


def brute(rows):
    pages, seen = {}, {}
    for d, u, b in rows:
        if u is None or b is None or d is None:
            continue
        s = re.sub("^www\\.", "", re.sub(":\\d*$", "", u.split("/")[2].lower()))
        pages.setdefault(s, set()).add(d)
        for l in b.split("\n"):
            if normal(l):
                seen.setdefault((s, normal(l)), set()).add(d)
    good = {k for k, v in seen.items() if len(v) >= 4 and len(v) * 100 >= 5 * len(pages[k[0]])}
    out = set()
    for d, u, b in rows:
        if u is None or b is None or d is None:
            continue
        s = re.sub("^www\\.", "", re.sub(":\\d*$", "", u.split("/")[2].lower()))
        out |= {(d, i) for i, l in enumerate(b.split("\n"), 1) if (s, normal(l)) in good}
    return out


def pages(seed):
    random.seed(seed)
    rows = []
    for d in range(300):
        url = random.choice(["https://big.example/", "HTTP://www.BIG.example:80/x", "https://big.example/", "https://s%d.example/" % random.randrange(12), None])
        body = [f"own {d}", random.choice(["Share  This\r", "share this ", "SHARE THIS", "other"]), f"part {random.randrange(25)}", "", " \t "]
        random.shuffle(body)
        rows.append((d, url, None if d % 40 == 7 else "\n".join(body)))
    return rows + [(300, "https://big.example/", ""), (301, "https://big.example/", "\n\n"), (302, "https://big.example/", "y" * 200_000 + "\nshare this")]


@pytest.mark.parametrize("tracked", [None, 8])
def test_found_and_cleaned(spark, monkeypatch, tracked):
    if tracked:  # summaries too small to be sure: the exact way
        monkeypatch.setattr(sitelines, "TRACKED", tracked)
    rows = pages(3)
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, url string, body string, site string").repartition(5)
    want = brute(rows)
    got = [tuple(r) for r in sitelines.found(df, "doc_id", site(), "body").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    clean = {r.doc_id: r.body for r in sitelines.cleaned(df, "doc_id", site(), "body").collect()}
    for d, _, b in rows:
        kept = None if b is None else "\n".join(l for i, l in enumerate(b.split("\n"), 1) if (d, i) not in want)
        assert clean[d] == kept




def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, url string, body string")
    assert sitelines.found(df, "doc_id", site(), "body").collect() == [] and sitelines.cleaned(df, "doc_id", site(), "body").collect() == []
