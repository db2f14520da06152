"""The queries of the ten problems on the smallest tables: those with SQL give its rows, the others what must hold."""

from pathlib import Path

import duckdb
import pytest

from lakesearch.llm import queries as llm
from test_queries import canonical

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_sql(spark, duck, name):
    got, want = llm.QUERIES[name](spark, str(FOLDER)).toPandas(), duck.sql(llm.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_problems_part_the_pages(spark):
    """No page is a case of 1 and 2, and none of either has furniture or an article."""
    rows = {n: {r.doc_id for r in llm.QUERIES[n](spark, str(FOLDER)).collect()} for n in ("p1_found", "p2_found", "p5_found", "p5_articles")}
    assert not rows["p1_found"] & rows["p2_found"]
    assert not (rows["p1_found"] | rows["p2_found"]) & (rows["p5_found"] | rows["p5_articles"])


def test_containers_hold(spark, duck):
    """No container is over its capacity, and no text that fits in one is split."""
    duck.register("packed", llm.QUERIES["p9_packed"](spark, str(FOLDER)).toPandas())
    over = duck.sql("select target_id, container_id, sum(n_tokens) from packed join pack_targets using (target_id) group by target_id, container_id, capacity having sum(n_tokens) > capacity").fetchall()
    split = duck.sql("select target_id, doc_id from packed join pack_targets using (target_id) group by target_id, doc_id, capacity having count(*) > 1 and sum(n_tokens) <= capacity").fetchall()
    assert over == [] and split == []
