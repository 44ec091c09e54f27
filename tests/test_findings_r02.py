"""What round 2 found: tables on which queries differed from their SQL, or grew too fast."""

import random

import duckdb
import pytest
from oracle import differences

from tesserax import plans
from tesserax.operators import spatial


@pytest.fixture
def check(spark, tmp_path):
    """A query against its SQL over one table of given rows."""

    def run(query, table, columns, rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"file:{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        return differences(plans.QUERIES[query](spark, f"file:{tmp_path}"), con, plans.ORACLES[query])

    return run


def test_level_hist_has_an_open_last_class(check):
    keys = [0, 127, 128, 32_767, 32_768, (1 << 23) - 1, 1 << 23, 9_000_000, 1 << 40, (1 << 63) - 1, None]
    assert check("q_rx_level_hist", "orders", "o_orderkey long", [(k,) for k in keys]) == ""


def test_lcp_of_pages_without_url(check):
    rows = [(1, "http://a/1"), (2, "http://b"), (3, None), (4, "http://a/12"), (5, "")]
    assert check("q_lcp", "pages", "page_id long, url string", rows) == ""


def test_lcp_of_equal_urls_goes_by_page_id(spark, tmp_path):
    rows = [(k, u) for u, ids in (("http://a", (9, 2, 5)), ("http://b", (8, 1)), (None, (7, 6))) for k in ids]
    spark.createDataFrame(rows, "page_id long, url string").repartition(3).write.parquet(f"file:{tmp_path}/pages.parquet")
    got = {r.page_id: r.n for r in plans.QUERIES["q_lcp"](spark, f"file:{tmp_path}").collect()}
    assert got == {5: 8, 9: 8, 1: 7, 8: 8, 6: 0}


def parts(seed):
    """Few different boxes with many rows each, repeated keys and rows without a size."""
    rng = random.Random(seed)
    rows = [(rng.randrange(40) + 1000 * rng.randrange(30), rng.choice([1, 2, 3, 7, 9, None]), "Brand#11") for _ in range(500)]
    return [*rows, (None, 3, "Brand#12"), (5, 1, "Brand#12"), (5, 1, "Brand#12")]


@pytest.mark.parametrize("query", ["q_rt_join_closed", "q_rt_fat_filter_refine"])
@pytest.mark.parametrize("per_list", [1024, 3])
def test_equal_boxes(check, monkeypatch, query, per_list):
    monkeypatch.setattr(spatial, "LIST", per_list)
    assert check(query, "part", "p_partkey long, p_size int, p_brand string", parts(3)) == ""


@pytest.mark.parametrize("query", ["q_rt_join_closed", "q_rt_fat_filter_refine"])
def test_equal_boxes_are_joined_once(spark, tmp_path, query):
    """The grid join sees one row per different box, however many rows have it."""
    spark.createDataFrame([(7 + 1000 * k, 5, "b") for k in range(300)], "p_partkey long, p_size int, p_brand string").write.parquet(f"file:{tmp_path}/part.parquet")
    seen = []
    real = spatial.join
    try:
        spatial.join = lambda left, right, *a, **k: seen.append((left.count(), right.count())) or real(left, right, *a, **k)
        plans.QUERIES[query](spark, f"file:{tmp_path}")
    finally:
        spatial.join = real
    assert seen == [(1, 1)]
