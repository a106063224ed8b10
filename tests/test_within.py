"""Queries whose rows meet within an order deal their tables out once, by order, and join without a shuffle."""

import re

import duckdb
import pytest
from factories import SF
from parity import connect, difference

from tomewright.plans import registry
from tomewright.plans.queries import ORACLES, QUERIES

NAMES = ("q79_apply_edits", "q28_progress_counts", "q29_next_unread", "q27_rehome_precedence", "q30_read_through_prefix", "q108_implied_follows")


@pytest.fixture
def many_parts(spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_works_are_not_shuffled_again(spark, many_parts, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, 7\), REPARTITION_BY_NUM", plan)
    assert set(exchanges) == {"series_ordinal"} and "Bucketed: true" in plan
    assert len(exchanges) == plan.count(" Exchange ") - plan.count("Exchange rangepartitioning")


@pytest.mark.parametrize("name", NAMES)
def test_parts_agree_with_sql(spark, many_parts, name):
    assert difference(spark, connect(SF), QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", ["q79_apply_edits", "q108_implied_follows"])
def test_orders_without_a_customer(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when o_orderkey % 5 = 0 then null else o_custkey end as o_custkey) from '{SF}/orders.parquet' where o_orderkey < 40) to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"copy (select * from '{SF}/lineitem.parquet' where l_orderkey < 50) to '{tmp_path}/lineitem.parquet' (format parquet)")
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert difference(spark, con, QUERIES[name], ORACLES[name], str(tmp_path)) == ""
