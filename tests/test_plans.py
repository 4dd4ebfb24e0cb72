"""What the plans of the main operators look like."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tillbook.fixtures import Fixtures
from tillbook.operators import lookup, merges, nesting
from tillbook.plans import registry
from tillbook.sources import delimited


@contextlib.contextmanager
def settings(spark, **conf):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
TINY_SKEW = {
    **NO_BROADCAST,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "10KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(frame):
    return [line for line in plan(frame).splitlines() if "FileScan" in line]


def test_order_details_reads_only_its_columns(spark, sf_dir):
    text = frame = registry.queries()["order_details"](spark, sf_dir)
    lines = next(s for s in scans(frame) if "lineitem" in s)
    assert "l_discount" not in lines and "l_shipdate" not in lines
    assert not any("nation" in s or "region" in s for s in scans(text))


def test_bound_values_reach_the_scan(spark, sf_dir):
    offices = lookup.by_value(Fixtures(spark, sf_dir).table("nation"), "n_name", "NATION_3")
    assert "EqualTo(n_name,NATION_3)" in plan(offices)


def test_bucketed_lines_are_not_shuffled_by_order(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    delimited.save_bucketed(fx.order_lines, "bucketed_lines", "orderNumber", 8)
    with settings(spark, **NO_BROADCAST):
        frame = lookup.order_details(spark.table("bucketed_lines"), fx.products, fx.orders, fx.customers)
        assert plan(frame).count("Exchange hashpartitioning(orderNumber") == 1
        assert frame.count() == fx.order_lines.count()


@pytest.fixture(scope="module")
def hot(spark):
    """Ten thousand keys, one of which holds a third of 200k rows."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10_000)
    return spark.range(200_000).select(key.cast("bigint").alias("k"), F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("w"))


def test_a_hot_key_is_split_in_a_left_join(spark, hot):
    with settings(spark, **TINY_SKEW):
        table = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
        frame = lookup.attach(hot, table, "k", "x")
        rows = frame.collect()
        assert len(rows) == 200_000 and all(r.x == 2 * r.k for r in rows)
        assert "skew=true" in plan(frame)


def test_a_hot_key_is_split_in_the_order_join(spark, hot):
    lines = hot.select(
        F.col("k").alias("orderNumber"), (F.col("v") % 50).alias("productCode"), F.lit(1.0).alias("quantityOrdered"),
        F.col("w").alias("priceEach"),
    )
    orders = spark.range(10_000).select(F.col("id").alias("orderNumber"), (F.col("id") % 100).alias("customerNumber"))
    customers = spark.range(100).select(F.col("id").alias("customerNumber"), F.lit("c").alias("customerName"))
    products = spark.range(50).select(
        F.col("id").alias("productCode"), F.lit("p").alias("productName"), F.lit("i").alias("productImage")
    )
    with settings(spark, **TINY_SKEW):
        frame = lookup.order_details(lines, products, orders, customers)
        assert len(frame.collect()) == 200_000
        assert "skew=true" in plan(frame)


def test_repeated_keys_are_reduced_before_a_lookup(spark, hot):
    with settings(spark, **NO_BROADCAST):
        frame = lookup.by_key(spark.range(100).withColumnRenamed("id", "k"), hot, "k")
        text = plan(frame)
        assert text.index("LeftSemi") < text.index("HashAggregate")
        assert text.count("Exchange") == 2
        assert frame.count() == 100


def test_changes_of_a_hot_key_combine_before_the_shuffle(spark, hot):
    snapshot = spark.range(10_000).select(F.col("id").alias("k"), F.lit("old").alias("w"))
    frame = merges.merge_update(snapshot, hot, ["k"], ["w"], ["v"])
    assert "partial_max_by" in plan(frame)
    assert frame.where("changed").count() == hot.select("k").distinct().count()


def test_a_hot_parent_lies_in_several_partitions(spark, hot, many_blocks):
    """With broadcasts off: neither its children nor its chunks meet in one task."""
    parents = spark.range(10_001).withColumnRenamed("id", "k")
    with settings(spark, **TINY_SKEW):
        nested = nesting.nest(parents, hot, "k", ["v"], "items", max_bytes=4000)
        rows = nested.select("k", "chunk", F.size("items").alias("n"), F.spark_partition_id().alias("p")).collect()
    by_partition: dict = {}
    for r in rows:
        by_partition[r.p] = by_partition.get(r.p, 0) + (r.n if r.k == 0 else 0)
    total = hot.where("k = 0").count()
    assert sum(by_partition.values()) == total
    assert max(by_partition.values()) < total / 2
    assert [r.n for r in rows if r.k == 10000] == [0]
