"""Stored tables: what a change writes, what readers see, repeated batches."""

import hashlib
from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillbook.operators import merges
from tillbook.operators.snapshots import BUCKET, BucketedTable
from tillbook.session import work_path
from tillbook.streaming import sinks

REPLACE = partial(merges.replace_rows, keys=["k"])


def table_of(spark, rows, buckets=16):
    return BucketedTable.create(spark.createDataFrame(rows, "k bigint, v string"), work_path(spark, "table"), ["k"], buckets)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def files(table):
    root = Path(table.path.removeprefix("file:")) / "data"
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("*.parquet")}


def test_few_keys_write_few_buckets(spark):
    table = table_of(spark, [(k, "old") for k in range(2000)], 64)
    before = files(table)
    assert len({name.split("/")[1] for name in before}) == 64
    # Keys of another width fall into the same buckets.
    changes = spark.createDataFrame([(k, "new") for k in range(0, 100, 10)], "k int, v string")
    assert table.apply(changes, REPLACE) == 1
    after = files(table)
    assert {n: h for n, h in after.items() if n in before} == before
    assert 0 < len({name.split("/")[1] for name in after if name not in before}) <= 10
    assert dict(held(table)) == {k: "new" if k < 100 and k % 10 == 0 else "old" for k in range(2000)}


def test_null_keys_empty_tables_and_emptied_buckets(spark):
    table = table_of(spark, [])
    assert held(table) == []
    rows = spark.createDataFrame([(None, "a"), (1, None), (2, "b")], "k bigint, v string")
    table.apply(rows, REPLACE)
    table.apply(rows.where("k IS NULL").withColumn("v", F.lit("c")), REPLACE)
    assert held(table) == [(1, None), (2, "b"), (None, "c")]
    table.apply(rows.where("k = 2"), lambda old, gone: old.join(gone, "k", "left_anti"))
    assert held(table) == [(1, None), (None, "c")]
    table.apply(rows.where("false"), REPLACE)
    assert held(table) == [(1, None), (None, "c")]


def test_a_failed_change_leaves_the_table_and_can_be_repeated(spark):
    table = table_of(spark, [(k, "old") for k in range(100)])
    changes = spark.createDataFrame([(1, "new"), (2, "new")], "k bigint, v string")
    broken = F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="lost"):
        table.apply(changes, lambda old, new: REPLACE(old, new).withColumn("v", broken))
    assert table.version() == 0 and {v for _, v in held(table)} == {"old"}
    # As if the writer ended between the rows and the manifest.
    stray = Path(table.path.removeprefix("file:")) / "manifest" / "1"
    stray.mkdir()
    assert table.version() == 0
    table.apply(changes, REPLACE)
    assert table.version() == 1 and dict(held(table))[2] == "new" and len(held(table)) == 100


def test_a_merge_may_not_make_rows_elsewhere(spark):
    table = table_of(spark, [(k, "old") for k in range(100)])
    changes = spark.createDataFrame([(1, "new")], "k bigint, v string")
    with pytest.raises(ValueError, match="without a change"):
        table.apply(changes, lambda old, new: old.unionByName(spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v"))))
    assert table.version() == 0 and len(held(table)) == 100
    with pytest.raises(ValueError):
        BucketedTable.create(changes, table.path, ["k"])
    with pytest.raises(ValueError):
        BucketedTable.create(changes.withColumn(BUCKET, F.lit(1)), work_path(spark, "table"), ["k"])


def test_storage_does_not_grow_and_repeated_batches_are_left_out(spark):
    table = table_of(spark, [(k, "0") for k in range(200)], 8)
    counts, manifests = [], []
    for batch in range(6):
        changes = spark.createDataFrame([(k, str(batch)) for k in range(200)], "k bigint, v string")
        table.apply(changes, REPLACE, batch=batch)
        table.apply(changes.withColumn("v", F.lit("twice")), REPLACE, batch=batch)
        counts.append(len(files(table)))
        manifests.append(len(table._versions()))
    assert {v for _, v in held(table)} == {"5"}
    # The last version and the one before it.
    assert max(counts) <= 2 * 8 and max(manifests) == 2
    table.apply(spark.createDataFrame([(1, "late")], "k bigint, v string"), REPLACE, batch=3)
    assert {v for _, v in held(table)} == {"5"}


def test_a_stream_folds_its_batches_across_a_restart(spark):
    path, state = work_path(spark, "in"), work_path(spark, "state")
    table = BucketedTable.create(spark.createDataFrame([], "k bigint, n bigint"), work_path(spark, "table"), ["k"], 4)
    for run in range(3):
        for _ in range(2):
            spark.range(run, 20).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(path)
        counts = stream.groupBy("k").agg(F.count("*").alias("n"))
        # A new handle each time: all it knows is stored.
        query = sinks.fold_updates(counts, BucketedTable(spark, table.path), REPLACE, state)
        query.awaitTermination()
    assert table.version() == 6
    assert dict(held(table)) == {k: 2 * min(k + 1, 3) for k in range(20)}
