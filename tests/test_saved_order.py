"""A saved order against sorting the whole table."""

import random
import tempfile
from pathlib import Path

import pytest
from tillbook.operators.ordering import SavedOrder, page

SCHEMA = "g string, k int, id bigint, v string"


def rows_of(seed, count, first=0):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(40)]), first + i, f"v{i}") for i in range(count)]


def plain_page(rows, index, size):
    low = lambda r: (r[1] is not None, r[1] or 0, r[2])
    found = []
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=low)
        found += [(*r, n, len(own)) for n, r in enumerate(own, 1) if index * size < n <= (index + 1) * size]
    return sorted(found, key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("g", "k", "id", "v", "row_no", "total").collect()), key=repr)


@pytest.fixture
def saved(spark, many_blocks):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/order"
    return lambda data, blocks=12: SavedOrder.save(spark.createDataFrame(data, SCHEMA), folder, ["g"], ["k", "id"], blocks)


def test_pages_equal_those_of_a_full_sort_before_and_after_appends(spark, saved):
    data = rows_of(1, 500)
    order = saved(data)
    for more in ([], rows_of(2, 300, 1000), [(g, None, 5000 + i, "x") for i, g in enumerate(["a", None, "b", "0", "z"])], rows_of(3, 50, 9000)):
        if more:
            order.append(spark.createDataFrame(more, SCHEMA).repartition(3))
            data = data + more
        for index, size in ((0, 10), (3, 10), (7, 23), (0, 10_000)):
            assert rows(order.page(index, size)) == plain_page(data, index, size)
    full = spark.createDataFrame(data, SCHEMA)
    assert rows(order.page(2, 40)) == rows(page(full, ["g"], ["k", "id"], 2, 40))
    pages = {(r.id, r.page) for r in order.all_pages(7).collect()}
    assert len(pages) == len(data) and all(r[2:3] for r in data)


def test_a_page_reads_its_blocks_only_and_writes_nothing(spark, saved):
    order = saved([("a", i, i, "v") for i in range(1000)], 20)
    files = sorted(str(p) for p in Path(order.folder).rglob("*"))
    found = order.page(3, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("block" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert sorted(r.id for r in found.collect()) == list(range(30, 40))
    assert files == sorted(str(p) for p in Path(order.folder).rglob("*"))


def test_appending_touches_no_saved_file(spark, saved):
    order = saved(rows_of(4, 200))
    before = {p: p.read_bytes() for p in Path(order.folder).rglob("*.parquet")}
    order.append(spark.createDataFrame(rows_of(5, 100, 700), SCHEMA))
    assert all(p.read_bytes() == data for p, data in before.items())


def test_empty_orders(spark, saved):
    order = saved([])
    assert order.page(0, 5).count() == 0
    order.append(spark.createDataFrame([("a", 1, 1, "x"), (None, None, 2, "y")], SCHEMA))
    assert rows(order.page(0, 5)) == plain_page([("a", 1, 1, "x"), (None, None, 2, "y")], 0, 5)
