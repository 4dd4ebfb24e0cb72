import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillbook.llm import hard_negatives
from tillbook.llm.queries import ORACLES, QUERIES
from tillbook.plans.compare import compare



def plain(rows, positives=5, negatives=3):
    """The contract straight away; rows of (vec_id, label, vector), kept apart by their place."""
    held = []
    for i, (vec_id, label, vector) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            held.append((i, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    found = []
    for i, vec_id, label, vector in held:
        if vec_id is None or vec_id % 5:
            continue
        score = {j: sum(a * b for a, b in zip(vector, v, strict=False)) for j, _, _, v in held}
        order = sorted((r for r in held if r[0] != i), key=lambda r: (-score[r[0]], r[1] is None, r[1] or 0))
        for j, positive, _, _ in [r for r in order if r[2] == label][:positives]:
            p = score[j]
            fits = [r for r in order if r[2] != label and 50 * p <= 100 * score[r[0]] <= 95 * p]
            found += [(vec_id, positive, rank, r[1], p, score[r[0]]) for rank, r in enumerate(fits[:negatives], 1)]
    return sorted(found, key=repr)


def rows_of(seed, count, width=8, labels=3, step=0.125):
    random = np.random.default_rng(seed)
    grid = np.round(random.normal(size=(count, width)) / step) * step  # coarse, so that scores tie
    return [(i, int(random.integers(labels)), v.tolist()) for i, v in enumerate(grid)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, label int, embedding array<float>, row int, score string").select("vec_id", "embedding", "label", "row", "score")


def mined(spark, rows, **sizes):
    found = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, **sizes)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard": 7}, {"shard": 16, "components": 100}])
def test_negatives_equal_a_full_scan(spark, sizes):
    """With one shard, with shards far smaller than the table, with several blocks of anchors."""
    rows = rows_of(1, 200)
    assert mined(spark, rows, **sizes) == plain(rows)


def test_rows_that_take_no_part_and_ties(spark):
    base = rows_of(2, 60)
    odd = [
        (60, None, [1.0] * 8), (65, 1, None), (70, 1, [1.0, float("nan")] + [0.0] * 6), (75, 2, [None] + [0.5] * 7), (80, 0, [float("inf")] * 8),
        (85, 0, [0.0] * 8), (90, 1, []), (95, 1, [0.5, -0.5]), (None, 1, [0.5] * 8), (96, 2, [0.5] * 8), (96, 2, [0.5] * 8), (97, 7, [0.5] * 8),
    ]
    same = [(100 + i, i % 2, [0.25, 0.5, -0.5, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(50)]
    rows = base + odd + same
    assert mined(spark, rows, shard=16) == plain(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, None, [1.0])]) == []


def test_an_anchor_reads_only_as_far_as_its_windows_need():
    """Clustered rows: the anchor's own cluster is read, the rest is left unread."""
    random = np.random.default_rng(3)
    centre = np.concatenate(([[200, -200, 200]], random.integers(-150, 150, (19, 3))))
    matrix = np.repeat(centre, 100, 0) + random.integers(-8, 9, (2000, 3))
    shard = hard_negatives.Shard(np.arange(2000), np.arange(2000), np.repeat(np.arange(20), 100), matrix)
    best = hard_negatives.Best(5)
    scored = hard_negatives.search(shard, matrix[0], (shard.label == 0) & (shard.row != 0), [best])
    exact = sorted(((int(matrix[i] @ matrix[0]), -i) for i in range(1, 100)), reverse=True)[:5]
    assert sorted(((s, v) for s, v, _ in best.heap), reverse=True) == exact
    assert scored < 400


def test_threshold_bounds_every_unread_row():
    random = np.random.default_rng(4)
    matrix = random.integers(-50, 50, (300, 6))
    shard = hard_negatives.Shard(np.arange(300), np.arange(300), np.zeros(300, int), matrix)
    for anchor in random.integers(-50, 50, (20, 6)):
        unread = set(range(300))
        for new, score, threshold in shard.blocks(anchor):
            assert (score == matrix[new] @ anchor).all()
            unread -= set(new.tolist())
            assert threshold is None or all(matrix[i] @ anchor <= threshold for i in unread)
        assert not unread


def test_query_equals_its_sql(spark, sf_dir):
    name = "op12_threshold_negatives"
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) is None
