"""Hard negatives against SQL and against all products in plain Python."""

import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.llm import negatives
from tidemark.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def _plain(rows, anchors, positives=5, negs=10):
    told = {
        (i, label, tuple(floor(256 * x) for x in v))
        for i, label, v in rows
        if i is not None and label is not None and v and all(x is not None and isfinite(x) for x in v)
    }
    out = []
    for a in told:
        if not anchors(a[0]):
            continue
        scores = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in told if b != a and len(b[2]) == len(a[2])]
        near = sorted((s, i) for s, i, label in scores if label == a[1])[:positives]
        for s, i in near:
            fits = sorted((t, j) for t, j, label in scores if label != a[1] and 30 * -s <= 100 * -t <= 90 * -s)[:negs]
            out += [(a[0], i, rank + 1, j, -s, -t) for rank, (t, j) in enumerate(fits)]
    return sorted(out)


def _got(frame):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


@pytest.mark.parametrize("kind", ["clustered", "long and short", "ties"])
def test_equal_to_all_products(spark, kind):
    draw, rows = random.Random(kind), []
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    for i in range(600):
        size = 10 ** draw.uniform(-2, 2) if kind == "long and short" else 1
        centre = centres[draw.randrange(8)]
        vector = [size * (x + draw.gauss(0, 0.1)) for x in centre]
        if kind == "ties":
            vector = [draw.randrange(-2, 3) / 2 for _ in range(6)]
        rows.append((i, draw.randrange(3), vector))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert _got(negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0)) == _plain(rows, lambda i: i % 20 == 0)


def test_rows_that_take_no_part_repeats_and_clashing_names(spark):
    draw = random.Random(2)
    rows = [(i, i % 2, [draw.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    rows += rows[:9] + [(None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0] * 3), (101, 1, None), (102, 1, []), (103, 0, [1.0, None, 2.0])]
    rows += [(104, 0, [1.0, float("nan"), 2.0]), (105, 1, [float("inf"), 0.0, 1.0]), (106, 0, [0.0] * 3), (110, 1, [0.0] * 3)]
    rows += [(i, 1, rows[3][2]) for i in range(120, 150)] + [(5, 0, [0.5, 0.25, -0.5]), (160, 1, [1.0, 2.0]), (170, 1, [2.0, 1.0]), (171, 0, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", mark int, chunk int")
    assert _got(negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)) == _plain(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") == 1).count() == 0
    with pytest.raises(Exception, match="component of 2"):
        negatives.hard_negatives(spark.createDataFrame([(1, 1, [2.0**20])], SCHEMA), F.lit(True)).collect()


def test_large_numbers_stay_exact(spark):
    draw = random.Random(3)
    rows = [(i, i % 3, [draw.randrange(2**27) / 256 for _ in range(4)]) for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert _got(negatives.hard_negatives(frame, F.col("vec_id") % 9 == 0)) == _plain(rows, lambda i: i % 9 == 0)


def test_feasible_ranges_hold_every_row_that_reaches_the_score_and_prune():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(20, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = (4096 * (centres[draw.integers(0, 20, 4000)] + draw.normal(scale=0.02, size=(4000, 8)))).astype(np.int64)
    anchor, listed = rows[17].astype(float), 0
    length = np.linalg.norm(anchor)
    scores, needed = rows @ rows[17], 0.97 * length * length
    seen = 0
    for bucket in negatives.buckets(rows.astype(float)):
        assert bucket.shortest >= negatives.ALIKE * bucket.longest or bucket.longest == 0
        good = {int(i) for i in bucket.at if scores[i] >= needed}
        cosine = bucket.angle(needed, length)
        if cosine > 1:
            assert not good
            continue
        near = bucket.feasible(anchor / length, cosine)
        found = set(bucket.at.tolist() if near is None else bucket.at[near].tolist())
        assert good <= found
        listed, seen = listed + len(found), seen + len(good)
    assert seen > 100 and listed < 1000


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_hard_negatives"](spark, folder), connect(folder), ORACLES["op12_hard_negatives"]) == []
