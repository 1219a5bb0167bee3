"""Nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.nearest import hilbert_keys, nearest

ROWS = "vec_id bigint, embedding array<float>, score string"


def asked():
    return F.col("vec_id") % 50 == 0


def _brute(rows, k):
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    told = {}
    for q in vectors:
        if q % 50 == 0:
            near = [(-(vectors[q] @ v) / math.sqrt((vectors[q] @ vectors[q]) * (v @ v)), i) for i, v in vectors.items() if i != q]
            told[q] = [(i, -s) for s, i in sorted((round(s, 9), i) for s, i in near)[:k]]
    return told


def test_hilbert_keys_visit_every_cell_by_single_steps():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(side, 3)
    assert sorted(keys) == list(range(512))
    path = side[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_and_scores_on_clustered_and_plain_vectors(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 24)) * 2
    rows = [(i, (centres[i % 20] + draw.normal(size=24)).tolist()) for i in range(1500)]
    got = nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], ROWS), asked()).collect()
    want = _brute(rows, 5)
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * 5 * len(want)
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in sorted(want) for k in range(1, 6)]
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for r in got:
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_copies_ties_and_unsound_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in (0, 50, 3, 4, 5, 6, 7, 8)] + [(100, [-1.0, 0.5, 0.0]), (0, same)]
    odd = [(9, None), (10, []), (11, [0.0, 0.0, 0.0]), (150, [1.0, None, 2.0]), (200, [1.0, float("nan"), 2.0]),
           (12, [1.0, float("inf"), 0.0]), (None, same), (13, [1.0, 2.0])]
    got = nearest(spark.createDataFrame([(i, v, None) for i, v in rows + odd], ROWS), asked()).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {0: [3, 4, 5, 6, 7], 50: [0, 3, 4, 5, 6], 100: [0, 3, 4, 5, 6]}


def test_few_candidates_and_empty_tables(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.5, 0.5], "")], ROWS)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(two, asked()).collect()] == [(0, 1, 1)]
    assert nearest(two.filter("vec_id = 0"), asked()).count() == 0
    assert nearest(two.limit(0), asked()).count() == 0
    assert nearest(two.filter("vec_id = 1"), asked()).count() == 0


def test_many_parallel_vectors_tie_to_the_smallest_ids(spark):
    """Multiples by powers of two have one and the same cosine, and are no copies of each other."""
    base = [3.0, -1.0, 2.0, 0.5]
    rows = [(50, base)] + [(i, [x * 2.0 ** (i % 25 - 12) for x in base]) for i in range(1, 31)] + [(40, [1.0, 1.0, 1.0, 1.0])]
    got = nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], ROWS), asked()).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
