"""Hand-computed statistics and agreement with a plain second implementation."""

import math
import random
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import student
from tidemark.operators import ranking, resampling, scoring, uncertainty

DIFFERENCES = [0.14, 0.02, 0.16, 0.05, 0.08]


def pairs(spark, differences, repeats=1):
    rows = [
        ("m", "c", r, f, 0.5 + d, 0.5) for r in range(repeats) for f, d in enumerate(differences)
    ]
    return spark.createDataFrame(
        rows, "model string, control string, repeat int, fold int, left double, right double"
    )


@pytest.mark.parametrize("repeats, expected", [(1, 0.08594), (10, 0.00215)])
def test_corrected_p_value(spark, repeats, expected):
    row = uncertainty.paired_difference(pairs(spark, DIFFERENCES, repeats), ["model"]).head()
    assert row["p_value"] == pytest.approx(expected, abs=5e-6)
    assert row["margin"] == pytest.approx(0.09)
    assert (row["agreeing"], row["folds"]) == (5 * repeats, 5 * repeats)
    assert row["low"] < row["margin"] < row["high"]


def test_no_spread_has_no_p_value(spark):
    row = uncertainty.paired_difference(pairs(spark, [0.25] * 5), ["model"]).head()
    assert row["p_value"] is None and row["low"] == row["high"] == row["margin"] == 0.25
    assert row["agreeing"] == 5
    described = uncertainty.describe_margin(
        uncertainty.paired_difference(pairs(spark, [0.25] * 5), ["model"])
    ).head()
    assert "untested" in described["verdict"] and not described["resolved"]
    row = uncertainty.paired_difference(pairs(spark, [0.0] * 5), ["model"]).head()
    assert row["p_value"] == 1.0 and row["agreeing"] == 0


def test_one_fold_is_refused(spark):
    with pytest.raises(PySparkException, match="two shared folds"):
        uncertainty.paired_difference(pairs(spark, [0.1]), ["model"]).collect()


def test_unmatched_folds_are_refused(spark):
    left = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "repeat int, fold int, score double")
    right = left.filter("fold = 0")
    with pytest.raises(PySparkException, match="same folds"):
        uncertainty.matched_folds(left, right).collect()


def test_repeats_pair_only_where_both_ran(spark):
    scores = spark.createDataFrame(
        [("a", 0, f, 0.5) for f in range(5)]
        + [("z", r, f, 0.4) for r in range(10) for f in range(5)],
        "model string, repeat int, fold int, score double",
    )
    wanted = spark.createDataFrame([("a", "z")], "model string, control string")
    assert uncertainty.shared_folds(scores, wanted).count() == 5


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.01, 0.02, 0.03, 0.04, 0.05], [0.05] * 5),
        ([0.01, 0.01, 0.5], [0.015, 0.015, 0.5]),
        ([0.01, None, 0.5], [0.02, None, 0.5]),
        ([None, None], [None, None]),
    ],
)
def test_step_up(spark, values, expected):
    frame = spark.createDataFrame(list(enumerate(values)), "id int, p_value double")
    got = [r["q_value"] for r in uncertainty.benjamini_hochberg(frame).orderBy("id").collect()]
    assert [g if g is None else round(g, 12) for g in got] == expected


def test_step_up_on_many_values_with_a_hot_tie(spark):
    random.seed(3)
    values = [1.0 if i % 3 == 0 else random.random() ** 3 for i in range(4000)]
    frame = spark.createDataFrame(list(enumerate(values)), "id int, p_value double").repartition(16)
    order = np.argsort(values, kind="stable")
    scaled = np.array(values)[order] * len(values) / np.arange(1, len(values) + 1)
    wanted = np.empty(len(values))
    wanted[order] = np.minimum(np.minimum.accumulate(scaled[::-1])[::-1], 1.0)
    got = {r["id"]: r["q_value"] for r in uncertainty.benjamini_hochberg(frame).collect()}
    assert np.allclose([got[i] for i in range(len(values))], wanted, rtol=0, atol=1e-15)


def test_student_t_against_known_points():
    # Published two-sided 95% points.
    for degrees, point in ((1, 12.706204736), (4, 2.776445105), (14, 2.144786688), (49, 2.009575237)):
        assert student.quantile(0.975, degrees) == pytest.approx(point, abs=1e-8)
        assert student.tail(point, degrees) == pytest.approx(0.025, abs=1e-10)
    assert 0 < student.tail(60.0, 49) < 1e-40


def _auc(labels, scores):
    wins = [
        1.0 if a > b else 0.5 if a == b else 0.0
        for a, x in zip(scores, labels)
        if x
        for b, y in zip(scores, labels)
        if not y
    ]
    return sum(wins) / len(wins)


def _precision(labels, scores):
    total, area, last = sum(labels), 0.0, 0.0
    for cut in sorted(set(scores), reverse=True):
        above = [x for x, s in zip(labels, scores) if s >= cut]
        area += (sum(above) / total - last) * sum(above) / len(above)
        last = sum(above) / total
    return area


def _ranked(spark, rows, n_classes):
    frame = spark.createDataFrame(
        [("m", i, label, probs) for i, (label, probs) in enumerate(rows)],
        "model string, item_id int, label int, probs array<double>",
    )
    return scoring.ranking_metrics(frame, ["model"], n_classes).head()


@pytest.mark.parametrize("present, n_classes", [((0, 1, 2), 3), ((0, 2, 3), 4), ((1, 2), 3), ((0, 1), 2)])
def test_ranking_against_brute_force(spark, present, n_classes):
    random.seed(11)
    rows = []
    for _ in range(90):
        raw = [random.randint(0, 4) for _ in range(n_classes)]
        total = sum(raw) or 1
        rows.append((random.choice(present), [r / total for r in raw]))
    row = _ranked(spark, rows, n_classes)
    kept = []
    for label, probs in rows:
        # Left to right, without the compensation of the built-in sum: ties must stay ties.
        total = reduce(add, [probs[k] for k in present], 0.0)
        kept.append([probs[k] / total if total > 0 else 1 / len(present) for k in present])
    full = len(present) == n_classes and len(present) > 2
    aucs = [
        _auc([label == k for label, _ in rows], [p[k] if full else q[i] for (_, p), q in zip(rows, kept)])
        for i, k in enumerate(present)
    ]
    aps = [_precision([label == k for label, _ in rows], [p[k] for _, p in rows]) for k in present]
    expected = aucs[1] if len(present) == 2 else sum(aucs) / len(aucs)
    assert row["roc_auc_ovr_macro"] == pytest.approx(expected, abs=1e-12)
    assert row["average_precision_macro"] == pytest.approx(sum(aps) / len(aps), abs=1e-12)


def test_ranking_is_undefined_on_one_class(spark):
    row = _ranked(spark, [(1, [0.2, 0.8]), (1, [0.6, 0.4])], 2)
    assert row["roc_auc_ovr_macro"] is None and row["average_precision_macro"] is None


def counts(spark, rows):
    return spark.createDataFrame(rows, "model string, label int, prediction int, n long")


def test_count_metrics_by_hand(spark):
    frame = counts(spark, [("m", 0, 0, 3), ("m", 0, 1, 1), ("m", 1, 1, 2)])
    row = scoring.count_metrics(frame, ["model"], 3).head()
    f0, f1 = 6 / 7, 4 / 5
    assert row["accuracy"] == pytest.approx(5 / 6)
    assert row["macro_f1"] == pytest.approx((f0 + f1) / 3)
    assert row["weighted_f1"] == pytest.approx((4 * f0 + 2 * f1) / 6)
    scored = frame.withColumn("present", F.array(F.lit(0), F.lit(1)))
    row = scoring.count_metrics(scored, ["model"], 3, scored="present").head()
    assert row["macro_f1"] == pytest.approx((f0 + f1) / 2)


def test_long_metrics_agree_with_the_tables(spark):
    rows = [("m", 0, f, i, i % 3, (i * i + f) % 3) for f in range(2) for i in range(30)]
    frame = spark.createDataFrame(
        rows, "model string, repeat int, fold int, item_id int, label int, prediction int"
    )
    metrics = scoring.score_folds(frame, ["x", "y", "z"], ranking=False)
    got = {(r["fold"], r["metric"]): r["value"] for r in metrics.collect()}
    keys = ["model", "repeat", "fold"]
    table = scoring.per_class(scoring.confusion_counts(frame, keys), keys, ["x", "y", "z"])
    for r in table.collect():
        for name in ("precision", "recall", "f1", "support"):
            assert got[r["fold"], f"{name}_{r['class']}"] == pytest.approx(r[name])
    assert len(got) == 2 * (4 + 12)


def test_an_item_counts_once_however_many_windows(spark):
    rows = [("m", 0, 0, "a", "g", "x", 0, [0.9, 0.1])] + [
        ("m", 0, 0, "b", "g", "y", 1, [0.6, 0.4]) for _ in range(15)
    ]
    frame = spark.createDataFrame(
        rows,
        "model string, repeat int, fold int, item_id string, group_id string, class string, "
        "label int, probs array<double>",
    )
    rolled = scoring.roll_up_windows(frame, 2)
    assert rolled.count() == 2
    metrics = scoring.score_folds(rolled, ["x", "y"], ranking=False).filter("metric = 'accuracy'")
    assert metrics.head()["value"] == 0.5


def bootstrap_rows(spark, groups=20, each=10):
    random.seed(5)
    rows = []
    for g in range(groups):
        label, right = g % 2, random.random() < 0.75
        for i in range(each):
            p = 0.8 if (label == 1) == right else 0.2
            rows.append(("m", f"{g}-{i:02d}", g, label, [1 - p, p], int(p > 0.5)))
    return spark.createDataFrame(
        rows,
        "model string, item_id string, group_id int, label int, probs array<double>, prediction int",
    )


def materialised(frame, draws, key="group_id"):
    """Every resample of a frame as the rows it drew, by plain loops."""
    rows = frame.collect()
    names = sorted({r[key] for r in rows})
    for times in draws:
        yield [r for r in rows for _ in range(times[names.index(r[key])])]


@pytest.mark.parametrize("block", [1 << 15, 6])
def test_bootstrap_by_additivity_equals_materialised_resamples(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    frame = bootstrap_rows(spark)
    seed, resamples = 3, 40
    # The tasks have the module's own block, so several blocks are summed here.
    times = resampling.group_times(20, 0, resamples, resamples, seed)
    assert (times.sum(axis=1) == 20).all()
    cells = [(0, 20, g, g % 2, 1 + g) for g in range(20)]
    if block == 1 << 15:
        found = uncertainty.cluster_bootstrap(frame, 2, resamples=resamples, seed=seed).head()
        estimates = []
        for rows in materialised(frame, times):
            f1 = []
            for k in (0, 1):
                hit = sum(r["label"] == k == r["prediction"] for r in rows)
                seen = sum((r["label"] == k) + (r["prediction"] == k) for r in rows)
                f1.append(2 * hit / seen if seen else 0.0)
            estimates.append(sum(f1) / 2)
        low, high = np.percentile(estimates, [2.5, 97.5])
        assert (found["low"], found["high"]) == (pytest.approx(low), pytest.approx(high))
    want = {}
    for b, row in enumerate(times):
        for _, _, g, cell, n in cells:
            want[b, cell] = want.get((b, cell), 0) + int(row[g]) * n
    got = {}
    for part in {g // block for _, _, g, _, _ in cells}:
        for first in range(0, resamples, resampling.PART):
            mine = [c for c in cells if c[2] // block == part]
            columns = dict(zip(["slice", "groups", "draw", "cell", "n"], map(list, zip(*mine))))
            table = pa.table({**columns, "block": [part] * len(mine), "first": [first] * len(mine)})
            for r in resampling._summed(resamples, seed)(table).to_pylist():
                got[r["resample"], r["cell"]] = got.get((r["resample"], r["cell"]), 0) + r["n"]
    assert got == {k: n for k, n in want.items() if n}


def test_draws_over_blocks_are_a_multinomial(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 8)
    groups, resamples = 45, 4000
    times = resampling.group_times(groups, 0, resamples, resamples, 11)
    assert (times.sum(axis=1) == groups).all()
    # Each count is binomial: mean 1, variance 1 - 1/G; two counts covary by -1/G.
    assert times.mean(axis=0) == pytest.approx(1, abs=0.08)
    assert times.var(axis=0).mean() == pytest.approx(1 - 1 / groups, abs=0.02)
    covariance = np.cov(times.T)
    assert (covariance.sum() - np.trace(covariance)) / (groups * (groups - 1)) == pytest.approx(-1 / groups, abs=0.003)
    some = resampling.group_times(groups, 100, 200, resamples, 11)
    assert (some == times[100:200]).all()
    assert (resampling.group_times(groups, 0, resamples, resamples, 12) != times).any()


@pytest.mark.parametrize("metric", ["roc_auc_ovr_macro", "average_precision_macro"])
def test_ranking_bootstrap_equals_rescored_resamples(spark, metric, monkeypatch):
    """A rare class is missing from many resamples: its scores are then dropped."""
    draw = random.Random(8)
    rows = []
    for g in range(12):
        for i in range(draw.randrange(1, 30)):
            p = [draw.randrange(1, 9) for _ in range(3)]
            label = 2 if g == 5 else draw.randrange(2)
            rows.append(("m", f"{g}-{i:02d}", g, label, [x / sum(p) for x in p], 0))
    frame = spark.createDataFrame(
        rows, "model string, item_id string, group_id int, label int, probs array<double>, prediction int"
    )
    resamples, seed = 60, 5
    found = uncertainty.cluster_bootstrap(frame, 3, metric=metric, resamples=resamples, seed=seed).head()
    times = resampling.group_times(12, 0, resamples, resamples, seed)
    assert len({bool(t[5]) for t in times}) == 2
    copies = [
        (str(b), f"{at}", r["label"], r["probs"])
        for b, drawn in enumerate(materialised(frame, times))
        for at, r in enumerate(drawn)
    ]
    rescored = spark.createDataFrame(copies, "model string, item_id string, label int, probs array<double>")
    each = [r[metric] for r in scoring.ranking_metrics(rescored, ["model"], 3).collect()]
    low, high = np.percentile([x for x in each if x is not None], [2.5, 97.5])
    assert (found["low"], found["high"]) == (pytest.approx(low), pytest.approx(high))


def test_chunks_end_where_a_score_ends(spark, monkeypatch):
    """Many small chunks with long ties give the areas of one sort."""
    draw = np.random.default_rng(2)
    score, hit = draw.integers(0, 40, 5000) / 8.0, draw.integers(0, 2, 5000)
    packed = []
    monkeypatch.setattr(ranking, "CHUNK", 100)
    for single in (True, False):
        packer, chunks = ranking._Packer(single), []
        order = np.argsort(-score, kind="stable")
        for part in np.array_split(order, 37):
            chunks += packer.add((1, 0), [score[part], part.astype(np.int32), hit[part], 1 - hit[part]])
        chunks += packer.flush()
        pos = np.concatenate([np.add.reduceat(c[3], np.concatenate([[0], c[5][:-1]])) for c in chunks])
        packed.append(pos.tolist())
        assert len(chunks) > 1
    levels = sorted(set(score), reverse=True)
    assert packed[0] == packed[1] == [int(hit[score == level].sum()) for level in levels]


def test_slices_with_different_classes_in_one_bootstrap(spark):
    two = bootstrap_rows(spark).withColumn("classes", F.lit(2))
    five = two.withColumn("model", F.lit("five")).withColumn("classes", F.lit(5))
    got = {r["model"]: r for r in uncertainty.cluster_bootstrap(two.unionByName(five), "classes", resamples=30).collect()}
    alone = uncertainty.cluster_bootstrap(two.drop("classes"), 2, resamples=30).head()
    assert got["m"].asDict() == alone.asDict()
    for name in ("estimate", "low", "high"):
        assert got["five"][name] == pytest.approx(alone[name] * 2 / 5)


def test_bootstrap_over_items_is_narrower(spark):
    both = uncertainty.bootstrap_unit_contrast(bootstrap_rows(spark), 2, resamples=60, seed=1).head()
    assert both["ratio"] > 1.5 and (both["groups"], both["items"]) == (20, 200)


def test_bootstrap_is_repeatable_and_needs_two_groups(spark):
    frame = bootstrap_rows(spark)
    once, again = (
        uncertainty.cluster_bootstrap(f, 2, resamples=30, seed=9).head()
        for f in (frame, frame.repartition(13))
    )
    assert once == again
    with pytest.raises(Exception, match="two or more of them"):
        uncertainty.cluster_bootstrap(frame.filter("group_id = 0"), 2, resamples=5).collect()


def test_precision_of_tables(spark):
    from tidemark.sources.results import rounded_table

    frame = spark.createDataFrame(
        [(1, 7.654321e-17, 0.12345678949, "x"), (2, 0.0, 1 / 3, "y")],
        "id int, p_value double, margin double, name string",
    )
    first, second = rounded_table(frame).orderBy("id").collect()
    assert first["p_value"] == pytest.approx(7.65432e-17, rel=1e-9)
    assert first["margin"] == 0.1234567895 and first["name"] == "x"
    assert second["p_value"] == 0.0 and math.isclose(second["margin"], 0.3333333333, abs_tol=0)


def test_splits_without_a_score_do_not_count(spark):
    rows = [("m", "c", 0, f, s, 0.5) for f, s in enumerate([0.6, 0.7, None, 0.65])]
    frame = spark.createDataFrame(rows, "model string, control string, repeat int, fold int, left double, right double")
    row = uncertainty.paired_difference(frame, ["model"]).head()
    same = uncertainty.paired_difference(frame.filter("left is not null"), ["model"]).head()
    assert row["folds"] == 3 and row == same


def test_pairs_without_a_shared_split_and_missing_metrics_are_refused(spark):
    scores = spark.createDataFrame([("m", 0, 0, 0.5), ("c", 0, 1, 0.4)], "model string, repeat int, fold int, score double")
    wanted = spark.createDataFrame([("m", "c")], "model string, control string")
    with pytest.raises(PySparkException, match="no split scored both m and c"):
        uncertainty.shared_folds(scores, wanted).collect()
    metrics = spark.createDataFrame([("m", 0, "accuracy", 0.5)], "model string, fold int, metric string, value double")
    with pytest.raises(Exception, match="macro_f1"):
        uncertainty.fold_scores(metrics)


def test_ranking_in_buckets_is_exact(spark, monkeypatch):
    """Views cut into buckets and merged from runs give the areas of one sort, ties and absent classes included."""
    rows = []
    for i in range(3000):
        p = [(i * 7919 % 97) / 97, (i * 104729 % 89) / 89, (i * 31 % 11) / 11]
        rows.append(("m", i % 2, i // 2 % (3 if i % 2 else 2), p))
    frame = spark.createDataFrame(rows, "model string, fold int, label int, probs array<double>")

    def scores():
        found = scoring.ranking_metrics(frame, ["model", "fold"], 3).orderBy("fold").collect()
        return [(row["fold"], row["roc_auc_ovr_macro"], row["average_precision_macro"]) for row in found]

    def plain(fold):
        own = [(label, p) for _, f, label, p in rows if f == fold]
        present = sorted({label for label, _ in own})
        aucs, aps = [], []
        for k in present:
            share = [p[k] if len(present) == 3 else (p[k] / sum(p[j] for j in present) if sum(p[j] for j in present) else 0.5) for _, p in own]
            pos = np.array([s for s, (label, _) in zip(share, own) if label == k])
            neg = np.array([s for s, (label, _) in zip(share, own) if label != k])
            if len(present) > 2 or k == present[1]:
                aucs.append(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg))
            hits = np.array([p[k] for label, p in own if label == k])
            every = np.array([p[k] for _, p in own])
            aps.append(np.mean([(hits >= s).sum() / (every >= s).sum() for s in hits]))
        return np.mean(aucs), np.mean(aps)

    whole = scores()
    monkeypatch.setattr(ranking, "BUCKET", 256)
    monkeypatch.setattr(ranking, "PLACING", 128)
    parted = scores()
    for (fold, *one), (_, *other) in zip(whole, parted):
        assert one == pytest.approx(plain(fold)) and other == pytest.approx(plain(fold))


def test_quantiles_that_recur_are_found_once(monkeypatch):
    asked = []
    whole = student.tail
    monkeypatch.setattr(student, "tail", lambda t, v: asked.append(len(t)) or whole(t, v))
    p, v = np.tile([0.5, 0.6, 0.975], 100), np.tile([2.0, 4.0, 14.0], 100)
    found = student.quantile(p, v)
    assert max(asked) == 3
    assert found[:3] == pytest.approx([0.0, 0.2707223, 2.1447867]) and (found.reshape(-1, 3) == found[:3]).all()


def test_fraction_has_the_terms_it_needs():
    t = np.linspace(0.01, 30, 500)
    for v in (1.0, 2.0, 14.0, 40.0, 400.0, 1500.0):
        a, x = np.full(len(t), v / 2), v / (v + t * t)
        near = x <= (a + 1) / (a + 2.5)
        a, x = np.append(a[near], 0.5), np.append(x[near], 0.4 / (1 + v))
        b = np.append(np.full(near.sum(), 0.5), v / 2)
        value = np.zeros_like(x)
        for m in range(600, 0, -1):
            half = m // 2
            step = half * (b - half) * x if m % 2 == 0 else -(a + half) * (a + b + half) * x
            value = step / ((a + m - 1) * (a + m)) / (1.0 + value)
        assert student._fraction(a, b, x) == pytest.approx(1 / (1 + value), rel=1e-13)


@pytest.mark.parametrize("groups", [40_000, 150_000])
def test_draws_of_many_groups_are_the_digests_of_their_numbers(groups):
    """As the oracle has it: draw d of resample b is a digest of 65536 b + d, however many groups there are."""
    resamples, seed = 4, 7
    salt = int(resampling.finish(np.array([seed * resampling.SEEDED & 0xFFFFFFFF], dtype=np.uint32))[0])
    times = resampling.group_times(groups, 0, resamples, resamples, seed)
    for b in range(resamples):
        x = ((b * 65536 + np.arange(groups, dtype=np.uint64)) & 0xFFFFFFFF) ^ salt
        for shift, factor in ((16, resampling.FIRST), (13, resampling.SECOND)):
            x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFF
        assert (times[b] == np.bincount(((x ^ (x >> 16)) % groups).astype(int), minlength=groups)).all()
    draw = np.random.default_rng(4)
    rows = {"draw": np.arange(groups), "cell": draw.integers(0, 5, groups), "n": draw.integers(1, 4, groups)}
    got = np.zeros((resamples, 5), int)
    table = pa.table({**rows, **{k: np.full(groups, v) for k, v in (("slice", 0), ("groups", groups), ("block", 0), ("first", 0))}})
    for r in resampling._summed(resamples, seed)(table).to_pylist():
        got[r["resample"], r["cell"]] += r["n"]
    for b in range(resamples):
        assert (got[b] == np.bincount(rows["cell"], weights=times[b] * rows["n"], minlength=5)).all()


@pytest.mark.parametrize("metric", [ranking.AUC_NAME, ranking.AP_NAME])
def test_chunks_of_a_batch_share_their_draws(monkeypatch, metric):
    """The resamples are drawn once a batch, and pairs between its chunks are counted."""
    draw = np.random.default_rng(6)
    groups, n, per = 30, 400, 100
    unit, pos = draw.integers(0, groups, n).astype(np.int32), draw.integers(0, 3, n)
    neg, ends = draw.integers(0, 2, n) + (pos == 0), np.arange(4, per + 1, 4).astype(np.int32)
    rows = [
        {"view": 0, "k": 0, "seq": at, "unit": unit[low : low + per], "pos": pos[low : low + per], "neg": neg[low : low + per],
         "ends": ends, "groups": groups, "resamples": np.arange(50, dtype=np.int32)}
        for at, low in enumerate(range(0, n, per))
    ]
    batch = pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows])
    asked, whole = [], ranking.resample_slices
    monkeypatch.setattr(ranking, "resample_slices", lambda *a: asked.append(a) or whole(*a))
    found = [r for part in ranking._sums(ranking.Draws(50, 3), metric)(iter([batch])) for r in part.to_pylist()]
    assert len(asked) == 1 and len(found) == (50 if metric == ranking.AUC_NAME else 200)
    times = resampling.group_times(groups, 0, 50, 50, 3)
    for b in range(50):
        p, q = ((times[b][unit] * x).reshape(-1, 4).sum(axis=1) for x in (pos, neg))
        own = [r for r in found if r["resample"] == b]
        assert (sum(r["pos"] for r in own), sum(r["neg"] for r in own)) == (p.sum(), q.sum())
        if metric == ranking.AUC_NAME:
            assert own[0]["won"] == (q * (np.cumsum(p) - p / 2)).sum()


def test_leaking_groups_sort_parts_and_not_items(spark):
    from tidemark.operators.splits import leaking_groups

    rows = [(0, f, g, p) for f in (0, 1) for g in range(6) for p in ["train"] * 5 + ["test"] * (g == 3 and f)] + [(0, 0, 9, None)]
    folds = spark.createDataFrame(rows, "repeat int, fold int, group_id long, part string")
    found = leaking_groups(folds)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 3, "test", "train")]
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    # The aggregate next to the rows is one of hashes.
    assert "HashAggregate" in [line for line in plan if "Aggregate" in line][-1]


def test_draws_of_a_task_do_not_grow_with_the_groups(monkeypatch):
    made, whole = [], resampling.drawn
    monkeypatch.setattr(resampling, "drawn", lambda a, b, g, seed: made.append(b - a) or whole(a, b, g, seed))
    asked = []
    for groups in (150_000, 600_000):
        one = {"slice": 0, "groups": groups, "draw": 5, "cell": 1, "n": 1, "block": 0, "first": 0}
        resampling._summed(40, 7)(pa.Table.from_pylist([one]))
        asked.append(sum(made))
        made.clear()
    assert max(asked) <= 2 * (40 + 10) * resampling.STRIDE


def test_resamples_of_many_groups_share_no_draws():
    """Draw d of resample b is a digest of its own number of 64 bits, as the oracle of U7 and U11 has it."""
    groups, seed, resamples = 150_000, 7, 3
    times = resampling.group_times(groups, 0, resamples, resamples, seed, True)
    for b in range(resamples):
        first = [next(resampling.own_draws(b, groups, seed))[d] for d in (0, 1, 9999)]
        for d, drawn in zip((0, 1, 9999), first):
            x = ((b << 32) + d) ^ resampling.wide_salt(seed)
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
            assert drawn == (((x ^ (x >> 31)) >> 32) * groups) >> 32
    assert (times.sum(axis=1) == groups).all() and times.var(axis=1) == pytest.approx(1, abs=0.02)
    assert np.corrcoef(times) == pytest.approx(np.eye(resamples), abs=0.01)
    # Blocks of two slices summed in one task, each to its own cells.
    draw = np.random.default_rng(4)
    rows = {
        "slice": np.repeat([4, 9], groups), "draw": np.tile(np.arange(groups), 2),
        "cell": draw.integers(0, 5, 2 * groups), "n": draw.integers(1, 4, 2 * groups),
    }
    table = pa.table({**rows, **{k: np.full(2 * groups, v) for k, v in (("groups", groups), ("block", 0), ("first", 0))}})
    got = {(r["slice"], r["resample"], r["cell"]): r["n"] for r in resampling._summed(resamples, seed, True)(table).to_pylist()}
    for own in (4, 9):
        at = rows["slice"] == own
        for b in range(resamples):
            want = np.bincount(rows["cell"][at], weights=times[b] * rows["n"][at], minlength=5)
            assert [got[own, b, k] for k in range(5)] == want.tolist()


def test_bootstrap_draws_its_own_unless_told_to_share(spark, monkeypatch):
    told = []
    monkeypatch.setattr(uncertainty, "resampled_counts", lambda *a: told.append(a[3]) or resampling.resampled_counts(*a))
    for settings in ({}, {"shared": True}):
        uncertainty.cluster_bootstrap(bootstrap_rows(spark), 2, resamples=4, **settings).collect()
    assert told == [True, False] and ranking.Draws(4, 1).own


@pytest.mark.parametrize("most, levels", [(1, 5000), (1, 40), (3, 300), (500, 300)])
def test_pairs_are_those_of_plain_sums(most, levels):
    """With ties, with rows that count more than once, and past what two bytes hold."""
    draw = np.random.default_rng(most)
    n, groups = 5000, 70
    score = np.sort(draw.integers(0, levels, n))
    ends = np.flatnonzero(np.append(np.diff(score), 1)) + 1
    unit, pos, neg = draw.integers(0, groups, n).astype(np.int32), draw.integers(0, most + 1, n), draw.integers(0, most + 1, n)
    times = resampling.group_times(groups, 0, 30, 30, 1).astype(np.uint8)
    found = ranking._Pairs(unit, pos, neg, ends).sums(np.ascontiguousarray(times.T), int(times.max()))
    for b, row in enumerate(times):
        p, q = (np.add.reduceat(row[unit].astype(int) * x, np.append(0, ends[:-1])) for x in (pos, neg))
        assert [x[b] for x in found] == [(q * (np.cumsum(p) - p / 2)).sum(), p.sum(), q.sum()]


def test_runs_keep_scores_as_steps():
    """Any falling scores come back as they were, and those of a grid take few bytes."""
    draw = np.random.default_rng(3)
    odd = np.array([np.inf, 1e300, 1.0, 5e-324, 0.0, -5e-324, -2.5, -np.inf])
    grid = np.unique(draw.integers(0, 1 << 20, 8000))[::-1] / (1 << 20)
    for score in (odd, odd[:1], grid, np.sort(draw.normal(size=500))[::-1].copy()):
        assert ranking._heard_scores(ranking._told_scores(score)).tolist() == score.tolist()
    assert len(ranking._told_scores(grid)) < 2.5 * len(grid)
    for counts in (np.zeros(5, np.int64), np.arange(400), draw.integers(0, 2, 8000)):
        assert ranking._heard(ranking._told(counts), len(counts)).tolist() == counts.tolist()
    assert len(ranking._told(draw.integers(0, 2, 8000))) < 2000


def test_rows_of_many_blocks_are_not_sent_for_each_part(spark):
    """A block is summed by few tasks where blocks are many, so its rows are sent few times."""
    block = resampling.BLOCK
    assert [-(-2000 // resampling.part_size(n * block, 2000)) for n in (1, 4, 16, 17, 32, 200)] == [8, 8, 2, 1, 1, 1]
    rows = [(0, 40 * block, 7, 1, 1), (1, 3, 2, 1, 1)]
    cells = spark.createDataFrame(rows, "slice long, groups long, draw long, cell long, n long")
    counted = resampling.resampled_counts(cells, 500, 1)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(0, 499" in plan
    sent = {r["slice"]: r["n"] for r in counted.groupBy("slice").agg(F.sum("n").alias("n")).collect()}
    times = [resampling.group_times(3, 0, 500, 500, 1)[:, 2].sum(), 500]
    assert sent[1] == times[0] and abs(sent[0] - times[1]) < 150
