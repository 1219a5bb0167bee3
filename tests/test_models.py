"""Fitted models against plain second implementations, and what a plan costs and refuses."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.errors import ExtractionIncomplete, SplitError
from tidemark.operators import boosting, models, probes, tasks
from tidemark.parameters import Split
from tidemark.plans import crossval


def windows_of(spark, groups=24, seed=3):
    draw, rows = random.Random(seed), []
    for g in range(groups):
        label = g % 3 if g < 18 else 0
        for i in range(draw.randrange(3, 9)):
            x = [draw.gauss(label == k, 1) * 10.0**k + 1000 * k for k in range(3)] + [7.0]
            for w in range(2):
                rows.append((f"{g}-{i}", g, f"c{label}", label, w, [v + draw.gauss(0, 0.1) * (v != 7.0) for v in x]))
    schema = "item_id string, group_id int, class string, label int, window_index int, features array<double>"
    return spark.createDataFrame(rows, schema)


SPLIT = Split(n_folds=3, repeats=2, seed=5, validation_splits=3)


def test_probes_of_all_folds_equal_one_fit_each(spark):
    windows, penalty = windows_of(spark), 0.05
    folds, planned = crossval.planned_windows(windows, SPLIT)
    pairs = crossval.fold_pairs(SPLIT)
    rows = models.with_parts(planned, pairs).cache()
    matrix, offset = probes.fit_probes(rows, len(pairs), 3, [penalty], 200, 1e-12)
    for number in (0, 4):
        split = pairs[number]
        train = models.in_part(planned, *split, "train").withColumn("v", array_to_vector("features"))
        counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        total = sum(counts.values())
        weight = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (3 * n))])
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="s").fit(train)
        fitted = LogisticRegression(
            featuresCol="s", weightCol="w", family="multinomial", regParam=penalty, maxIter=300, tol=1e-12,
            standardization=False,
        ).fit(scaler.transform(train).withColumn("w", weight[F.col("label")]))
        held = models.in_part(planned, *split, "test").withColumn("v", array_to_vector("features"))
        told = fitted.transform(scaler.transform(held)).select(
            "item_id", "window_index", "features", vector_to_array("probability").alias("want")
        )
        both = probes.with_probs(told, matrix[number : number + 1], offset[number : number + 1]).collect()
        assert len(both) > 5
        for r in both:
            assert r["probs"] == pytest.approx(r["want"], abs=1e-5)


def test_penalty_is_picked_on_validation(spark):
    _, planned = crossval.planned_windows(windows_of(spark), SPLIT)
    pairs = crossval.fold_pairs(SPLIT)
    rows = models.with_parts(planned, pairs).cache()
    penalties = [1000.0, 0.01]
    matrix, offset = probes.fit_probes(rows, len(pairs), 3, penalties, 50)
    alone = [probes.fit_probes(rows, len(pairs), 3, [p], 50) for p in penalties]
    for number, split in enumerate(pairs):
        held = models.in_part(planned, *split, "validation").collect()
        label, x = np.array([r["label"] for r in held]), np.array([r["features"] for r in held])
        scores = []
        for one, off in alone:
            guess = (x @ one[number] + off[number]).argmax(axis=1)
            f1 = [
                2 * ((label == k) & (guess == k)).sum() / max(1, (label == k).sum() + (guess == k).sum()) for k in range(3)
            ]
            scores.append(np.mean(f1))
        assert np.allclose(matrix[number], alone[int(np.argmax(scores))][0][number], atol=1e-4)


def test_cross_validation_writes_features_once_and_scans_them_once_to_predict(spark, monkeypatch):
    written = []
    keep = models.durable
    monkeypatch.setattr(models, "durable", lambda df: written.append("features" in df.columns) or keep(df))
    monkeypatch.setattr(crossval, "durable", lambda df: written.append("features" in df.columns) or keep(df))
    windows = windows_of(spark)
    done = crossval.cross_validate(windows, ["c0", "c1", "c2"], models.fit_probe((0.05,)), SPLIT, "probe", ranking=False)
    assert written.count(True) == 1
    assert done["predictions"].groupBy("repeat").count().collect()[0]["count"] == windows.select("item_id").distinct().count()
    folds, planned = crossval.planned_windows(windows, SPLIT)
    fitted = models.fit_folds(planned, folds, models.fit_probe((0.05,)), 3, crossval.fold_pairs(SPLIT))
    plan = models.predict_folds(planned, folds, fitted, "probe")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_plans_that_leak_or_leave_out_are_refused(spark, monkeypatch):
    windows = windows_of(spark)
    with pytest.raises(ExtractionIncomplete, match="lost"):
        kept = windows.select("item_id").distinct().unionByName(spark.createDataFrame([("lost",)], "item_id string"))
        crossval.planned_windows(windows, SPLIT, kept)
    sound = crossval.folds_for(windows, SPLIT)
    # One item of a group changes sides.
    moved = F.when((F.col("item_id") == "3-0") & (F.col("part") == "test"), "train").otherwise(F.col("part"))
    monkeypatch.setattr(crossval, "folds_for", lambda *_: sound.withColumn("part", moved))
    with pytest.raises(SplitError, match="both sides"):
        crossval.planned_windows(windows, SPLIT)
    monkeypatch.setattr(crossval, "folds_for", lambda *_: sound.filter("item_id <> '3-0'"))
    with pytest.raises(SplitError, match="partition"):
        crossval.planned_windows(windows, SPLIT)
    with pytest.raises(SplitError, match="2 windows belong"):
        models.with_plan(windows, sound.filter("item_id <> '3-0'"))


def test_occlusion_by_sums_equals_hiding_the_cells(spark):
    draw = np.random.default_rng(4)
    matrix, offset = draw.normal(size=(1, 12, 3)), draw.normal(size=(1, 3))
    rows = [(f"i{i // 2}", i // 4, f"c{i // 2 % 3}", i // 2 % 3, draw.normal(size=12).tolist()) for i in range(120)]
    tested = spark.createDataFrame(rows, "item_id string, group_id int, class string, label int, features array<double>")
    classes, hertz = ["c0", "c1", "c2"], [10.0 * (i + 1) for i in range(6)]
    by_sums = models.occlusion_by_sums(tested, matrix, offset, 6, classes, hertz, 4)
    hidden = models.occlusion(tested, lambda df: probes.with_probs(df, matrix, offset), 6, classes, hertz, 4)
    names = [c for c in by_sums.columns]
    got, want = ([tuple(r[n] for n in names) for r in f.orderBy("band_low_bin").collect()] for f in (by_sums, hidden))
    assert len(got) == 4
    for g, w in zip(got, want):
        assert g == pytest.approx(w)


def plain_boost(rows, edges, n_classes, settings, rounds):
    """Margins of boosted trees by recursion over lists of rows, without any sampling."""
    label = np.array([r[0] for r in rows])
    cut = np.array([[sum(v > e for e in edges[j]) for j, v in enumerate(r[1])] for r in rows])
    counts = np.bincount(label, minlength=n_classes)
    weight = len(label) / (n_classes * counts[label])
    per = 1 if n_classes == 2 else n_classes
    margins = np.zeros((len(rows), per))

    def grow(at, g, h, depth):
        value = -settings.rate * g[at].sum() / (h[at].sum() + settings.penalty)
        score = lambda s: g[s].sum() ** 2 / (h[s].sum() + settings.penalty)
        best = (1e-9, None)
        for j in range(cut.shape[1]):
            for b in range(max(len(e) for e in edges)):
                left, right = at[cut[at, j] <= b], at[cut[at, j] > b]
                if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= settings.least_weight:
                    gain = score(left) + score(right) - score(at)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if depth == 0 or best[1] is None:
            step[at] = value
        else:
            for side in best[1]:
                grow(side, g, h, depth - 1)

    for _ in range(rounds):
        if per == 1:
            p = 1 / (1 + np.exp(-margins))
            g, h = weight[:, None] * (p - (label[:, None] == 1)), weight[:, None] * p * (1 - p)
        else:
            p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
            g, h = weight[:, None] * (p - (label[:, None] == np.arange(per))), 2 * weight[:, None] * p * (1 - p)
        moved = margins.copy()
        for k in range(per):
            step = np.zeros(len(rows))
            grow(np.arange(len(rows)), g[:, k], h[:, k], settings.depth)
            moved[:, k] += step
        margins = moved
    return margins


@pytest.mark.parametrize("n_classes", [2, 3])
def test_boosting_equals_a_plain_run_in_every_split(spark, n_classes):
    windows = windows_of(spark, groups=18).filter(F.col("label") < n_classes)
    split = Split(n_folds=3, seed=5, validation_splits=3)
    _, planned = crossval.planned_windows(windows, split)
    pairs = crossval.fold_pairs(split)
    settings = boosting.Settings(
        rounds=12, depth=3, rate=0.3, rows=1.0, columns=1.0, least_weight=1.0, patience=12, bins=8
    )
    booster = boosting.Booster(models.with_parts(planned, pairs), len(pairs), n_classes, settings).fit()
    booster.kept[:] = 12
    for number, pair in enumerate(pairs[:2]):
        train = models.in_part(planned, *pair, "train").select("label", "features").collect()
        want = plain_boost([(r[0], r[1]) for r in train], booster.edges, n_classes, settings, 12)
        got = booster.probs(np.array([r[1] for r in train]), number)
        if n_classes == 2:
            p = 1 / (1 + np.exp(-want[:, 0]))
            want = np.stack([1 - p, p], axis=1)
        else:
            want = np.exp(want) / np.exp(want).sum(axis=1, keepdims=True)
        assert np.allclose(got, want, atol=1e-8)


def test_boosting_stops_each_split_on_its_validation_rows_and_is_repeatable(spark):
    windows = windows_of(spark)
    settings = {"rounds": 60, "depth": 2, "rate": 0.5, "patience": 5, "bins": 8}
    done = [
        crossval.cross_validate(frame, ["c0", "c1", "c2"], models.fit_trees(**settings), SPLIT, "trees", ranking=False)
        for frame in (windows, windows.repartition(7))
    ]
    kept = [d["fitted"].booster.kept for d in done]
    assert (kept[0] == kept[1]).all() and (kept[0] > 0).all() and (kept[0] < 60).all()
    told = [sorted((r["repeat"], r["item_id"], r["prediction"]) for r in d["predictions"].collect()) for d in done]
    assert told[0] == told[1]
    assert done[0]["summary"].filter("metric = 'macro_f1'").head()["mean"] > 0.4
    gains = models.feature_importance(spark, done[0]["fitted"], ["a", "b", "c", "still"]).collect()
    assert all(r["gain"] == 0 for r in gains if r["feature"] == "still") and any(r["gain"] > 0 for r in gains)


def test_probes_look_up_the_parts_once(spark, monkeypatch):
    scanned, fit = [], probes.fit_probes
    monkeypatch.setattr(probes, "fit_probes", lambda rows, *more: scanned.append(rows) or fit(rows, *more))
    draw = random.Random(2)
    rows = [(f"i{i}", f"g{i // 2}", f"c{i // 2 % 2}", i // 2 % 2, 0, [draw.random(), draw.random()]) for i in range(60)]
    kinds = "item_id string, group_id string, class string, label int, window_index int, features array<double>"
    windows = spark.createDataFrame(rows, kinds)
    crossval.cross_validate(windows, ["c0", "c1"], models.fit_probe((0.1,)), Split(n_folds=3), "probe", ranking=False)
    # A step reads a table that has the parts; the plan's map is not taken apart again.
    read = scanned[0].select("features", "label", probes.PARTS)
    assert models.PLAN not in read._jdf.queryExecution().optimizedPlan().toString().split("Relation [")[0]


def test_a_task_parses_its_notes_once(spark):
    known = "item_id string, call_a boolean, call_b boolean, site string, lat double, lon double, code string, cond_x boolean"
    notes = spark.createDataFrame([("i1", True, False, "s", 1.0, 2.0, "c", True)], known)
    items = spark.createDataFrame([("i1", "en", True, 3.0), ("i2", "en", True, 4.0)], "item_id string, class string, keep boolean, duration double")
    found = tasks.task_items(items, notes, "en")
    assert found._jdf.queryExecution().analyzed().toString().count("Join ") == 1
    assert sorted((r["item_id"], r["call_a"], r["site"], r["cond_x"]) for r in found.collect()) == [
        ("i1", True, "s", True), ("i2", None, None, None),
    ]
