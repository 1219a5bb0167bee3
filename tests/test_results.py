"""Committed sets, class lists, and tag tasks."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.errors import MissingResults, TaskError
from tidemark.functions.notes import Vocabulary
from tidemark.operators import families, notes, tables, tasks
from tidemark.operators.ordered import shared_folder
from tidemark.plans import report
from tidemark.sources import sets


@pytest.fixture
def root(spark):
    return f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"


def test_two_models_in_two_calls_are_both_there(spark, root):
    one, two = (spark.createDataFrame([(k, f"x{k}")], "item_id int, model string") for k in (1, 2))
    sets.commit_set({"predictions": one}, root, "base", "a", classes=["absent", "present"], facts={"tag": "the"})
    sets.commit_set({"predictions": two, "summary": two}, root, "base", "01", classes=["p", "q"])
    assert {(r["model"], tuple(r["classes"])) for r in sets.committed(spark, root).collect()} == {
        ("a", ("absent", "present")), ("01", ("p", "q")),
    }
    read = sets.read_sets(spark, root, "predictions", config="base")
    assert {(r["item_id"], r["model"]) for r in read.collect()} == {(1, "a"), (2, "01")}
    assert sets.read_sets(spark, root, "summary").count() == 1
    with pytest.raises(MissingResults, match="'a'"):
        sets.read_sets(spark, root, "summary", models=["a"])
    with pytest.raises(MissingResults):
        sets.read_sets(spark, f"{root}-none", "summary")


def test_a_killed_write_is_invisible_and_a_new_version_replaces(spark, root):
    first = spark.createDataFrame([(1,)], "v int")
    sets.commit_set({"t": first}, root, "c", "m")
    before = sets.read_sets(spark, root, "t")
    fails = F.when(F.col("v") == 2, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v"))
    with pytest.raises(Exception, match="killed"):
        sets.commit_set({"s": first, "t": spark.createDataFrame([(2,)], "v int").select(fails.alias("v"))}, root, "c", "m")
    assert [r["v"] for r in sets.read_sets(spark, root, "t").collect()] == [1]
    with pytest.raises(MissingResults):
        sets.read_sets(spark, root, "s")
    sets.commit_set({"t": spark.createDataFrame([(3,)], "v int")}, root, "c", "m")
    assert [r["v"] for r in sets.read_sets(spark, root, "t").collect()] == [3]
    assert [r["v"] for r in before.collect()] == [1]
    assert {r["version"] for r in sets.committed(spark, root).collect()} == {2}


def test_healed_notes_are_committed_once(spark, root):
    place = "struct<name: array<string>, coordinates: array<struct<lat: double, lon: double>>>"
    raw = spark.createDataFrame(
        [("1", "x", "BE7A  Click", (["Pier"], [(1.0, 2.0)]))],
        f"record_number string, display_name string, note string, location {place}",
    )
    old = Vocabulary(tags={"gone": ["gone"]}, conditions={})
    new = Vocabulary(tags={"click": ["click"]}, conditions={})
    sets.commit_set({"annotations": notes.annotate(raw, old)}, root, "notes", "annotations")
    assert notes.healed(spark, root, "notes", new).head()["call_click"] is True
    assert "call_gone" not in notes.healed(spark, root, "notes", new).columns
    folder = f"{root}/commits".removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == 2


def test_tasks_are_refused_and_ordered(spark):
    rows = spark.createDataFrame([("x", 3, 2), ("y", 2, 9), ("z", 7, 2)], "task string, positives int, groups int")
    assert [r["task"] for r in tasks.require_tasks(rows).collect()] == ["y", "z", "x"]
    with pytest.raises(TaskError, match="minimum"):
        tasks.require_tasks(rows.limit(0))
    with pytest.raises(TaskError, match="no kept items for it"):
        tasks.require_items(rows.limit(0), "it")


def test_class_lists_must_agree_in_a_family(spark):
    known = spark.createDataFrame(
        [("f", "a", "member"), ("f", "b", "control"), ("g", "c", "member"), ("g", "d", "control")],
        "family string, model string, role string",
    )
    lists = [("a", ["p", "q"]), ("b", ["p", "q"]), ("c", ["x", "y", "z"]), ("d", ["x", "y", "z"])]
    schema = "model string, classes array<string>"
    told = families.with_class_lists(known, spark.createDataFrame(lists, schema))
    assert {(r["model"], len(r["classes"])) for r in told.collect()} == {("a", 2), ("b", 2), ("c", 3), ("d", 3)}
    for wrong in (lists[:3], [*lists[:3], ("d", ["x", "z", "y"])]):
        with pytest.raises(Exception, match="family g"):
            families.with_class_lists(known, spark.createDataFrame(wrong, schema)).collect()


def test_report_scores_each_family_over_its_own_classes(spark):
    rows = []
    for model, k in (("a", 2), ("b", 2), ("c", 4), ("d", 4)):
        for i in range(40):
            rows.append((model, i % 2, i % 5, f"i{i}", i // 4, i % 2, (i // (3 if model in "ac" else 2)) % 2))
    frame = spark.createDataFrame(
        rows, "model string, repeat int, fold int, item_id string, group_id int, label int, prediction int"
    )
    known = spark.createDataFrame(
        [("f", "a", "member", ["p", "q"]), ("f", "b", "control", ["p", "q"]),
         ("g", "c", "member", ["p", "q", "r", "s"]), ("g", "d", "control", ["p", "q", "r", "s"])],
        "family string, model string, role string, classes array<string>",
    )
    built = report.build(frame, known, [], [], resamples=50)
    told = {r["model"]: r["estimate"] for r in built["intervals"].collect()}
    # The same predictions over twice the classes have half the macro-F1.
    assert told["c"] == pytest.approx(told["a"] / 2) and told["d"] == pytest.approx(told["b"] / 2)
    margins = {r["family"]: r["margin"] for r in built["margin_over_control"].collect()}
    assert margins["g"] == pytest.approx(margins["f"] / 2)
    assert tables.fold_metrics(frame, known).filter("metric = 'macro_f1'").count() == 4 * 10


def test_classes_of_families_meet_counts_and_not_predictions(spark, monkeypatch):
    from tidemark.operators import tables

    counted, whole = [], tables.confusion_counts
    monkeypatch.setattr(tables, "confusion_counts", lambda rows, keys: counted.append(rows) or whole(rows, keys))
    rows = [(m, 0, f, i % 2, (i + (m == "b" and i < 2)) % 2) for m in "abc" for f in (0, 1) for i in range(8)]
    predictions = spark.createDataFrame(rows, "model string, repeat int, fold int, label int, prediction int")
    known = [("one", "a", ["x", "y"]), ("one", "b", ["x", "y"]), ("two", "a", ["x", "y", "z"])]
    families = spark.createDataFrame(known, "family string, model string, classes array<string>")
    found = tables.fold_metrics(predictions, families).filter("metric = 'macro_f1' and fold = 1").collect()
    got = {(r["family"], r["model"]): r["value"] for r in found}
    assert got == {("one", "a"): 1.0, ("one", "b"): pytest.approx(0.75), ("two", "a"): pytest.approx(2 / 3)}
    assert len(counted) == 1 and "Join" not in counted[0]._jdf.queryExecution().analyzed().toString()
