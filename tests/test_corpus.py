"""Items, notes, audits, folds and tasks on small hand-made frames."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import parameters
from tidemark.errors import FamilyError, IdentityError, SplitError, VocabularyError
from tidemark.functions.notes import Vocabulary, leading_code, tag_note
from tidemark.operators import collection, context, controls, families, notes, splits, tables, tasks
from tidemark.operators.items import check_items, parse_identity, strict
from tidemark.operators.joins import lookup
from tidemark.operators.ordered import Ordered, with_position

VOCABULARY = Vocabulary(
    {"pulsed_call": ["pulsed call"], "call": ["call", "calls"], "click": ["click"]},
    {"noise": ["ship noise", "propeller"]},
    {"click": 8.0},
)


@pytest.mark.parametrize(
    "note, expected",
    [
        ("BA2A  Pulsed CALL; ship noise.", {"call_pulsed_call", "cond_noise"}),
        ("pulsed call and a call", {"call_pulsed_call", "call_call"}),
        ("Clicks. Propeller.", {"call_click", "cond_noise"}),
        ("", set()),
        (None, set()),
    ],
)
def test_longest_term_wins(spark, note, expected):
    frame = spark.createDataFrame([(note,)], "note string")
    assert set(frame.select(tag_note(F.col("note"), VOCABULARY)).head()[0]) == expected


@pytest.mark.parametrize(
    "note, code",
    [
        ("BE7A  Squeal.", "BE7A"),
        ("   AC2A clicks", "AC2A"),
        ("BD19D x", "BD19D"),
        ("Clicks from BE7A", ""),
        ("ABCD12 too long", ""),
        (None, ""),
    ],
)
def test_leading_code(spark, note, code):
    frame = spark.createDataFrame([(note,)], "note string")
    assert frame.select(leading_code(F.col("note"))).head()[0] == code


def test_vocabulary_is_strict():
    with pytest.raises(VocabularyError, match="has no 'conditions'"):
        Vocabulary.from_mapping({"call_types": {}})
    with pytest.raises(VocabularyError, match="cannot read the terms of 'a'"):
        Vocabulary.from_mapping(
            {"call_types": {"a": {"terms": ["a"], "length": 3}}, "conditions": {}}
        )
    read = Vocabulary.from_mapping(
        {"call_types": {"a": {"terms": ["a"], "max_clip_seconds": 8}}, "conditions": {}}
    )
    assert read.guards == {"a": 8.0}


def test_annotations_heal_when_the_vocabulary_moves(spark):
    place = "struct<name: array<string>, coordinates: array<struct<lat: double, lon: double>>>"
    raw = spark.createDataFrame(
        [("1", "x", "BE7A  Click", (["Pier"], [(1.0, 2.0)])), ("2", "y", None, None)],
        f"record_number string, display_name string, note string, location {place}",
    )
    old = notes.annotate(raw, Vocabulary({"gone": ["zzz"]}, {}))
    healed = notes.reparse_on_drift(old, VOCABULARY)
    assert "call_gone" not in healed.columns and notes.reparse_on_drift(healed, VOCABULARY) is healed
    first, second = healed.orderBy("item_id").collect()
    assert (first["site"], first["lat"], first["code"], first["call_click"]) == ("Pier", 1.0, "BE7A", True)
    assert (second["site"], second["lat"], second["code"], second["n_call_types"]) == ("", None, "", 0)


def test_paths(spark):
    rows = ["Orca/1999/5401800A.wav", "Orca\\1999\\54018001.WAV", "Orca/99/a/b.wav", "Orca/x/54018001.wav"]
    parsed = parse_identity(spark.createDataFrame([(r,) for r in rows], "path string"), "path", 5)
    got = {r["path"]: r for r in parsed.collect()}
    assert got[rows[0]]["group_id"] == got[rows[1]]["group_id"] == "54018"
    assert (got[rows[0]]["cut_id"], got[rows[1]]["cut_id"]) == ("00A", "001")
    assert [got[r]["parse_error"] for r in rows] == ["", "", "not_three_parts", "year_not_numeric"]
    with pytest.raises(PySparkException, match="malformed item"):
        strict(parsed).collect()


def fold_items(spark, hot=1):
    """Three classes of eight groups; the first group of class 0 has ``hot`` times the items."""
    rows = [
        (f"{c}-{g}-{i}", f"{c}-{g}", c, str(c))
        for c in range(3)
        for g in range(8)
        for i in range(4 * (hot if (c, g) == (0, 0) else 1))
    ]
    return spark.createDataFrame(rows, "item_id string, group_id string, label int, class string")


@pytest.mark.parametrize("hot", [1, 15])
def test_folds_keep_every_promise(spark, hot):
    items = fold_items(spark, hot)
    parts = splits.item_parts(items, n_folds=4, repeats=3, seed=7)
    assert splits.check_folds(items, parts, 12).count() == items.count() * 12
    tested = parts.filter("part = 'test'")
    assert tested.groupBy("repeat", "item_id").count().filter("count <> 1").count() == 0
    per_fold = tested.groupBy("repeat", "fold").agg(F.countDistinct("class").alias("c"))
    assert per_fold.filter("c <> 3").count() == 0 and per_fold.count() == 12
    for part in ("train", "validation"):
        seen = parts.filter(F.col("part") == part).groupBy("repeat", "fold").agg(
            F.countDistinct("class").alias("c")
        )
        assert seen.filter("c <> 3").count() == 0 and seen.count() == 12


def test_repeat_zero_is_the_single_split_and_repeats_differ(spark):
    items = fold_items(spark)
    many = splits.grouped_folds(items, n_folds=4, repeats=4, seed=7)
    once = splits.grouped_folds(items.repartition(11), n_folds=4, repeats=1, seed=7)
    picked = many.filter("repeat = 0").select("group_id", "fold")
    assert picked.exceptAll(once.select("group_id", "fold")).count() == 0
    moved = many.groupBy("group_id").agg(F.countDistinct("fold").alias("folds"))
    assert moved.filter("folds > 1").count() > 12


def test_too_few_groups_and_repeated_items_are_refused(spark):
    items = fold_items(spark)
    with pytest.raises(SplitError, match="cannot fill"):
        splits.grouped_folds(items.filter("group_id in ('0-0', '1-0')"), n_folds=4)
    with pytest.raises(IdentityError, match="not unique"):
        check_items(items.unionByName(items.limit(1)))
    leaky = spark.createDataFrame(
        [("a", "g", 0, 0, "train"), ("b", "g", 0, 0, "test")],
        "item_id string, group_id string, repeat int, fold int, part string",
    )
    with pytest.raises(SplitError, match="both sides"):
        splits.check_folds(items, leaky, 1)


def control_items(spark, code_of):
    rows = [
        (f"{c}-{g}-{i}", f"{c}-{g}", c, str(c), code_of(c, g))
        for c in range(3)
        for g in range(10)
        for i in range(4)
    ]
    return spark.createDataFrame(
        rows, "item_id string, group_id string, label int, class string, code string"
    )


@pytest.mark.parametrize(
    "code_of, helps", [(lambda c, g: f"code{c}", True), (lambda c, g: f"code{c}-{g}", False)]
)
def test_only_a_code_that_spans_groups_crosses_the_fold(spark, code_of, helps):
    items = control_items(spark, code_of)
    predicted = controls.lookup_model(items, splits.group_parts(items, n_folds=5, seed=1), ["code"])
    right = predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).head()[0]
    assert (right == 1.0) if helps else (right <= 0.5)
    assert predicted.filter(F.col("seen") == (not helps)).count() == 0


def test_blank_fields_are_absent_not_shared(spark):
    rows = [("1", "a", "A1"), ("2", "b", "A1"), ("3", "a", "B2"), ("4", "a", " "), ("5", "b", None)]
    items = spark.createDataFrame(rows, "item_id string, class string, code string")
    got = {
        r["item_id"]: r["outcome"]
        for r in context.giveaway_labels(items, ["code", "not_there"]).collect()
    }
    assert got == {"1": "shared", "2": "shared", "3": "unique", "4": "absent", "5": "absent"}
    row = context.field_giveaway(items, "code").head()
    assert (row["values"], row["items"], row["items_recorded"], row["share_given_away"]) == (2, 5, 3, 0.2)


def test_groups_kept_only_when_two_studied_classes_survive(spark):
    rows = [("g", "a", True), ("g", "b", False), ("h", "a", True), ("h", "b", True), ("i", "a", True)]
    items = spark.createDataFrame(rows, "group_id string, class string, keep boolean")
    got = {r["group_id"]: r["kept"] for r in collection.cross_label_groups(items, ["a", "b"]).collect()}
    assert got == {"g": False, "h": True}


def test_guard_applies_before_viability(spark):
    rows = [
        (f"{i}", f"g{i % 12}", "Orca", 20.0 if i % 2 else 4.0, True, i % 4 == 0) for i in range(160)
    ]
    frame = spark.createDataFrame(
        rows, "item_id string, group_id string, class string, duration double, call_click boolean, call_call boolean"
    )
    found = {r["tag"]: r for r in tasks.viable_tasks(frame, VOCABULARY, min_items=30, min_groups=3).collect()}
    assert found["click"]["positives"] == 80 and found["click"]["guard"] == 8.0
    assert found["click"]["task"] == "calltype_orca_click"
    assert found["call"]["positives"] == 40


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_longest_task_owns_a_model(spark):
    frame = names(
        spark,
        "calltype_orca_call", "calltype_orca_call_context", "calltype_orca_call_long",
        "calltype_orca_call_long_context", "calltype_orca_call_long_cnn", "xgb", "meta",
    )
    found = families.check_families(
        frame, families.discover(frame, ["xgb", "meta"], "meta", ["Orca"])
    )
    got = {(r["model"], r["role"]): (r["family"], r["title"]) for r in found.collect()}
    assert got["calltype_orca_call_long_cnn", "member"] == ("calltype_orca_call_long", "Orca, call long")
    assert got["calltype_orca_call", "member"][0] == "calltype_orca_call"
    assert got["meta", "control"][0] == "species"


@pytest.mark.parametrize(
    "results, problem",
    [
        (["calltype_orca_call"], "no family"),
        (["calltype_orca_call", "calltype_orca_call_context", "calltype_orca_call_context_old"], "two controls"),
        (["calltype_orca_call_context"], "without a model"),
        (["xgb"], "without a control"),
    ],
)
def test_results_that_fit_no_family_are_refused(spark, results, problem):
    frame = names(spark, *results)
    with pytest.raises(FamilyError, match=problem):
        families.check_families(frame, families.discover(frame, ["xgb", "meta"], "meta", ["Orca"]))


def test_lookup_with_hot_and_null_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id int, k string").repartition(7)
    table = frame.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = lookup(frame, table, ["k"], "n", spread=["id"])
    assert joined.count() == 3000
    got = {r["id"]: r["top"] for r in joined.collect()}
    assert got[0] == got[2997] == 2997 and got[1] is None and got[5] == 5
    assert lookup(frame, table, ["k"], "n", spread=["id"], how="inner").count() == 2000


def test_running_totals_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot" if i % 3 else f"k{i % 5}", i, (i * 7919) % 101) for i in range(2000)]
        frame = spark.createDataFrame(rows, "k string, i int, v int").repartition(9)
        laid = Ordered(frame, ["k"], [("i", True)])
        assert laid.frame.filter("k = 'hot'").select("__part").distinct().count() > 1
        both = laid.running(laid.frame, {"total": ("sum", F.col("v"))})
        both = laid.running(both, {"least": ("min", F.col("v"))}, reverse=True)
        got = {(r["k"], r["i"]): (r["total"], r["least"]) for r in both.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key in {k for k, _, _ in rows}:
        mine = sorted((i, v) for k, i, v in rows if k == key)
        total = 0
        for place, (i, v) in enumerate(mine):
            total += v
            assert got[key, i] == (total, min(x for _, x in mine[place:]))
    places = {(r["k"], r["i"]): r["position"] for r in with_position(frame, ["k"], [("i", True)]).collect()}
    assert places["hot", 1] == 0


def test_parameters_guard_the_data():
    with pytest.raises(ValueError, match="up-sample"):
        parameters.Band(target_rate=10000, min_native_rate=5000, window=100, hop=50)
    with pytest.raises(ValueError, match="hop"):
        parameters.Band(target_rate=100, min_native_rate=100, window=10, hop=11)
    with pytest.raises(ValueError, match="Nyquist"):
        parameters.Band(target_rate=100, min_native_rate=100, window=10, hop=5, fmax=60)
    with pytest.raises(ValueError, match="unknown keys"):
        parameters.from_mapping(parameters.Split, {"folds": 3})
    with pytest.raises(ValueError, match="two folds"):
        parameters.Split(n_folds=1)


def test_white_space_is_not_recorded_and_long_names_are_not_cut(spark):
    from tidemark.functions.notes import recorded
    from tidemark.operators.scoring import headline_text

    frame = spark.createDataFrame([("\t",), ("\n ",), ("a",), (None,), ("",)], "site string")
    assert [row[0] for row in frame.select(recorded(frame, "site")).collect()] == [False, False, True, False, False]
    names = ["a_very_long_model_name", "a_very_long_model_other", "b"]
    rows = [(name, metric, 0.5, 0.1) for name in names for metric in ("accuracy", "macro_f1")]
    summary = spark.createDataFrame(rows, "model string, metric string, mean double, std double")
    lines = {row["model"]: row["headline"] for row in headline_text(summary).collect()}
    assert all(lines[name].startswith(name.rjust(10) + ": ") for name in names)


def test_unknown_classes_and_years_out_of_range_are_errors(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from tidemark.operators.items import label_index

    frame = spark.createDataFrame([("a",), ("z",)], "class string")
    with pytest.raises(PySparkException, match="no such class: z"):
        frame.select(label_index(F.col("class"), ["a", "b"])).collect()
    assert [row[0] for row in frame.select(label_index(F.col("class"), ["a"], unknown="null")).collect()] == [0, None]


def test_results_of_other_models_stay_and_unfinished_sets_do_not_count(spark, tmp_path):
    from tidemark.sources import results

    path = str(tmp_path / "sets")
    for model in ("a", "b"):
        results.write_items(spark.createDataFrame([("c1", model, 1)], "config string, model string, n int"), path)
    found = results.scan_results(spark, path)
    assert sorted(row["model"] for row in results.result_names(found).collect()) == ["a", "b"]
    done = spark.createDataFrame([("c1", "b")], "config string, model string")
    assert [row["model"] for row in results.scan_results(spark, path, summaries=done).collect()] == ["b"]


def test_bands_hide_rows_of_a_matrix_and_cells_of_a_vector(spark):
    from tidemark.operators.models import hide_bands

    frame = spark.createDataFrame([([1.0] * 12,)], "features array<double>")
    hidden = {row["low"]: row["features"] for row in hide_bands(frame, 4, 2).collect()}
    assert hidden[0] == [0.0] * 6 + [1.0] * 6 and hidden[2] == [1.0] * 6 + [0.0] * 6 and hidden[-1] == [1.0] * 12
    flat = {row["low"]: row["features"] for row in hide_bands(frame, 12, 3).collect()}
    assert flat[4] == [1.0] * 4 + [0.0] * 4 + [1.0] * 4


def test_lookup_model_on_a_single_later_fold(spark):
    rows = [(i, i, "k" + str(i % 2), i % 2) for i in range(16)]
    items = spark.createDataFrame(rows, "item_id int, group_id int, code string, label int")
    parts = [(2, 1, i, "test" if i % 4 == 0 else "train") for i in range(16)]
    folds = spark.createDataFrame(parts, "repeat int, fold int, group_id int, part string")
    got = controls.lookup_model(items, folds, ["code"]).collect()
    assert got and all(row["seen"] and row["prediction"] == row["label"] for row in got)


@pytest.mark.parametrize("mode", ["reflect", "wrap", "edge", "constant"])
def test_echo_places_invert_the_padding(spark, mode):
    from pyspark.sql import functions as F

    from tidemark.functions.signal import echo_places, pad_index, silent_places

    rows = spark.range(1, 9).withColumnRenamed("id", "n").withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))
    want = F.filter(places, lambda i: pad_index(i, F.col("n"), mode) == F.col("p"))
    mute = F.filter(places, lambda i: pad_index(i, F.col("n"), mode).isNull() & (F.col("p") == 0))
    for row in rows.select(
        F.array_sort(echo_places(F.col("p"), F.col("n"), 11, mode)).alias("got"), want.alias("want"),
        silent_places(F.col("p"), F.col("n"), 11, mode).alias("quiet"), mute.alias("mute"),
    ).collect():
        assert row["got"] == row["want"] and row["quiet"] == row["mute"]


def test_fold_plans_copy_no_window(spark):
    from tidemark.operators.models import in_part, with_plan

    windows = spark.createDataFrame([(i // 3, [float(i)]) for i in range(30)], "item_id int, features array<double>")
    rows = [(i, r, f, "test" if i % 5 == f else "train") for i in range(10) for r in range(4) for f in range(5)]
    folds = spark.createDataFrame(rows, "item_id int, repeat int, fold int, part string")
    planned = with_plan(windows, folds)
    assert planned.count() == windows.count()
    tested = in_part(planned, 2, 1, "test")
    assert {row["item_id"] for row in tested.collect()} == {1, 6} and tested.count() == 6
    assert {(row["repeat"], row["fold"]) for row in tested.collect()} == {(2, 1)}


def test_tallies_of_group_plans_equal_counting_every_split(spark):
    """Lookups and class weights against plain loops; null fields, ties, unseen keys."""
    import random
    from collections import Counter

    draw = random.Random(3)
    rows = [
        (i, draw.randrange(30), draw.choice(["a", "b", None, f"own{i % 30}"]), draw.choice(["x", "y"]), draw.randrange(3))
        for i in range(400)
    ]
    items = spark.createDataFrame(rows, "item_id int, group_id int, code string, site string, label int")
    plan = {(r, f, g): draw.choice(["train", "train", "validation", "test"]) for r in range(2) for f in range(3) for g in range(30)}
    parts = spark.createDataFrame([(*k, v) for k, v in plan.items()], "repeat int, fold int, group_id int, part string")
    got = {
        (r["item_id"], r["repeat"], r["fold"]): (r["prediction"], r["seen"])
        for r in controls.lookup_model(items, parts, ["code", "site"]).collect()
    }
    weights = {
        (r["repeat"], r["fold"], r["label"]): r["weight"]
        for r in controls.class_weights_by_groups(items, parts, 4).collect()
    }
    want, want_weights = {}, {}
    for r in range(2):
        for f in range(3):
            train = [x for x in rows if plan[r, f, x[1]] == "train"]
            labels = Counter(x[4] for x in train)
            most = lambda counts: min(counts, key=lambda k: (-counts[k], k))
            for x in rows:
                if plan[r, f, x[1]] == "test":
                    own = Counter(y[4] for y in train if y[2:4] == x[2:4])
                    want[x[0], r, f] = (most(own or labels), bool(own))
            for k in range(4):
                want_weights[r, f, k] = len(train) / (4 * labels[k]) if labels[k] else 0.0
    assert got == want
    assert weights == pytest.approx(want_weights)


def test_uncovered_items_are_counted_where_the_item_is(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 5)], "item_id bigint")
    whole = [(1, r, f) for r in range(2) for f in range(2)]
    rows = [*whole, *[(2, r, f) for _, r, f in whole[:3]], *[(3, 0, 0)] * 4, (9, 0, 1)]
    folds = spark.createDataFrame(rows, "item_id bigint, repeat int, fold int")
    found = splits.uncovered_items(items, folds, 4)
    assert {tuple(row) for row in found.collect()} == {(2, 3, 3), (3, 4, 1), (4, 0, 0), (9, 1, 1)}
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_plans_of_all_groups_are_not_broadcast(spark):
    """Only those of the heaviest groups are: a group has a row for each split in its plan."""
    n = F.col("id")
    items = spark.range(400).select(n.alias("item_id"), (n % 40).alias("group_id"), (n % 4).cast("int").alias("label"))
    parts = splits.item_parts(items, n_folds=5, repeats=3)
    plan = parts._jdf.queryExecution().sparkPlan().toString()
    assert [line.strip("+-: ").split()[0] for line in plan.splitlines() if "Join" in line] == ["SortMergeJoin", "BroadcastHashJoin"]
    assert parts.count() == 400 * 15 and splits.uncovered_items(items, parts, 15).count() == 0


def test_ambiguity_counts_an_item_once_for_each_model(spark):
    """Items of a slice are distinct however many splits a model has, and models do not share them."""
    rows = [(m, r, i % 2, i, i % 3, (i + r) % 3) for m, n in (("a", 3), ("b", 1)) for r in range(n) for i in range(12)]
    frame = spark.createDataFrame(rows, "model string, repeat int, fold int, item_id bigint, label int, prediction int")
    named = spark.createDataFrame(
        [(i, "site", "unique" if i < 4 else "shared") for i in range(12)], "item_id bigint, field string, outcome string"
    )
    found = {(x["model"], x["subset"]): (x["items"], x["folds"]) for x in tables.ambiguity(frame, named, 3).collect()}
    assert found == {
        ("a", "site unique to a class"): (4, 6),
        ("a", "site shared by classes"): (8, 6),
        ("b", "site unique to a class"): (4, 2),
        ("b", "site shared by classes"): (8, 2),
    }
