"""Grouping results into the sets that are comparable, and what they must beat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import FamilyError

CONTEXT_MARKER = "_context"
TASK_PREFIX = "calltype_"
MAIN = "species"


def longest_prefix_owner(
    names: DataFrame, keys: DataFrame, name: str = "name", key: str = "key"
) -> DataFrame:
    """Give each name the longest key that equals it or is its ``key_`` prefix.

    A name has one candidate prefix per underscore, so this is an equi-join on those
    few prefixes and not a comparison of every name with every key. A name without
    an owner keeps a null key.
    """
    parts = F.split(F.col(name), "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_")
    )
    candidates = names.select(name, F.explode(prefixes).alias(key))
    known = keys.select(key).distinct().withColumn("__known", F.lit(True))
    matched = candidates.join(known, key, "left").withColumn(
        "__hit", F.when(F.col("__known"), F.col(key))
    )
    return matched.groupBy(name).agg(F.max_by("__hit", F.length("__hit")).alias(key))


def orphans(names: DataFrame, claims: DataFrame, name: str = "name") -> DataFrame:
    """Results that no family claims."""
    return names.select(name).distinct().join(claims.select(name), name, "left_anti")


def claimed_twice(claims: DataFrame, name: str = "name", family: str = "family") -> DataFrame:
    """Results that more than one family claims."""
    pairs = claims.select(name, family).distinct()
    return pairs.groupBy(name).agg(F.count(F.lit(1)).alias("families")).filter("families > 1")


def controls_by_key(names: DataFrame, name: str = "name") -> DataFrame:
    """Every context control with the task key it belongs to."""
    return names.filter(F.contains(F.col(name), F.lit(CONTEXT_MARKER))).select(
        F.get(F.split(F.col(name), CONTEXT_MARKER), 0).alias("key"), F.col(name).alias("control")
    )


def repeated_controls(controls: DataFrame) -> DataFrame:
    """Task keys with more than one control."""
    return controls.groupBy("key").agg(F.count(F.lit(1)).alias("controls")).filter("controls > 1")


def idle_controls(controls: DataFrame, owned: DataFrame) -> DataFrame:
    """Controls of a task that has no model on trial."""
    return controls.join(owned.filter(F.col("key").isNotNull()), "key", "left_anti")


def family_title(key, class_names: Sequence[str]):
    """``calltype_<class>_<tag>`` as "Class, tag words", the class taken from the list."""
    body = F.when(F.startswith(key, F.lit(TASK_PREFIX)), F.expr("substring(key, 10)")).otherwise(key)
    title = F.lit(None).cast("string")
    for name in reversed(list(class_names)):
        prefix = f"{name.lower()}_"
        rest = F.substring(body, F.lit(len(prefix) + 1), F.length(body))
        words = F.concat(F.lit(f"{name}, "), F.replace(rest, F.lit("_"), F.lit(" ")))
        title = F.when(F.startswith(body, F.lit(prefix)), words).otherwise(title)
    return F.coalesce(title, F.replace(body, F.lit("_"), F.lit(" ")))


def discover(
    names: DataFrame, declared: Sequence[str], control: str, class_names: Sequence[str]
) -> DataFrame:
    """``(family, title, model, role)`` for every result name.

    ``declared`` are the models of the main task with ``control`` among them; every
    other family is a tag task with a ``_context`` control. Lazy: ``check_families``
    refuses what does not fit.
    """
    names = names.select("name").distinct()
    main = names.filter(F.col("name").isin(list(declared))).select(
        F.lit(MAIN).alias("family"),
        F.lit("Species").alias("title"),
        F.col("name").alias("model"),
        F.when(F.col("name") == control, "control").otherwise("member").alias("role"),
    )
    controls = controls_by_key(names)
    trials = names.filter(~F.contains(F.col("name"), F.lit(CONTEXT_MARKER)))
    owned = longest_prefix_owner(trials, controls).filter(F.col("key").isNotNull())
    both = owned.select("key", F.col("name").alias("model"), F.lit("member").alias("role")).unionByName(
        controls.select("key", F.col("control").alias("model"), F.lit("control").alias("role"))
    )
    tasks = both.select(
        F.col("key").alias("family"),
        family_title(F.col("key"), class_names).alias("title"),
        "model",
        "role",
    )
    return main.unionByName(tasks)


def check_families(names: DataFrame, families: DataFrame) -> DataFrame:
    """The families, or an error naming some of the results that do not fit."""

    def some(df: DataFrame) -> list:
        return [row[0] for row in df.limit(5).collect()]

    controls = controls_by_key(names.select("name").distinct())
    claims = families.select(F.col("model").alias("name"), "family")
    roles = families.groupBy("family").agg(
        F.count_if(F.col("role") == "member").alias("m"),
        F.count_if(F.col("role") == "control").alias("c"),
    )
    problems = {
        "tasks with two controls": repeated_controls(controls),
        "families without a model on trial": roles.filter("m = 0"),
        "families without a control": roles.filter("c = 0"),
        "results claimed by two families": claimed_twice(claims),
        "results that belong to no family": orphans(names, claims),
    }
    for problem, frame in problems.items():
        found = some(frame)
        if found:
            raise FamilyError(f"{problem}: {found}")
    return families


def pairs_with_control(families: DataFrame) -> DataFrame:
    """``(family, model, control)`` for every member."""
    controls = families.filter(F.col("role") == "control").select(
        "family", F.col("model").alias("control")
    )
    return families.filter(F.col("role") == "member").join(controls, "family").select(
        "family", "model", "control"
    )


def strongest_floor(
    families: DataFrame, summary: DataFrame, silent: Sequence[str], metric: str = "macro_f1"
) -> DataFrame:
    """Per family the best model that sees no signal.

    Null when fewer than two such models are there or the control is already it.
    Members come before the control on ties, then by name.
    """
    means = summary.filter(F.col("metric") == metric).select("model", "mean")
    floors = families.filter(F.col("model").isin(list(silent))).join(means, "model")
    best = floors.groupBy("family").agg(
        F.count(F.lit(1)).alias("floors"),
        F.min_by(
            F.struct("model", "role"),
            F.struct((-F.col("mean")).alias("m"), (F.col("role") == "control").alias("r"), F.col("model").alias("n")),
        ).alias("best"),
    )
    kept = (F.col("floors") >= 2) & (F.col("best")["role"] != "control")
    return families.select("family").distinct().join(best, "family", "left").select(
        "family", F.when(kept, F.col("best")["model"]).alias("strongest")
    )


def against_strongest(families: DataFrame, floors: DataFrame) -> DataFrame:
    """``(family, model, control)`` with the strongest floor as the control."""
    chosen = floors.filter(F.col("strongest").isNotNull())
    return (
        families.filter(F.col("role") == "member")
        .join(chosen, "family")
        .filter(F.col("model") != F.col("strongest"))
        .select("family", "model", F.col("strongest").alias("control"))
    )


def with_class_lists(families: DataFrame, sets: DataFrame) -> DataFrame:
    """Each family's model with the classes its result set was saved with.

    ``sets`` has ``model`` and ``classes`` (``sources.sets.committed``). The job fails if a model has
    no set, or if models of one family were scored on different classes.
    """
    joined = families.join(sets.select("model", "classes"), "model", "left")
    lists = joined.groupBy("family").agg(
        F.count_if(F.coalesce(F.size("classes"), F.lit(0)) < 1).alias("unknown"),
        F.min("classes").alias("first"),
        F.max("classes").alias("last"),
    )
    fail = F.raise_error(F.concat(F.lit("classes unknown or not alike in family "), F.col("family"))).cast("array<string>")
    sound = F.when((F.col("unknown") > 0) | (F.col("first") != F.col("last")), fail).otherwise(F.col("first"))
    return families.join(lists.select("family", sound.alias("classes")), "family")
