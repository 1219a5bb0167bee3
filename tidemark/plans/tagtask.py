"""One tag of one class as a task: a model and its control on the same splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.notes import Vocabulary
from tidemark.operators import controls, models
from tidemark.operators.ordered import durable
from tidemark.operators.tasks import ABSENT, PRESENT, relabel_windows, require_items, task_items
from tidemark.parameters import Split
from tidemark.plans.crossval import cross_validate, save_result

CLASSES = [ABSENT, PRESENT]


def run_task(
    windows: DataFrame,
    items: DataFrame,
    notes: DataFrame,
    class_name: str,
    tag: str,
    vocabulary: Vocabulary,
    split: Split,
    root: str,
    config: str,
    fit: models.Fit,
    control_fit: models.Fit,
    *,
    with_control: bool = True,
) -> list[str]:
    """Fit, score and commit a tag's model and its control; returns the names of the sets.

    The model has the windows' features; the control has what is written down about the item
    and hears nothing. Both run on the folds of the same items, so that split by split they
    can be compared. A second model on the task is run ``with_control=False``, which leaves the
    committed control as it is. A class without kept items is refused.
    """
    guard = vocabulary.guards.get(tag)
    name = f"calltype_{class_name.lower()}_{tag}"
    labelled = require_items(durable(task_items(items, notes, class_name, guard)), name)
    subset = relabel_windows(windows, labelled, tag, guard)
    done = cross_validate(subset, CLASSES, fit, split, name, ranking=False)
    facts = {"class": class_name, "tag": tag, "max_seconds": guard}
    save_result(done, root, config, name, CLASSES, facts)
    if not with_control:
        return [name]
    # Each item is in each split once.
    heard = done["folds"].filter("repeat = 0 and fold = 0").select("item_id", "label", "class")
    context = controls.logbook_matrix(labelled.drop("label", "class").join(heard, "item_id"))
    paper = durable(context.select("item_id", "group_id", "class", "label", F.lit(0).alias("window_index"), "features"))
    control = f"{name}_context"
    floor = cross_validate(paper, CLASSES, control_fit, split, control, ranking=False, folds=done["folds"])
    save_result(floor, root, config, control, CLASSES, facts)
    return [name, control]
