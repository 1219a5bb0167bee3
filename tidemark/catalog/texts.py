"""Notes: identity, tags, codes, context joins and tag tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    CONTEXT_CONDITIONS,
    CTES,
    LANGS,
    N_FOLDS,
    REPEATS,
    SEED,
    VOCABULARY,
    add_cte,
    document_items,
    items,
    kept_items,
    query,
    raw_notes,
    sql,
    table,
)
from tidemark.functions.notes import (
    LEADING_CODE,
    Vocabulary,
    coordinate_of,
    leading_code,
    site_of,
    tag_note,
)
from tidemark.operators import context, notes, tasks
from tidemark.operators.items import parse_identity
from tidemark.operators.models import fit_probe
from tidemark.operators.ordered import shared_folder
from tidemark.parameters import Split
from tidemark.plans import tagtask
from tidemark.sources import sets, shards

FLAGS = VOCABULARY.flag_names()
# The vocabulary's terms in the order that they are looked for.
_SEARCHED = [
    ("call_ation", "ation"),
    ("call_ther", "there"),
    ("call_tion", "tion"),
    ("call_ther", "ther"),
    ("call_the", "the"),
    ("call_an", "an"),
    ("cond_le", "elle"),
    ("cond_ing", "ing"),
    ("cond_le", "le"),
]


def _tag_ctes() -> str:
    """One nested select per term, in search order, as the oracle of the fold."""
    body, taken = "SELECT *, lower(note) AS rest0 FROM raw_notes", 0
    hits: dict[str, list[str]] = {flag: [] for flag in FLAGS}
    for flag, term in _SEARCHED:
        body = (
            f"SELECT *, contains(rest{taken}, '{term}') AS hit{taken}, "
            f"replace(rest{taken}, '{term}', '{' ' * len(term)}') AS rest{taken + 1} FROM ({body})"
        )
        hits[flag].append(f"hit{taken}")
        taken += 1
    flags = ", ".join(f"({' OR '.join(found)}) AS \"{flag}\"" for flag, found in hits.items())
    calls = " + ".join(
        f"({' OR '.join(found)})::INT" for flag, found in hits.items() if flag.startswith("call_")
    )
    code = f"regexp_extract(coalesce(note, ''), '{LEADING_CODE}', 1)"
    return f"""SELECT item_id, class, site, lat, lon, note, {code} AS code,
      {calls} AS n_call_types, {flags} FROM ({body})"""


add_cte("notes", ("raw_notes",), _tag_ctes())
add_cte(
    "labelled",
    ("notes", "doc_items"),
    """SELECT d.*, n.* EXCLUDE (item_id, class)
       FROM doc_items d LEFT JOIN notes n ON d.item_id = n.item_id""",
)
_FLAG_LIST = ", ".join(f'"{flag}"' for flag in FLAGS)


def annotated(spark, d):
    return notes.annotate(raw_notes(spark, d), VOCABULARY)


def labelled(spark, d):
    return notes.items_with_notes(document_items(spark, d), annotated(spark, d))


_PATHS = """
    SELECT o_orderkey, CASE o_orderkey % 8
      WHEN 0 THEN c || '\\' || y || '\\' || k || 'A.WAV'
      WHEN 1 THEN c || '/' || k || '.wav'
      WHEN 2 THEN c || '/' || y || '/' || k || '.mp3'
      WHEN 3 THEN c || '/y' || y || '/' || k || '.wav'
      WHEN 4 THEN c || '/' || y || '/' || k % 1000 || '.wav'
      ELSE c || '/' || y || '/' || k || '.wav' END AS path
    FROM (SELECT o_orderkey, 10000000 + o_orderkey AS k, o_orderpriority AS c,
            year(o_orderdate) AS y FROM orders)"""


def paths(spark, d):
    k = F.col("o_orderkey") + 10000000
    c, y, text = F.col("o_orderpriority"), F.year("o_orderdate").cast("string"), k.cast("string")
    slash, back = F.lit("/"), F.lit("\\")
    form = F.col("o_orderkey") % 8
    path = (
        F.when(form == 0, F.concat(c, back, y, back, text, F.lit("A.WAV")))
        .when(form == 1, F.concat(c, slash, text, F.lit(".wav")))
        .when(form == 2, F.concat(c, slash, y, slash, text, F.lit(".mp3")))
        .when(form == 3, F.concat(c, F.lit("/y"), y, slash, text, F.lit(".wav")))
        .when(form == 4, F.concat(c, slash, y, slash, (k % 1000).cast("string"), F.lit(".wav")))
        .otherwise(F.concat(c, slash, y, slash, text, F.lit(".wav")))
    )
    return table(spark, d, "orders").select("o_orderkey", path.alias("path"))


@query(
    "P1_parse_identity",
    f"""
    SELECT o_orderkey, path, parse_error, CASE WHEN ok THEN parts[1] END AS class,
      CASE WHEN ok THEN parts[2]::INT END AS year, CASE WHEN ok THEN stem END AS item_id,
      CASE WHEN ok THEN substr(stem, 1, 5) END AS group_id,
      CASE WHEN ok THEN substr(stem, 6) END AS cut_id
    FROM (SELECT *, parse_error = '' AS ok FROM (
      SELECT *, CASE WHEN len(parts) <> 3 THEN 'not_three_parts'
          WHEN NOT lower(parts[-1]) LIKE '%.wav' THEN 'not_wav'
          WHEN NOT regexp_full_match(parts[2], '\\d+') THEN 'year_not_numeric'
          WHEN length(stem) < 5 THEN 'id_too_short' ELSE '' END AS parse_error
      FROM (SELECT *, substr(parts[-1], 1, length(parts[-1]) - 4) AS stem
        FROM (SELECT *, string_split(replace(path, '\\', '/'), '/') AS parts FROM ({_PATHS})))))""",
)
def p1(spark, d):
    return parse_identity(paths(spark, d), "path", 5)


@query(
    "P4_tag_note",
    sql(
        "SELECT item_id, tag FROM (SELECT item_id, unnest(list_filter(["
        + ", ".join(f"CASE WHEN \"{flag}\" THEN '{flag}' END" for flag in FLAGS)
        + "], lambda x: x IS NOT NULL)) AS tag FROM notes)",
        "notes",
    ),
)
def p4(spark, d):
    return raw_notes(spark, d).select(
        F.col("record_number").alias("item_id"),
        F.explode(tag_note(F.col("note"), VOCABULARY)).alias("tag"),
    )


@query("P5_leading_code", sql("SELECT item_id, code FROM notes", "notes"))
def p5(spark, d):
    return raw_notes(spark, d).select(
        F.col("record_number").alias("item_id"), leading_code(F.col("note")).alias("code")
    )


@query("P6_site_coords", sql("SELECT item_id, site, lat, lon FROM raw_notes", "raw_notes"))
def p6(spark, d):
    place = F.col("location")
    return raw_notes(spark, d).select(
        F.col("record_number").alias("item_id"),
        site_of(place).alias("site"),
        coordinate_of(place, "lat").alias("lat"),
        coordinate_of(place, "lon").alias("lon"),
    )


@query("P7_flag_columns", sql("SELECT * FROM notes", "notes"))
def p7(spark, d):
    return annotated(spark, d)


@query(
    "P10_guard_seconds",
    sql(
        """SELECT item_id, duration FROM labelled WHERE "call_an" AND duration <= 30""",
        "labelled",
    ),
)
def p10(spark, d):
    carrying = labelled(spark, d).filter("call_an")
    return notes.within_guard(carrying, VOCABULARY.guards["an"]).select("item_id", "duration")


@query(
    "S1_scan_notes",
    "SELECT doc_id, text, lang, source FROM documents UNION ALL "
    "SELECT page_id AS doc_id, html AS text, NULL AS lang, url AS source FROM pages",
)
def s1(spark, d):
    documents = shards.scan_columns(
        spark, [f"{d}/documents.parquet"], ["doc_id", "text", "lang", "source"]
    )
    pages = shards.scan_columns(spark, [f"{d}/pages.parquet"], ["page_id", "html", "url"])
    return documents.unionByName(
        pages.select(
            F.col("page_id").alias("doc_id"),
            F.col("html").alias("text"),
            F.lit(None).cast("string").alias("lang"),
            F.col("url").alias("source"),
        )
    )


@query("S7_reparse_on_drift", sql("SELECT * FROM notes", "notes"))
def s7(spark, d):
    """Annotations committed with an old vocabulary, healed, and read back as committed."""
    root = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    old = Vocabulary(tags={"gone": ["gone"], "the": ["th"]}, conditions={"le": ["le"]})
    sets.commit_set({"annotations": notes.annotate(raw_notes(spark, d), old)}, root, "notes", "annotations")
    return notes.healed(spark, root, "notes", VOCABULARY)


_CONTEXT = ["site", "lat", "lon", "code", *CONTEXT_CONDITIONS]


@query(
    "J1_attach_context",
    sql(
        f"""SELECT i.item_id, i.class, {', '.join('c.' + c for c in _CONTEXT)}
            FROM items i LEFT JOIN items c ON i.item_id = c.item_id AND c.keep""",
        "items",
    ),
)
def j1(spark, d):
    context_frame = kept_items(spark, d).select("item_id", *_CONTEXT)
    return notes.attach_context(items(spark, d).select("item_id", "class"), context_frame)


@query("J2_items_with_notes", sql("SELECT * FROM labelled", "labelled"))
def j2(spark, d):
    return labelled(spark, d)


@query(
    "A12_tags_by_class",
    sql(
        " UNION ALL ".join(
            "SELECT '{t}' AS tag, {cols}, count(*) FILTER (WHERE \"call_{t}\") AS total, "
            "({having}) AS classes_with_any FROM labelled".format(
                t=t,
                cols=", ".join(
                    f"count(*) FILTER (WHERE class = '{c}' AND \"call_{t}\") AS \"{c}\"" for c in LANGS
                ),
                having=" + ".join(
                    f"(count(*) FILTER (WHERE class = '{c}' AND \"call_{t}\") > 0)::INT"
                    for c in LANGS
                ),
            )
            for t in VOCABULARY.tags
        ),
        "labelled",
    ),
)
def a12(spark, d):
    return context.tags_by_class(labelled(spark, d), LANGS)


@query(
    "A13_annotation_summary",
    sql(
        """SELECT class, count(*) AS items, count(*) FILTER (WHERE n_call_types = 0) AS untagged,
             count(DISTINCT site) AS sites FROM notes GROUP BY class""",
        "notes",
    ),
)
def a13(spark, d):
    return notes.annotation_summary(annotated(spark, d))


@query(
    "A13_tags_per_class",
    sql(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT class, '{t}' AS tag, count(*) FILTER (WHERE \"call_{t}\") AS items "
            "FROM notes GROUP BY class"
            for t in VOCABULARY.tags
        )
        + ") WHERE items > 0",
        "notes",
    ),
)
def a13_tags(spark, d):
    return notes.tags_per_class(annotated(spark, d))


_CALLS = ", ".join(f'"call_{t}"' for t in VOCABULARY.tags)
_CONDS = ", ".join(f'"cond_{c}"' for c in VOCABULARY.conditions)


@query(
    "K8_task_items",
    sql(
        f"""SELECT item_id, group_id, class, duration, keep, {_CALLS}, site, lat, lon, code, {_CONDS}
            FROM labelled WHERE keep AND class = 'en' AND duration <= 30""",
        "labelled",
    ),
)
def k8(spark, d):
    return tasks.require_items(tasks.task_items(document_items(spark, d), annotated(spark, d), "en", 30), "en")


def _guarded(t: str) -> str:
    guard = VOCABULARY.guards.get(t)
    return f'"call_{t}"' + ("" if guard is None else f" AND duration <= {guard}")


@query(
    "K9_viable_tasks",
    sql(
        "SELECT *, 'calltype_' || lower(class) || '_' || tag AS task, "
        "'calltype_' || lower(class) || '_' || tag || '_context' AS control FROM ("
        + " UNION ALL ".join(
            f"SELECT class, '{t}' AS tag, count(*) AS positives, count(DISTINCT group_id) AS groups, "
            f"{VOCABULARY.guards.get(t, 'NULL')}::DOUBLE AS guard "
            f"FROM labelled WHERE keep AND {_guarded(t)} GROUP BY class"
            for t in VOCABULARY.tags
        )
        + ") WHERE positives >= 60 AND groups >= 10",
        "labelled",
    ),
)
def k9(spark, d):
    return tasks.require_tasks(tasks.viable_tasks(labelled(spark, d).filter("keep"), VOCABULARY))


@query(
    "K10_relabel_windows",
    sql(
        """SELECT w.item_id, window_index, "call_an"::INT AS label,
             CASE WHEN "call_an" THEN 'present' ELSE 'absent' END AS class
           FROM (SELECT item_id, unnest(range(item_id::BIGINT % 3 + 1))::INT AS window_index
                 FROM doc_items) w
           JOIN labelled l ON l.item_id = w.item_id AND l.duration <= 30 AND l.keep""",
        "labelled",
    ),
)
def k10(spark, d):
    rows = labelled(spark, d).filter("keep")
    last = (F.col("item_id").cast("bigint") % 3).cast("int")
    windows = document_items(spark, d).select(
        "item_id", "class", F.explode(F.sequence(F.lit(0), last)).alias("window_index")
    )
    return tasks.relabel_windows(windows, rows, "an", VOCABULARY.guards["an"])


# A tag task over documents: sources are groups, a document has one window or two.
TASK_SPLIT = Split(n_folds=N_FOLDS, repeats=REPEATS, seed=SEED)
add_cte(
    "task_rows",
    ("labelled",),
    """SELECT item_id, group_id, CASE WHEN "call_ther" THEN 'present' ELSE 'absent' END AS class,
         coalesce("call_ther", FALSE)::INT AS label FROM labelled WHERE keep AND class = 'en'""",
)
for _name, _old, _new in (("ranked_groups", "kept", "task_rows"), ("group_folds", "ranked_groups", "task_ranked_groups")):
    add_cte(f"task_{_name}", (_new,), CTES[_name][1].replace(_old, _new))


@query(
    "K10_run_task",
    sql(
        """SELECT 'calltype_en_ther' || suffix AS model, repeat, fold, count(*) AS items,
             sum(task_rows.label)::BIGINT AS present, sum(item_id::BIGINT)::BIGINT AS ids, ['absent', 'present'] AS classes
           FROM task_rows JOIN task_group_folds USING (group_id)
           CROSS JOIN (VALUES (''), ('_context')) s(suffix)
           GROUP BY suffix, repeat, fold""",
        "task_rows",
        "task_group_folds",
    ),
)
def k10_run(spark, d):
    """A tag's model and its control, fitted on the same splits, committed and read back."""
    root = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    things = document_items(spark, d, F.col("n_chars").alias("bytes")).withColumns(
        {"native_rate": F.col("bytes") % 7, "year": F.lit(2000) + F.col("item_id").cast("int") % 5}
    )
    share = [
        (F.length("text") - F.length(F.replace("text", F.lit(x)))) / F.greatest(F.length("text"), F.lit(1)) for x in "aehrt"
    ]
    last = (F.col("item_id").cast("bigint") % 2).cast("int")
    windows = (
        document_items(spark, d, F.array(*share).alias("features"))
        .filter("class = 'en'")
        .select("item_id", "group_id", "class", "features", F.explode(F.sequence(F.lit(0), last)).alias("window_index"))
    )
    told = annotated(spark, d).filter("class = 'en'")
    models_ = tagtask.run_task(
        windows.withColumn("label", F.lit(0)), things, told, "en", "ther", VOCABULARY, TASK_SPLIT,
        root, "documents", fit_probe((0.1,)), fit_probe((0.1,)),
    )
    told = sets.read_sets(spark, root, "predictions", config="documents", models=models_)
    return told.groupBy("model", "repeat", "fold", "classes").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(F.col("label").cast("bigint")).alias("present"),
        F.sum(F.col("item_id").cast("bigint")).alias("ids"),
    )
