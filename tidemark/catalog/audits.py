"""Corpus audits over the item bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EVENT_TYPES,
    SEGMENTS,
    STUDIED,
    items,
    kept_items,
    multi_items,
    query,
    rounded,
    sql,
)
from tidemark.functions.notes import recorded
from tidemark.operators import collection, context
from tidemark.operators.items import (
    below_band,
    check_items,
    duplicate_items,
    label_index,
    with_drop_reason,
)

FIELDS = ["native_rate", "site", "code"]


@query(
    "P2_drop_reason",
    sql("SELECT item_id, drop_reason, keep FROM items", "items"),
)
def p2(spark, d):
    bare = items(spark, d).drop("drop_reason", "keep")
    return with_drop_reason(bare, min_rate=0, min_seconds=1).select("item_id", "drop_reason", "keep")


@query(
    "P3_label_index",
    f"""SELECT event_id AS item_id,
        CASE WHEN event_type IN ('click', 'error', 'view')
             THEN (list_position({STUDIED}, event_type) - 1)::INT END AS label FROM events""",
)
def p3(spark, d):
    return multi_items(spark, d).select("item_id", label_index(F.col("class"), STUDIED, unknown="null").alias("label"))


@query(
    "P8_recorded",
    sql(
        """SELECT item_id, length(regexp_replace(site, '[ \t\n\r\f\v]', '', 'g')) > 0 AS site_recorded, lat IS NOT NULL AS lat_recorded
           FROM items""",
        "items",
    ),
)
def p8(spark, d):
    rows = items(spark, d)
    return rows.select(
        "item_id",
        recorded(rows, "site").alias("site_recorded"),
        recorded(rows, "lat").alias("lat_recorded"),
    )


@query(
    "P9_validate_band",
    sql(
        """SELECT item_id, native_rate FROM items WHERE keep AND native_rate < 20""",
        "items",
    ),
)
def p9(spark, d):
    return below_band(items(spark, d), target_rate=20).select("item_id", "native_rate")


@query(
    "J9_unique_items",
    "SELECT o_custkey AS item_id, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def j9(spark, d):
    rows = check_items(items(spark, d)).select(F.col("group_id").alias("item_id"))
    return duplicate_items(rows)


@query(
    "A1_audit_coverage",
    sql(
        """SELECT class, count(*) AS items, count(DISTINCT group_id) AS groups,
             count(*) FILTER (WHERE keep) AS kept_items,
             count(DISTINCT CASE WHEN keep THEN group_id END) AS kept_groups,
             floor((coalesce(sum(CASE WHEN keep THEN duration END), 0) / 3600.0) * 1e6 + 0.5) / 1e6 AS kept_hours
           FROM items GROUP BY class""",
        "items",
    ),
)
def a1(spark, d):
    return rounded(collection.coverage(items(spark, d)), "kept_hours")


@query(
    "A2_audit_sample_rates",
    sql(
        """SELECT class, native_rate, count(*) AS items, count(DISTINCT group_id) AS groups
           FROM items GROUP BY ALL""",
        "items",
    ),
)
def a2(spark, d):
    return collection.value_counts(items(spark, d), "native_rate")


_PER_GROUP = """
    SELECT class, group_id, count(*) AS items, count(*) FILTER (WHERE keep) AS kept_items,
      arg_min(year, item_id) AS year, arg_min(native_rate, item_id) AS native_rate,
      floor(sum(duration) * 1e6 + 0.5) / 1e6 AS seconds FROM items GROUP BY class, group_id"""


@query("A3_audit_per_group", sql(_PER_GROUP, "items"))
def a3(spark, d):
    return rounded(collection.per_group(items(spark, d)), "seconds")


@query(
    "A4_audit_dropped",
    sql(
        """SELECT class, drop_reason, count(*) AS items, count(DISTINCT group_id) AS groups
           FROM items WHERE NOT keep GROUP BY ALL""",
        "items",
    ),
)
def a4(spark, d):
    return collection.dropped(items(spark, d))


_CROSS = f"""
    SELECT group_id, n_classes, classes, len(under)::BIGINT AS n_under_study,
      array_to_string(under, ', ') AS under_study, alive > 1 AS kept
    FROM (
      SELECT group_id, count(DISTINCT class) AS n_classes,
        string_agg(DISTINCT class, ', ' ORDER BY class) AS classes,
        coalesce(list_sort(list(DISTINCT class) FILTER (WHERE class IN {tuple(STUDIED)})), []) AS under,
        count(DISTINCT class) FILTER (WHERE keep AND class IN {tuple(STUDIED)}) AS alive
      FROM multi GROUP BY group_id HAVING count(DISTINCT class) > 1)"""


@query("A5_cross_label_groups", sql(_CROSS, "multi"))
def a5(spark, d):
    return collection.cross_label_groups(multi_items(spark, d), STUDIED)


@query(
    "A6_classes_per_value",
    sql(
        """SELECT site, count(DISTINCT class) AS classes, count(*) AS items
           FROM items WHERE keep AND length(regexp_replace(site, '[ \t\n\r\f\v]', '', 'g')) > 0 GROUP BY site""",
        "items",
    ),
)
def a6(spark, d):
    return context.classes_per_value(kept_items(spark, d), "site")


def _outcome(field: str, absent: str) -> str:
    return f"""
      SELECT item_id, '{field}' AS field, CASE WHEN {absent} THEN 'absent'
        WHEN (SELECT count(DISTINCT class) FROM kept k WHERE k.{field} = o.{field}) > 1
        THEN 'shared' ELSE 'unique' END AS outcome FROM kept o"""


OUTCOMES = " UNION ALL ".join(
    [
        _outcome("native_rate", "native_rate IS NULL"),
        _outcome("site", "length(regexp_replace(site, '[ \t\n\r\f\v]', '', 'g')) = 0"),
        _outcome("code", "length(regexp_replace(code, '[ \t\n\r\f\v]', '', 'g')) = 0"),
    ]
)


@query("A7_giveaway_labels", sql(OUTCOMES, "kept"))
def a7(spark, d):
    return context.giveaway_labels(kept_items(spark, d), FIELDS)


def _giveaway(field: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {lead}count(*) FILTER (WHERE written) AS values,
      count(*) FILTER (WHERE written AND classes = 1) AS single_class_values,
      sum(n)::BIGINT AS items,
      coalesce(sum(n) FILTER (WHERE written), 0)::BIGINT AS items_recorded,
      coalesce(sum(n) FILTER (WHERE written AND classes = 1), 0)::BIGINT AS items_given_away,
      round(coalesce(sum(n) FILTER (WHERE written AND classes = 1), 0)::DOUBLE
            / greatest(sum(n), 1), 4) AS share_given_away
    FROM (SELECT {lead}{field}, length(regexp_replace({field}, '[ \t\n\r\f\v]', '', 'g')) > 0 AS written,
            count(DISTINCT class) AS classes, count(*) AS n FROM kept GROUP BY ALL) {group}"""


@query("A8_site_giveaway", sql(_giveaway("site"), "kept"))
def a8(spark, d):
    return context.field_giveaway(kept_items(spark, d), "site")


@query("A8_site_giveaway_by_year", sql(_giveaway("site", "year"), "kept"))
def a8_by_year(spark, d):
    return context.field_giveaway(kept_items(spark, d), "site", by=["year"])


@query("A9_code_giveaway", sql(_giveaway("code"), "kept"))
def a9(spark, d):
    return context.field_giveaway(kept_items(spark, d), "code")


@query(
    "A10_codes_by_class",
    sql(
        """SELECT code, count(*) AS items, count(DISTINCT group_id) AS groups,
             count(DISTINCT class) AS classes,
             string_agg(DISTINCT class, ', ' ORDER BY class) AS carried
           FROM kept WHERE length(regexp_replace(code, '[ \t\n\r\f\v]', '', 'g')) > 0 GROUP BY code""",
        "kept",
    ),
)
def a10(spark, d):
    return context.values_by_class(kept_items(spark, d), "code").orderBy(F.desc("items"), "code")


@query(
    "A11_sites_by_class",
    sql(
        """SELECT class, site, count(*) AS items, count(DISTINCT group_id) AS groups
           FROM kept WHERE length(regexp_replace(site, '[ \t\n\r\f\v]', '', 'g')) > 0 GROUP BY ALL""",
        "kept",
    ),
)
def a11(spark, d):
    table = context.class_value_counts(kept_items(spark, d), "site")
    return table.orderBy("class", F.desc("items"), "site")


_COVERED = """(SELECT class, count(DISTINCT group_id) AS groups,
     count(DISTINCT CASE WHEN keep THEN group_id END) AS kept_groups FROM items GROUP BY class)"""


@query(
    "A14_filter_loss",
    sql(
        f"""SELECT class, groups, kept_groups, groups - kept_groups AS groups_lost,
             round((groups - kept_groups)::DOUBLE / groups, 3) AS share_lost FROM {_COVERED}""",
        "items",
    ),
)
def a14(spark, d):
    return collection.filter_loss(collection.coverage(items(spark, d)))


@query(
    "A15_concentration",
    sql(
        f"""SELECT class, count(*) AS groups, sum(kept_items)::BIGINT AS items,
              round(avg(kept_items), 1) AS items_per_group
            FROM ({_PER_GROUP}) WHERE kept_items > 0 GROUP BY class""",
        "items",
    ),
)
def a15(spark, d):
    return collection.concentration(collection.per_group(items(spark, d)))


@query(
    "A15_top_share",
    sql(
        f"""SELECT (SELECT sum(kept_items)::BIGINT FROM
              (SELECT kept_items FROM ({_PER_GROUP}) ORDER BY kept_items DESC LIMIT 10)) AS top_items,
              count(*) AS kept_items,
              (SELECT sum(kept_items)::BIGINT FROM
              (SELECT kept_items FROM ({_PER_GROUP}) ORDER BY kept_items DESC LIMIT 10))
              / greatest(count(*), 1)::DOUBLE AS share FROM kept""",
        "kept",
    ),
)
def a15_share(spark, d):
    return collection.top_share(collection.per_group(items(spark, d)))


@query(
    "A16_rate_pivot",
    sql(
        "SELECT native_rate, "
        + ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS \"{c}\"" for c in SEGMENTS)
        + " FROM items GROUP BY native_rate",
        "items",
    ),
)
def a16(spark, d):
    return collection.value_matrix(items(spark, d), "native_rate", SEGMENTS)


@query(
    "A17_caveat_groups",
    sql(
        f"""SELECT class, count(*) AS shared_groups FROM (
              SELECT group_id, unnest(string_split(under_study, ', ')) AS class
              FROM ({_CROSS}) WHERE n_under_study >= 2 AND kept) GROUP BY class""",
        "multi",
    ),
)
def a17(spark, d):
    return collection.caveat_groups(collection.cross_label_groups(multi_items(spark, d), STUDIED))


@query(
    "X1_top_groups",
    sql(
        f"""SELECT class, group_id, year, native_rate, kept_items FROM ({_PER_GROUP})
            WHERE kept_items > 0 ORDER BY kept_items DESC, group_id, class LIMIT 10""",
        "items",
    ),
)
def x1(spark, d):
    return collection.top_groups(collection.per_group(items(spark, d)))


@query(
    "A2_event_values",
    sql(
        """SELECT class, keep, count(*) AS items, count(DISTINCT group_id) AS groups
           FROM multi GROUP BY ALL""",
        "multi",
    ),
)
def a2_events(spark, d):
    return collection.value_counts(multi_items(spark, d), "keep")


assert set(STUDIED) <= set(EVENT_TYPES)
