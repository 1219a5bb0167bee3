"""The query registry, and the bindings that read driver tables as a corpus.

Each binding exists twice: as a DataFrame for Spark and as a CTE for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import digest, hex_number
from tidemark.functions.notes import Vocabulary
from tidemark.operators.items import label_index, with_drop_reason
from tidemark.operators.joins import spread_out
from tidemark.operators.ordered import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Oracles that take minutes on more than the smallest tables; tests run them there.
SLOW_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, slow: bool = False):
    """Register a query under its operator id, with its oracle if it has one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            (SLOW_ORACLES if slow else ORACLES)[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def six(value):
    """Six decimals, so that the order of a floating sum cannot show.

    Spelled out, because engines differ in how ``round`` treats a tie.
    """
    return F.floor(value * 1e6 + 0.5) / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: six(F.col(name)) for name in names})


# ---------------------------------------------------------------------------- items
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CONTEXT_CONDITIONS = ["cond_urgent", "cond_final"]


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as items, customers as groups, market segments as classes."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    nation = F.col("c_nationkey").cast("string")
    balance = F.floor(F.col("c_acctbal") / 500).cast("int").cast("string")
    even = F.col("c_nationkey") % 2 == 0
    code = F.when(even, nation).otherwise(
        F.concat(nation, F.lit("/"), F.substring("c_mktsegment", 1, 1))
    )
    chosen = joined.select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_custkey").alias("group_id"),
        F.col("c_mktsegment").alias("class"),
        label_index(F.col("c_mktsegment"), SEGMENTS).alias("label"),
        F.year("o_orderdate").alias("year"),
        F.floor(F.col("c_acctbal") / 10).cast("int").alias("native_rate"),
        (F.col("o_totalprice") / 10000).alias("duration"),
        F.floor("o_totalprice").cast("bigint").alias("bytes"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.concat(nation, F.lit("-"), balance))
        .alias("site"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(code).alias("code"),
        F.when(F.col("c_nationkey") != 0, F.col("c_acctbal")).alias("lat"),
        F.when(F.col("c_nationkey") != 0, F.col("c_nationkey").cast("double")).alias("lon"),
        (F.col("o_orderpriority") == "1-URGENT").alias("cond_urgent"),
        (F.col("o_orderstatus") == "F").alias("cond_final"),
    )
    return with_drop_reason(chosen, min_rate=0, min_seconds=1)


def kept_items(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).filter("keep")


def multi_items(spark: SparkSession, folder: str) -> DataFrame:
    """Events as items, users as groups: every group carries several classes."""
    chosen = table(spark, folder, "events").select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("group_id"),
        F.col("event_type").alias("class"),
        label_index(F.col("event_type"), EVENT_TYPES).alias("label"),
        F.col("value").alias("duration"),
        F.lit(0).alias("native_rate"),
    )
    return with_drop_reason(chosen, min_rate=0, min_seconds=20)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STUDIED = ["click", "error", "view"]

# ---------------------------------------------------------------------------- notes
LANGS = ["de", "en", "es", "fr"]
VOCABULARY = Vocabulary.from_mapping(
    {
        "call_types": {
            "ation": ["ation"],
            "tion": ["tion"],
            "the": ["the"],
            "ther": ["ther", "there"],
            "an": {"terms": ["an"], "max_clip_seconds": 30},
        },
        "conditions": {"ing": ["ing"], "le": ["elle", "le"]},
    }
)


def raw_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as field notes; one in seven opens with no code."""
    text = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(
        F.concat(F.upper("source"), F.lit("  "), F.col("text"))
    )
    point = F.struct(
        F.col("doc_id").cast("double").alias("lat"), F.col("n_chars").cast("double").alias("lon")
    )
    place = F.struct(F.array("source").alias("name"), F.array(point).alias("coordinates"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("record_number"),
        F.col("lang").alias("display_name"),
        text.alias("note"),
        F.when(F.col("doc_id") % 11 != 0, place).alias("location"),
    )


def document_items(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """The items the notes are about: sources as groups, languages as classes; and ``more`` of each."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.col("source").alias("group_id"),
        F.col("lang").alias("class"),
        (F.col("n_chars") / 100).alias("duration"),
        (F.col("n_chars") >= 200).alias("keep"),
        *more,
    )


# ---------------------------------------------------------------------- predictions
N_FOLDS, REPEATS, SEED = 5, 3, 1234
# Scores are whole multiples of 1 / GRID, so a mean over windows is exact in any order.
GRID = 1 << 20
# model -> (points added to the true class, hears the signal, repeats)
MODELS = {
    "a": (400, True, REPEATS),
    "b": (250, True, REPEATS),
    "c": (300, True, 1),
    "log": (500, False, REPEATS),
    "meta": (200, False, REPEATS),
}


def with_scores(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``probs`` for the model named in ``model``: twelve bits of a digest per class,
    plus the model's points for the true class, as shares of their sum."""
    bonus = F.lit(0)
    for model, (points, _, _) in MODELS.items():
        bonus = F.when(F.col("model") == model, F.lit(points)).otherwise(bonus)
    drawn = df.withColumn("__bits", hex_number(digest(*[F.col(k) for k in keys]), 1, 15))
    classes = range(len(SEGMENTS))
    raw = drawn.withColumns(
        {
            f"__r{k}": F.shiftright("__bits", 12 * k).bitwiseAND(4095) % 1000
            + F.when(F.col("label") == k, bonus).otherwise(0)
            + 1
            for k in classes
        }
    )
    total = sum((F.col(f"__r{k}") for k in classes[1:]), F.col("__r0"))
    shares = [F.floor(F.col(f"__r{k}") * GRID / F.col("__total")) / GRID for k in classes]
    return (
        raw.withColumn("__total", total)
        .withColumn("probs", F.array(*shares))
        .drop("__bits", "__total", *[f"__r{k}" for k in classes])
    )


def model_runs(df: DataFrame) -> DataFrame:
    """One row per model for each (item, repeat) the model ran."""
    runs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(repeats).alias("repeats"))
            for m, (_, _, repeats) in MODELS.items()
        ]
    )
    return (
        spread_out(df, "item_id").select("*", F.inline(runs)).filter(F.col("repeat") < F.col("repeats")).drop("repeats")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Item predictions of five models on the test fold of every repeat."""
    from tidemark.operators.scoring import predicted_class
    from tidemark.operators.splits import item_test_folds

    folds = item_test_folds(kept_items(spark, folder), n_folds=N_FOLDS, repeats=REPEATS, seed=SEED)
    scored = with_scores(model_runs(folds), "model", "repeat", "item_id")
    # Never null, so no null filter on it is pushed below the draws and repeats them.
    never_null = F.coalesce(predicted_class(F.col("probs")), F.lit(-1))
    return scored.withColumn("prediction", never_null)


def stored_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions as a stored result set, for queries that read them more than once."""
    return durable(predictions(spark, folder))


def window_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Window predictions: one to four windows per item."""
    from tidemark.operators.splits import item_test_folds

    folds = item_test_folds(kept_items(spark, folder), n_folds=N_FOLDS, repeats=REPEATS, seed=SEED)
    windows = model_runs(folds).withColumn(
        "window_index", F.explode(F.sequence(F.lit(0), (F.col("item_id") % 4).cast("int")))
    )
    return with_scores(windows, "model", "repeat", "item_id", "window_index")


# --------------------------------------------------------------------------- oracle
def h(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT"


def wide(*parts: str) -> str:
    """The same with 60 bits."""
    return h(*parts).replace("1, 8))", "1, 15))")


_POINTS = " ".join(f"WHEN '{m}' THEN {points}" for m, (points, _, _) in MODELS.items())
_RAW = ", ".join(
    f"((bits >> {12 * k}) & 4095) % 1000 + CASE WHEN label = {k} THEN bonus ELSE 0 END + 1 AS r{k}" for k in range(5)
)
_PROBS = ", ".join(
    f"floor(r{k} * {GRID} / (r0 + r1 + r2 + r3 + r4)::DOUBLE) / {GRID} AS p{k}" for k in range(5)
)
_ARGMAX = "CASE " + " ".join(
    f"WHEN p{k} = greatest(p0, p1, p2, p3, p4) THEN {k}" for k in range(5)
) + " END"
_RUNS = ", ".join(f"('{m}', {r})" for m, (_, _, r) in MODELS.items())


def _scored(source: str, keys: str) -> str:
    return f"""
    SELECT *, {_PROBS} FROM (
      SELECT *, {_RAW} FROM (
        SELECT *, CASE model {_POINTS} END AS bonus,
          ('0x' || substr(md5(concat_ws('|', {keys})), 1, 15))::BIGINT AS bits
        FROM {source}))"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "items": (
        (),
        f"""
    SELECT *, drop_reason = '' AS keep FROM (
      SELECT *, CASE WHEN native_rate < 0 THEN 'native_rate_below_target'
                     WHEN duration < 1 THEN 'clip_too_short' ELSE '' END AS drop_reason
      FROM (
        SELECT o_orderkey AS item_id, o_custkey AS group_id, c_mktsegment AS class,
          (list_position({SEGMENTS}, c_mktsegment) - 1)::INT AS label,
          year(o_orderdate)::INT AS year, floor(c_acctbal / 10)::INT AS native_rate,
          o_totalprice / 10000 AS duration, floor(o_totalprice)::BIGINT AS bytes,
          CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
               ELSE c_nationkey::VARCHAR || '-' || floor(c_acctbal / 500)::INT::VARCHAR END AS site,
          CASE WHEN o_orderstatus = 'P' THEN ''
               WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR
               ELSE c_nationkey::VARCHAR || '/' || substr(c_mktsegment, 1, 1) END AS code,
          CASE WHEN c_nationkey <> 0 THEN c_acctbal END AS lat,
          CASE WHEN c_nationkey <> 0 THEN c_nationkey::DOUBLE END AS lon,
          o_orderpriority = '1-URGENT' AS cond_urgent, o_orderstatus = 'F' AS cond_final
        FROM orders JOIN customer ON o_custkey = c_custkey))""",
    ),
    "kept": (("items",), "SELECT * FROM items WHERE keep"),
    "multi": (
        (),
        f"""
    SELECT event_id AS item_id, user_id AS group_id, event_type AS class, value AS duration,
      (list_position({EVENT_TYPES}, event_type) - 1)::INT AS label, value >= 20 AS keep
    FROM events""",
    ),
    "raw_notes": (
        (),
        """
    SELECT doc_id::VARCHAR AS item_id, lang AS class, source,
      CASE WHEN doc_id % 7 = 0 THEN text ELSE upper(source) || '  ' || text END AS note,
      CASE WHEN doc_id % 11 <> 0 THEN source ELSE '' END AS site,
      CASE WHEN doc_id % 11 <> 0 THEN doc_id::DOUBLE END AS lat,
      CASE WHEN doc_id % 11 <> 0 THEN n_chars::DOUBLE END AS lon
    FROM documents""",
    ),
    "doc_items": (
        (),
        """
    SELECT doc_id::VARCHAR AS item_id, source AS group_id, lang AS class,
      n_chars / 100 AS duration, n_chars >= 200 AS keep FROM documents""",
    ),
    # Groups ranked by size inside their majority class, cut into blocks of N_FOLDS.
    "ranked_groups": (
        ("kept",),
        f"""
    SELECT group_id, label, n, rnk // {N_FOLDS} AS block, rnk % {N_FOLDS} AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, group_id) - 1 AS rnk FROM (
        SELECT group_id, arg_min(label, (-c, label)) AS label, sum(c)::BIGINT AS n
        FROM (SELECT group_id, label, count(*) AS c FROM kept GROUP BY ALL) GROUP BY group_id))""",
    ),
    "group_folds": (
        ("ranked_groups",),
        f"""
    SELECT g.*, repeat, (row_number() OVER (PARTITION BY repeat, label, block
        ORDER BY {h(str(SEED) + " + repeat", "group_id")}, group_id) - 1)::INT AS fold
    FROM ranked_groups g CROSS JOIN (SELECT range::INT AS repeat FROM range({REPEATS}))""",
    ),
    "item_folds": (
        ("group_folds", "kept"),
        """
    SELECT k.item_id, k.group_id, k.class, k.label, repeat, fold
    FROM kept k JOIN group_folds f ON k.group_id = f.group_id""",
    ),
    "runs": (
        ("item_folds",),
        f"""
    SELECT f.*, model FROM item_folds f
    JOIN (VALUES {_RUNS}) m(model, repeats) ON repeat < repeats""",
    ),
    "preds": (
        ("runs",),
        f"SELECT *, {_ARGMAX} AS prediction FROM ({_scored('runs', 'model, repeat, item_id')})",
    ),
    "window_runs": (
        ("runs",),
        "SELECT *, unnest(range(item_id % 4 + 1))::INT AS window_index FROM runs",
    ),
    "wpreds": (
        ("window_runs",),
        _scored("window_runs", "model, repeat, item_id, window_index"),
    ),
}


def add_cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *names: str) -> str:
    """The body with every named CTE, and all they need, in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body
