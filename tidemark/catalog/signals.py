"""Windows and features: embeddings as array signals, events as sample rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog.base import (
    add_cte,
    kept_items,
    query,
    rounded,
    six,
    sql,
    table,
)
from tidemark.catalog.splits import item_windows
from tidemark.functions import signal
from tidemark.operators import windows
from tidemark.parameters import Band
from tidemark.plans.registry import build_extractor

BAND = Band(target_rate=1000, min_native_rate=1000, window=16, hop=8, max_windows=4)
UNCAPPED = Band(target_rate=1000, min_native_rate=1000, window=24, hop=10)
LONG = Band(target_rate=1000, min_native_rate=1000, window=128, hop=64, n_fft=32, fft_hop=16, n_mels=8)


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def starts_sql(n: str, band: Band) -> str:
    """The list of window starts for ``n`` samples."""
    w, hop, m = band.window, band.hop, band.max_windows
    last = f"greatest({n} - {w}, 0)"
    count = f"(ceil({last} / {hop}.0::DOUBLE)::BIGINT + 1)"
    every = f"range(0, {count})"
    at = f"list_transform({{ids}}, lambda i: least(i * {hop}, {last})::BIGINT)"
    if not m:
        return at.format(ids=every)
    step = f"(({count} - 1) / {m - 1}.0::DOUBLE)"
    picks = (
        f"list_sort(list_distinct(list_transform(range(0, {m}), lambda i: CASE WHEN i = {m - 1} "
        f"THEN {count} - 1 ELSE round_even(i * {step}, 0)::BIGINT END)))"
    )
    return at.format(ids=f"CASE WHEN {count} > {m} THEN {picks} ELSE {every} END")


def _exploded(source: str, keep: str, lists: str) -> str:
    return f"""SELECT {keep}, (i - 1)::INT AS window_index, starts[i] AS start FROM (
        SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM (
          SELECT *, {lists} AS starts FROM {source}))"""


@query("W1_window_starts", _exploded("documents", "doc_id", starts_sql("n_chars", BAND)))
def w1(spark, d):
    starts = signal.window_starts(F.col("n_chars"), BAND.window, BAND.hop, BAND.max_windows)
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode(starts).alias("window_index", "start")
    )


@query("W1_window_starts_uncapped", _exploded("documents", "doc_id", starts_sql("n_chars", UNCAPPED)))
def w1_uncapped(spark, d):
    starts = signal.window_starts(F.col("n_chars"), UNCAPPED.window, UNCAPPED.hop)
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode(starts).alias("window_index", "start")
    )


def vectors(spark, d):
    """Embeddings as short array signals."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )


_INDEX = {
    "reflect": "CASE WHEN i < 64 THEN i ELSE least(i % 126, 126 - i % 126) END",
    "wrap": "i % 64",
    "edge": "least(i, 63)",
    "constant": "CASE WHEN i < 64 THEN i END",
}


@query(
    "W2_pad_signal",
    " UNION ALL ".join(
        f"""SELECT vec_id AS item_id, '{mode}' AS mode, i::INT AS position,
              coalesce(embedding[({at}) + 1]::DOUBLE, 0) AS value
            FROM embeddings CROSS JOIN (SELECT range AS i FROM range(100))"""
        for mode, at in _INDEX.items()
    ),
)
def w2(spark, d):
    padded = F.array(
        *[
            F.struct(F.lit(m).alias("mode"), signal.pad_signal(F.col("signal"), 100, m).alias("s"))
            for m in _INDEX
        ]
    )
    rows = vectors(spark, d).select("item_id", F.inline(padded))
    return rows.select("item_id", "mode", F.posexplode("s").alias("position", "value"))


add_cte(
    "vector_windows",
    (),
    _exploded("(SELECT vec_id AS item_id, embedding FROM embeddings)", "item_id, embedding", starts_sql("64", BAND)),
)
add_cte(
    "vector_samples",
    ("vector_windows",),
    """SELECT item_id, window_index, start, i::INT AS "offset",
         embedding[start + i + 1]::DOUBLE AS value
       FROM vector_windows CROSS JOIN (SELECT range AS i FROM range(16))""",
)


def vector_windows(spark, d):
    return windows.split_windows(vectors(spark, d), BAND)


@query("W3_split_windows", sql("SELECT * FROM vector_samples", "vector_samples"))
def w3(spark, d):
    return vector_windows(spark, d).select(
        "item_id", "window_index", "start", F.posexplode("samples").alias("offset", "value")
    )


# Events as signals kept in rows: one signal per user, ordered by time.
add_cte(
    "samples",
    (),
    """SELECT user_id AS item_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position,
         count(*) OVER (PARTITION BY user_id) AS n FROM events""",
)


def _sample_ctes(name: str, band: Band) -> None:
    add_cte(
        name,
        ("samples",),
        f"""
    SELECT w.item_id, window_index::BIGINT AS window_index, i::INT AS "offset", value
    FROM ({_exploded('(SELECT DISTINCT item_id, n FROM samples)', 'item_id, n', starts_sql('n', band))}) w
    CROSS JOIN (SELECT range AS i FROM range({band.window}))
    JOIN samples s ON s.item_id = w.item_id AND s.position =
      CASE WHEN start + i < s.n THEN start + i
           ELSE least((start + i) % (2 * (s.n - 1)),
                      2 * (s.n - 1) - (start + i) % (2 * (s.n - 1))) END""",
    )


SHORT = Band(target_rate=1000, min_native_rate=1000, window=80, hop=30)
_sample_ctes("capped_samples", BAND)
_sample_ctes("padded_samples", SHORT)


def event_samples(spark, d):
    events = table(spark, d, "events").select(
        F.col("user_id").alias("item_id"), "ts", "event_id", "value"
    )
    return windows.number_samples(events, "item_id", ["ts", "event_id"])


@query("W3_split_sample_rows", sql("SELECT * FROM capped_samples", "capped_samples"))
def w3_rows(spark, d):
    return windows.split_samples(event_samples(spark, d), BAND)


@query("W3_split_sample_rows_padded", sql("SELECT * FROM padded_samples", "padded_samples"))
def w3_padded(spark, d):
    """No cap, and users with fewer than 80 events are padded by reflection."""
    return windows.split_samples(event_samples(spark, d), SHORT)


_STATS = f"""{r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std,
    {r6('quantile_cont(value, 0.1)')} AS p10, {r6('quantile_cont(value, 0.9)')} AS p90"""
_STAT_NAMES = ["mean", "std", "p10", "p90"]


@query(
    "W4_frame_stats",
    sql(f"SELECT item_id, window_index, {_STATS} FROM vector_samples GROUP BY ALL", "vector_samples"),
)
def w4(spark, d):
    stats = signal.series_stats(F.col("samples"))
    rows = vector_windows(spark, d).select("item_id", "window_index", stats.alias("s"))
    return rounded(rows.select("item_id", "window_index", "s.*"), *_STAT_NAMES)


@query(
    "W4_sample_row_stats",
    sql(f"SELECT item_id, window_index, {_STATS} FROM capped_samples GROUP BY ALL", "capped_samples"),
)
def w4_rows(spark, d):
    cut = windows.split_samples(event_samples(spark, d), BAND)
    return rounded(windows.sample_window_stats(cut), *_STAT_NAMES)


@query(
    "W5_time_descriptors",
    sql(
        f"""SELECT item_id, window_index, {r6('avg(rms)')} AS rms_mean,
              {r6('stddev_pop(rms)')} AS rms_std, {r6('avg(zcr)')} AS zcr_mean,
              {r6('quantile_cont(zcr, 0.9)')} AS zcr_p90
            FROM (SELECT item_id, window_index, f, sqrt(sum(value * value) / 8) AS rms,
                    count(*) FILTER (WHERE "offset" > 4 * f AND (value < 0) <> (before < 0))
                      / 8.0::DOUBLE AS zcr
                  FROM (SELECT *, lag(value) OVER (PARTITION BY item_id, window_index
                          ORDER BY "offset") AS before FROM vector_samples)
                  JOIN (SELECT range AS f FROM range(3)) ON "offset" BETWEEN 4 * f AND 4 * f + 7
                  GROUP BY ALL) GROUP BY ALL""",
        "vector_samples",
    ),
)
def w5(spark, d):
    rms = signal.series_stats(signal.frame_rms(F.col("samples"), 8, 4))
    zcr = signal.series_stats(signal.frame_crossings(F.col("samples"), 8, 4))
    rows = vector_windows(spark, d).select(
        "item_id", "window_index", rms.alias("r"), zcr.alias("z")
    )
    return rows.select(
        "item_id",
        "window_index",
        six(F.col("r.mean")).alias("rms_mean"),
        six(F.col("r.std")).alias("rms_std"),
        six(F.col("z.mean")).alias("zcr_mean"),
        six(F.col("z.p90")).alias("zcr_p90"),
    )


@query(
    "W6_standardise_window",
    sql(
        f"""SELECT item_id, window_index, "offset",
              {r6('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS value
            FROM vector_samples WINDOW w AS (PARTITION BY item_id, window_index)""",
        "vector_samples",
    ),
)
def w6(spark, d):
    scaled = signal.standardise(F.col("samples"))
    rows = vector_windows(spark, d).select(
        "item_id", "window_index", F.posexplode(scaled).alias("offset", "value")
    )
    return rounded(rows, "value")


def long_windows(spark, d):
    return windows.split_windows(vectors(spark, d), LONG)


@query("W7_spectral_job")
def w7(spark, d):
    return build_extractor("acoustic", LONG, n_mfcc=8)(long_windows(spark, d))


@query("W8_log_mel_job")
def w8(spark, d):
    return build_extractor("logmel", LONG)(long_windows(spark, d))


def random_encoder():
    """A fixed random projection of sixteen-sample frames, standing in for an encoder."""
    weights = np.random.default_rng(7).normal(size=(16, 12))
    return lambda block: np.tanh(block.reshape(len(block), -1, 16) @ weights)


@query("W9_embed_windows")
def w9(spark, d):
    job = build_extractor(
        "encoder", LONG, make_encoder=random_encoder, width=12, pooling="mean"
    )
    return job(long_windows(spark, d))


@query(
    "X5_extractor_registry",
    sql(
        " UNION ALL ".join(
            f"SELECT item_id, '{n}' AS name, {n}::DOUBLE AS value FROM kept"
            for n in ("native_rate", "year", "duration", "bytes")
        ),
        "kept",
    ),
)
def x5(spark, d):
    names = F.array(*[F.lit(n) for n in ("native_rate", "year", "duration", "bytes")])
    rows = build_extractor("metadata")(kept_items(spark, d))
    return rows.select(
        "item_id", F.inline(F.arrays_zip(names.alias("name"), "features")).alias("name", "value")
    )


@query(
    "W10_extract_complete",
    sql(
        """SELECT item_id, CASE WHEN year = 1997 THEN 'unreadable' ELSE 'no windows' END AS error
           FROM kept WHERE year IN (1997, 1998)""",
        "kept",
    ),
)
def w10(spark, d):
    """Two years produce nothing; one of them says why."""
    kept = kept_items(spark, d)
    produced = item_windows(spark, d).join(
        kept.filter(F.col("year").isin(1997, 1998)).select("item_id"), "item_id", "left_anti"
    )
    errors = kept.filter("year = 1997").select("item_id", F.lit("unreadable").alias("error"))
    windows.extract_complete(kept, produced, errors, allow_missing=True)
    return windows.missing_items(kept, produced, errors)


@query(
    "W11_window_summary",
    sql(
        """SELECT class, count(*) AS windows, count(DISTINCT item_id) AS items,
             count(DISTINCT group_id) AS groups FROM item_windows GROUP BY class""",
        "item_windows",
    ),
)
def w11(spark, d):
    return windows.window_summary(item_windows(spark, d))


