"""The dealt operators bound to the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat,
    exact_dedup,
    licences,
    minhash,
    nearest,
    negatives,
    packing,
    pieces,
    quality,
    spelling,
    toxicity,
    urls,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


QUERIES["op3_exact_dedup"] = op3_exact_dedup
ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_components(_table(spark, folder, "documents"))


QUERIES["op5_minhash"] = op5_minhash


def _vocabulary(name: str) -> str:
    """Where the vocabulary files of this installation lie; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"))


QUERIES["op9_packing"] = op9_packing


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES["op10_quality"] = op10_quality


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES["op2_toxicity"] = op2_toxicity


def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op1_nearest"] = op1_nearest


#: A conversation made of control strings, which formatting must keep apart from its own.
_TRICKY = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(_TRICKY, "conv_id bigint, turn bigint, role string, text string")
    told = chat.read_chat(chat.format_chat(turns.unionByName(tricky)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES["op4_chat"] = op4_chat
# Each turn adds "<s>", its opening and closing strings, and a mark before \\, < and [.
ORACLES["op4_chat"] = r"""
WITH told AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(
           length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) + 3
           + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 17 WHEN 'assistant' THEN 9
                       ELSE 17 + length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) END
       ) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(_table(spark, folder, "pages"))


QUERIES["op6_warc"] = op6_warc
ORACLES["op6_warc"] = """
WITH told AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), sized AS (
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM told
), grouped AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = winner THEN NULL ELSE winner END AS refers_to
FROM grouped
"""


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document with dropout, decode the ids, and compare the texts' digests."""
    model = _vocabulary("piece_bpe_32k.model")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    docs = _table(spark, folder, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    encoded = pieces.encode_documents(docs, model)
    told = encoded.withColumn("n_pieces", F.size("ids").cast("bigint")).withColumn("ids_hash", F.xxhash64("ids"))
    return pieces.decode_documents(told, model).select(
        "doc_id",
        "n_pieces",
        "ids_hash",
        "text_sha256",
        (F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256")).alias("lossless"),
    )


QUERIES["op7_pieces"] = op7_pieces


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(_table(spark, folder, "documents"))


QUERIES["op8_licences"] = op8_licences
ORACLES["op8_licences"] = licences.oracle()


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.word_counts(_table(spark, folder, "documents"), every=199)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES["op11_spelling"] = op11_spelling


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, folder, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES["op12_hard_negatives"] = op12_hard_negatives
ORACLES["op12_hard_negatives"] = """
WITH told AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM told a JOIN told b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""


#: ``(host, path, verdict)``
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op13_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(_table(spark, folder, "pages"), rules)


QUERIES["op13_url_filters"] = op13_url_filters
ORACLES["op13_url_filters"] = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
    SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS written,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), told AS (
    SELECT page_id, path, translate(written, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut
), fits AS (
    SELECT page_id, host, path,
           arg_max(struct_pack(r := rule_host || rule_path, v := rule_verdict), length(rule_host || rule_path)) AS best
    FROM told LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY ALL
)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM fits
"""
