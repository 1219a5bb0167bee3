"""URL filters by a sort-merge range join of host keys.

A host's key is its labels from the last to the first, each closed by a dot, so that a rule's
host is the interval of all keys that begin with its own key, and intervals are nested or
apart. Addresses and rules are range-partitioned together by key into parts, a busy host over
several of them, and each part is swept once in key order with a stack: a rule opens when its
key comes, and closes when a key comes that does not begin with it. Of the open rules those
whose path begins the address's path fit. A part starts inside the intervals of its
first key's ancestors; the rules of those hosts, a label each at most, are repeated for it.
Neither rules nor addresses are broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import null_safe
from tidemark.operators.ordered import durable

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z lowered."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def host_key(host: Column) -> Column:
    """Labels from last to first, each closed by a dot; the empty host has the empty key."""
    labels = F.transform(F.reverse(F.split(host, r"\.", -1)), lambda label: F.concat(label, F.lit(".")))
    return F.when(host == "", "").otherwise(F.concat_ws("", labels))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``key, host, path, verdict`` of each rule once.

    Null hosts and paths count as empty; a rule without a verdict is none. Of rules with the
    same host and path, one that blocks wins.
    """
    told = rules.filter("verdict is not null").select(
        F.translate(F.coalesce("host", F.lit("")), _CAPITALS, _SMALL).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    )
    once = told.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return once.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")


class _Open:
    """Rules of one host while keys below it pass."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.rules[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def best(self, path: str) -> tuple[str, str] | None:
        """The rule with the longest path that begins ``path``."""
        for length in self.lengths:
            if length <= len(path) and (found := self.rules.get(path[:length])):
                return found
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, key and kind, a key's rules before its addresses."""
    part, stack = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at, rules, verdicts = [], [], []
        columns = [batch.column(name).to_pylist() for name in ("part", "key", "path", "rule", "verdict")]
        for row, (here, key, path, rule, verdict) in enumerate(zip(*columns)):
            if here != part:
                part, stack = here, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1].key != key:
                    stack.append(_Open(key))
                stack[-1].add(path, rule, verdict)
                continue
            # Innermost first: of equally long rules the one with the longer host wins.
            fits = [found for host in reversed(stack) if (found := host.best(path))]
            best = max(fits, key=lambda found: len(found[0]), default=(None, None))
            at.append(row)
            rules.append(best[0])
            verdicts.append(best[1])
        kept = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [kept.column("id"), kept.column("host"), kept.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    *,
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``). A rule fits its host and all
    hosts below it if its path begins the address's; a rule with an empty host fits every
    host. The longest rule (host and path together, then the longer host) wins, and an address
    that none fits has a null rule and the verdict ``default``. A null address, or one without
    ``://``, has an empty host and path. Rows that repeat stay rows, ids may be null, and
    other columns are neither read nor returned.
    """
    wide = "id bigint, key string, host string, path string, rule string, verdict string"
    asked = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
        path_of(F.col(f"`{url_col}`")).alias("path"),
    )
    none = F.lit(None).cast("string")
    asked = asked.select("id", host_key(F.col("host")).alias("key"), "host", "path", none.alias("rule"), none.alias("verdict"))
    told = durable(canonical_rules(rules))
    events = told.select(
        F.lit(None).cast("bigint").alias("id"), "key", "host", "path", F.concat("host", "path").alias("rule"), "verdict"
    )
    # The digest spreads a busy host over parts; within a part its order does not matter.
    spread = F.xxhash64(null_safe(F.col("id"), F.col("path")))
    names = [part.split()[0] for part in wide.split(", ")]
    laid = durable(
        asked.unionByName(events)
        .repartitionByRange("key", F.col("rule").isNull(), spread)
        .withColumn("part", F.spark_partition_id())
        .select("part", *names)
    )
    # Rules of the hosts that are open where a part starts, the first key's own host included.
    firsts = laid.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split("first", r"\.", -1)
    above = firsts.select(
        "part",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(labels) - 1),
                lambda n: F.concat_ws("", F.transform(F.slice(labels, 1, n), lambda x: F.concat(x, F.lit(".")))),
            )
        ).alias("key"),
    )
    carried = above.join(events, "key").select("part", *names)
    count = laid.sparkSession.conf.get("spark.sql.shuffle.partitions")
    swept = (
        laid.unionByName(carried)
        .repartition(int(count), "part")
        .sortWithinPartitions("part", "key", F.col("rule").isNull())
        .mapInArrow(_sweep, "page_id bigint, host string, path string, rule string, verdict string")
    )
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
