"""Spelling variants by pivotal grams.

Two words at one edit share a bigram that the edit has not touched. Bigrams are ordered from
rare to frequent; a word's *prefix* is its three rarest (and what repeats the third), and its
*pivots* are two disjoint grams of the prefix, chosen by dynamic programming so that they are
the least frequent together. One edit can touch one pivot at most. So of two near words, the one
whose prefix reaches further in that order has a pivot of the other in it, and matching the
pivots of all words with the prefixes of all words finds every pair.

Position limits: the untouched pivot has the edit on one side, so it stands equally far from
one end of both words, and all letters between it and that end are equal. The other side
is cut in halves, one of which is equal too. Length, place, side and the equal letters make
the key under which pivots and prefixes meet, so a frequent gram is no bucket. What meets
is verified by the edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import durable

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 3

INDEX = "word string, n bigint, role string, key bigint"


def thinned(run: Column, doc_id: Column, every: int) -> Column:
    """A run, without one letter if the digest of document and run is divisible by ``every``."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run)
    h = F.crc32(told.cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    every: int | None = None,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word, n`` of the words of whole texts: runs of Latin letters with A-Z lowered.

    A null text has none. With ``every``, the runs whose digest it divides lose a letter. Words
    shorter or rarer than the limits are left out.
    """
    runs = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.explode(F.expr(f"regexp_extract_all(`{text_col}`, r'{RUN}', 0)")).alias("run"),
    ).filter(F.length("run") >= least_length)
    word = F.translate("run", _CAPITALS, _SMALL)
    if every is not None:
        word = thinned(word, F.col("doc_id"), every)
    return (
        runs.select(word.alias("word"))
        .filter(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_count)
    )


def gram_prefix(word: str, rank: dict[str, int]) -> list[tuple[int, int]]:
    """``(rank, place)`` of the rarest bigrams; what equals the last of them comes along."""
    grams = sorted((rank[word[p : p + 2]], p) for p in range(len(word) - 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    return [gram for gram in grams if gram[0] <= last]


def pivots(prefix: list[tuple[int, int]], cost: list[int], count: int = 2) -> list[int]:
    """Places of ``count`` disjoint grams of the prefix with the least total cost.

    ``best[m]`` holds the cheapest choices of ``m`` grams among those seen so far, for each end
    that still matters: a gram may follow a choice that ends two places earlier.
    """
    places = sorted((place, cost[rank]) for rank, place in prefix)
    table: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for i, (place, price) in enumerate(places):
        row = list(table[-1]) if table else [(0, ())] + [None] * count
        before = next((table[j] for j in range(i - 1, -1, -1) if places[j][0] <= place - 2), [(0, ())] + [None] * count)
        for m in range(1, count + 1):
            if before[m - 1] is not None:
                choice = (before[m - 1][0] + price, (*before[m - 1][1], place))
                if row[m] is None or choice < row[m]:
                    row[m] = choice
        table.append(row)
    return list(table[-1][count][1])


def _key(*parts: object) -> int:
    told = "\x00".join(map(str, parts)).encode()
    return int.from_bytes(blake2b(told, digest_size=8).digest(), "little", signed=True)


def pivot_keys(word: str, place: int) -> set[int]:
    """Keys of a pivot: what stays equal if the edit is right or left of it, in either half."""
    n, end = len(word), place + 2
    half, low = end + (n - end) // 2, place // 2
    return {
        _key("a", n, place, word[:half]),
        _key("b", n, place, word[:end], word[half:]),
        _key("c", n, place, word[low:]),
        _key("d", n, place, word[:low], word[place:]),
    }


def prefix_keys(word: str, place: int) -> set[int]:
    """The same keys for each length that a near word with this gram as pivot can have."""
    keys, length = set(), len(word)
    for n in (length - 1, length, length + 1):
        end = place + 2
        if n >= end:
            half = end + (n - end) // 2
            if length >= half:
                keys.add(_key("a", n, place, word[:half]))
            if length - (n - half) >= end:
                keys.add(_key("b", n, place, word[:end], word[length - (n - half) :]))
        other = place + n - length
        if other >= 0:
            low = other // 2
            if length >= n - low:
                keys.add(_key("c", n, other, word[length - (n - low) :]))
            if length - (n - other) >= low:
                keys.add(_key("d", n, other, word[:low], word[length - (n - other) :]))
    return keys


def _index(grams: list[tuple[str, int]]):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {gram: i for i, (gram, _) in enumerate(grams)}
        cost = [n for _, n in grams]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                at, roles, keys = [], [], []
                for row, word in enumerate(part.column("word").to_pylist()):
                    prefix = gram_prefix(word, rank)
                    own = [key for place in pivots(prefix, cost) for key in pivot_keys(word, place)]
                    others = {key for _, place in prefix for key in prefix_keys(word, place)}
                    at.extend([row] * (len(own) + len(others)))
                    roles.extend(["pivot"] * len(own) + ["prefix"] * len(others))
                    keys.extend([*own, *others])
                taken = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("word"), taken.column("n"), pa.array(roles, pa.string()), pa.array(keys, pa.int64())],
                    names=["word", "n", "role", "key"],
                )

    return indexed


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for each ordered pair of different words at exactly one edit.

    ``words`` has each word (four letters or more) once with its count ``n``. A code point is
    inserted, deleted or replaced.
    """
    # Bigrams of the runs' alphabet: 90 x 90 at most.
    counted = (
        words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), p -> substring(word, p, 2))")).alias("gram"))
        .groupBy("gram").count()
    )
    grams = sorted(((r["gram"], r["count"]) for r in counted.collect()), key=lambda g: (g[1], g[0]))
    index = durable(words.select("word", "n").mapInArrow(_index(grams), INDEX))
    x = index.filter("role = 'pivot'").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    y = index.filter("role = 'prefix'").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = x.join(y, "key").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    turned = F.col("a") < F.col("b")
    pair = F.array(F.struct("a", "n_a", "b", "n_b"), F.expr("struct(b as a, n_b as n_a, a as b, n_a as n_b)"))
    once = met.select(F.when(turned, pair[0]).otherwise(pair[1]).alias("p")).select("p.*").distinct()
    both = once.select(F.explode(pair).alias("p"))
    return both.select(
        F.col("p.a").alias("word"), F.col("p.n_a").alias("n"), F.col("p.b").alias("near"), F.col("p.n_b").alias("near_n")
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` of every link ``word, form``: pointers are doubled until none moves.

    Counts grow by the factor along a chain, so the rounds are few at any size.
    """
    now = durable(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(now.join(onward, "root", "left"))
        if moved.filter("further is not null").isEmpty():
            return now
        now = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(words: DataFrame, *, factor: int = FACTOR) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` of every word of ``words(word, n)``.

    Two words are near if they differ by exactly one code point inserted, deleted or replaced.
    The form is the near word of largest ``n`` (ties: smallest in code-point order) if that is at
    least ``factor`` times the word's own; the root is where forms lead. A word without near
    words has 0, nulls, and itself as root. Each word comes once; an empty table gives one.
    """
    words = durable(words.select("word", "n"))
    near = near_words(words)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    strong = -F.col("best.less") >= F.lit(factor) * F.col("n")
    told = durable(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.when(strong, F.col("best.form")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        )
    )
    roots = _roots(told.filter("form is not null"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
