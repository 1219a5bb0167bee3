"""Exact and near duplicates against plain Python, and their defined corner cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact_dedup, minhash
from tidemark.llm.components import components, merged
from tidemark.llm.words import buffers, shingle_sets

DOCS = "doc_id bigint, text string"


def _sets(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def _near(rows, size=3, percent=85):
    """Component of every id, by comparing all pairs."""
    sets = {i: _sets(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def _family(seed, copies, edits, words=60):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(draw.randrange(edits + 1)):
            own[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_shingle_sets_count_as_plain_sets_do():
    texts = ["A b\tc\x0bd", "", None, "one", "One two", "a a a a a a", "é è é è é", "x" * 5000 + " y z w", " \n\r\f "]
    got = [len(s) for s in shingle_sets(*buffers(pa.array(texts, pa.string())), 3)]
    assert got == [len(_sets(t, 3)) for t in texts]
    same = list(shingle_sets(*buffers(pa.array(["The quick Fox ran", "the QUICK fox ran", "the quick fox run"])), 3))
    assert (same[0] == same[1]).all() and not (same[0] == same[2]).all()


def test_exact_groups_nulls_ties_and_clashing_names(spark):
    rows = [(1, "a", "z"), (7, "a", "y"), (3, "a ", "x"), (4, None, "w"), (5, "", "v"), (None, "a", "u"), (9, "b", "t"), (9, "b", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id string")
    got = exact_dedup.exact_dedup(docs).collect()
    told = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["kept"]) for r in got)
    assert [t[:3] for t in told] == [(-1, 7, 3), (1, 7, 3), (3, 3, 1), (4, 5, 2), (5, 5, 2), (7, 7, 3), (9, 9, 2), (9, 9, 2)]
    assert sum(t[3] for t in told) == 4
    assert {r["text_sha256"] for r in got if r["doc_id"] == 4} == {hashlib.sha256(b"").hexdigest()}
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 7, 9]


def test_exact_hot_group_is_split_and_right(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 500}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    for r in got:
        like = [i for i, t in rows if t == rows[r["doc_id"]][1]] if r["doc_id"] < 40 else None
        if like:
            assert (r["keep_id"], r["group_size"]) == (max(like), len(like))
    assert len(got) == 3000 and sum(r["kept"] for r in got) == len({t for _, t in rows})


def test_exact_and_near_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert minhash.near_components(docs).count() == 0


def test_near_components_match_all_pairs(spark):
    texts = [t for seed in range(4) for t in _family(seed, 14, 3)] + _family(9, 40, 6)
    texts += [None, "", " \t", "one two", "One  two", "one two three", "x" * 3000] + texts[:3]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    got = minhash.near_components(spark.createDataFrame(rows, DOCS)).collect()
    want = _near(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_takes_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (2, text), (None, text), (None, None)]
    got = minhash.near_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [
        (-1, -1, True), (-1, 2, False), (2, 2, True), (5, 2, False), (5, 2, False),
    ]
    kept = minhash.drop_near(spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, kept string"))
    assert kept.columns == ["doc_id", "text", "kept"] and sum(r["doc_id"] == 2 for r in kept.collect()) == 1


def test_near_keeps_different_texts_under_no_id_or_one(spark):
    texts = [" ".join(f"{name}{i}" for i in range(30)) for name in "abcdefgh"]
    rows = [(None, t) for t in texts[:3]] + [(3, t) for t in texts[3:6]] + [(None, ""), (3, None), (3, texts[3])]
    # A near copy and another spelling go, and so does one under the same id.
    rows += [(4, texts[4] + " x"), (4, texts[6]), (3, texts[5].upper()), (3, texts[5] + " y"), (2, texts[7]), (3, texts[7] + " z")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = [(r["doc_id"], r["text"]) for r in minhash.drop_near(docs).collect()]
    assert len(kept) == len(set(kept))
    assert {(i, t) for i, t in kept if i is None} == {(None, t) for t in [*texts[:3], ""]}
    assert {(i, t) for i, t in kept if i != 3 and i} == {(4, texts[6]), (2, texts[7])}
    of_three = [t for i, t in kept if i == 3]
    assert len(of_three) == 4 and {texts[3], texts[4], None} < set(of_three)
    found = {(r["component_id"], r["kept"]) for r in minhash.near_components(docs).filter("doc_id = 4").collect()}
    assert found == {(3, False), (4, True)}


def test_estimate_follows_the_true_similarity(spark):
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(pool[:3000]), np.unique(pool[300:3300])]  # 2700 of 3300 in common
    low = np.zeros((2, 128), np.uint64)
    low[:, :120] = [minhash.minima(s) & np.uint32(15) for s in sets]
    bits = (low.reshape(2, 8, 16) << minhash._SHIFTS).sum(axis=2, dtype=np.uint64).view(np.int64).tolist()
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(bits[0], bits[1])], "a array<bigint>, b array<bigint>")
    found = row.select(minhash.estimate(F.col("a"), F.col("b")).alias("e"), minhash.estimate(F.col("a"), F.col("a")).alias("one")).first()
    assert found["one"] == pytest.approx(1.0) and abs(found["e"] - 2700 / 3300) < 0.12


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_merging_components_equals_components_of_all_links(spark):
    draw = random.Random(12)
    for size in (30, 200):
        one = [(draw.randrange(size), draw.randrange(size)) for _ in range(size // 2)]
        two = [(draw.randrange(size + 9), draw.randrange(size + 9)) for _ in range(size // 6)] + [(1, 1)]
        frames = [spark.createDataFrame(links, "a bigint, b bigint") for links in (one, two)]
        got = {r["node"]: r["component"] for r in merged(components(frames[0]), frames[1]).collect()}
        want = {r["node"]: r["component"] for r in components(frames[0].unionByName(frames[1])).collect()}
        assert got == want
    assert merged(components(frames[0]), frames[1].limit(0)).count() == components(frames[0]).count()


def test_dropping_keeps_columns_named_like_the_key(spark):
    columns = f"{DOCS}, __key string, `__KEY_` int"
    rows = [(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, "g h i j k l", None, 3), (None, "", "z", 4)]
    docs = spark.createDataFrame(rows, columns)
    exact = exact_dedup.drop_exact(docs)
    assert exact.dtypes == docs.dtypes
    assert {tuple(r) for r in exact.collect()} == set(rows[1:])
    near = minhash.drop_near(docs)
    assert near.dtypes == docs.dtypes
    assert {tuple(r) for r in near.collect()} == {rows[0], *rows[2:]}


def test_a_crowded_bucket_takes_no_more_tasks_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 16)
    draw = random.Random(8)
    sets = [sorted(draw.sample(range(12), draw.randrange(8, 12))) for _ in range(400)]
    # One bucket of 400 candidates of three components, and one of two.
    rows = [(0, 7, n, len(s), [0] * 8, n % 3, len(s), [7], s) for n, s in enumerate(sets)]
    rows += [(0, 8, n, 9, [0] * 8, n, 9, [8], list(range(9))) for n in (900, 901)]
    kinds = "band int, key bigint, node bigint, n_shingles bigint, bits array<bigint>, component bigint, common bigint"
    table = spark.createDataFrame(rows, f"{kinds}, bands array<bigint>, shingles array<bigint>")
    want = {(900, 901)}
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            shared = len(set(x) & set(y))
            if a % 3 != b % 3 and 100 * shared >= 80 * (len(x) + len(y) - shared):
                want.add((a, b))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    }
    before = {name: spark.conf.get(name) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        links = minhash._crossing_links(minhash._blocked(table.repartition(16, "node")), 0.0, 80)
        got = [(r["a"], r["b"]) for r in links.collect()]
        tasks = links.rdd.getNumPartitions()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(got) == len(set(got)) and set(got) == want
    assert tasks <= 8
