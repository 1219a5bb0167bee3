"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling
from tidemark.llm.queries import QUERIES

LOWER = {code: code + 32 for code in range(65, 91)}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def _variants(counts, factor=5):
    near = {w: [x for x in counts if _one_edit(w, x)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[word] = best if best is not None and counts[best] >= factor * counts[word] else None

    def root(word):
        return word if form[word] is None else root(form[word])

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def _told(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def _counts(rows, every, length=6, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = run.translate(LOWER)
            digest = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
            if every and digest % every == 0:
                word = word[: digest % len(word)] + word[digest % len(word) + 1 :]
            if len(word) >= length:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé\u00ff"])
def test_all_pairs_are_found_in_dense_vocabularies(spark, letters):
    draw, words = random.Random(letters), {}
    while len(words) < 400:
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(6, 11)))
        words.setdefault(word, 5 ** draw.randrange(1, 6) + draw.randrange(3))
        at = draw.randrange(len(word))
        for other in (word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:], word[:at] + draw.choice(letters) + word[at + 1 :]):
            if len(other) >= 6:
                words.setdefault(other, draw.randrange(5, 40))
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert _told(spelling.spelling_variants(frame)) == _variants(words)


def test_edges_ties_and_chains(spark):
    words = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "xbcdef": 25, "abcdxf": 25, "zzzzzz": 9, "zzzzzzz": 44}
    words |= {"a" * 3000: 30, "a" * 1500 + "b" + "a" * 1499: 150}
    got = _told(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got == _variants(words)
    # Of three near words with 25 the first in order is the form; 44 is less than five nines.
    assert got["abcdef"][:2] == ("abcdefg", "abcdefghi") and got["zzzzzz"] == (None, "zzzzzz", 9, 1, None)


def test_pivots_are_disjoint_and_cheapest():
    draw = random.Random(4)
    for _ in range(300):
        word = "".join(draw.choice("abc") for _ in range(draw.randrange(6, 12)))
        grams = sorted({word[p : p + 2] for p in range(len(word) - 1)}, key=lambda g: (hash(g), g))
        rank, cost = {g: i for i, g in enumerate(grams)}, sorted(draw.randrange(100) for _ in grams)
        prefix = spelling.gram_prefix(word, rank)
        one, two = spelling.pivots(prefix, cost)
        assert two - one >= 2
        price = dict((place, cost[r]) for r, place in prefix)
        least = min(price[p] + price[q] for p in price for q in price if q - p >= 2)
        assert price[one] + price[two] == least


def test_words_of_whole_texts_nulls_and_clashing_names(spark):
    draw = random.Random(9)
    rows = [(i if i % 9 else None, " ".join(draw.choice(["Banana", "ÉTÉÉTÉÉ", "straße\u00d7x", "kind of", "cherries,", "BANANA5split", "ĀĀĀĀĀĀ"]) for _ in range(60))) for i in range(200)]
    rows += [(1, None), (2, ""), (3, "longword " * 5000 + "lastword")] + [(4, "lastword")] * 4
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id bigint, text string, word string, n bigint")
    for every in (None, 7):
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs, every=every).collect()}
        assert got == _counts(rows, every)
    assert _counts(rows, None)["lastword"] == 5
    assert spelling.spelling_variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert _told(QUERIES["op11_spelling"](spark, folder)) == _variants(_counts([tuple(r) for r in docs], 199))
