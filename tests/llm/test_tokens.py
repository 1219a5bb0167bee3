"""Token ids against the libraries, packing plans against brute force, lossless pieces."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import packing, pieces
from tidemark.llm.tokens import WordTokens
from tidemark.llm.words import buffers

WORDS, PIECES = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id bigint, text string, length string"
ODD = ["", " ", "a\x1cb É'S don't <|endoftext|>x", "ΣΑΣ İx ǅ ﬁ́ a b", "...!!! 12a 3", "é É ́x ÀÿÞ×÷ß", "x.y z,, !?'s",
       "a" * 700 + " " + "é" * 300, "!" * 600, "日本語 テスト 😀", "\t\r\n", "a▁b ▁▁", "  lead", "<s> </s>", "\x00\x01 x", "ab" * 500]


def test_word_ids_are_the_librarys(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = WordTokens.at(WORDS)
    ids, at = encoder.encode(*buffers(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def _fewest(lengths, capacity):
    """The fewest sequences, by trying every assignment in canonical order."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_plans_are_valid_and_the_reduction_loses_nothing():
    draw = np.random.default_rng(7)
    for _ in range(60):
        lengths = sorted(draw.integers(1, 21, draw.integers(1, 9)).tolist(), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        plan = packing.plan_sequences(counts)
        used = Counter(itertools.chain.from_iterable(p * n for p, n in plan.items()))
        assert used == Counter(lengths) and all(sum(p) <= 20 for p in plan)
        fewest = _fewest(lengths, 20)
        assert sum(plan.values()) <= fewest + 1
        reduction = packing._Reduction(counts)
        reduction.run()
        left = [n for n, k in enumerate(reduction.left) for _ in range(k)]
        # What the reduction has fixed belongs to some best packing.
        assert sum(reduction.fixed.values()) + _fewest(sorted(left, reverse=True), 20) == fewest


def test_packed_documents_are_whole_and_gapless(spark):
    long_text = " ".join(f"w{i}" for i in range(9000))
    rows = [(i, text, "x") for i, text in enumerate(ODD)] + [(50, None, ""), (51, long_text, ""), (51, long_text, ""), (None, "no id", "")]
    rows += [(100 + i, "the same words again", "") for i in range(400)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), WORDS).collect()
    tokenizer = WordTokens.at(WORDS).tokenizer
    want = Counter()
    for i, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[(i, piece, start, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 4096
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 4096) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_piece_ids_without_dropout_are_the_librarys():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in ODD if "▁" not in t]
    ids, at = pieces.PieceModel.at(PIECES).encode(texts, np.zeros(len(texts), int), 0.0, 1)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(text), text[:80]


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.9, 1.0])
def test_pieces_decode_to_the_text_at_any_rate(spark, rate):
    rows = [(i, text, "x") for i, text in enumerate(ODD)] + [(70, None, "y"), (None, "no id", "z"), (1, "again", ""), (1, "again", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = pieces.encode_documents(docs, PIECES, rate)
    told = pieces.decode_documents(encoded, PIECES).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in told) == sorted((i or -1, t or "") for i, t, _ in rows)
    assert encoded.collect() == pieces.encode_documents(docs, PIECES, rate).collect()
    assert pieces.decode_documents(pieces.encode_documents(docs.limit(0), PIECES), PIECES).count() == 0


def test_seeds_and_variants_vary_the_pieces():
    model, texts = pieces.PieceModel.at(PIECES), ["internationalisation of unbelievable circumstances"] * 8
    made = {tuple(model.encode(texts[:1], np.array([v]), 0.3, s)[0].tolist()) for v in range(4) for s in range(4)}
    assert len(made) > 8
    plain = len(model.encode(texts[:1], np.array([0]), 0.0, 1)[0])
    assert len(model.encode(texts[:1], np.array([0]), 1.0, 1)[0]) > plain


def test_occurrences_of_a_word_vary_and_equal_a_merge_of_each(spark):
    model, word = pieces.PieceModel.at(PIECES), "internationalisation"
    rows = [(1, " ".join([word] * 1000)), *((i, word) for i in range(2, 1002)), *((None, f"{word} {i}") for i in range(300))]
    encoded = pieces.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), PIECES)
    told = sorted((r["doc_id"] or -1, r["text"]) for r in pieces.decode_documents(encoded, PIECES).collect())
    assert told == sorted((i or -1, text) for i, text in rows)
    made = encoded.collect()
    single = {tuple(r["ids"]) for r in made if r["doc_id"] not in (1, None)}
    ids = next(r["ids"] for r in made if r["doc_id"] == 1)
    # Every word begins with the one piece that holds its mark.
    begins = [k for k, i in enumerate(ids) if model.read[model.read_at[i]] == 32] + [len(ids)]
    inside = {tuple(ids[a:b]) for a, b in zip(begins, begins[1:])}
    unnamed = {tuple(r["ids"][: len(r["ids"]) - 2]) for r in made if r["doc_id"] is None}
    assert len(begins) == 1001 and min(len(single), len(inside), len(unnamed)) > 50
    # Shared or merged again, the pieces are those of merging every occurrence with its draws.
    texts = ["the cat and the dog and the cat", "the the theory of the internationalisation of the"] * 3
    got, at = model.encode(texts, np.arange(6), 0.3, 1)
    whole = model._dropped

    def each(spelled, skipped, lead, which, often):
        return whole(spelled, skipped, np.arange(len(which)), np.arange(len(which)), np.ones(len(which), int))

    model._dropped = each
    try:
        want, want_at = model.encode(texts, np.arange(6), 0.3, 1)
    finally:
        del model._dropped
    assert got.tolist() == want.tolist() and at.tolist() == want_at.tolist()
