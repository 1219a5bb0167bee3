"""Toxicity of whole documents, read through a noisy channel.

1. A character language model is counted over all texts: three-letter counts of the
   lower-cased words, summed by Spark; its size does not depend on the data.
2. Words that could hide another word (digits or signs between letters, a letter three
   times or more, letters set apart) become a lattice: each character may stand for
   itself, for the letters it is used for, or for nothing. A Viterbi pass finds the path
   the language model and the channel together find likeliest. Plain words have one
   path and are left alone.
3. A lexicon is learned from a bounded sample of labelled texts, restored in the same way:
   words and word beginnings with more evidence for the label than chance explains. A few
   boosted trees turn the weights of a text's entries, their number and the text's length
   into its score; they are fitted on the same texts with each text's own words left out.

Null and empty texts hold no entry and get the score of such texts. Labels that are null
are left out; of labels that repeat an id the largest counts. Repeated rows are scored
one by one. Without toxic labels every score is the share of such labels (none: zero).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import labelled_ids
from tidemark.llm.rows import document_rows, remainder
from tidemark.llm.trees import Forest, fit_forest
from tidemark.llm.words import buffers, slices, word_hashes, word_spans
from tidemark.operators.ordered import durable

#: At most this many labelled documents of each label are used to learn the lexicon.
SAMPLE = 20_000
#: At most this many lexicon entries are kept, those with the most evidence.
ENTRIES = 20_000
#: Evidence (log-likelihood ratio) an entry needs: a chance of about 1 in 200,000.
EVIDENCE = 20.0
THRESHOLD = 0.3
#: Letters of the longest word the lexicon may list.
LONGEST = 64
#: Tokens a worker remembers before it forgets all of them.
REMEMBERED = 60_000
#: Hashes kept of tokens that hit nothing (32 MB).
QUIET = 1 << 22
# A worker serves many tasks of a job: what it knows of one lexicon's quiet tokens stays.
_quiet: dict[bytes, np.ndarray] = {}
#: Bytes of text whose entries are counted together.
COUNT_SLICE = 1 << 19
#: Lengths of the word beginnings that the lexicon may list, best first.
STEMS = (7, 6, 5, 4)

# ------------------------------------------------------------- fixed values of the channel
#: What a character is used for besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "h", "%": "", "&": "", "^": "a", ".": "", "-": "", "_": "", "~": "", "'": "", "`": "",
}
#: Signs that set letters apart; they are often put in and mean nothing.
SEPARATORS = ".-_*~'`^%&#|"
_KEEP, _SWAP, _REPEAT = math.log(0.9), math.log(0.3), math.log(0.2)
_DROP = {True: math.log(0.3), False: math.log(0.001)}

_LETTER = "a-zß-öø-ÿ"
_SIGNS = re.escape("".join(STANDS_FOR))
_WORD = re.compile(rf"[{_LETTER}]+")
_RUN = re.compile(rf"[{_LETTER}{_SIGNS}]+")
#: A sign beside a letter: the run could hide a word.
_MIXED = re.compile(rf"[{_LETTER}][{_SIGNS}]|[{_SIGNS}][{_LETTER}]")
_THRICE = re.compile(r"(.)\1\1")
_AROUND = ".,;:!?*#%&$|\"()[]{}<>-_"
_CLASSES = 28


def _class_table() -> np.ndarray:
    """Class of a byte: 0 outside words, 1-26 for a-z, 27 for any other letter's bytes."""
    table = np.zeros(256, dtype=np.int64)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[128:] = 27
    return table


_CLASS = _class_table()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_CLASSES**3, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = buffers(part.column("text"))
            # A blank before and behind each text, so that no gram joins two texts.
            kinds = np.zeros(len(raw) + 2 * (len(offsets) - 1) + 2, dtype=np.int64)
            at = np.arange(len(raw)) + 2 * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 2
            kinds[at] = _CLASS[raw]
            gram = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:]
            counts += np.bincount(gram, minlength=_CLASSES**3)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a character after two others, counted over all texts."""
    rows = (
        docs.select("text").mapInArrow(_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    ).collect()  # at most 28 ** 3 rows
    counts = np.zeros((_CLASSES,) * 3)
    for row in rows:
        counts.reshape(-1)[row["gram"]] = row["n"]
    counts[0, 0, 0] = 0
    single = counts.sum(axis=(0, 1)) + 1.0
    single = single / single.sum()
    pair = counts.sum(axis=0)
    pair = (pair + 20 * single) / (pair.sum(axis=1, keepdims=True) + 20)
    return np.log((counts + 5 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Finds the likeliest plain word behind a disguised one."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def _ways(self, text: str, at: int) -> list[tuple[str, float]]:
        char = text[at]
        if char not in STANDS_FOR:
            ways = [(char, _KEEP)]
            if at and text[at - 1] == char:
                ways.append(("", _REPEAT))
            return ways
        drop = _DROP[char in SEPARATORS]
        return [(letter, _SWAP) for letter in STANDS_FOR[char]] + [("", drop)]

    def decode(self, text: str) -> str:
        """Viterbi over the lattice of ``text``; a state is the last two letters' classes."""
        states = {(0, 0): (0.0, "")}
        for at in range(len(text)):
            then: dict[tuple[int, int], tuple[float, str]] = {}
            ways = self._ways(text, at)
            for (two, one), (score, path) in states.items():
                follow = self.model[two][one]
                for letter, cost in ways:
                    if letter:
                        kind = ord(letter) - 96 if "a" <= letter <= "z" else 27
                        state, value = (one, kind), score + cost + follow[kind]
                    else:
                        state, value = (two, one), score + cost
                    if state not in then or value > then[state][0]:
                        then[state] = (value, path + letter)
            states = then
        model = self.model
        return max(states.items(), key=lambda s: (s[1][0] + model[s[0][0]][s[0][1]][0], s[1][1]))[1][1]

    def word(self, text: str) -> str:
        """The plain word; longer runs than any word are decoded piece by piece."""
        return "".join(self.decode(text[k : k + 64]) for k in range(0, len(text), 64))

    def token(self, token: str) -> set[str]:
        """The words of one lower-case token, with what it may hide."""
        core = token.strip(_AROUND)
        if core.isalpha() and not _THRICE.search(core):
            return {core} if core == token or not set(token) & {"$", "!"} else {core, self.word(token)}
        found = set(_WORD.findall(token))
        found.update(self.word(run) for run in _RUN.findall(token) if _MIXED.search(run))
        found.update(self.word(word) for word in list(found) if _THRICE.search(word))
        return found


def _entries(word: str) -> list[str]:
    """What the lexicon may list of a word, best first: itself, and its beginnings."""
    if len(word) > LONGEST:
        return []
    return [word, *(word[:n] + "…" for n in STEMS if len(word) > n)]


@dataclass
class Lexicon:
    """How many tokens, distinct within their text, each entry has met in toxic and clean texts.

    ``forest`` turns the hits of a text into its score.
    """

    met: dict[str, tuple[int, int]]
    words: tuple[int, int]
    forest: Forest | None = None

    def weight(self, entry: str, less: tuple[int, int] = (0, 0)) -> float:
        """Log ratio of the entry's rates, zero without enough evidence for toxicity.

        ``less`` takes a text's own words out, so that it isn't its own evidence.
        """
        bad, good = (n - k for n, k in zip(self.met.get(entry, (0, 0)), less))
        if bad < 3:
            return 0.0
        share, part = self.words[0] / max(sum(self.words), 1), bad / (bad + good)
        if part <= share or share <= 0:
            return 0.0
        evidence = bad * math.log(part / share) + (good * math.log((1 - part) / (1 - share)) if good else 0.0)
        if 2 * evidence < EVIDENCE:
            return 0.0
        return math.log(bad / self.words[0]) - math.log((good + 1) / (self.words[1] + 1))


class Reader:
    """Reads slices of texts; what a token means is worked out once and remembered."""

    def __init__(self, model: np.ndarray, lexicon: Lexicon | None = None):
        self.restorer, self.lexicon = Restorer(model), lexicon
        self.known: dict[int, tuple] = {}
        told = [] if lexicon is None else [sorted(lexicon.met.items()), lexicon.words]
        self.job = blake2b(model.tobytes() + repr(told).encode()).digest()
        self.quiet = _quiet.get(self.job, np.zeros(0, np.uint64))

    def _meaning(self, token: str) -> tuple:
        """Without a lexicon the token's words, with one its hits ``(word, entry)``."""
        words = self.restorer.token(token.lower())
        if self.lexicon is None:
            return tuple(words)
        best = ((word, next((e for e in _entries(word) if self.lexicon.weight(e)), None)) for word in words)
        return tuple(hit for hit in best if hit[1] is not None)

    def _meanings(self, distinct: np.ndarray, token: Callable[[int], str]) -> list[tuple]:
        """What each of the sorted token hashes means; ``token`` tells the text of one.

        Of tokens that hit nothing, which nearly all are, only the hashes are kept, in order.
        """
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.quiet) > QUIET:
            self.quiet = self.quiet[:0]
        meaning: list[tuple] = [()] * len(distinct)
        place = np.searchsorted(self.quiet, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        there = place < len(self.quiet)
        known[there] = self.quiet[place[there]] == distinct[there]
        fresh = []
        for k in np.flatnonzero(~known).tolist():
            name = int(distinct[k])
            if name not in self.known:
                told = self._meaning(token(k))
                if self.lexicon is not None and not told:
                    fresh.append(k)
                    continue
                self.known[name] = told
            meaning[k] = self.known[name]
        if fresh:
            self.quiet = np.insert(self.quiet, place[fresh], distinct[fresh])
            _quiet.clear()
            _quiet[self.job] = self.quiet
        return meaning

    def tokens(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Text and token number of every token, and what each numbered token means.

        Single characters in a row are one token more, as letters may be set apart.
        """
        starts, ends, first = word_spans(raw, offsets)
        hashes, _ = word_hashes(raw, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        distinct, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
        meaning = self._meanings(distinct, lambda k: raw[starts[lead[k]] : ends[lead[k]] + 1].tobytes().decode("utf-8"))
        size = ends - starts + 1
        single = (size == 1) | ((size == 2) & (raw[starts] >= 0xC2) & (raw[starts] < 0xE0))
        go_on = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], go_on, [False]]).astype(np.int8)))
        texts, numbers = [], []
        for low, high in zip(edge[::2], edge[1::2]):  # tokens low to high, both included
            if high - low >= 2:
                letters = b"".join(raw[starts[k] : ends[k] + 1].tobytes() for k in range(low, high + 1))
                texts.append(owner[low])
                numbers.append(len(meaning))
                meaning.append(self._meaning(letters.decode("utf-8")))
        if texts:
            owner, which = np.concatenate([owner, texts]), np.concatenate([which, numbers])
        return owner, which, meaning

    def entry_counts(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> dict[str, list[int]]:
        """Of each entry, how many tokens of clean and of toxic texts it has; "" counts all."""
        owner, which, meaning = self.tokens(raw, offsets)
        width = max(len(meaning), 1)
        text, token = np.divmod(np.unique(owner * width + which), width)
        toxic = np.bincount(token, label[text], width).astype(np.int64).tolist()
        both = np.bincount(token, minlength=width).tolist()
        counts: dict[str, list[int]] = {"": [0, 0]}
        for words, n, bad in zip(meaning, both, toxic):
            for word in words:
                for entry in ("", *_entries(word)):
                    held = counts.setdefault(entry, [0, 0])
                    held[0] += n - bad
                    held[1] += bad
        return counts

    def numbers(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """A row of ``NUMBERS`` for each text; ``label`` leaves each text's own words out."""
        owner, which, meaning = self.tokens(raw, offsets)
        n = len(offsets) - 1
        size = np.bincount(owner, minlength=n)
        rows = np.zeros((n, len(NUMBERS)))
        rows[:, 5] = np.log1p(size)
        telling = np.array([bool(m) for m in meaning], dtype=bool)
        hits: dict[int, set[int]] = {}
        if len(owner):
            at = np.flatnonzero(telling[which])
            for text, token in zip(owner[at].tolist(), which[at].tolist()):
                hits.setdefault(text, set()).add(token)
        for text, tokens in hits.items():
            found = {word: entry for token in tokens for word, entry in meaning[token]}
            if label is None:
                weights = [self.lexicon.weight(entry) for entry in found.values()]
            else:
                own = Counter(e for token in tokens for word, _ in meaning[token] for e in _entries(word))
                toxic = bool(label[text])
                less = {e: (k, 0) if toxic else (0, k) for e, k in own.items()}
                weights = [
                    next((w for e in _entries(word) if (w := self.lexicon.weight(e, less[e]))), 0.0) for word in found
                ]
            weights = sorted((w for w in weights if w), reverse=True)
            if weights:
                second = weights[1] if len(weights) > 1 else 0.0
                rows[text, :5] = sum(weights), len(weights), weights[0], second, len(weights) / size[text]
        return rows

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.lexicon.forest.score(self.numbers(*buffers(texts)))


NUMBERS = ("weight", "hits", "first", "second", "hit_share", "length")


def _counted(model: np.ndarray):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part in slices(batch, "text", COUNT_SLICE):
                label = part.column("label").to_numpy(zero_copy_only=False)
                counts = reader.entry_counts(*buffers(part.column("text")), label)
                sides = [pa.array(side, pa.int64()) for side in zip(*counts.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), *sides], names=["entry", "good", "bad"]
                )

    return counted


def _numbered(model: np.ndarray, lexicon: Lexicon):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, lexicon)
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column("label").to_numpy(zero_copy_only=False)
                rows = reader.numbers(*buffers(part.column("text")), label)
                columns = [pa.array(np.ascontiguousarray(c)) for c in rows.T]
                yield pa.RecordBatch.from_arrays([part.column("label"), *columns], names=["label", *NUMBERS])

    return numbered


def learn_lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> Lexicon:
    """Count entries on bounded samples of both labels, then fit the forest on their hits."""
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [labelled_ids(known.filter(F.col("toxic") == y), "toxic", 4, 2, sample) for y in (0, 1)]
    chosen = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    # Copies of one text are one piece of evidence.
    chosen = durable(chosen.select("text", "label").dropDuplicates())
    counted = durable(
        chosen.mapInArrow(_counted(model), "entry string, good bigint, bad bigint")
        .groupBy("entry")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter((F.col("bad") >= 3) | (F.col("entry") == ""))
    )
    total = counted.filter("entry = ''").collect()
    words = (total[0]["bad"], total[0]["good"]) if total else (0, 0)
    share = words[0] / max(sum(words), 1)
    best = (
        counted.filter("entry <> ''")
        .withColumn("part", F.col("bad") / (F.col("bad") + F.col("good")))
        .filter(F.col("part") > share)
        .orderBy(F.desc(F.col("bad") * F.log(F.col("part") / F.lit(max(share, 1e-9)))), "entry")
        .limit(ENTRIES)
        .collect()
    )
    lexicon = Lexicon({row["entry"]: (row["bad"], row["good"]) for row in best}, words)
    kinds = ", ".join(f"{name} double" for name in NUMBERS)
    # At most two samples' rows of six numbers each.
    rows = chosen.mapInArrow(_numbered(model, lexicon), f"label int, {kinds}").toPandas()
    table, label = rows[list(NUMBERS)].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float)
    order = np.lexsort([*table.T, label])
    lexicon.forest = fit_forest(table[order], label[order], trees=40, depth=3)
    return lexicon


def _prepared(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, Lexicon]:
    model = language_model(docs)
    return model, learn_lexicon(docs, labels, model, sample)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    rows = document_rows(docs, id_col, text_col)
    model, lexicon = _prepared(rows, labels, sample)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, lexicon)
        for batch in batches:
            for part in slices(batch, "text"):
                score = reader.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(scored, "doc_id bigint, score double").select(
        "doc_id",
        (F.coalesce(remainder("doc_id", 4), F.lit(-1)) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, columns unchanged."""
    model, lexicon = _prepared(document_rows(docs, id_col, text_col), labels, sample)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, lexicon)
        for batch in batches:
            for part in slices(batch, text_col):
                score = reader.scores(part.column(text_col))
                yield part.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
