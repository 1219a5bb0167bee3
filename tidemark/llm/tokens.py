"""Token ids of whole texts for a byte-pair vocabulary with word ends.

Each slice of texts is cut at white space, its distinct chunks are merged once, and the
ids of the chunks are laid out in text order; all of it on numpy arrays. A chunk of plain
letters followed by plain punctuation is merged here. Every other chunk (digits,
apostrophes, other scripts, special tokens) is encoded by the tokenizer itself.
"""

from __future__ import annotations

import json

import numpy as np

from tidemark.llm.merges import PairTable, merge_words
from tidemark.llm.words import word_hashes, word_spans

_END = "</w>"
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in ".,;:!?%&$#*|"]] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
# Second bytes of the two-byte letters from U+00C0 to U+00FF; the two signs among them.
_SECOND = np.zeros(256, dtype=bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class WordTokens:
    """Encodes the texts of a slice; made once for each worker process."""

    _made: dict[str, WordTokens] = {}

    @classmethod
    def at(cls, path: str) -> WordTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (
            np.array([vocab[text] for text in side])
            for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
        )
        self.table = PairTable(left, right, np.arange(len(pairs)), merged)
        letters = byte_letters()
        self.inner = np.array([vocab[letter] for letter in letters])
        self.last = np.array([vocab[letter + _END] for letter in letters])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and where each text's ids start."""
        starts, ends, first = word_spans(raw, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        hashes, _ = word_hashes(raw, offsets)
        _, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
        pool, at = self._chunks(raw, starts[lead], ends[lead] - starts[lead] + 1)
        size = np.diff(at)[which]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(at[which] - total[:-1], size) + np.arange(total[-1])
        return pool[place].astype("<u4"), total[first]

    def _chunks(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks behind one another, and where each begins."""
        begin = np.concatenate([[0], np.cumsum(size)])
        data = raw[np.repeat(start - begin[:-1], size) + np.arange(begin[-1])].copy()
        head = begin[:-1]
        data[(data >= 65) & (data <= 90)] += 32
        two = np.zeros(len(data), dtype=bool)
        two[1:] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
        two[head] = False
        data[two & (data <= 0x9E)] += 32
        letter = _SMALL[data] | two
        letter[:-1] |= two[1:]
        mark = _MARKS[data]
        turn = np.zeros(len(data), dtype=bool)  # the first mark behind letters
        turn[1:] = mark[1:] & letter[:-1]
        back = np.zeros(len(data), dtype=bool)
        back[1:] = letter[1:] & mark[:-1]
        turn[head] = back[head] = False
        plain = np.logical_and.reduceat((letter | mark) & ~back, head)

        inside = np.repeat(plain, size)
        cut = turn.copy()
        cut[head] = True
        own = data[inside]
        words = np.append(np.flatnonzero(cut[inside]), len(own))
        symbols = self.inner[own]
        symbols[words[1:] - 1] = self.last[own[words[1:] - 1]]
        merged, word_at = merge_words(self.table, symbols, words)
        # Each plain chunk begins at one of its words.
        chunk_word = np.searchsorted(words, np.concatenate([[0], np.cumsum(size[plain])]))
        own_size = np.diff(word_at[chunk_word])

        other = np.flatnonzero(~plain)
        texts = [raw[start[k] : start[k] + size[k]].tobytes().decode("utf-8") for k in other]
        encoded = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        count = np.empty(len(size), np.int64)
        count[plain], count[other] = own_size, [len(ids) for ids in encoded]
        at = np.concatenate([[0], np.cumsum(count)])
        pool = np.empty(at[-1], np.int64)
        pool[np.repeat(plain, count)] = merged
        pool[np.repeat(~plain, count)] = np.array([i for ids in encoded for i in ids], dtype=np.int64)
        return pool, at
