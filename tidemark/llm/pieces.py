"""SentencePiece encoding with seeded merge-dropout, and decoding that gives the text back.

The text gets a blank before it, blanks become word marks, and merges go by the model's
scores, best first and leftmost among equals. With dropout every candidate merge is skipped
if a keyed hash of the seed, the document's id and text, the word's place in the text, the
word, the place in the word and the merged piece falls below the rate: every occurrence of a
word has draws of its own, and a text's pieces can be computed again anywhere. With rate zero
the ids are the library's own.

No piece joins two words, so a slice's distinct words are merged together on numpy
matrices (``tidemark.llm.merges``), once and without dropout, and the candidates met are
noted. An occurrence for which no draw hits one of them shares that result, for it would meet
the same candidates; the others are merged again, each with its own draws. Characters without a piece become their UTF-8 bytes;
so does the word mark itself when a text holds one, which the library would turn into a
blank.

Null and empty texts have no pieces and decode to the empty text. Rows are encoded one by
one, repeated ones alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.merges import PairTable, Skip, merge_words
from tidemark.llm.rows import small_batches
from tidemark.llm.words import mix, slices

MARK = "▁"
RATE = 0.1
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class PieceModel:
    """The pieces of a model file as numpy tables; made once for each worker process."""

    _made: dict[str, PieceModel] = {}

    @classmethod
    def at(cls, path: str) -> PieceModel:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        whole = range(self.size)
        names = [model.id_to_piece(i) for i in whole]
        special = {i for i in whole if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        number = {name: i for i, name in enumerate(names) if i not in special}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # A symbol is a piece's id, or behind them the code point of a character without one.
        symbol = number | {c: self.size + ord(c) for name in number for c in name if c not in number}
        order = sorted(number.values(), key=lambda i: (-model.get_score(i), i))
        splits = [
            (symbol[names[i][:k]], symbol[names[i][k:]], rank, i)
            for rank, i in enumerate(order)
            for k in range(1, len(names[i]))
            if names[i][:k] in symbol and names[i][k:] in symbol
        ]
        self.table = PairTable(*(np.array(side) for side in zip(*splits)))
        self.letters = np.full(0x110000, -1, dtype=np.int32)
        for name, i in number.items():
            if len(name) == 1:
                self.letters[ord(name)] = i
        free = self.letters < 0
        self.letters[free] = self.size + np.flatnonzero(free).astype(np.int32)
        self.letters[0x2581] = self.size + 0x2581
        self.blank = number[MARK]
        self.letters[ord(" ")] = self.blank
        # What each id reads as.
        read = [b"" if i in special else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
        for b in range(256):
            read[self.byte[b]] = bytes([b])
        self.read = np.frombuffer(b"".join(read), dtype=np.uint8)
        self.read_at = np.concatenate([[0], np.cumsum([len(r) for r in read])])

    def encode(self, texts: list[str], keys: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and where each text's ids start.

        ``keys`` has a number for each text, from which its draws are made.
        """
        size = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.letters[points].astype(np.int64)
        if not len(symbols):
            return np.zeros(0, np.int32), np.zeros(len(begin), np.int64)
        blank = symbols == self.blank
        fresh = np.zeros(len(symbols), dtype=bool)
        fresh[begin[:-1][size > 0]] = True
        starts = np.flatnonzero(fresh | (blank & ~np.concatenate([[False], blank[:-1]])))
        spans = np.append(starts, len(symbols))
        length = np.diff(spans)
        owner = np.searchsorted(begin, starts, side="right") - 1
        place = np.arange(len(symbols)) - np.repeat(starts, length)
        terms = mix((symbols.astype(np.uint64) + np.uint64(1)) * _STEP + place.astype(np.uint64) * _TURN)
        content = np.add.reduceat(terms, starts)
        _, lead, which, often = np.unique(mix(content), return_index=True, return_inverse=True, return_counts=True)

        def spelled(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = length[words]
            own_at = np.concatenate([[0], np.cumsum(own)])
            return symbols[np.repeat(starts[words] - own_at[:-1], own) + np.arange(own_at[-1])], own_at

        if rate > 0:
            told = mix(keys[owner].astype(np.uint64) + np.uint64(seed * int(_TURN) & 0xFFFFFFFFFFFFFFFF))
            key = mix(told + (starts - begin[owner]).astype(np.uint64) * _STEP) ^ content
            below = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))

            def skipped(word: np.ndarray, at: np.ndarray, merged: np.ndarray) -> np.ndarray:
                return mix(key[word] + at.astype(np.uint64) * _STEP + merged.astype(np.uint64) * _TURN) < below

            merged, merged_at, which = self._dropped(spelled, skipped, lead, which, often)
        else:
            merged, merged_at = merge_words(self.table, *spelled(lead))
        merged, merged_at = self._bytes(merged, merged_at)
        count = np.diff(merged_at)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = merged[np.repeat(merged_at[which] - total[:-1], count) + np.arange(total[-1])]
        return ids.astype(np.int32), total[np.searchsorted(starts, begin)]

    def _dropped(
        self, spelled: Callable, skipped: Skip, lead: np.ndarray, which: np.ndarray, often: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merged words, their starts, and which of them each occurrence is."""
        none = np.zeros(0, np.int64)
        seen = [(none, none, none)]

        def note(number: np.ndarray, at: np.ndarray, merged: np.ndarray) -> np.ndarray:
            seen.append((number, at, merged))
            return np.zeros(len(at), dtype=bool)

        shared = lead[often > 1]
        merged, merged_at = merge_words(self.table, *spelled(shared), note)
        number, at, piece = (np.concatenate(side) for side in zip(*seen))
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(shared) + 1))
        result = (np.cumsum(often > 1) - 1)[which]
        alone = often[which] == 1
        many = np.flatnonzero(~alone)
        met = np.diff(bounds)[result[many]]
        total = np.concatenate([[0], np.cumsum(met)])
        asked = order[np.repeat(bounds[result[many]] - total[:-1], met) + np.arange(total[-1])]
        word = np.repeat(many, met)
        alone[word[skipped(word, at[asked], piece[asked])]] = True
        own = np.flatnonzero(alone)
        more, more_at = merge_words(self.table, *spelled(own), lambda k, at, merged: skipped(own[k], at, merged))
        result[own] = len(shared) + np.arange(len(own))
        return np.concatenate([merged, more]), np.concatenate([merged_at[:-1], merged_at[-1] + more_at]), result

    def _bytes(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of its bytes in the place of every character without a piece."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, at
        spelled = [self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in symbols[odd] - self.size]
        count = np.ones(len(symbols), dtype=np.int64)
        count[odd] = [len(s) for s in spelled]
        total = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(symbols, count)
        inside = np.repeat(symbols >= self.size, count)
        out[inside] = np.concatenate(spelled)
        return out, total[at]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 of all texts behind one another without their first blanks, and offsets."""
        size = np.diff(self.read_at)[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.read[np.repeat(self.read_at[ids] - total[:-1], size) + np.arange(total[-1])]
        offsets = total[at]
        stays = np.ones(len(raw), dtype=bool)
        some = np.flatnonzero(np.diff(at) > 0)
        stays[offsets[some]] = raw[offsets[some]] != 32
        cut = np.concatenate([[0], np.cumsum(~stays)])
        return raw[stays].tobytes(), offsets - cut[offsets]


def _carried(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(name) for name in names]


def encode_documents(
    docs: DataFrame, model: str, rate: float = RATE, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the text replaced by ``ids``, an array of piece ids."""
    rest = [name for name in docs.columns if name not in (text_col, "ids")]
    fields = ", ".join(f"`{name}` {kind}" for name, kind in docs.select(*[f"`{n}`" for n in rest]).dtypes)
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("|"), F.col(f"`{text_col}`"))
    rows = small_batches(docs).select(
        *[f"`{n}`" for n in rest], F.col(f"`{text_col}`").alias("__text"), key.alias("__key")
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.at(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [text or "" for text in part.column("__text").to_pylist()]
                ids, at = pieces.encode(texts, part.column("__key").to_numpy(), rate, seed)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*_carried(part, rest), lists], names=[*rest, "ids"])

    return rows.mapInArrow(encoded, f"{fields}{', ' if fields else ''}ids array<int>")


def decode_documents(encoded: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``encoded`` with the ids replaced by their text."""
    rest = [name for name in encoded.columns if name not in (text_col, "ids")]
    fields = ", ".join(f"`{name}` {kind}" for name, kind in encoded.select(*[f"`{n}`" for n in rest]).dtypes)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.at(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column("ids")
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                raw, offsets = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False), at)
                texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([*_carried(part, rest), texts.cast(pa.string())], names=[*rest, text_col])

    return encoded.select(*[f"`{n}`" for n in rest], "ids").mapInArrow(
        decoded, f"{fields}{', ' if fields else ''}`{text_col}` string"
    )
