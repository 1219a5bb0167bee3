"""Best-fit packing of token pieces after a Martello-Toth dominance reduction.

The packing problem only depends on how many pieces there are of each length, so the
plan is made on that histogram, which has at most ``capacity`` rows whatever the data:

1. The reduction fixes small sets for good where they provably dominate every other way
   to fill a sequence: a piece nothing fits beside, a pair that fills a sequence
   exactly or beside which no third piece fits, and a triple no better one can replace.
   All copies of such a set are fixed at once, and the reduction starts over on what is
   left until nothing more is fixed.
2. The remainder goes longest first into the fullest sequence that has room.

The plan says, for each length, which ranks go to which sequences and offsets. Pieces are
ranked within their length by a range partitioning, so a length with a third of all pieces
is spread over many tasks, and the plan is broadcast.

Null and empty texts are the closing id alone. Rows that repeat an id are packed as pieces
of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import document_rows
from tidemark.llm.tokens import WordTokens
from tidemark.llm.words import buffers, slices
from tidemark.operators.ordered import durable, with_position

CAPACITY = 4096
CLOSING_ID = 1
#: Bytes of text that share one table of distinct chunks.
TOKEN_SLICE = 1 << 21
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = WordTokens.at(path), np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", TOKEN_SLICE):
                ids, at = encoder.encode(*buffers(part.column("text")))
                whole, at, rows = ids.tobytes(), (4 * at).tolist(), []
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = whole[at[k] : at[k + 1]] + closing
                    for piece, start in enumerate(range(0, len(own), 4 * capacity)):
                        cut_ids = own[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(cut_ids) // 4, zlib.crc32(cut_ids)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return cut


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for each run of at most ``capacity`` ids."""
    return document_rows(docs, id_col, text_col).mapInArrow(_cut(vocabulary, capacity), _PIECES)


# ------------------------------------------------------------------ the plan
class _Reduction:
    """Fixes dominating sets on a histogram of lengths; ``left`` is what remains."""

    def __init__(self, counts: np.ndarray):
        self.left, self.capacity = counts.copy(), len(counts) - 1
        self.fixed: Counter[tuple[int, ...]] = Counter()

    def _take(self, *lengths: int) -> None:
        """Fix a set as many times as its lengths allow."""
        need = Counter(lengths)
        times = min(int(self.left[length]) // n for length, n in need.items())
        for length, n in need.items():
            self.left[length] -= n * times
        self.fixed[lengths] += times

    def _others(self, length: int) -> np.ndarray:
        """Lengths present besides one piece of ``length``, ascending."""
        self.left[length] -= 1
        present = np.flatnonzero(self.left)
        self.left[length] += 1
        return present

    def _smallest(self, present: np.ndarray, length: int, n: int) -> list[int]:
        least: list[int] = []
        for other in present[:n]:
            copies = int(self.left[other]) - (other == length)
            least += [int(other)] * min(copies, n - len(least))
        return least[:n]

    def _best_pair(self, present: np.ndarray, length: int, room: int) -> tuple[int, int] | None:
        best: tuple[int, int] | None = None
        for a in present:
            if 2 * a > room:
                break
            upto = present[: int(np.searchsorted(present, room - a, side="right"))]
            upto = upto[upto >= a]
            if len(upto) and upto[-1] == a and self.left[a] - (a == length) < 2:
                upto = upto[:-1]
            if len(upto) and (best is None or upto[-1] + a > sum(best)):
                best = (int(upto[-1]), int(a))
        return best

    def _dominating(self, length: int) -> tuple[int, ...] | None:
        """The set that dominates all others with a piece of ``length``, if there is one."""
        room, present = self.capacity - length, self._others(length)
        least = self._smallest(present, length, 3)
        if not least or least[0] > room:
            return (length,)
        partner = int(present[np.searchsorted(present, room, side="right") - 1])
        if partner == room or sum(least[:2]) > room or len(least) < 2:
            return (length, partner)
        if sum(least) > room or len(least) < 3:
            a, b = self._best_pair(present, length, room)
            if partner >= a + b:
                return (length, partner)
            larger = present[present > b]
            if partner == a and len(larger) and 2 * int(larger[0]) > room and self.left[b] == 1:
                return (length, a, b)
        return None

    def run(self) -> None:
        before = -1
        while before != self.left.sum():
            before = int(self.left.sum())
            for length in range(self.capacity, 0, -1):
                while self.left[length] and (found := self._dominating(length)):
                    self._take(*found)


def _best_fit(counts: np.ndarray) -> Counter[tuple[int, ...]]:
    """Longest first, each piece into the fullest open sequence that has room for it."""
    capacity = len(counts) - 1
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]
    room = np.zeros(capacity + 1, dtype=bool)
    done: Counter[tuple[int, ...]] = Counter()

    def put(pattern: tuple[int, ...], times: int, left: int) -> None:
        if not left:
            done[pattern] += times
        elif times:
            open_[left].append([pattern, times])
            room[left] = True

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                at = length + int(fits[0])
                group = open_[at][-1]
            else:
                at, group = capacity, [(), n]
            # Best fit returns to the sequence it has just made fuller while there is room.
            each = min(at // length, n)
            times = min(group[1], n // each)
            n -= each * times
            group[1] -= times
            put(group[0] + (length,) * each, times, at - each * length)
            if len(fits) and not group[1]:
                open_[at].remove(group)
                room[at] = bool(open_[at])
    for groups in open_:
        for pattern, times in groups:
            done[pattern] += times
    return done


def plan_sequences(counts: np.ndarray) -> Counter[tuple[int, ...]]:
    """How often each combination of lengths is used; ``counts[n]`` pieces have length ``n``."""
    reduction = _Reduction(counts)
    reduction.run()
    return reduction.fixed + _best_fit(reduction.left)


def _slots(plan: Counter[tuple[int, ...]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, ranks, first sequence, offset)`` for each place of the plan."""
    ranks, sequence, slots = [0] * (capacity + 1), 0, []
    for pattern in sorted(plan, reverse=True):
        times, offset = plan[pattern], 0
        for length in pattern:
            slots.append((length, ranks[length], times, sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written ``pieces`` (``doc_id, piece, length, …``)."""
    found = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found:
        counts[row["length"]] = row["count"]
    slots = pieces.sparkSession.createDataFrame(
        _slots(plan_sequences(counts), capacity),
        "length bigint, first bigint, ranks bigint, sequence bigint, offset bigint",
    )
    ranked = with_position(pieces, ["length"], [("doc_id", True), ("piece", True)], "rank")
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    return (
        ranked.join(F.broadcast(slots), "length")
        .filter(here)
        .select(
            *pieces.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
        )
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack whole documents: one row per piece with its sequence and its place in it."""
    return pack(durable(token_pieces(docs, vocabulary, capacity, id_col, text_col)), capacity)
