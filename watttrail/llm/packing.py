"""Sum-of-squares online packing of token sequences into windows.

Each partition of the input packs its own documents as they come, so nothing is exchanged and
every split's work is independent. A document longer than a window fills whole windows first.
The rest goes to the fill level that minimises the sum of the squared counts of partially filled
windows, kept in an array by level. Windows leave as soon as they are full.

At the end of a partition (or when ``OPEN`` windows are open) the emptiest windows are cut up to
fill the gaps of the fullest, so at most one window stays partial. It is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watttrail.llm.wordbpe import encoder

WINDOW = 2048
END_ID = 1
OPEN = 4096
_ID = 4  # bytes of an id

Piece = tuple[int, int, bytes]  # document, ids before it in the document, its ids


class SumOfSquares:
    """Windows open at each fill level; ``place`` returns a window when it is full."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.stacks: list[list[list[Piece]]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """Level to which an item of ``size`` goes; ties go to the fullest level."""
        last = self.window - size + 1
        before, after = self.counts[:last], self.counts[size:]
        change = np.where(before > 0, 2 - 2 * before + 2 * after, np.iinfo(np.int64).max)
        if before[-1] > 0:
            change[-1] = 1 - 2 * before[-1]  # a full window leaves
        change[0] = 2 * after[0] + 1 if size < self.window else 0
        return last - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        size = len(piece[2]) // _ID
        level = self.level(size)
        if level:
            pieces = self.stacks[level].pop()
            self.counts[level] -= 1
            pieces.append(piece)
        else:
            pieces = [piece]
        if level + size == self.window:
            return pieces
        self.stacks[level + size].append(pieces)
        self.counts[level + size] += 1
        return None

    def open(self) -> int:
        return int(self.counts.sum())

    def close(self) -> Iterator[list[Piece]]:
        """Empties all open windows into full ones and sequences of a power of two."""
        levels = [(level, pieces) for level in range(1, self.window) for pieces in self.stacks[level]]
        self.counts[:] = 0
        self.stacks = [[] for _ in range(self.window)]
        low, spare, room, current = 0, [], 0, None
        high = len(levels) - 1
        while low <= high or spare:
            if current is None:
                if low > high:
                    break
                level, current = levels[high]
                room, high = self.window - level, high - 1
            if not spare:
                if low > high:
                    break
                spare, low = list(reversed(levels[low][1])), low + 1
            doc, start, ids = spare.pop()
            current = [*current, (doc, start, ids[: room * _ID])]
            if len(ids) > room * _ID:
                spare.append((doc, start + room, ids[room * _ID :]))
            room -= min(room, len(ids) // _ID)
            if not room:
                yield current
                current = None
        yield from powers_of_two([*(current or []), *reversed(spare)])


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cuts a run of pieces into sequences whose lengths are powers of two, longest first."""
    left = sum(len(p[2]) // _ID for p in pieces)
    queue = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left, sequence = left - size, []
        while size:
            doc, start, ids = queue.pop()
            sequence.append((doc, start, ids[: size * _ID]))
            if len(ids) > size * _ID:
                queue.append((doc, start + size, ids[size * _ID :]))
            size -= min(size, len(ids) // _ID)
        yield sequence


def sequences(docs: Iterator[tuple[int, bytes]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Packs ``(document, ids)`` and yields each finished sequence."""
    packer = SumOfSquares(window)
    for doc, ids in docs:
        n, start = len(ids) // _ID, 0
        while n - start >= window:
            yield [(doc, start, ids[start * _ID : (start + window) * _ID])]
            start += window
        if n > start and (full := packer.place((doc, start, ids[start * _ID :]))):
            yield full
        if packer.open() >= OPEN:
            yield from packer.close()
    yield from packer.close()


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is a tokenizer file that every worker can read. Each document's ids are those
    of its text followed by ``end_id``; a null or empty text has that id alone. Every id lies in
    exactly one piece. Repeated rows are packed each. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        ids, totals = [], []  # of the documents that this task has read

        def docs() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    content = encode(text or "") + end
                    ids.append(key)
                    totals.append(len(content) // _ID)
                    yield len(ids) - 1, content

        first = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            out.clear()
            return batch

        for k, pieces in enumerate(sequences(docs(), window)):
            offset = 0
            for doc, start, content in pieces:
                n = len(content) // _ID
                out.append((ids[doc], start, n, zlib.crc32(content), totals[doc], first + k, offset))
                offset += n
            if len(out) >= 10_000:
                yield flush()
        yield flush()

    id_type = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    target = pa.schema([pa.field("id", to_arrow_type(id_type)), *(pa.field(n, pa.int64()) for n in names)])
    packed = rows.mapInArrow(run, f"id {id_type.simpleString()}, " + ", ".join(f"{n} long" for n in names))
    return packed.withColumnRenamed("id", id_col)
