"""Sum-of-squares online packing of tokenised documents into sequences of a fixed window.

Every task packs the rows it reads as they come, without a shuffle. A level array counts the partly filled windows
of each fill level; a document goes to the level that keeps the sum of the squared counts least (a new window is
level 0). Stretches of a whole window are sequences of their own. What is partly filled at the end is closed by
cutting the emptiest windows into the gaps of the fullest, and the last one is cut at powers of two. A task that holds
too many open windows closes some in the same way before the end, without leaving any short.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import ENCODED_BYTES, encode_bytes, encoder
from quire.llm.shared import slices, steady

WINDOW = 4096
#: Partly filled windows that a task holds (of 16 KB at most each); beyond this, half are filled up from the emptiest and closed.
OPEN = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple  # (doc_id, start, ids as bytes, tokens of the document)


class Packer:
    """Packs documents into windows; emit(sequence number, pieces in order) gets each finished one."""

    def __init__(self, emit: Callable[[int, list[Piece]], None], window: int = WINDOW, most_open: int = OPEN):
        self.emit, self.window, self.most_open = emit, window, most_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.held = self.sequence = 0

    def close(self, pieces: list[Piece]) -> None:
        self.emit(self.sequence, pieces)
        self.sequence += 1

    def level(self, size: int) -> int:
        """The fill level to add `size` to: least change of the sum of squares, then the fullest."""
        after = self.count[size:].copy()
        after[-1] = 0  # full windows are not counted
        change = 2 * after + 1
        change[1:] += 1 - 2 * self.count[1 : self.window - size + 1]
        change[-1] -= 1
        usable = self.count[: self.window - size + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.close([(doc_id, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        size = total - at
        if not size:
            return
        piece = (doc_id, at, ids[4 * at :], total)
        level = self.level(size)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
            self.held -= 1
        window.append(piece)
        if level + size == self.window:
            self.close(window)
            return
        self.open[level + size].append(window)
        self.count[level + size] += 1
        self.held += 1
        if self.held > self.most_open:
            self.shrink(self.most_open // 2)

    def finish(self) -> None:
        """Close all open windows: gaps are filled from the emptiest windows; the last one is cut at powers of two."""
        self.shrink(1)
        for level, windows in enumerate(self.open):
            for window in windows:
                self._powers(level, window)
        self.count[:] = 0
        self.open = [[] for _ in range(self.window)]
        self.held = 0

    def shrink(self, keep: int) -> None:
        """Fill the fullest windows up from the emptiest and close them until at most `keep` are open."""
        queue = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        first, last = 0, len(queue) - 1
        while first < last and last - first >= keep:
            level, window = queue[first]
            gap = self.window - level
            while gap and first < last:
                left, donor = queue[last]
                doc_id, start, ids, total = donor.pop()
                size = len(ids) // 4
                if size > gap:
                    donor.append((doc_id, start, ids[: 4 * (size - gap)], total))
                    start, ids, size = start + size - gap, ids[4 * (size - gap) :], gap
                window.append((doc_id, start, ids, total))
                gap, left = gap - size, left - size
                queue[last] = (left, donor)
                last -= not left
            if gap:
                queue[first] = (self.window - gap, window)
                break
            self.close(window)
            first += 1
        left = [x for x in queue[first : last + 1] if x[0]]
        self.count[:] = 0
        self.open = [[] for _ in range(self.window)]
        for level, window in left:
            self.open[level].append(window)
            self.count[level] += 1
        self.held = len(left)

    def _powers(self, size: int, pieces: list[Piece]) -> None:
        pieces = pieces[::-1]
        while size:
            room = want = 1 << (size.bit_length() - 1)
            out: list[Piece] = []
            while room:
                doc_id, start, ids, total = pieces.pop()
                n = len(ids) // 4
                if n > room:
                    pieces.append((doc_id, start + room, ids[4 * room :], total))
                    ids, n = ids[: 4 * room], room
                out.append((doc_id, start, ids, total))
                room -= n
            self.close(out)
            size -= want


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", most_open: int = OPEN) -> DataFrame:
    """One row per piece (columns PIECES): which ids of which document lie where in which sequence.

    path: vocabulary file. Null and empty texts are `end_id` alone; a null id is kept. Repeated rows are packed each on
    their own. A text longer than a window is cut. An empty table gives no rows. Sequence ids are unique, not dense:
    the task's number above 40 bits. most_open bounds a task's memory; it changes where pieces lie, not that sequences
    are full: a task leaves at most one short sequence for each bit of `window`. Other columns are not read. A task that is run again reads the same rows and gives the same pieces.
    """
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []

        def emit(sequence: int, pieces: list[Piece]) -> None:
            offset = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), total, base + sequence, offset))
                offset += n

        def drain() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

        packer = Packer(emit, window, most_open)
        for batch in steady(batches, "bpe"):
            for part in slices(batch, limit=ENCODED_BYTES):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode_bytes(enc, part.column(1))):
                    packer.add(doc_id, ids + tail)
                if len(rows) > 10_000:
                    yield drain()
        packer.finish()
        yield drain()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)
