"""Packing documents into fixed windows by the sum-of-squares rule, online.

Every partition packs its own documents in the order read. A level array holds, for each fill level h, the open windows
filled to h; N(h) is their number. A document (cut at whole windows first) goes to the level whose choice makes the sum of
N(h)^2 least: with s ids, leaving level h for h + s changes it by 2 N(h + s) - 2 N(h) + 2, opening a window by
2 N(s) + 1, filling one up by 1 - 2 N(h); ties go to the fuller window. When a partition ends, or more than `max_open`
windows are open, the open ones are emptied into each other: the fullest are filled from the emptiest, whose documents
are cut. The last remainder of a partition is cut into windows whose lengths are powers of two, which need no padding.

Memory is bounded by the open windows. Recovery: a task depends on its input split alone, so a rerun gives the same rows.
Defined cases: null text is empty and becomes the end id alone; repeated rows are packed each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty
from .tokens import encoder_for

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A partition's sequence numbers start at its number times this.
STRIDE = 1 << 36


class Packer:
    """Windows of `size` ids. A piece is (doc_id, start, length, doc_tokens, ids as bytes); emit gets each closed window."""

    def __init__(self, size: int, emit, max_open: int = 4096):
        self.size, self.emit, self.max_open = size, emit, max_open
        self.count = np.zeros(size + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(size + 1)]
        self.open = 0

    def choose(self, s: int) -> int:
        """The level, 0 for a new window, at which s ids change the sum of squares least."""
        last = self.size - s
        delta = 2 * (self.count[s : self.size + 1] - self.count[: last + 1]) + 2
        delta[last] = 1 - 2 * self.count[last]
        delta[self.count[: last + 1] == 0] = np.iinfo(np.int64).max
        delta[0] = 2 * self.count[s] + 1
        return last - int(np.argmin(delta[::-1]))

    def add(self, doc_id, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.size:
            self.emit([(doc_id, at, self.size, n, ids[4 * at : 4 * (at + self.size)])])
            at += self.size
        if s := n - at:
            h = self.choose(s)
            window = self.levels[h].pop() if h else []
            window.append((doc_id, at, s, n, ids[4 * at :]))
            if h:
                self.count[h] -= 1
                self.open -= 1
            if h + s == self.size:
                self.emit(window)
            else:
                self.levels[h + s].append(window)
                self.count[h + s] += 1
                self.open += 1
                if self.open > self.max_open:
                    self.drain(last=False)

    def drain(self, last: bool = True) -> None:
        """Fill the fullest open windows from the emptiest; at the end, cut what is left into powers of two."""
        windows = [[h, w] for h in range(self.size - 1, 0, -1) for w in self.levels[h]]
        self.levels, self.open = [[] for _ in range(self.size + 1)], 0
        self.count[:] = 0
        low, high = 0, len(windows) - 1
        while low < high:
            gap = self.size - windows[low][0]
            piece = windows[high][1].pop()
            doc_id, start, length, n, ids = piece
            take = min(gap, length)
            windows[low][1].append((doc_id, start, take, n, ids[: 4 * take]))
            windows[low][0] += take
            windows[high][0] -= take
            if take < length:
                windows[high][1].append((doc_id, start + take, length - take, n, ids[4 * take :]))
            if windows[low][0] == self.size:
                self.emit(windows[low][1])
                low += 1
            if not windows[high][1]:
                high -= 1
        if low == high and windows[low][1]:
            level, window = windows[low]
            if last:
                self.cut(level, window)
            else:
                self.levels[level].append(window)
                self.count[level] += 1
                self.open = 1

    def cut(self, level: int, window: list) -> None:
        pieces = window[::-1]
        for bit in reversed(range(level.bit_length())):
            if level >> bit & 1:
                want, out = 1 << bit, []
                while want:
                    doc_id, start, length, n, ids = pieces.pop()
                    take = min(want, length)
                    out.append((doc_id, start, take, n, ids[: 4 * take]))
                    if take < length:
                        pieces.append((doc_id, start + take, length - take, n, ids[4 * take :]))
                    want -= take
                self.emit(out)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048, spaced: bool = True, with_ids: bool = False) -> DataFrame:
    """A row of PIECES for each piece; with_ids adds the piece's ids."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a vocabulary: its size is fixed
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder, base = encoder_for(tokenizer.value, spaced), TaskContext.get().partitionId() * STRIDE
        rows: list[tuple] = []
        number = 0

        def emit(window):
            nonlocal number
            offset = 0
            for doc_id, start, length, n, ids in window:
                rows.append((doc_id, start, length, zlib.crc32(ids), n, base + number, offset, *([ids] if with_ids else [])))
                offset += length
            number += 1

        def flush():
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(columns[i], pa.int64()) for i in range(7)]
            if with_ids:
                flat = np.frombuffer(b"".join(columns[7]), "<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in columns[7]])]).astype(np.int32)), pa.array(flat)))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        packer = Packer(size, emit)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, x in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                    packer.add(doc_id, x + end)
                if len(rows) > 4096:
                    yield flush()
        yield flush()
        packer.drain()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return arrow_map(rows, run, PIECES + (", ids array<int>" if with_ids else ""))
