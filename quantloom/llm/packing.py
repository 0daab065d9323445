"""Packing of token sequences by bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOCAL_BITS = 40  # low bits of a sequence number count the sequences of one task


class OpenBins:
    """At most ``limit`` open bins; ``free`` has bit f set if a bin with free space f is open.

    An item goes to the open bin with the least space that suffices. If none fits and the
    limit is reached, the fullest bin closes. Full bins close at once.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free = self.open = self.made = 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        found = stack.pop()
        self.open -= 1
        if not stack:
            del self.bins[space]
            self.free ^= 1 << space
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of an item of 1 to ``size`` tokens."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, at = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(at)
            self.free |= 1 << left
            self.open += 1
        return at, self.size - space


SCHEMA = "doc_id {id}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


def pack_documents(
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]],
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    open_bins: int = 2048,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``.

    ``tokenizer`` makes, in the task, a function from texts to id arrays. A document is its ids
    and ``end_id``; only longer ones than ``size`` are cut, into pieces of ``size`` and a rest. ``ids``
    are little-endian 32-bit words. Each task packs its own rows in the order they come, so
    nothing is shuffled and a task that is run again makes the same sequences; a task's last
    open bins stay as they are. The documents of a batch are placed longest first.
    A null text counts as empty and becomes the end id alone.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = tokenizer(), OpenBins(size, open_bins)
        first = TaskContext.get().partitionId() << _LOCAL_BITS
        for batch in batches:
            names = batch.column(0)
            rows: list[tuple[int, int, int, int, bytes]] = []
            for row, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((row, piece, at, len(part), part.tobytes()))
            places = [(0, 0)] * len(rows)
            for i in sorted(range(len(rows)), key=lambda i: -rows[i][3]):
                places[i] = bins.place(rows[i][3])
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(columns[0], pa.int32())),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.binary()),
                    pa.array([first + p[0] for p in places], pa.int64()),
                    pa.array([p[1] for p in places], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(pack, SCHEMA.format(id=picked.schema["doc_id"].dataType.simpleString()))
