"""What the trained text classifiers share: a bounded training sample and sparse rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows, those with the least hashes of the key; never more than twice as many.

    The share is set from a count, so no rows are ordered or gathered to find them, and the
    same rows are chosen whatever the partitioning.
    """
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 31)) < int((1 << 31) * min(1.0, size / max(n, 1))))
    return chosen.limit(2 * size)


def sparse_column(text: Column, features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> Column:
    """Struct of two arrays, the features of a text and their weights."""
    kind = pa.struct([("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32()))])

    @F.arrow_udf("struct<at:array<int>,weight:array<float>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [features(t or "") for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], fields=list(kind)
            )

    return run(text)


class SparseRows:
    """Rows of (feature, weight) lists as flat arrays."""

    def __init__(self, at: Sequence[np.ndarray], weight: Sequence[np.ndarray]):
        self._hold(
            np.array([len(a) for a in at], np.int64),
            np.concatenate([np.zeros(0, np.int32), *at]),
            np.concatenate([np.zeros(0, np.float32), *weight]),
        )

    @classmethod
    def from_arrow(cls, at: pa.ChunkedArray, weight: pa.ChunkedArray) -> SparseRows:
        """List columns as they lie; nothing becomes a Python object."""
        made = object.__new__(cls)
        size = [c.value_lengths().to_numpy(zero_copy_only=False) for c in at.chunks]
        flat = [[c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] for column in (at, weight)]
        made._hold(
            np.concatenate([np.zeros(0, np.int64), *size]),
            np.concatenate([np.zeros(0, np.int32), *flat[0]]),
            np.concatenate([np.zeros(0, np.float32), *flat[1]]),
        )
        return made

    def _hold(self, size: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        self.size, self.start = size.astype(np.int64), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        self.at, self.weight = at.astype(np.int32), weight.astype(np.float32)

    def __len__(self) -> int:
        return len(self.size)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, weights and place in ``rows`` of all entries of these rows."""
        spans = [np.arange(self.start[r], self.start[r + 1]) for r in rows]
        flat = np.concatenate([np.zeros(0, np.int64), *spans])
        return self.at[flat].astype(np.int64), self.weight[flat].astype(np.float64), np.repeat(np.arange(len(rows)), self.size[rows])


def collect_rows(df: DataFrame, extra: str) -> tuple[SparseRows, np.ndarray]:
    """Sampled rows at the driver; ``df`` has ``f`` from ``sparse_column`` and one more column."""
    rows = df.select("f.at", "f.weight", extra).toArrow()
    return SparseRows.from_arrow(rows.column("at"), rows.column("weight")), rows.column(extra).to_numpy()
