"""Two tables that meet cell by cell, one side held and the other streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet(held: DataFrame, streamed: DataFrame, parts: int, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows that ``step`` makes of each cell's rows of both sides.

    Both have a column ``cell`` (long). All held rows of a cell come to its task before the streamed ones: ``start`` (a
    table) makes a state of them, and ``step`` (state, batch of streamed rows) gives a record batch or None; ``step`` (state, None) ends a cell. The caller bounds the held rows of a cell;
    streamed ones need no bound. Cells without rows of one side give nothing.
    """
    both = held.withColumn("_late", F.lit(False)).unionByName(streamed.withColumn("_late", F.lit(True)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("cell", "_late")]
    both = both.select("cell", "_late", *names).repartition(parts, "cell").sortWithinPartitions("cell", "_late")

    def run(it: Iterator[pa.RecordBatch]):
        cell, waiting, state = None, [], None
        for b in it:
            own, late = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (late[1:] != late[:-1])) + 1).tolist(), len(own)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if own[begin] != cell:
                    if state is not None and (out := step(state, None)) is not None:
                        yield out
                    cell, waiting, state = own[begin], [], None
                if not late[begin]:
                    waiting.append(b.slice(begin, end - begin))
                    continue
                if waiting:
                    state, waiting = start(pa.Table.from_batches(waiting)), []
                if state is not None and (out := step(state, b.slice(begin, end - begin))) is not None:
                    yield out
        if state is not None and (out := step(state, None)) is not None:
            yield out

    return both.mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays([column])
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of every row of ``q`` to every row of ``x``, summed dimension by dimension, so that equal vectors are equally far everywhere."""
    far = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        far += (q[:, j][:, None] - x[:, j][None, :]) ** 2
    return far
