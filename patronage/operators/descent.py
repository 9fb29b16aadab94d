"""L-BFGS for many small problems whose losses are sums over the same rows.

The rows are kept in blocks.  Every problem is a generator that asks for its
loss and gradient at a point; one job answers all problems that still run, so a
whole grid over all folds takes as many jobs as its longest problem takes steps.
Tasks add up gradients over their blocks; the driver holds the parameters and
gets one row per task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .materialize import materialize, spread
from .nearest import _vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
# Pairs of steps that L-BFGS remembers, tries of a line search, steps over which the loss has to fall.
MEMORY, TRIES, STALL = 10, 12, 10


def minimize(start: np.ndarray, steps: int, tol: float = 1e-6, again: Callable[[], bool] = lambda: False) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points, is sent (loss, gradient) of each, returns the best point.

    The line search halves and doubles until the loss falls enough and the slope
    has flattened, which also holds for losses with kinks.  Where it ends before
    its steps it goes on from there if ``again()`` says so, with answers that may
    be more precise from then on.
    """
    at, taken = start, 0
    while True:
        loss, gradient = yield at
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        losses = [loss]
        while taken < steps:
            if np.linalg.norm(gradient) <= tol * max(abs(loss), 1e-8):
                break
            way = -_inverse(pairs, gradient)
            slope = float(way @ gradient)
            if not slope < 0:
                pairs, way = [], -gradient
                slope = float(way @ gradient)
            low, high, found = 0.0, math.inf, None
            step = 1.0 if pairs else min(1.0, 1 / float(np.linalg.norm(gradient)))
            for _ in range(TRIES):
                there = at + step * way
                value, slopes = yield there
                if not value <= loss + 1e-4 * step * slope:
                    high = step
                else:
                    found, low = (there, value, slopes), step
                    if slopes @ way >= 0.9 * slope:
                        break
                step = (low + high) / 2 if high < math.inf else 2 * step
            if found is None:
                break
            taken += 1
            moved, turned = found[0] - at, found[2] - gradient
            if moved @ turned > 1e-12 * (turned @ turned):
                pairs = [*pairs[1 - MEMORY :], (moved, turned)]
            at, loss, gradient = found
            losses.append(loss)
            if len(losses) > STALL and losses[-1 - STALL] - loss <= tol * abs(loss):
                break
        if taken >= steps or not again():
            return at


def _inverse(pairs: list[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> np.ndarray:
    """The gradient times the approximate inverse of the Hessian."""
    out, shares = gradient.copy(), []
    for moved, turned in reversed(pairs):
        share = (moved @ out) / (moved @ turned)
        out -= share * turned
        shares.append(share)
    if pairs:
        moved, turned = pairs[-1]
        out *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(pairs, reversed(shares)):
        out += (share - (turned @ out) / (moved @ turned)) * moved
    return out


def solve(problems: list[Generator], answer: Callable[[dict], dict]) -> list[np.ndarray]:
    """The results of all problems; ``answer`` turns {problem: point} into {problem: (loss, gradient)}."""
    results: list = [None] * len(problems)
    asked = {i: next(p) for i, p in enumerate(problems)}
    while asked:
        further = {}
        for i, found in answer(asked).items():
            try:
                further[i] = problems[i].send(found)
            except StopIteration as end:
                results[i] = end.value
        asked = further
    return results


def row_blocks(data: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``data`` (vector, label, fold), dealt out evenly, as blocks: n, vectors, label, fold."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                held = [_vectors(part.column(0)).astype("<f8"), part.column(1).to_numpy().astype("<i4"), part.column(2).to_numpy().astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)]), *[pa.array([x.tobytes()], pa.binary()) for x in held]], names=["n", "vectors", "label", "fold"])

    return materialize(spread(data.select("vector", "label", "fold")).mapInArrow(pack, "n long, vectors binary, label binary, fold binary"))


def summed(blocks: DataFrame, of_block: Callable, shared, size: int) -> np.ndarray:
    """The sum over all blocks of ``of_block(vectors, label, fold, shared value)``, ``size`` numbers."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, total = shared.value, np.zeros(size)
        for batch in batches:
            for n, vectors, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                total += of_block(np.frombuffer(vectors, "<f8").reshape(n, -1), np.frombuffer(label, "<i4"), np.frombuffer(fold, "<i4"), value)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = blocks.mapInArrow(add_up, "total binary").collect()
    return np.sum([np.frombuffer(r.total) for r in parts], axis=0) if parts else np.zeros(size)
