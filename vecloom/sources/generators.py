"""Synthetic vectors from a 64-bit linear congruential generator, any row without the rows before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecloom.runtime import ship

#: First state, multiplier and increment of the generator.
SEED, MULTIPLY, ADD = 0x515545525941424C, 6364136223846793005, 1442695040888963407
MASK = (1 << 64) - 1


def jump(state: int, steps: int) -> int:
    """The state after so many steps, by repeated squaring of the step."""
    a, c = MULTIPLY, ADD
    while steps:
        if steps & 1:
            state = (state * a + c) & MASK
        c = (c * a + c) & MASK
        a = (a * a) & MASK
        steps >>= 1
    return state


def block(first: int, rows: int, dimension: int) -> np.ndarray:
    """Rows first ... first + rows - 1 as Float32."""
    n = rows * dimension
    a, c = np.empty(n, np.uint64), np.empty(n, np.uint64)
    if n:
        a[0], c[0] = MULTIPLY, ADD
    have = 1
    while have < n:  # the map of k + have steps is that of k after that of have
        more = min(have, n - have)
        a[have : have + more] = a[:more] * a[have - 1]
        c[have : have + more] = a[:more] * c[have - 1] + c[:more]
        have += more
    state = a * np.uint64(jump(SEED, first * dimension)) + c
    return ((state >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5).astype(np.float32).reshape(rows, dimension)


def synthetic_vectors(spark: SparkSession, count: int, dimension: int, partitions: int | None = None) -> DataFrame:
    """id 'synthetic-<row>', embedding."""
    ship(spark)

    def run(batches):
        for b in batches:
            rows = b.column(0).to_numpy()
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                x = block(int(part[0]), len(part), dimension)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), dimension).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([f"synthetic-{r}" for r in part], pa.string()), flat], names=["id", "embedding"])

    return spark.range(0, count, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, "id string, embedding array<float>")
