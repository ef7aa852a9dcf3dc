"""Small helpers for operators that need Arrow batches in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Apply ``make()(batch)`` to every Arrow batch; ``make`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def ints(values) -> pa.Array:
    return pa.array(values, pa.int64())
