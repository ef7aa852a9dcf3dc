"""Problem 1: the best N rows of every group.

Each task keeps a heap of at most N rows per group and sends only the heaps; after the shuffle heaps of one group are
merged as they stream by. A group that holds a third of all rows sends at most N rows from each task, and no task ever
holds a group. A task that meets many groups sends its heaps early, so its memory is bounded as well.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Down:
    """Orders values the other way round."""

    __slots__ = ("value",)

    def __init__(self, value) -> None:
        self.value = value

    def __lt__(self, other: Down) -> bool:
        return other.value < self.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Down) and self.value == other.value


def _rank(values: list, descending: bool, numeric: bool) -> list:
    """Comparable ranks, the better the greater; null and NaN are worst in either direction."""
    if numeric:
        sign = 1 if descending else -1
        return [-math.inf if v is None or v != v else sign * v for v in values]
    return [(0, 0) if v is None else (1, v if descending else Down(v)) for v in values]


class Heaps:
    """Mergeable aggregate: per group the best ``n`` (rank, row) in a heap whose root is the worst."""

    def __init__(self, n: int) -> None:
        self.n, self.of = n, {}

    def add(self, group, rank, row) -> None:
        heap = self.of.get(group)
        if heap is None:
            self.of[group] = [(rank, row)]
        elif len(heap) < self.n:
            heapq.heappush(heap, (rank, row))
        elif heap[0][0] < rank:
            heapq.heapreplace(heap, (rank, row))

    def drain(self) -> list[tuple]:
        rows = [(group, k + 1, row) for group, heap in self.of.items() for k, (_, row) in enumerate(sorted(heap, key=lambda x: x[0], reverse=True))]
        self.of = {}
        return rows


def top_n_per_group(df: DataFrame, group: str, order: list[tuple[str, bool]], n: int, held_groups: int = 50_000) -> DataFrame:
    """(group, order columns, rank): for each group its first ``n`` rows.

    ``order`` has (column, descending) pairs; the last column must be unique in its group, so that the order is total
    (rows that agree in all of them are interchangeable). Null and NaN values come last, a null group is a group,
    an empty table gives no rows, other columns are ignored. ``n`` < 1 raises ValueError.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [c for c, _ in order]
    source = df.select(F.col(group).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(names)])
    schema = source.schema
    numbers = [isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType)) for f in schema.fields[1:]]
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema] + [("rank", pa.int32())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [[g for g, _, _ in rows], *([row[i] for _, _, row in rows] for i in range(len(names))), [k for _, k, _ in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch], ordered: bool) -> Iterator[pa.RecordBatch]:
        heaps, last = Heaps(n), object()
        for batch in batches:
            groups, *values = (batch.column(i).to_pylist() for i in range(1 + len(names)))
            ranks = zip(*(_rank(v, descending, number) for v, (_, descending), number in zip(values, order, numbers, strict=True)), strict=True)
            for g, rank, row in zip(groups, ranks, zip(*values, strict=True), strict=True):
                if ordered and g != last:  # its rows are all there
                    if len(heaps.of) >= 5_000:
                        yield batch_of(heaps.drain())
                    last = g
                heaps.add(g, rank, row)
            if not ordered and len(heaps.of) > held_groups:
                yield batch_of(heaps.drain())
        if heaps.of:
            yield batch_of(heaps.drain())

    out = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
    partial = source.mapInArrow(lambda b: run(b, False), out).drop("rank")
    merged = partial.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: run(b, True), out)
    return merged.select(F.col("g").alias(group), *[F.col(f"o{i}").alias(c) for i, c in enumerate(names)], "rank")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def latest_windows(windows: DataFrame) -> DataFrame:
    """(id, window_id, similarity_score, hit_sentence_index): each window by its row with the latest ``processed_at``.

    A null time counts as earliest. Windows whose latest row has a null ``id`` or a null or NaN score are left out.
    """
    latest = windows.filter(F.col("window_id").isNotNull()).groupBy("window_id").agg(F.max(F.struct("processed_at", "similarity_score", "hit_sentence_index", "id")).alias("r"))
    return latest.select("r.id", "window_id", "r.similarity_score", "r.hit_sentence_index").filter(F.col("id").isNotNull() & F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))


def top_windows(windows: DataFrame, n: int = 5) -> DataFrame:
    """For each ``id`` its ``n`` best windows: score descending, hit sentence and window id ascending."""
    return top_n_per_group(latest_windows(windows), "id", [("similarity_score", True), ("hit_sentence_index", False), ("window_id", False)], n)
