"""Streams: file sources that feed the store, with checkpoints; every flow also runs once over what is there.

State is bounded: duplicates are dropped within a watermark, and keywords live in the store, not in the stream.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.store import Store


def file_stream(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_batch: int = 1_000, pattern: str = "*") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).format(form).load(path)


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats within ``delay`` are dropped, and keys are forgotten after it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str, once: bool = True, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None) -> StreamingQuery:
    """Every micro-batch goes into the store: new ids are inserted, known ones merged by the column rules.

    A batch that is repeated after a failure changes nothing but times.
    """

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_filings(prepare(batch), order)

    return _start(stream, step, checkpoint, once)


def keyword_stream(stream: DataFrame, store: Store, checkpoint: str, key: str = "id", keyword: str = "keyword", once: bool = True) -> StreamingQuery:
    """Keywords of a stream are appended to their filings where they are missing."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.add_keywords(batch.select(F.col(key).alias("id"), F.col(keyword).alias("keyword")))

    return _start(stream, step, checkpoint, once)


def transform_stream(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Stateless work on new files only, appended to a folder; the checkpoint remembers what is done."""
    writer = change(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, by…, n) of event-time windows; rows later than ``delay`` are left out."""
    late = stream.withWatermark(time, delay) if stream.isStreaming else stream
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return late.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def keyword_state(stream: DataFrame, key: str, keyword: str) -> DataFrame:
    """(key, keywords): after every batch the keywords of the keys that it touched, by keyed state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):
        have = list(state.get[0]) if state.exists else []
        for pdf in batches:
            have += [w for w in dict.fromkeys(pdf[keyword].dropna()) if w not in have]
        state.update((have,))
        yield pd.DataFrame({key: [k[0]], "keywords": [have]})

    kind = stream.schema[key].dataType
    return stream.groupBy(key).applyInPandasWithState(step, T.StructType([T.StructField(key, kind), T.StructField("keywords", T.ArrayType(T.StringType()))]), "keywords array<string>", "update", GroupStateTimeout.NoTimeout)


def _start(stream: DataFrame, step, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stop_when(query: StreamingQuery, flag: threading.Event, every: float = 0.2) -> bool:
    """Wait for a stream's end, or stop it between batches once the flag is set; whether it was stopped."""
    while query.isActive:
        if flag.wait(every):
            query.stop()
            return True
    return False


class Topics:
    """In-process topics: subscribers are called in order; one that fails doesn't stop the others."""

    def __init__(self) -> None:
        self.subscribers: dict[str, list[Callable]] = {}
        self.failures: list[tuple[str, Exception]] = []

    def subscribe(self, topic: str, call: Callable) -> None:
        self.subscribers.setdefault(topic, []).append(call)

    def unsubscribe(self, topic: str, call: Callable) -> None:
        if call in self.subscribers.get(topic, []):
            self.subscribers[topic].remove(call)

    def publish(self, topic: str, *args) -> int:
        calls = list(self.subscribers.get(topic, []))
        for call in calls:
            try:
                call(*args)
            except Exception as problem:  # noqa: BLE001
                self.failures.append((topic, problem))
        return len(calls)


class ProgressListener(StreamingQueryListener):
    """Publishes a stream's progress and end to topics."""

    def __init__(self, topics: Topics) -> None:
        self.topics = topics

    def onQueryStarted(self, event):
        self.topics.publish("stream.started", str(event.id))

    def onQueryProgress(self, event):
        self.topics.publish("stream.progress", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.topics.publish("stream.ended", str(event.id), event.exception)
