"""Reproducible samples, splits and orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import rows_at


def top_and_bottom(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` greatest and least rows with ``side`` (top or bottom); a report of bounded size."""
    known = df.filter(F.col(value).isNotNull())
    top = known.orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(known.orderBy(value, key).limit(n).withColumn("side", F.lit("bottom")))


def bucket(value: Column | str, width: float = 0.1, low: float = 0.1, high: float = 1.0) -> Column:
    """Number of the bucket [low + k·width, …) that a value is in; null outside."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when((v >= low) & (v < high), F.floor((v - F.lit(low)) / F.lit(width) + F.lit(1e-9))).cast("int")


def systematic_sample(df: DataFrame, value: str, key: str, per: int = 8, bucket_of: Column | None = None) -> DataFrame:
    """From each bucket its rows at evenly spaced places of the order by value: all of up to ``per`` rows, else at most ``per``.

    The place of the k-th is the half-even rounding of k·n/(per+1).
    """
    placed = df.withColumn("bucket", bucket_of if bucket_of is not None else bucket(value)).filter(F.col("bucket").isNotNull())
    even = F.transform(F.sequence(F.lit(1), F.lit(per)), lambda k: F.rint(k * F.col("n") / F.lit(float(per + 1))).cast("long"))
    all_ = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: k.cast("long"))
    return rows_at(placed, "bucket", value, key, F.when(F.col("n") <= per, all_).otherwise(even))


def hashed(key: str, seed: int) -> Column:
    """A hash of a key and a seed that every engine has: the SHA-256 of ``key:seed`` in hexadecimal."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)


def bucket_sample(df: DataFrame, value: str, key: str, per: int = 5, width: float = 0.1, seed: int = 42) -> DataFrame:
    """Up to ``per`` rows of each bucket of the data's own range, by a hash of the key; a value on the top edge is in no bucket."""
    step = F.floor(F.col(value) / F.lit(width) + F.lit(1e-9)).cast("int")
    end = df.agg(F.ceil(F.max(value) / F.lit(width) - F.lit(1e-9)).cast("int").alias("b")).first()["b"]
    placed = df.withColumn("bucket", step).filter(F.col("bucket") < F.lit(end))
    order = Window.partitionBy("bucket").orderBy(hashed(key, seed), key)
    return placed.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per).drop("__n")


def seeded_places(n: int, seed: int = 42) -> np.ndarray:
    """The permutation of n rows that the seed gives (numpy's legacy generator)."""
    return np.random.RandomState(seed).permutation(n)


def holdout(df: DataFrame, order: list[str], test: float = 0.5, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test``: the first ceil(n·test) places of the seeded permutation of the rows in ``order``.

    For labelled tables: the permutation is made on the driver, so more than a million rows raise; use
    :func:`hash_split` for those.
    """
    n = df.count()
    if n > 1_000_000:
        raise ValueError("holdout is for labelled tables of up to a million rows; use hash_split")
    places = seeded_places(n, seed)[: int(np.ceil(n * test))]
    spark = df.sparkSession
    test_rows = spark.createDataFrame([(int(k),) for k in places], "__row long")
    numbered = df.withColumn("__row", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return numbered.join(F.broadcast(test_rows.withColumn("is_test", F.lit(True))), "__row", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False))).drop("__row")


def hash_split(df: DataFrame, key: str, test: float = 0.5, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test`` by a hash of the key: no shuffle, the same at any size."""
    return df.withColumn("is_test", F.conv(F.left(hashed(key, seed), F.lit(8)), 16, 10).cast("long") < F.lit(test * (1 << 32)))


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded order by hash (a top-n, never a full sort)."""
    return df.withColumn("__h", hashed(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def first_n(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
