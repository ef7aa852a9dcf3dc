"""Joins, and filters by the rows of another table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import close

#: Tables of at most this many rows are broadcast by the operators here; larger ones go through a shuffle join.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_version(main: DataFrame, results: DataFrame, version: str, key: str = "id", result_key: str = "filing_id", version_column: str = "experiment_version", skip: tuple[str, ...] = ("id", "classified_at")) -> DataFrame:
    """``main`` with the sorted result columns of one version, null where a row has no result."""
    columns = sorted(set(results.columns) - {result_key, version_column, *skip})
    one = results.filter(F.col(version_column) == version).select(F.col(result_key).alias("__k"), *columns)
    return main.join(one, F.col(key) == F.col("__k"), "left").drop("__k")


def atoms(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array, as an array of one; rows without elements stay as they are."""
    out = df.withColumn("__e", F.explode_outer(column))
    return out.withColumn(column, F.when(F.col("__e").isNotNull(), F.array("__e")).otherwise(F.col(column))).drop("__e")


def missing_from(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key (null as empty text) the other table lacks; repeated rows stay."""
    keys = other.select(F.coalesce(F.trim(F.col(other_key or key).cast("string")), F.lit("")).alias("__k")).distinct()
    out = df.join(keys, F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == F.col("__k"), "left_anti")
    return out.orderBy(*(order or [key])).limit(limit) if limit is not None else out


def present_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key, without spaces at its ends, the other table has."""
    keys = other.select(F.trim(F.col(other_key or key).cast("string")).alias("__k")).distinct()
    return df.join(keys, F.trim(F.col(key).cast("string")) == F.col("__k"), "left_semi")


def new_and_known(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of new and of known keys, in two joins instead of a lookup per row."""
    keys = known.select(key).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def match_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matched, left_only, right_only) of two tables of distinct keys."""
    a, b = left.select(key).withColumn("__l", F.lit(1)), right.select(key).withColumn("__r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("matched"), F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"))


def lookup_ignoring_case(df: DataFrame, dimension: DataFrame, key: str, name: str, ordinal: str) -> DataFrame:
    """``df`` with the last row of the dimension (by ``ordinal``) whose name agrees but for case."""
    last = dimension.groupBy(F.lower(name).alias("__n")).agg(F.max(F.struct(ordinal, *[c for c in dimension.columns if c != ordinal])).alias("d"))
    return df.join(small(last), F.lower(key) == F.col("__n"), "left").select(*df.columns, F.col("d.*"))


def similar_names(queries: DataFrame, names: DataFrame, query: str, name: str, top: int = 5, score: Callable[[Column, Column], Column] | None = None, block: int = 1_000) -> DataFrame:
    """(query, name, score, rank): the best names of each stated query, by ``1 - levenshtein / longest`` in the JVM.

    The queries are a stated, counted set: they are broadcast in blocks against all names, and each task keeps only
    its best ``top`` per query before anything is shuffled.
    """
    score = score or (lambda a, b: F.round(1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b), F.lit(1)), 6))
    asked = queries.select(F.col(query).alias("query")).dropna().distinct()
    blocks = max(1, -(-asked.count() // block))
    out = None
    for k in range(blocks):
        part = F.broadcast(asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k))
        scored = names.select(F.col(name).alias("name")).dropna().join(part).select("query", "name", score(F.col("query"), F.col("name")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one whole number."""
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    state = full = (1 << len(a)) - 1
    for ch in b:
        hit = state & places.get(ch, 0)
        state = (state + hit) | (state - hit)
    return len(a) - (state & full).bit_count()


def _share(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 200 * _common(a, b) / size if size else 100.0


def _partial(a: str, b: str) -> float:
    """The best share of the shorter text with a stretch of the longer one, cut off at its ends or of the shorter's length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n, m = len(a), len(b)
    spans = [(k, k + n) for k in range(m - n + 1)] + [(0, k) for k in range(1, n)] + [(m - k, m) for k in range(1, n)]
    best = max(_share(a, b[i:j]) for i, j in spans)
    if n == m and best < 100:
        best = max(best, *(_share(b, a[i:j]) for i, j in spans))
    return best


def _by_tokens(a: str, b: str) -> float:
    """Agreement of the words: sorted, or those that differ beside those that are shared."""
    x, y = sorted(a.split()), sorted(b.split())
    if not x or not y:
        return 0.0
    ordered = _share(" ".join(x), " ".join(y))
    shared, p, q = " ".join(sorted({*x} & {*y})), " ".join(sorted({*x} - {*y})), " ".join(sorted({*y} - {*x}))
    if shared and not (p and q):
        return 100.0
    gap = 1 if shared else 0
    left, right = len(shared) + gap + len(p), len(shared) + gap + len(q)
    best = 100 - 100 * (len(p) + len(q) - 2 * _common(p, q)) / (left + right)
    if shared:
        best = max(best, 200 * len(shared) / (len(shared) + left), 200 * len(shared) / (len(shared) + right))
    return max(ordered, best)


def _partial_by_tokens(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if {*x} & {*y}:
        return 100.0
    best = _partial(" ".join(sorted(x)), " ".join(sorted(y)))
    if len({*x}) < len(x) or len({*y}) < len(y):
        best = max(best, _partial(" ".join(sorted({*x})), " ".join(sorted({*y}))))
    return best


def weighted_agreement(a: str | None, b: str | None) -> float:
    """The weighted ratio of two texts, 0 to 100 (the published rule of fuzzy matchers: shares of the longest common
    subsequence of the whole texts, of their words and, where lengths differ by half or more, of parts)."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = _share(a, b)
    if longer < 1.5:
        return max(best, 0.95 * _by_tokens(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * _partial(a, b), 0.95 * scale * _partial_by_tokens(a, b))


@F.pandas_udf(T.DoubleType())
def weighted_ratio_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([round(weighted_agreement(a, b), 6) for a, b in zip(x, y, strict=True)], dtype=float)


def weighted_ratio(a: Column, b: Column) -> Column:
    """:func:`weighted_agreement` by Arrow batches."""
    return weighted_ratio_udf(a, b)


def first_close_column(df: DataFrame, value: str, columns: list[str]) -> Column:
    """The first of these columns whose number agrees with ``value``; null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        out = F.when(F.coalesce(close(F.col(value), F.col(c)), F.lit(False)), F.lit(c)).otherwise(out)
    return out


def grid(df: DataFrame, values: list[float], name: str = "threshold") -> DataFrame:
    """Every row with every one of a few constants, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
