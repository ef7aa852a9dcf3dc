"""Running sums and maxima, and rows at given ranks, without any task that holds a whole group.

Values are first aggregated by buckets of the order, the few bucket results are added up, and only then the rows of a
bucket are taken in order. Buckets are as many as the data asks for; one value that fills a bucket by itself is the
most that a task has to take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ROWS_PER_BUCKET = 20_000
#: Coarse edges of an order: quantiles of the data.
QUANTILES = 200


def bucket_count(rows: int) -> int:
    return min(100_000, max(8, rows // ROWS_PER_BUCKET))


def running(df: DataFrame, groups: list[str], bucket: Column, order: list, value: str, into: str, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """``df`` with the sum or maximum of ``value`` up to (``inclusive``: and with) each row, in the order of ``bucket``, then ``order``.

    ``bucket`` must rise with the order. Null where nothing is before (sums: 0).
    """
    fold = F.max if how == "max" else F.sum
    placed = df.withColumn("__bucket", bucket)
    each = placed.groupBy(*groups, "__bucket").agg(fold(value).alias("__each"))
    before = fold("__each").over(Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = before if how == "max" else F.coalesce(before, F.lit(0))
    names = [*groups, "__bucket"]
    known = each.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(names)], before.alias("__before"))
    joined = placed.join(known, [F.col(c).eqNullSafe(F.col(f"__k{n}")) for n, c in enumerate(names)]).select(*placed.columns, "__before")
    frame = Window.partitionBy(*groups, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = fold(value).over(frame)
    total = F.greatest("__before", own) if how == "max" else F.col("__before") + F.coalesce(own, F.lit(0))
    return joined.withColumn(into, total).drop("__bucket", "__before")


def spread(df: DataFrame, column: str, descending: bool = False) -> Column:
    """A bucket expression for the order of a number, by one small aggregate.

    Quantiles of the data are the coarse edges, so that a heavy tail fills no bucket alone; between two of them steps
    are equal.
    """
    x = F.col(column).cast("double")
    known = df.filter(x.isNotNull() & ~F.isnan(x))
    n, edges = known.agg(F.count("*"), F.percentile_approx(x, [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES)).first()
    edges = sorted(set(edges or [0.0]))
    fine = max(1, -(-bucket_count(n) // len(edges)))
    at, table = F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)), F.lit(1)), F.array(*map(F.lit, [*edges, edges[-1]]))
    low, high = F.element_at(table, at), F.element_at(table, at + 1)
    step = F.least(F.floor(F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)) * fine), F.lit(fine - 1))
    place = F.greatest(at * fine + F.greatest(step, F.lit(0)), F.lit(0))
    return -place if descending else place


def rows_at(df: DataFrame, group: str, value: str, key: str, places: Column) -> DataFrame:
    """The rows at some places (from 0) of each group's order by value and key.

    ``places`` is an array column made from ``n``, the group's number of rows. Each group is cut into bins at its own
    quantiles; only the rows of bins that hold a wanted place are ranked.
    """
    x = F.col(value).cast("double")
    edges = df.groupBy(group).agg(F.percentile_approx(x, [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES).alias("__e"), F.count("*").alias("n")).withColumn("__places", places)
    edges = cut(edges, "edges")
    placed = df.join(F.broadcast(edges) if edges.limit(10_001).count() <= 10_000 else edges, group)
    placed = placed.withColumn("__bin", F.size(F.filter(F.array_distinct("__e"), lambda e: e <= x)))
    counts = placed.groupBy(group, "__bin").agg(F.count("*").alias("__c"))
    first = F.coalesce(F.sum("__c").over(Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__first", first).join(edges.select(group, "__places"), group)
    wanted = starts.filter(F.exists("__places", lambda p: (p >= F.col("__first")) & (p < F.col("__first") + F.col("__c")))).select(group, "__bin", "__first")
    near = placed.join(wanted, [group, "__bin"])
    ranked = near.withColumn("__i", F.col("__first") + F.row_number().over(Window.partitionBy(group, "__bin").orderBy(value, key)) - 1)
    return ranked.filter(F.array_contains("__places", F.col("__i").cast("long"))).select(df.columns)
