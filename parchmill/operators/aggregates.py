"""Counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import keyword_combination
from ..session import cut
from .running import bucket_count, running


def three_valued_counts(df: DataFrame, column: str) -> DataFrame:
    """(total, is_true, is_false, is_null) of a boolean."""
    c = F.col(column)
    return df.agg(F.count("*").alias("total"), F.count_if(c).alias("is_true"), F.count_if(~c).alias("is_false"), F.count_if(c.isNull()).alias("is_null"))


def keyword_counts(df: DataFrame, column: str) -> DataFrame:
    """(keyword, n): how many rows hold each trimmed keyword, most first."""
    return df.select(F.explode(column).alias("k")).groupBy(F.trim("k").alias("keyword")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword")


def combination_counts(df: DataFrame, column: str) -> DataFrame:
    """(combination, n): how many rows hold each set of keywords."""
    return df.groupBy(keyword_combination(column).alias("combination")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination")


def keywords_alone(df: DataFrame, group: str, keyword: str) -> DataFrame:
    """(keyword, groups, alone): in how many groups a keyword occurs, and in how many it is the only one."""
    pairs = df.select(group, keyword).dropna(subset=[keyword]).distinct()
    sized = pairs.withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    return sized.groupBy(F.col(keyword).alias("keyword")).agg(F.count("*").alias("groups"), F.count_if(F.col("__n") == 1).alias("alone"))


def first_per_key(df: DataFrame, key: str, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key (Spark limits groups before the shuffle as well), with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def record_scores(windows: DataFrame, keys: list[str], score: str, threshold: float) -> DataFrame:
    """Per record its windows, accepted and rejected ones and ``filings_average`` (of rounded scores, to 4 digits)."""
    s = F.nanvl(F.col(score), F.lit(None).cast("double"))
    return windows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(s, F.lit(0.0)) >= threshold).alias("accepted"), F.count_if(F.coalesce(s, F.lit(0.0)) < threshold).alias("rejected"),
        F.round(F.avg(F.round(s, 4).cast("decimal(18,4)")), 4).cast("double").alias("filings_average"),
    )


def run_summary(records: DataFrame) -> DataFrame:
    """One row of run counters from (total, accepted, rejected, excluded, filings_average, min_score, max_score, sum_score).

    Exclusion goes before having no windows. A record with accepted and rejected windows counts for both.
    """
    live = (F.coalesce("excluded", F.lit(0)) == 0)
    used = live & (F.col("total") > 0)
    return records.agg(
        F.count("*").alias("records"), F.count_if(~live).alias("records_excluded"), F.count_if(live & (F.col("total") == 0)).alias("records_skipped"), F.count_if(used).alias("records_processed"),
        F.count_if(used & (F.col("accepted") > 0)).alias("accepted_total"), F.count_if(used & (F.col("accepted") == F.col("total"))).alias("accepted_full"), F.count_if(used & (F.col("accepted") > 0) & (F.col("rejected") > 0)).alias("accepted_partial"),
        F.count_if(used & (F.col("rejected") > 0)).alias("rejected_total"), F.coalesce(F.sum(F.when(used, F.col("total"))), F.lit(0)).alias("windows"), F.coalesce(F.sum(F.when(used, F.col("accepted"))), F.lit(0)).alias("windows_accepted"),
        F.coalesce(F.sum(F.when(used, F.col("rejected"))), F.lit(0)).alias("windows_rejected"), F.coalesce(F.sum("excluded"), F.lit(0)).alias("windows_excluded"),
        F.round(F.min("min_score"), 4).alias("min_score"), F.round(F.max("max_score"), 4).alias("max_score"), F.round(F.sum("sum_score") / F.sum(F.when(used, F.col("total"))), 4).alias("avg_score"), F.round(F.avg("filings_average"), 4).alias("avg_filing"),
    )


def last_non_default(df: DataFrame, key: str, order: list[str], defaults: dict[str, object]) -> DataFrame:
    """Per key and column the last value (by ``order``) that isn't the default, else the default.

    One aggregation; a boolean that was ever true stays true.
    """
    place = F.struct(*order)
    out = []
    for c, default in defaults.items():
        given = F.col(c).isNotNull() if default is None else F.col(c).isNotNull() & (F.col(c) != F.lit(default))
        value = F.max(F.when(given, F.struct(place.alias("p"), F.col(c).alias("v"))))["v"]
        out.append((value if default is None else F.coalesce(value, F.lit(default))).alias(c))
    return df.groupBy(key).agg(*out)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``is_duplicate``: every row of a key but the first by ``order``, which must tell a key's rows apart.

    The first of each key comes from an aggregate with partial results, and the rows are held against it by a join
    that splits skewed keys; no task sorts a whole key. Null keys are keys.
    """
    first = df.groupBy(*[F.col(k).alias(f"__k{k}") for k in keys]).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("__first"))
    same = [df[k].eqNullSafe(first[f"__k{k}"]) for k in keys]
    return df.join(first, same).select(*[df[c] for c in df.columns], (F.struct(*[df[c] for c in order]) != F.col("__first")).alias("is_duplicate"))


def distinct_first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, order).filter(~F.col("is_duplicate")).drop("is_duplicate")


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    """(by…, bin, n): counts of equal bins from 0; the last bin holds the upper edge; values outside and null are left out.

    Edges that aren't given are the least and greatest value (one small aggregate).
    """
    if low is None or high is None:
        edge = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).first()
        low, high = (edge["a"] if low is None else low), (edge["b"] if high is None else high)
    by = by or []
    if low is None:
        return df.select(*by, F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) or 1.0
    x = F.col(column).cast("double")
    place = F.least(F.floor((x - F.lit(low)) * bins / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter((x >= low) & (x <= high) & ~F.isnan(x)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def counts_with_cumulative(df: DataFrame, column: str, fill: bool = True) -> DataFrame:
    """(value, n, share): counts of whole numbers, missing ones between as 0, with the cumulative share.

    Missing numbers come from a distributed range, and the sums run by buckets, so one outlier fills no task.
    """
    counts = cut(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n")), "counts")
    edge = counts.agg(F.min("value").alias("a"), F.max("value").alias("b"), F.sum("n").alias("n")).first()
    if edge["a"] is None:
        return counts.withColumn("share", F.lit(None).cast("double"))
    if fill:
        span = df.sparkSession.range(edge["a"], edge["b"] + 1).select(F.col("id").alias("value"))
        counts = span.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    width = edge["b"] - edge["a"] + 1
    place = F.floor((F.col("value") - edge["a"]) / F.lit(width) * F.lit(bucket_count(width)))
    summed = running(counts.withColumn("__one", F.lit(0)), ["__one"], place, ["value"], "n", "__sum")
    return summed.select("value", "n", (F.col("__sum") / F.lit(edge["n"])).alias("share"))


def pivot_best(df: DataFrame, row: str, column: str, columns: list, value: str, how: str = "max") -> DataFrame:
    """One row per ``row``, one column per given value of ``column``."""
    return df.groupBy(row).pivot(column, columns).agg({"max": F.max, "min": F.min, "sum": F.sum, "first": F.first}[how](value))


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "label", value: str = "value") -> DataFrame:
    """Columns as rows; NaN becomes null."""
    longer = df.unpivot(keys, columns, name, value)
    return longer.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))


def row_mean(columns: list[str]) -> Column:
    """Mean of a row's columns without null and NaN; null if none is left."""
    values = F.filter(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def composition(df: DataFrame, flags: list[str], values: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group the rows, the true ones of each flag and the given ones of each value."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in flags], *[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in values])


def crawl_statistics(df: DataFrame, keyword: str, container: str) -> DataFrame:
    """One row: items, distinct keywords, and items by container type as a map."""
    per = df.groupBy(container).agg(F.count("*").alias("n"), F.collect_set(keyword).alias("k"))
    return per.agg(F.sum("n").alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("keywords"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(container, F.lit("")), "n")))).alias("containers"))


def display_names(df: DataFrame, folder: str, cls: str, order: list[str]) -> DataFrame:
    """``df`` with ``display_name``: the folder, with its class where it has several, and a number where both agree."""
    each, both = Window.partitionBy(folder), Window.partitionBy(folder, cls)
    kinds = F.size(F.collect_set(cls).over(each))
    name = F.when(kinds > 1, F.concat(F.col(folder), F.lit(" ("), F.col(cls), F.lit(")"))).otherwise(F.col(folder))
    n = F.row_number().over(both.orderBy(*order))
    return df.withColumn("display_name", F.when(F.count("*").over(both) > 1, F.concat(name, F.lit(" #"), n.cast("string"))).otherwise(name))


def value_range(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(column).alias("least"), F.max(column).alias("most"))
