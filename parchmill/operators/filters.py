"""Predicates and splits over filings and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scope
from ..functions.strings import plain_keyword
from .joins import small


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def point(df: DataFrame, key: str, value, *columns: str) -> DataFrame:
    """The row of one key, whole or some columns; unknown columns raise ValueError."""
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    hit = df.filter(F.col(key) == F.lit(value))
    return hit.select(*columns) if columns else hit


def flag(col: Column | str) -> Column:
    """A boolean, false for null."""
    return F.coalesce(_c(col), F.lit(False))


def non_empty(col: Column | str) -> Column:
    """Neither null nor an empty text."""
    return _c(col).isNotNull() & (_c(col) != "")


def non_blank(col: Column | str) -> Column:
    return _c(col).isNotNull() & (F.trim(_c(col)) != "")


def has_keyword(col: Column | str, keyword: str, strict: bool = False) -> Column:
    """Whether an array holds a keyword, bare or in double quotes; strict: and nothing else."""
    forms = [keyword, f'"{keyword}"']
    if strict:
        return F.coalesce((F.size(_c(col)) == 1) & _c(col)[0].isin(forms), F.lit(False))
    return F.coalesce(F.arrays_overlap(_c(col), F.array(*map(F.lit, forms))), F.lit(False))


def keyword_set(col: Column | str) -> Column:
    """Distinct keywords in lower case without quotation marks, sorted; null gives an empty array."""
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(_c(col), lambda k: plain_keyword(k)))), F.array().cast("array<string>"))


def included(keywords: Column | str, wanted: str | list[str] | None, strict: bool = False) -> Column:
    """Whether a filing is wanted by its keywords.

    None wants all. Strict: exactly one keyword, in the list or equal to the text; else any shared keyword.
    """
    if wanted is None:
        return F.lit(True)
    have = keyword_set(keywords)
    words = [w.strip("\"'").lower() for w in ([wanted] if isinstance(wanted, str) else wanted)]
    if strict:
        return (F.size(have) == 1) & have[0].isin(words)
    return F.arrays_overlap(have, F.array(*map(F.lit, words)))


def in_scope(keywords: Column | str, scope: Scope) -> Column:
    """Whether the threshold is for a filing: no scope means yes; strict asks for the same set, else for any shared keyword."""
    if scope.keywords is None:
        return F.lit(True)
    have = keyword_set(keywords)
    words = F.array(*map(F.lit, sorted({w.strip("\"'").lower() for w in scope.keywords})))
    return (have == words) if scope.strict else F.arrays_overlap(have, words)


def decision(score: Column | str, threshold: float, scope: Column | None = None) -> Column:
    """``accept`` or ``reject``; a missing or NaN score counts as 0; out of scope all is accepted."""
    value = F.coalesce(F.nanvl(_c(score), F.lit(None).cast("double")), F.lit(0.0))
    by_score = F.when(value >= threshold, "accept").otherwise("reject")
    return by_score if scope is None else F.when(~scope, "accept").otherwise(by_score)


def result_columns(df: DataFrame, skip: tuple[str, ...] = ("id", "filing_id", "experiment_version", "classified_at")) -> list[str]:
    return sorted(set(df.columns) - set(skip))


def allowed_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    return df.select([c for c in df.columns if c in set(allowed)])


def unprocessed(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key has no output yet; ``force`` takes all."""
    return df if force else df.join(done.select(key).distinct(), key, "left_anti")


def stale_reports(reports: DataFrame, model: str = "model", cls: str = "class") -> DataFrame:
    """(model, stale): whether any field of a model's report counts ``wrong_value`` cases; ``reports`` has (metric, value)."""
    wrong = (F.col(cls) == "wrong_value") & (F.col("metric") == "support") & (F.col("value") > 0)
    return reports.groupBy(model).agg(F.coalesce(F.bool_or(wrong), F.lit(False)).alias("stale"))


def in_category(df: DataFrame, dimension: DataFrame, category: str, form: str = "form") -> DataFrame:
    """Rows whose form a dimension (category, form) puts in a category; the empty category takes all."""
    if not category:
        return df
    return df.join(small(dimension.filter(F.col("category") == category).select(F.col("form").alias("__f")).distinct()), F.col(form) == F.col("__f"), "left_semi")


def by_prefix(df: DataFrame, column: str, roles: dict[str, str], into: str = "role") -> DataFrame:
    """Rows whose value starts with one of a few prefixes, with that prefix's role (the first that fits)."""
    role = F.lit(None).cast("string")
    for prefix, name in reversed(roles.items()):
        role = F.when(F.startswith(F.col(column), F.lit(prefix)), F.lit(name)).otherwise(role)
    return df.withColumn(into, role).filter(F.col(into).isNotNull())
