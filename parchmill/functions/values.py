"""Typed values of classification properties: casts, answers of language models, numbers in text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Property types and their Spark types; another name counts as boolean.
TYPES = {"boolean": T.BooleanType(), "bool": T.BooleanType(), "float": T.DoubleType(), "int": T.IntegerType(), "integer": T.IntegerType()}
#: Fixed value: a number of up to three digits that isn't part of a longer one.
NUMBER = r"(?<![\w.,])[-+]?\d{1,3}(?:\.\d+)?(?!\d|,\d{3}|\.\d)"
REACH = 240


def property_type(name: str) -> T.DataType:
    return TYPES.get(name.lower(), T.BooleanType())


def as_number(col: Column) -> Column:
    """A text as a number; a comma counts as the decimal point; null and NaN, and what is no number, give null."""
    value = F.replace(F.trim(col.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value), value)


def as_property(col: Column, kind: str) -> Column:
    """A stored text as a property's value: integers rounded half to even, booleans by presence, else the default."""
    kind = kind.lower()
    if kind == "float":
        return as_number(col)
    if kind in ("int", "integer"):
        return F.rint(as_number(col)).cast("int")
    text = col.cast("string")
    number = as_number(col)
    empty = text.isNull() | (text == "") | (F.lower(text) == "nan")
    return F.when(empty, F.lit(False)).when(number.isNotNull(), number != 0).otherwise(F.lit(True))


def truthy(col: Column) -> Column:
    """1.0 for true, 1, yes and y in any case and for numbers other than 0, else 0.0."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), 1.0).when(F.coalesce(as_number(text), F.lit(0.0)) != 0, 1.0).otherwise(0.0)


def close(a: Column, b: Column, absolute: float = 1e-5, relative: float = 1e-9) -> Column:
    """Whether two numbers agree up to a tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def value_label(truth: Column, said: Column) -> Column:
    """``no_value``, ``correct_value`` or ``wrong_value`` of an extracted number."""
    return F.when(said.isNull(), "no_value").when(truth.isNotNull() & close(truth, said), "correct_value").otherwise("wrong_value")


def sigmoid(col: Column) -> Column:
    return 1 / (1 + F.exp(-col))


def clamp(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def parse_answer(text: Column, properties: dict[str, str]) -> Column:
    """A model's answer as a struct of properties: fences stripped, one JSON object; all defaults for anything else.

    JSON booleans are told from strings, as any non-empty string is true for a boolean property.
    """
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))
    tree = F.try_parse_json(bare)
    fields = []
    for name, kind in properties.items():
        path = f"$['{name}']"
        as_text = F.try_variant_get(tree, path, "string")
        if property_type(kind) == T.BooleanType():
            said = F.schema_of_variant(F.try_variant_get(tree, path, "variant")) == "BOOLEAN"
            value = F.coalesce(F.when(said, as_text == "true").otherwise(as_property(as_text, kind)), F.lit(False))
        else:
            value = as_property(as_text, kind)
        fields.append(value.alias(name))
    return F.struct(*fields)


def numeric_candidates(df: DataFrame, key: str, text: str, low: float | None = None, high: float | None = None, reach: int = REACH) -> DataFrame:
    """(key, position, value, begin, end, context): the numbers of a text, each with its surroundings, marked by « »."""
    pattern = re.compile(NUMBER)

    @F.pandas_udf("array<struct<value:double,begin:int,end:int,context:string>>")
    def found(batch: pd.Series) -> pd.Series:
        def of(t):
            rows = []
            for m in pattern.finditer(t or ""):
                before, after = t[max(0, m.start() - reach) : m.start()], t[m.end() : m.end() + reach]
                rows.append({"value": float(m.group()), "begin": m.start(), "end": m.end(), "context": f"{before}«{m.group()}»{after}"})
            return rows

        return batch.map(of)

    # a native test first: texts without a digit never go to Python
    some = df.filter(F.rlike(F.col(text), F.lit(r"\d"))).select(key, F.posexplode(found(text)).alias("position", "c")).select(key, "position", "c.*")
    if low is not None:
        some = some.filter(F.col("value") >= low)
    return some if high is None else some.filter(F.col("value") <= high)


def candidate_texts(text: Column) -> Column:
    """The numbers of a text as written, in the JVM."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
