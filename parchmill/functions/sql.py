"""The engine's functions for SQL: native ones as SQL functions, which the optimizer sees through, others by Arrow.

``register(spark)`` makes them temporary functions of the session:

    split_sentences(text)                sentences of a text; tables that are marked stay whole
    cosine_sim(a, b)                     cosine of two vectors; 0 where either is a zero vector
    context_windows(text, phrase)        table function (sentence_no, context): two sentences around each hit, 600 characters at most on each side
    clean_html(text)                     visible text of a page
    wratio(a, b)                         weighted agreement of two names, 0 to 100
    numeric_candidates(text)             table function (value, begin): numbers of up to three digits
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import Phrases, html_to_text
from .values import NUMBER

_SENTENCES = r"""
filter(transform(split(
  if(contains(text, '[TABLE]'), array_join(transform(split(text, r'(?=\[TABLE\])|(?<=\[/TABLE\])'), p -> if(startswith(p, '[TABLE]') AND endswith(p, '[/TABLE]'), replace(p, '. ', concat(char(1), ' ')), p)), ''), text),
  r'(?U)(?<=[.!?])\s+'), s -> regexp_replace(replace(s, char(1), '.'), r'(?U)^\s+|\s+$', '')), s -> s <> '')"""
_COSINE = """
coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
  sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x))), if(a IS NULL OR b IS NULL, NULL, 0D))"""
_WINDOWS = rf"""
SELECT sentence_no, trim(concat(right(substring(whole, 1, at - 1), 600), substring(whole, at, length(phrase)), substring(substring(whole, at + length(phrase)), 1, 600))) AS context FROM (
  SELECT sentence_no, whole, instr(lower(whole), phrase) AS at FROM (
    SELECT sentence_no, trim(regexp_replace(array_join(slice(sentences, greatest(0, sentence_no - 2) + 1, 3 + least(2, sentence_no)), ' '), r'(?U)\s+', ' ')) AS whole
    FROM (SELECT sentences, posexplode(sentences) AS (sentence_no, sentence) FROM (SELECT {_SENTENCES} AS sentences)) WHERE contains(lower(sentence), phrase)))"""


@F.pandas_udf(T.StringType())
def clean_html(batch: pd.Series) -> pd.Series:
    nothing = Phrases(())
    return batch.map(lambda t: None if t is None else html_to_text(t, nothing))


@F.udtf(returnType=T.StructType([T.StructField("value", T.DoubleType()), T.StructField("begin", T.IntegerType())]))
class NumericCandidates:
    def __init__(self) -> None:
        self.number = re.compile(NUMBER)

    def eval(self, text: str):
        for m in self.number.finditer(text or ""):
            yield float(m.group()), m.start()


def register(spark: SparkSession) -> None:
    from ..operators.joins import weighted_ratio_udf

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION split_sentences(text STRING) RETURNS ARRAY<STRING> RETURN {_SENTENCES}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_COSINE}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION context_windows(text STRING, phrase STRING) RETURNS TABLE(sentence_no INT, context STRING) RETURN {_WINDOWS}")
    spark.udf.register("clean_html", clean_html)
    spark.udf.register("wratio", weighted_ratio_udf)
    spark.udtf.register("numeric_candidates", NumericCandidates)
