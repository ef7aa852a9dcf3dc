"""Problem 5: texts that look the same although their characters differ.

Every text gets a 128-bit fingerprint of its one form (:mod:`.forms`) and one of its own characters. Texts that
agree in the first look the same. Only fingerprints are shuffled, never texts.

Defined results: null texts and texts without a letter or digit belong to no class; exact copies belong to one class
and aren't paired with each other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import map_batches
from .forms import VOCABULARY, canonical


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fingerprints(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, form, raw): the fingerprints of each text with a letter or digit."""

    def make():
        form_of = canonical(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, forms, raws = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                shown = form_of(t)
                if any(map(str.isalnum, shown)):
                    ids.append(k)
                    raws.append(digest(t))
                    forms.append(raws[-1] if shown is t else digest(shown))
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], names=[key, "form", "raw"])

        return step

    source = df.select(F.col(key), F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    return map_batches(source, make, f"`{key}` {dict(df.select(key).dtypes)[key]}, form binary, raw binary")


def lookalike_members(df: DataFrame, key: str = "record_id", text: str = "core_text", path: str = VOCABULARY) -> DataFrame:
    """(key, form, raw) of the texts that look like a text of other characters, cut once so that each text is read once."""
    prints = cut(fingerprints(df, key, text, path), "forms")
    mixed = prints.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("form")
    return prints.join(mixed, "form", "left_semi")


def lookalike_pairs(df: DataFrame, key: str = "record_id", text: str = "core_text", path: str = VOCABULARY) -> DataFrame:
    """(key_a, key_b), key_a < key_b: texts that differ but look the same. Copies of one text aren't paired."""
    members = lookalike_members(df, key, text, path)
    a, b = (members.select(F.col(key).alias(f"{key}_{x}"), "form", F.col("raw").alias(f"raw_{x}")) for x in "ab")
    return a.join(b, "form").filter((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("raw_a") != F.col("raw_b"))).select(f"{key}_a", f"{key}_b")


def lookalike_classes(df: DataFrame, key: str = "record_id", text: str = "core_text", path: str = VOCABULARY) -> DataFrame:
    """(key, class_id, spellings): one row per text that looks like a text of other characters; class_id is the class's least key."""
    members = lookalike_members(df, key, text, path)
    # copies fold into their spelling before the shuffle
    spelled = members.groupBy("form", "raw").agg(F.min(key).alias("k"))
    classes = spelled.groupBy("form").agg(F.min("k").alias("class_id"), F.count("*").alias("spellings"))
    return members.join(classes, "form").select(key, "class_id", "spellings")


def with_form(df: DataFrame, text: str, into: str = "form_text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the one form of ``text`` in a further column (null stays null)."""

    @F.pandas_udf("string")
    def form(batch):
        form_of = canonical(path)
        return batch.map(lambda t: None if t is None else form_of(t))

    return df.withColumn(into, form(F.col(text)))
