"""Vector columns: similarity, normalisation, and a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(vector: Column | str, reference: list[float]) -> Column:
    """Cosine of a vector column with one reference, in the JVM; a zero vector scores 0, null stays null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    r = np.asarray(reference, float)
    length = float(np.sqrt((r * r).sum())) or 1.0
    ref = F.array(*[F.lit(float(x)) for x in r])
    own = norm(v)
    return dot(v, ref) / (F.when(own == 0, F.lit(1.0)).otherwise(own) * F.lit(length))


def cosine_columns(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vector columns; 0 where either is a zero vector."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    scale = norm(a) * norm(b)
    return dot(a, b) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def normalised(vector: Column | str) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    own = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(own == 0, F.lit(1.0)).otherwise(own))


def round_exactly(col: Column, digits: int) -> Column:
    """Rounding of the exact binary value, halves to even, as stored scores are rounded; the JVM's ``round`` takes the decimal text.

    The value times a power of ten is taken in two exact halves, so that it is told from a half without an error.
    """
    scale = float(10**digits)
    wide = col * F.lit(134217729.0)  # 2^27 + 1 parts a double into two halves of 26 bits
    high = wide - (wide - col)
    below = F.floor(col * scale).cast("double")
    over = (high * scale - (below + 0.5)) + (col - high) * scale
    up = F.when(over != 0, over > 0).otherwise(F.pmod(below, F.lit(2.0)) == 1)
    return F.when(F.abs(col) < F.lit(1e15 / scale), (below + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(col)


class LetterEmbedder:
    """The plainest embedder: how often each letter from a to z stands in the lower-case text."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[low.count(ch) for ch in "abcdefghijklmnopqrstuvwxyz"] for low in map(str.lower, texts)], np.float32).reshape(-1, 26)


class HashingEmbedder:
    """Deterministic embedder without a model: signed counts of words and word pairs in ``size`` places."""

    def __init__(self, size: int = 256) -> None:
        self.size, self._places = size, {}

    def _place(self, word: str) -> tuple[int, int]:
        if word not in self._places:
            if len(self._places) > 200_000:
                self._places.clear()
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self._places[word] = (h % self.size, 1 if h >> 63 else -1)
        return self._places[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                place, sign = self._place(w)
                row[place] += sign
        return out


def embed(text: Column | str, make: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEmbedder, batch: int = 512, unit: bool = False) -> Column:
    """Embedding column; ``make`` builds the embedder once per worker. Texts are batched by length, results keep their order.

    Null gives null. ``unit`` scales the vectors to length 1 (zero vectors stay).
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for series in batches:
            texts = series.tolist()
            order = sorted((k for k, t in enumerate(texts) if t is not None), key=lambda k: len(texts[k]))
            out: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                made = np.asarray(model([texts[j] for j in part]))
                if unit:
                    size = np.linalg.norm(made, axis=1, keepdims=True)
                    made = made / np.where(size == 0, 1, size)
                for k, vector in zip(part, made, strict=True):
                    out[k] = vector.tolist()
            yield pd.Series(out)

    return run(text)
