import datetime as dt
import math
import random

import pytest

from parchmill.llm import topn
from tests.conftest import order, rows


def test_top_n_against_sorting(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, math.nan, 0.1, 0.5, 0.5, 0.9]), rng.choice([None, 1, 2]), k) for k in range(3_000)]
    df = spark.createDataFrame(data, "g string, s double, h int, w long").repartition(7)
    got = rows(topn.top_n_per_group(df, "g", [("s", True), ("h", False), ("w", False)], 5, held_groups=2).select("g", "w", "rank"))
    want = []
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is None or r[1] != r[1], -(r[1] if r[1] is not None and r[1] == r[1] else 0), r[2] is None, r[2] or 0, r[3]))
        want += [(g, r[3], k + 1) for k, r in enumerate(own[:5])]
    assert got == sorted(want, key=order)


def test_text_order_and_bad_n(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", None, 3)], "g string, t string, rank int")
    assert [r["t"] for r in topn.top_n_per_group(df, "g", [("t", True)], 2).orderBy("rank").collect()] == ["y", "x"]
    assert [r["t"] for r in topn.top_n_per_group(df, "g", [("t", False)], 3).orderBy("rank").collect()] == ["x", "y", None]
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "g", [("t", True)], 0)
    assert topn.top_n_per_group(df.limit(0), "g", [("t", True)], 2).count() == 0


def test_latest_row_of_a_window_counts(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("f", 1, 0.9, 1, t), ("f", 1, 0.1, 1, t + dt.timedelta(1)), ("f", 2, 0.5, 1, t), ("f", 2, 0.5, 1, t), ("f", 3, 0.8, 2, t), ("f", 3, math.nan, 2, t + dt.timedelta(1)), (None, 4, 0.9, 1, t), ("f", 5, None, 1, t), ("f", None, 1.0, 1, t), ("f", 6, 0.5, 0, None)]
    df = spark.createDataFrame(data, "id string, window_id long, similarity_score double, hit_sentence_index int, processed_at timestamp")
    assert [r["window_id"] for r in topn.top_windows(df).orderBy("rank").collect()] == [6, 2, 1]
