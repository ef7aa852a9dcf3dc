import random

import pytest
from pyspark.sql import functions as F

from parchmill.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    sources = ["a"] * 60 + ["b"] * 25 + ["c"] * 10 + ["unlisted"] * 4 + [None]
    data = [(k, rng.choice([None, ""]) if k % 50 == 0 else " ".join(rng.choices(["score", "net", "loyal", "customer"], k=rng.randint(1, 60))), rng.choice(sources)) for k in range(1_500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_and_repeats(spark, tables):
    docs, targets = tables
    mixed = mixing.mixture(docs, targets).cache()
    got = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    for source, share, repeats in [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]:
        assert abs(got[source]["share"] - share) < 0.02 and got[source]["most_copies"] <= repeats
    assert got["none"]["tokens"] == 0
    assert mixed.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    rows = mixed.orderBy("position").collect()
    at = 0
    for r in rows:  # positions are the running sum in a total order
        assert r["position"] == at
        at += r["tokens"]
    half = {}
    for r in rows:
        if r["position"] < at / 2:
            half[r["source"]] = half.get(r["source"], 0) + r["tokens"]
    assert abs(half["a"] / sum(half.values()) - 0.5) < 0.05


def test_time_when_the_budget_is_spent(spark):
    totals = spark.createDataFrame([(100, 0.5, 1), (300, 0.3, 2), (50, 0.2, 4)], "total long, weight double, max_repeats int")
    for budget in (1, 50, 200, 350, 700, 899, 900):
        at = mixing.spent_by(totals, budget)
        assert abs(sum(min(t * m, at * w) for t, w, m in [(100, 0.5, 1), (300, 0.3, 2), (50, 0.2, 4)]) - budget) < 1e-6
    assert mixing.spent_by(totals, 5_000) == 2_000 and mixing.spent_by(totals.limit(0), 5) == 0


def test_nothing_is_lost_by_pruning(spark, tables):
    """Against plain fair queueing of all repetitions."""
    docs, targets = tables
    sized = {r[0]: (r[1], r[2]) for r in mixing.token_counts(docs.drop("tokens"), "doc_id", "text", ["source"]).select("doc_id", "source", "tokens").collect() if r[2]}
    everything = {(r["doc_id"], r["copy"]): r for r in mixing.mixture(docs, targets, budget=10**9).collect()}
    for budget in (500, 7_000):
        got = {(r["doc_id"], r["copy"]) for r in mixing.mixture(docs, targets, budget=budget).collect()}
        assert got == {k for k, r in everything.items() if r["position"] + r["tokens"] <= budget}
    assert len(everything) == sum({"a": 1, "b": 2, "c": 4}.get(s, 0) for s, _ in sized.values())


def test_budget_and_order(spark, tables):
    docs, targets = tables
    one = mixing.mixture(docs, targets, budget=3_000)
    assert 2_800 <= one.agg(F.sum("tokens")).first()[0] <= 3_000
    assert sorted(one.collect()) == sorted(mixing.mixture(docs.repartition(5), targets, budget=3_000).collect())
    everything = mixing.mixture(docs, targets, budget=10**9)
    assert everything.groupBy("source").agg(F.max("copy").alias("m")).filter("source = 'c'").first()["m"] == 4
    assert mixing.mixture(docs.limit(0), targets).count() == 0

