import math
import random

import pytest
from pyspark.sql import functions as F

from parchmill.operators import aggregates, filters, joins, metrics, running, sampling
from tests.conftest import rows


def test_metrics_without_predictions(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, False), (None, True)], "s double, t boolean")
    got = rows(metrics.threshold_sweep(df, "s", F.col("t"), [0.9]).select("tp", "fp", "fn", "tn", "precision", "recall", "f1"))
    assert got == [(0, 0, 2, 1, 0.0, 0.0, 0.0)]
    assert metrics.threshold_sweep(df, "s", F.col("t"), [0.9], empty=None).first()["precision"] is None


def test_sweep_against_counting(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([None, 0.1, 0.25, 0.5, 0.75]), rng.choice([True, False, None])) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, s double, t boolean")
    steps = [0.0, 0.25, 0.5, 1.0]
    sweep = metrics.threshold_sweep(df, "s", F.col("t"), steps, ["g"])
    for r in sweep.collect():
        own = [(s is not None and s >= r["threshold"], bool(t)) for g, s, t in data if g == r["g"]]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(sum(x == c for x in own) for c in [(True, True), (True, False), (False, True), (False, False)])
    best = {r["g"]: r for r in metrics.best_threshold(sweep, ["g"]).collect()}
    for g in "ab":
        own = [r for r in sweep.collect() if r["g"] == g]
        top = max(r["f1"] for r in own)
        assert best[g]["threshold"] == min(r["threshold"] for r in own if r["f1"] == top)


def test_report_supports_sum_to_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, s string")
    got = {r["class"]: r for r in metrics.classification_report(df, "t", "s").collect()}
    assert sum(got[c]["support"] for c in "abc") == 4 and got["accuracy"]["f1"] == 0.5 and got["c"]["f1"] == 0.0
    assert math.isclose(got["macro avg"]["recall"], (0.5 + 1 + 0) / 3)


def test_pareto(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 0.3), (3, 0.5), (None, 0.9), (3, 0.45)], "t int, q double")
    assert rows(metrics.pareto(df, "t", "q")) == [(1, 0.4), (3, 0.5)]


def test_means(spark):
    df = spark.createDataFrame([(1.0, 1), (math.nan, 5), (None, 5), (3.0, 3)], "v double, w int")
    assert df.agg(metrics.weighted_mean("v", "w")).first()[0] == 2.5
    assert df.limit(0).agg(metrics.weighted_mean("v", "w")).first()[0] is None
    wide = spark.createDataFrame([(1, 0.5, math.nan), (2, None, None)], "id int, a double, b double")
    assert rows(wide.select("id", aggregates.row_mean(["a", "b"]))) == [(1, 0.5), (2, None)]


def test_systematic_sample(spark):
    df = spark.createDataFrame([(0.2 + k / 1000, k) for k in range(18)] + [(0.5, 100)], "v double, k int")
    got = rows(sampling.systematic_sample(df, "v", "k").select("k"))
    assert got == [(k,) for k in (2, 4, 6, 8, 10, 12, 14, 16)] + [(100,)]


def test_bucket_sample_loses_the_top_edge(spark):
    df = spark.createDataFrame([(0.1, 1), (0.15, 2), (0.3, 3)], "v double, k int")
    assert rows(sampling.bucket_sample(df, "v", "k").select("k")) == [(1,), (2,)]
    assert sampling.bucket_sample(df.limit(0), "v", "k").count() == 0


def test_splits_are_stable(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    one = rows(sampling.holdout(df, ["k"]).filter("is_test").select("k"))
    assert len(one) == 51 and one == rows(sampling.holdout(df.repartition(5), ["k"]).filter("is_test").select("k"))
    assert rows(sampling.hash_split(df, "k")) == rows(sampling.hash_split(df.repartition(3), "k"))
    assert sampling.shuffled_head(df, "k", 7).count() == 7


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (None,), (math.nan,)], "x double")
    assert rows(aggregates.histogram(df, "x", 2, 0.0, 1.0)) == [(0, 1), (1, 2)]
    assert aggregates.histogram(df.filter("x < -5"), "x", 2).count() == 0


def test_roll_up(spark):
    df = spark.createDataFrame([("f", 1, True, 61.0), ("f", 2, False, None), ("f", 3, False, 65.0), ("g", 1, None, None)], "id string, o int, b boolean, v double")
    assert rows(aggregates.last_non_default(df, "id", ["o"], {"b": False, "v": None})) == [("f", True, 65.0), ("g", False, None)]


def test_keyword_reports(spark):
    df = spark.createDataFrame([(1, [" b", "a"]), (2, []), (3, None), (4, ["a", "b"])], "id long, k array<string>")
    assert rows(aggregates.combination_counts(df, "k")) == [("['a', 'b']", 2), ("[no keywords]", 2)]
    assert rows(aggregates.keyword_counts(df, "k")) == [("a", 2), ("b", 2)]
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None)], "g long, k string")
    assert rows(aggregates.keywords_alone(pairs, "g", "k")) == [("a", 2, 1), ("b", 1, 0)]


def test_display_names(spark):
    df = spark.createDataFrame([("f", "A", 1), ("f", "B", 2), ("f", "B", 3), ("g", "A", 4)], "folder string, c string, o int")
    assert [r["display_name"] for r in aggregates.display_names(df, "folder", "c", ["o"]).orderBy("o").collect()] == ["f (A)", "f (B) #1", "f (B) #2", "g"]


def test_joins(spark):
    a = spark.createDataFrame([("x ",), ("y",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    assert rows(joins.missing_from(a, b, "k")) == [("y",), ("y",), (None,)]
    assert rows(joins.present_in(a, b, "k")) == [("x ",)]
    new, known = joins.new_and_known(a, b, "k")
    assert new.count() == 4 and known.count() == 0
    dim = spark.createDataFrame([("ACME", 1, "t1"), ("acme", 2, "t2")], "name string, o int, ticker string")
    assert joins.lookup_ignoring_case(spark.createDataFrame([("Acme",), ("q",)], "n string"), dim, "n", "name", "o").filter("n = 'Acme'").first()["ticker"] == "t2"
    values = spark.createDataFrame([(61.0, 5.0, 61.000001), (7.0, None, 1.0)], "v double, p double, q double")
    assert [r[0] for r in values.select(joins.first_close_column(values, "v", ["p", "q"])).collect()] == ["q", None]
    names = spark.createDataFrame([("Acme Corp",), ("Apex",)], "n string")
    best = joins.similar_names(spark.createDataFrame([("Corp Acme",)], "q string"), names, "q", "n", 1, joins.weighted_ratio).first()
    assert best["name"] == "Acme Corp" and best["score"] == 95
    # published values of the weighted ratio and its parts
    assert round(joins._share("this is a test", "this is a test!"), 2) == 96.55 and joins._partial("this is a test", "this is a test!") == 100
    assert joins._by_tokens("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100 and joins._by_tokens("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert joins.weighted_agreement("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95 and joins.weighted_agreement("", "a") == joins.weighted_agreement(None, "a") == 0
    assert joins.weighted_agreement("abc", "abcabcabcabc") == 90 and joins.weighted_agreement("abc", "abc" * 9) == 60
    assert rows(joins.grid(a.limit(1), [0.1, 0.2]).select("threshold")) == [(0.1,), (0.2,)]
    assert rows(joins.match_counts(a.dropna().distinct(), b, "k")) == [(0, 2, 2)]


def test_stale_reports_and_supports(spark):
    data = [("m", "l", "1", "support", 4.0), ("m", "l", "1", "f1-score", 0.5), ("m", "l", "wrong_value", "support", 1.0), ("n", "l", "True", "support", 0.0), ("n", "l", "True", "f1-score", 0.9), ("n", "l", "macro avg", "support", 9.0)]
    df = spark.createDataFrame(data, "model string, label string, class string, metric string, value double")
    assert rows(filters.stale_reports(df)) == [("m", True), ("n", False)]
    assert rows(metrics.positive_metric(df)) == [("m", "l", 0.5), ("n", "l", None)]
    assert rows(metrics.supports(df, ["model"])) == [("m", 4.0, None, None), ("n", 0.0, None, 9.0)]
    assert rows(metrics.metric_frame(metrics.positive_metric(df), ["l"])) == [("m", 0.5, 0.5), ("n", None, None)]


def test_unprocessed(spark):
    df, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert rows(filters.unprocessed(df, done, "k")) == [(2,)] and filters.unprocessed(df, done, "k", True).count() == 2


def test_curves(spark):
    df = spark.createDataFrame([(0.9, True, 1), (0.8, False, 1), (0.8, True, 1), (0.1, False, 1)], "s double, t boolean, g int")
    curve = metrics.pr_curve(df, "s", F.col("t"), ["g"])
    assert math.isclose(metrics.average_precision(curve, ["g"]).first()[1], 0.5 * 1 + 0.5 * 2 / 3)
    with pytest.raises(ValueError):
        sampling.holdout(spark.range(1_000_001), ["id"])


def test_running_against_loops(spark):
    rng = random.Random(1)
    data = [(rng.choice(["x", "y", None]), k, rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(data, "g string, k int, v int")
    place = F.floor(F.col("k") / 7)
    sums = {r["k"]: r["s"] for r in running.running(df, ["g"], place, ["k"], "v", "s").collect()}
    tops = {r["k"]: r["s"] for r in running.running(df, ["g"], place, ["k"], "v", "s", "max", inclusive=False).collect()}
    total, top = {}, {}
    for g, k, v in data:
        assert tops[k] == top.get(g)
        total[g], top[g] = total.get(g, 0) + v, max(top.get(g, v), v)
        assert sums[k] == total[g]


def test_rows_at_places(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([rng.random(), 0.5]), k) for k in range(400)]
    df = spark.createDataFrame(data, "g string, v double, k int")
    got = rows(running.rows_at(df, "g", "v", "k", F.array(F.lit(0), F.lit(7), F.col("n") - 1)))
    want = []
    for g in "ab":
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        want += [own[0], own[7], own[-1]]
    assert got == sorted(want)


def test_first_wins_with_null_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, o int")
    assert rows(aggregates.first_wins(df, ["k"], ["o"])) == [("a", 1, False), ("a", 2, True), (None, 3, False), (None, 4, True)]
    assert rows(aggregates.distinct_first_seen(df, ["k"], ["o"]).select("o")) == [(1,), (3,)]
