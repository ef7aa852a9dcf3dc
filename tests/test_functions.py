import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill import config
from parchmill.config import Category, Property, Scope
from parchmill.functions import strings, values, vectors
from parchmill.operators import filters
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    for given, want in [("a/b", "a_b"), ("x:y*z?", "x_y_z_"), ("  pad  ded ", "pad ded"), ("  ", "unnamed"), (None, "unnamed")]:
        assert one(spark, strings.base_name(F.lit(given).cast("string"))) == want
    assert len(one(spark, strings.base_name(F.lit("n" * 300), 10))) == 10
    assert one(spark, strings.slug(F.lit("/org/mo del:1/"))) == "org_mo_del_1"
    name = F.lit("Acme Inc  (ACM, ACM-PA)  (CIK 0000000001)")
    assert one(spark, strings.company(name)) == "Acme Inc" and one(spark, strings.first_ticker(name)) == "N/A"
    assert one(spark, strings.strict_name(name)) == ("Acme Inc", "ACM, ACM-PA") and one(spark, strings.ticker_list(name)) == ["ACM", "ACM-PA"]
    assert one(spark, strings.reference_label(F.lit("V2_short_def"))) == "V2: Short def"
    assert one(spark, strings.without_prefix(F.lit("a/b/m"), ["x/", "a/", "a/b/"])) == "b/m"
    assert one(spark, strings.document_urls(F.array(F.lit("7")), F.lit("1-2"), F.lit("f.htm"), "https://h/")) == ["https://h/7/12/f.htm"]
    assert one(spark, strings.entity_name(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit("1"))) == "T (A, B) (CIK 1)"
    assert one(spark, strings.query_string([("q", F.lit("a b")), ("n", F.lit(None)), ("e", F.lit(""))])) == "q=a+b"
    assert one(spark, strings.comma_list(F.lit(" a, ,b "))) == ["a", "b"]


def test_dates_and_times(spark):
    day = F.lit(dt.date(2024, 2, 29))
    assert one(spark, strings.range_start(F.lit("1y"), day)) == dt.date(2023, 2, 28)
    assert one(spark, strings.range_start(F.lit("30d"), day)) == dt.date(2024, 1, 30)
    assert one(spark, strings.range_start(F.lit("all"), day)) is None
    assert one(spark, strings.duration(F.lit(3_725))) == "1:02:05 h" and one(spark, strings.duration_words(F.lit(3_725))) == "01h 02m 05s"
    assert one(spark, strings.timed_label(F.lit("m"), F.lit(None).cast("double"))) == "m" and one(spark, strings.timed_label(F.lit("m"), F.lit(12.34))) == "m (12.3 ms/ctx)"


@pytest.mark.parametrize("given,kind,want", [("61,5", "float", 61.5), ("61.0", "int", 61), ("2.5", "int", 2), ("3.5", "int", 4), ("NaN", "float", None), ("x", "float", None), (None, "boolean", False), ("false", "boolean", True), ("0", "boolean", False), ("", "boolean", False), ("1", "unknown", True)])
def test_casts(spark, given, kind, want):
    assert one(spark, values.as_property(F.lit(given).cast("string"), kind)) == want


def test_answers(spark):
    props = {"b": "boolean", "f": "float", "i": "int"}
    for text, want in [('```json\n{"b": true, "i": "2.5"}\n```', (True, None, 2)), ('{"b": false, "f": 1.5}', (False, 1.5, None)), ('{"b": "false"}', (True, None, None)), ("no json", (False, None, None)), ("[1]", (False, None, None)), (None, (False, None, None))]:
        assert tuple(one(spark, values.parse_answer(F.lit(text).cast("string"), props))) == want, text


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(1, "NPS of 61 up +4 from 57.5 in 2020, 12,000 Q4 -3."), (2, None), (3, "none")], "id long, t string")
    got = values.numeric_candidates(df, "id", "t")
    assert [r["value"] for r in got.orderBy("position").collect()] == [61.0, 4.0, 57.5, -3.0]
    assert got.filter("position = 1").first()["context"].startswith("NPS of 61 up «+4» from")
    assert values.numeric_candidates(df, "id", "t", 0, 60).count() == 2


@pytest.mark.parametrize("truth,said,want", [(61.0, 61.0, "correct_value"), (61.0, 50.0, "wrong_value"), (61.0, None, "no_value"), (None, None, "no_value"), (None, 5.0, "wrong_value")])
def test_value_labels(spark, truth, said, want):
    assert one(spark, values.value_label(F.lit(truth).cast("double"), F.lit(said).cast("double"))) == want


def test_scopes_and_keywords(spark):
    df = spark.createDataFrame([(1, ['"nps"']), (2, ["nps", "x"]), (3, []), (4, None)], "id long, k array<string>")
    assert [r[0] for r in df.select(filters.in_scope("k", Scope(("nps",)))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(filters.included("k", ["nps"], True)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(filters.included("k", "NPS")).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(filters.has_keyword("k", "nps", True)).collect()] == [True, False, False, False]
    assert one(spark, filters.decision(F.lit(float("nan")), 0.3)) == "reject" and one(spark, filters.decision(F.lit(0.3), 0.3)) == "accept"
    assert one(spark, filters.decision(F.lit(0.1), 0.3, F.lit(False))) == "accept"
    with pytest.raises(ValueError):
        filters.point(df, "id", 1, "nope")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>")
    assert rows(df.select("id", F.round(vectors.cosine("v", [3.0, 4.0]), 6))) == [(1, 1.0), (2, 0.0), (3, None)]
    assert df.select(vectors.normalised("v")).first()[0] == [0.6, 0.8]
    texts = spark.createDataFrame([(1, "net score"), (2, None), (3, "net score"), (4, "")], "id long, t string")
    got = {r["id"]: r["e"] for r in texts.select("id", vectors.embed("t").alias("e")).collect()}
    assert got[1] == got[3] and got[2] is None and not np.any(got[4])


def test_configuration(tmp_path):
    assert config.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    c = Category("c", (Property("b", "flag"), Property("f", "value", "float")), "Label it.", (("text", {"b": True}),))
    assert len(c.stable_id) == 64 and Category.of(config.load_json(c.save(tmp_path))).stable_id == c.stable_id
    assert "- f (float): value" in c.prompt() and c.types == {"b": "boolean", "f": "float"}
    assert config.resolve_section("c.json", {"x": 1}, tmp_path)["x"] == 1 and config.resolve_section(None, {"x": 1}) == {"x": 1}
    assert config.first_config(tmp_path, "c").name == "c.json" and config.first_config(tmp_path, "zz").name == "c.json"
    assert config.ProcessConfig.of({"threshold": 0.5, "rule": {"phrases": ["a"]}, "scope": {"keywords": None}}).scope.keywords is None
    assert config.unique_properties([c, Category("d", (Property("b", "", "float"),))]) == {"b": "boolean", "f": "float"}
