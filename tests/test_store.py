import pytest
from pyspark.sql import functions as F

from parchmill.operators import store
from parchmill.operators.store import Store
from parchmill.plans import process
from tests.conftest import rows

PROPS = {"KPI_CURRENT_VALUE": "boolean", "nps_value_fix": "float"}


@pytest.fixture
def db(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db", PROPS)


def filings(spark, *data, schema="id string, ticker array<string>, project_relevant boolean"):
    return spark.createDataFrame(list(data), schema)


def test_column_rules(spark, db):
    schema = "id string, blacklisted boolean, url string, keywords array<string>"
    db.upsert_filings(filings(spark, ("x", True, "u", ["a"]), schema=schema))
    db.upsert_filings(filings(spark, ("x", False, None, None), schema=schema))
    assert rows(db.read("filings").select("blacklisted", "url", "keywords")) == [(True, "u", ["a"])]
    db.upsert_filings(filings(spark, ("x", None, "v", []), ("y", None, None, None), (None, True, "z", None), schema=schema))
    assert rows(db.read("filings").select("id", "blacklisted", "url", "keywords")) == [("x", True, "v", []), ("y", False, None, [])]


def test_upsert_twice_changes_nothing_but_times(spark, db):
    new = filings(spark, ("a", ["t"], None), ("b", [], True))
    first = rows(db.upsert_filings(new).drop("last_crawled"))
    assert rows(db.upsert_filings(new).drop("last_crawled")) == first


def test_last_of_a_batch_wins(spark):
    old = spark.createDataFrame([("k", 1)], "id string, v int")
    new = spark.createDataFrame([("k", 2, 1), ("k", 3, 2), ("n", None, 1)], "id string, v int, seq int")
    assert rows(store.upsert(old, new, ["id"], {}, "seq").select("id", "v")) == [("k", 3), ("n", None)]


def test_keywords(spark, db):
    db.upsert_filings(filings(spark, ("a", [], None)))
    for word in ("NPS", "Net Promoter Score", "NPS"):
        db.add_keywords(spark.createDataFrame([("a", word), ("a", None), ("missing", "x")], "id string, keyword string"))
    assert db.read("filings").first()["keywords"] == ["NPS", "Net Promoter Score"]
    assert rows(store.append_keywords(spark.createDataFrame([("a", None)], "id string, keywords array<string>"), spark.createDataFrame([("a", "k")], "id string, keyword string"))) == [("a", ["k"])]


def test_versions_are_apart(spark, db):
    schema = "filing_id string, experiment_version string, nps_value_fix double"
    db.upsert_classifications(spark.createDataFrame([("a", "v1", 8.0), ("a", "v2", 7.0)], schema))
    db.upsert_classifications(spark.createDataFrame([("a", "v1", 8.5)], schema))
    db.upsert_classifications(spark.createDataFrame([("a", "v3", 1.0, True, 5)], schema + ", NEW boolean, junk int"), allowed=["nps_value_fix", "NEW"])
    assert rows(db.versions("a").select("experiment_version", "nps_value_fix", "NEW")) == [("v1", 8.5, None), ("v2", 7.0, None), ("v3", 1.0, True)]
    assert "junk" not in db.read("classifications").columns


def test_preprocessing_overwrites_the_main_row(spark, db):
    db.upsert_filings(filings(spark, ("a", [], None)))
    schema = "filing_id string, preprocessing_version string, project_relevant boolean, path_to_preprocessed string"
    db.upsert_preprocessing(spark.createDataFrame([("a", "prep_v1", True, "p")], schema))
    db.upsert_preprocessing(spark.createDataFrame([("a", "prep_v2", False, None)], schema))
    assert rows(db.read("filings").select("project_relevant", "path_to_preprocessed")) == [(False, None)]
    assert db.read("preprocessing").count() == 2


def test_delete_reaches_the_children(spark, db):
    db.upsert_filings(filings(spark, ("a", [], None), ("b", [], None)))
    db.upsert_classifications(spark.createDataFrame([("a", "v1"), ("b", "v1")], "filing_id string, experiment_version string"))
    db.delete(spark.createDataFrame([("a",)], "id string"))
    assert rows(db.read("classifications").select("filing_id")) == [("b",)] and rows(db.read("filings").select("id")) == [("b",)]
    db.blacklist(spark.createDataFrame([("b",), ("c",)], "id string"))
    assert rows(db.read("filings").select("id", "blacklisted")) == [("b", True), ("c", True)]


def test_updates(spark):
    df = spark.createDataFrame([("a", "u", ["k"]), ("b", "v", ["k"])], "id string, url string, keywords array<string>")
    assert rows(store.update_where(df, "id", "a", {"url": None, "keywords": None})) == [("a", None, []), ("b", "v", ["k"])]
    with pytest.raises(ValueError):
        store.update_where(df, "id", "a", {"nope": 1})
    assert rows(store.reset_column(df, "url").select("url")) == [(None,), (None,)]
    assert store.evolve(df, {"x": "float", "url": "boolean", "y": "unknown"}).dtypes[-2:] == [("x", "double"), ("y", "boolean")]


def test_export(spark):
    main = filings(spark, ("a", ["abc"], True), ("b", ["cde", "efg"], True), ("c", ["xyz"], False))
    results = spark.createDataFrame([("a", "v1", True, 68.5), ("a", "v2", False, 1.0)], "filing_id string, experiment_version string, KPI_CURRENT_VALUE boolean, nps_value_fix double")
    some = rows(process.export(main, results, "v1", True).select("id", "ticker", "KPI_CURRENT_VALUE", "nps_value_fix"))
    assert some == [("a", "['abc']", True, 68.5), ("b", "['cde']", None, None), ("b", "['efg']", None, None)]
    assert process.export(main, results, "v1").count() == 4
    assert process.export(filings(spark, ("x", [], None)), None, "v1").columns == ["id", "ticker", "project_relevant"]


def test_empty_tables(spark, db):
    assert db.read("filings").count() == 0 and db.read("classifications").columns[:2] == ["filing_id", "experiment_version"]
    db.upsert_filings(filings(spark, ("a", [], None)).filter(F.lit(False)))
    assert db.read("filings").count() == 0
