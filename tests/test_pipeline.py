import json

import pytest
from pyspark.sql import functions as F

from parchmill.config import Category, ProcessConfig, Property, Scope
from parchmill.functions.windows import WindowRule
from parchmill.models import base
from parchmill.operators.store import Store
from parchmill.plans import process
from parchmill.sources import pages, readers, writers
from parchmill.streaming import flows
from tests.conftest import rows

CONFIG = ProcessConfig(WindowRule(("nps",), ("press",), 1, 1), 0.1, Scope(("nps",), True), "nps score")
BOOL = Category("c", (Property("flag", "has it"), Property("other", "never")))


def test_process_end_to_end(spark):
    records = spark.createDataFrame([("a", "<p>Our nps score rose.</p> More."), ("b", "The nps fell. press"), ("c", "nothing"), ("d", None), ("e", "nps & more")], "id string, core_text string")
    keywords = spark.createDataFrame([("a", ['"NPS"']), ("b", ["nps"]), ("e", ["nps", "x"])], "id string, keywords array<string>")
    got = {r["id"]: r for r in process.process(records, CONFIG, keywords).collect()}
    assert set(got) == {"a", "e"} and got["a"]["decision"] == "accept" and got["a"]["similarity_score"] > 0.3
    assert got["e"]["similarity_score"] is None and got["e"]["decision"] == "accept"
    found, excluded = process.extract(process.clean(records, CONFIG), CONFIG)
    decided = process.score(found, CONFIG).withColumn("decision", F.lit("accept"))
    one = process.summary(decided, records, excluded).first()
    assert (one["records"], one["records_excluded"], one["records_skipped"], one["records_processed"], one["windows"]) == (5, 1, 2, 2, 2)
    assert process.process(records.limit(0), CONFIG).count() == 0
    assert rows(process.nested(decided).select("id", "status", F.size("context"))) == [("a", "accepted", 1), ("e", "accepted", 1)]


def test_phrases_that_cleaning_puts_together(spark):
    config = ProcessConfig(WindowRule(("nps", "net promoter")), 0.1, Scope(None), "nps score")
    texts = [
        "Our net\npromoter score rose.", "Our net\u00a0promoter score rose.", "Our net\rpromoter score rose.", "Our net&nbsp;promoter score rose.", "Our net <b>promoter</b> score rose.", "<p>Our net\npromoter score rose.</p>",
        "Our net&#32;promoter score rose.", "Our &#110;ps rose.", "Our n&#x50;s rose.", "R&D and our NET <i>Promoter</i> score.",
    ]
    other = ["Our netting of promoters.", "The <b>net</b> income rose.", "R&D rose.", "n<b>p</b>s"]
    records = spark.createDataFrame(list(enumerate(texts + other)), "id int, core_text string")
    assert [r["id"] for r in process.process(records, config).select("id").distinct().orderBy("id").collect()] == list(range(len(texts)))


def test_svm_and_roll_up(spark):
    data = [(f"s{k}", "the nps score rose strongly" if k % 2 else "weather was calm and mild", str(k % 2), None) for k in range(40)]
    train = spark.createDataFrame(data, "id string, text string, flag string, other string")
    model = base.EmbeddingSVM(BOOL)
    with pytest.raises(base.NotTrained):
        model.classify(train, "text")
    model.train(train, "text")
    said = model.classify(train, "text")
    assert said.filter((F.col("answer.flag").cast("int").cast("string") != F.col("flag")) | F.col("answer.other")).count() == 0
    report, seconds = model.evaluate(train, "text")
    assert report.filter("property = 'flag' AND class = 'accuracy'").first()["f1"] == 1.0 and seconds > 0
    rolled = process.roll_up(process.classify(train.select("id", "text", F.lit(1).alias("hit_sentence_index"), F.lit(0).alias("context_start_index"), F.lit("").alias("matched_phrase")), [(BOOL, model)], text="text"), [BOOL])
    assert rolled.filter("flag").count() == 20
    assert base.from_dict(model.to_dict()) is base.from_dict(model.to_dict())


def test_candidates_and_unified(spark):
    data = [(k, f"the nps reached {20 + k} and the fee was {60 + k} dollars", float(20 + k), "1") for k in range(30)]
    train = spark.createDataFrame(data, "id int, text string, value double, flag string")
    category = Category("n", (Property("flag", "", "boolean"), Property("value", "", "float")))
    model = base.UnifiedModel(category).train(train, "text")
    got = model.classify(train.unionByName(spark.createDataFrame([(99, None, None, None)], train.schema)), "text")
    right = got.filter("answer.value = value").count()
    assert right >= 27 and got.filter("id = 99").first()["answer"]["value"] is None
    with pytest.raises(base.NotSupported):
        base.EmbeddingSVM(category)
    with pytest.raises(ValueError):
        base.CandidateModel(Category("n", (Property("value", "", "float"),))).train(train.limit(0), "text")


def test_language_model(spark):
    def make():
        return lambda prompts: ["<think>hm</think>```json\n" + json.dumps({"flag": "nps" in p.rsplit("Text:", 1)[1]}) + "\n```" for p in prompts]

    df = spark.createDataFrame([(1, "nps"), (2, "no"), (3, None)], "id int, text string")
    got = base.LanguageModel(BOOL, make=make).classify(df, "text")
    assert rows(got.select("id", "answer.flag", "answer.other")) == [(1, True, False), (2, False, False), (3, False, False)]


def test_readers_and_writers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    record = {"metadata": {"filing": {"id": "1-2:a/b.htm", "ciks": ["7"], "display_names": ["Acme (AC) (CIK 7)"]}, "keyword": "nps"}, "core_text": "t", "url": "u"}
    (raw / "one.json").write_text(json.dumps([record, record]))
    (raw / "bad.json").write_text("{not json")
    (raw / "empty.json").write_text("[]")
    records = readers.raw_records(spark, str(raw))
    assert records.count() == 2 and records.first()["file"] == "one.json"
    writers.write_raw(records.drop("file", "path", "modified_at"), str(tmp_path / "out"))
    assert readers.read_json(spark, str(tmp_path / "out"), records.drop("file", "path", "modified_at").schema, multi_line=False, recursive=True).count() == 2
    queries = tmp_path / "queries"
    queries.mkdir()
    (queries / "q.json").write_text(json.dumps({"queries": {"id1": {"keyword": "nps", "filing_limit": 3}}}))
    got = readers.search_queries(spark, str(queries)).first()
    assert (got["query_id"], got["keyword"], got["from_date"], got["individual_search_ticker"], got["filing_limit"]) == ("id1", "nps", "", [], 3)
    page = {"query": {"size": 100}, "hits": {"total": {"value": 1}, "hits": [{"_id": "1-2:f.htm", "_source": {"ciks": ["7"], "display_names": ["Acme (AC, AD)  (CIK 7)"]}}]}}
    (tmp_path / "page.json").write_text(json.dumps(page))
    hit = readers.search_hits(readers.search_pages(spark, str(tmp_path / "page.json"))).first()
    assert (hit["file_path_name"], hit["ticker"], hit["file_container_type"]) == ("f.htm", ["AC", "AD"], "htm")
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "A", "title": "x"}, "1": {"cik_str": 7, "ticker": "B", "title": "y"}}))
    assert rows(readers.ticker_dimension(spark, str(tmp_path / "t.json"))) == [("0000000007", "B", "y")]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.HTM").write_text("<p>x")
    (docs / "b.exe").write_text("x")
    assert rows(readers.documents(spark, str(docs)).select("container", "text", "problem")) == [("exe", None, "unknown container type exe"), ("htm", "<p>x", None)]
    rated = spark.createDataFrame([("a", "1", 1), ("a", "0", 2), ("b", "x", 3), (None, "1", 4)], "context_id string, label string, row_no int")
    assert rows(readers.labels(rated)) == [("a", 0)]
    (tmp_path / "scores_m__r_metrics.csv").write_text("threshold,TP,FP,FN,TN,precision,recall,F1,a,b\n0.5,1,2,3,4,0.1,0.2,0.3,,\n")
    assert rows(readers.metric_files(spark, str(tmp_path / "scores_m__r_metrics.csv")).select("model", "reference", "TP")) == [("m", "r", 1)]
    writers.write_csv(spark.createDataFrame([("x", ["a", "b"])], "id string, t array<string>"), str(tmp_path / "csv"), single=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["t"] == "['a', 'b']"
    assert rows(writers.context_ids(spark.createDataFrame([("f.json", 0, ["w", "v"])], "file string, record_no int, context array<string>")).select("context_id")) == [("f__r0__c0",), ("f__r0__c1",)]
    assert writers.markdown(spark.createDataFrame([(1, None)], "a int, b int")) == "| a | b |\n|---|---|\n| 1 |  |"
    assert rows(readers.company_submissions(spark.createDataFrame([("c", ["10-K", "8-K"], ["x", "y"])], "cik string, form array<string>, doc array<string>"), ["8-K"], ["form", "doc"])) == [("c", "8-K", "y")]


def test_evaluation_tree(spark, tmp_path):
    for folder in ("m1", "graphics"):
        (tmp_path / "e" / folder).mkdir(parents=True)
        (tmp_path / "e" / folder / "r.json").write_text(json.dumps({"model_name": "m", "evaluation_results": {"task": {"label": {"1": {"f1-score": 0.5, "support": 3}}}}}))
    assert rows(readers.evaluations(spark, str(tmp_path / "e")).select("folder", "task", "label", "class", "metric", "value")) == [("m1", "task", "label", "1", "f1-score", 0.5), ("m1", "task", "label", "1", "support", 3.0)]


def test_pages():
    assert pages.page_ranges(250, -1) == [(1, 100), (2, 100), (3, 50)] and pages.page_ranges(250, 120) == [(1, 100), (2, 20)] and pages.page_ranges(0, -1) == []
    calls = []

    def opener(url):
        calls.append(url)
        raise OSError

    with pytest.raises(OSError):
        pages.fetch("u", opener, wait=0)
    assert len(calls) == pages.TRIES


def test_streams(spark, tmp_path):
    source, at = str(tmp_path / "in"), f"file://{tmp_path}"
    schema = "id string, url string, keyword string, seq int"
    df = spark.createDataFrame([("a", "u", "k1", 1), ("a", None, "k2", 2), ("b", "v", "k1", 3)], schema)
    df.write.parquet(source)
    store = Store(spark, at + "/db", {})

    def run(n):
        stream = flows.file_stream(spark, source, df.schema)
        flows.upsert_stream(stream.drop("keyword"), store, at + "/c1", prepare=lambda b: b.filter("url IS NOT NULL").drop("seq")).awaitTermination()
        flows.keyword_stream(stream, store, at + "/c2").awaitTermination()
        assert store.read("filings").count() == n

    run(2)
    assert rows(store.read("filings").select("id", "url", "keywords")) == [("a", "u", ["k1", "k2"]), ("b", "v", ["k1"])]
    spark.createDataFrame([("c", "w", "k", 1)], schema).write.mode("append").parquet(source)
    run(3)  # only the new file is read again
    flows.transform_stream(flows.file_stream(spark, source, df.schema), str(tmp_path / "o"), at + "/c3", lambda s: s.filter("id = 'c'")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_topics():
    topics, got = flows.Topics(), []

    def fails(*_):
        raise RuntimeError

    topics.subscribe("t", fails)
    topics.subscribe("t", got.append)
    assert topics.publish("t", 1) == 2 and got == [1] and len(topics.failures) == 1
    topics.unsubscribe("t", got.append)
    topics.publish("t", 2)
    assert got == [1]
