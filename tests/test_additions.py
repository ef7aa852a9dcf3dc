"""Readers, writers, models and functions that need no data folder."""

import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from parchmill.config import Category
from parchmill.functions import html, strings, vectors
from parchmill.models import base, remote
from parchmill.operators import aggregates, metrics, running, sampling
from parchmill.operators.store import Store
from parchmill.plans import process
from parchmill.sources import pages, readers, workbook, writers
from tests.conftest import rows

FLAGS = Category.of({"name": "flags", "properties": [{"name": "up", "description": "rises", "type": "bool"}, {"name": "never", "description": "-", "type": "bool"}]})


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(4)
    data = [0.12345, 0.00005, 2.5, 0.03125, 1e300, -0.12345, 0.99995, 0.5, -1.00005, 0.0] + [round(rng.uniform(-2, 2), 5) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    assert [r[0] for r in df.select(vectors.round_exactly(F.col("x"), 4)).collect()] == [round(x, 4) for x in data]
    assert df.select(vectors.round_exactly(F.lit(None).cast("double"), 4)).first()[0] is None


def test_range_macros(spark):
    df = spark.createDataFrame([("1y",), ("30D",), ("3w",), ("custom",), ("",), (None,)], "m string")
    assert [str(r[0]) for r in df.select(strings.range_start("m", F.lit("2024-02-29").cast("date"), F.lit("2001-01-01"))).collect()] == ["2023-02-28", "2024-01-30", "2024-02-29", "2001-01-01", "2001-01-01", "2001-01-01"]


def test_buckets_of_a_heavy_tail(spark):
    df = spark.createDataFrame([(float(k % 100), k) for k in range(5_000)] + [(1e12, 5_000)], "v double, k long").withColumn("one", F.lit(1))
    for down in (False, True):
        placed = df.withColumn("b", running.spread(df, "v", down))
        sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
        assert max(sizes) <= 60  # one outlier doesn't press the rest into one bucket
        order = [r["v"] for r in placed.orderBy("b", F.desc("v") if down else "v").collect()]
        assert order == sorted(order, reverse=down)


def test_an_outlier_makes_no_long_task(spark):
    got = rows(aggregates.counts_with_cumulative(spark.createDataFrame([(1,), (1,), (4,), (None,)], "x int"), "x"))
    assert [r[:2] for r in got] == [(1, 2), (2, 0), (3, 0), (4, 1)] and got[-1][2] == 1.0
    wide = aggregates.counts_with_cumulative(spark.createDataFrame([(0,), (3_000_000,)], "x int"), "x")
    assert wide.filter("n > 0").count() == 2 and wide.count() == 3_000_001
    assert aggregates.counts_with_cumulative(spark.createDataFrame([], "x int"), "x").count() == 0


def test_store_keeps_states_and_refuses_lost_changes(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/db", {}, buckets=4, keep=2)
    first = db.upsert_filings(spark.createDataFrame([(f"f{k}", "u") for k in range(20)], "id string, url string"))
    before = first.select("id").count()
    for k in range(4):
        db.upsert_filings(spark.createDataFrame([("f1", f"v{k}")], "id string, url string"))
    assert before == 20 and db.read("filings").count() == 20 and db.read("filings").filter("id = 'f1'").first()["url"] == "v3"
    names = [p.name for p in (tmp_path / "db" / "filings").iterdir()]
    assert sum(n.startswith("manifest-") for n in names) == 2 and not any(n.startswith(".manifest-") and not n.endswith(".crc") for n in names)
    have = db._manifest("filings", db._manifests("filings")[-1])
    assert len(set(q.rsplit("/", 1)[0] for q in have.values())) == 2  # one bucket was written again, the others stay
    (tmp_path / "db" / "filings" / "data-000000099-torn").mkdir()  # what a crash leaves behind is never read
    assert db.read("filings").count() == 20
    known = db._manifests
    db._manifests = lambda name: known(name)[:-1]  # someone else has written meanwhile
    with pytest.raises(RuntimeError):
        db.blacklist(spark.createDataFrame([("f2",)], "id string"))


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("a & <b>", 1, 2.5, True, ["x", "y"]), (None, None, float("nan"), None, None)], "s string, n long, d double, b boolean, l array<string>")
    assert workbook.write(df, f"file://{tmp_path}/w.xlsx") == 2
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    back = workbook.read(spark, f"file://{tmp_path}/*.xlsx", "s string, n long, d double, b boolean, l string, missing int")
    assert rows(back) == [("a & <b>", 1, 2.5, True, "['x', 'y']", None), (None, None, None, None, None, None)]
    assert workbook._letters(0) == "A" and workbook._letters(27) == "AB" and list(workbook.rows_of(workbook.to_bytes(["a"], [])))
    with pytest.raises(ValueError):
        workbook.write(df, f"file://{tmp_path}/w.xlsx", 1)


def test_named_files_and_copies(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"])], "k string, l array<string>")
    writers.write_named(df, f"file://{tmp_path}/out", "one.csv")
    writers.write_named(df, f"file://{tmp_path}/out", "one.csv")
    assert (tmp_path / "out" / "one.csv").read_text() == "k,l\na,['x']\n" and [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["one.csv"]
    assert writers.copy_files(spark.createDataFrame([(f"file://{tmp_path}/out/one.csv",)] * 2, "path string"), f"file://{tmp_path}/copy") == 1
    assert (tmp_path / "copy" / "one.csv").exists()
    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), 3)


class Answers(http.server.BaseHTTPRequestHandler):
    fails = 1

    def log_message(self, *args):
        pass

    def _say(self, value, code=200):
        body = json.dumps(value).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        at = int(self.path.split("from=")[1]) if "from=" in self.path else 0
        self._say({"hits": {"total": {"value": 150}, "hits": [{"_id": f"i{k}", "_source": {"k": k}} for k in range(at, min(at + 100, 150))]}})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Answers.fails:
            Answers.fails -= 1
            return self._say({}, 500)
        text = asked.get("prompt") or asked["messages"][0]["content"]
        said = json.dumps({"up": "rise" in text.rsplit("Text: ", 1)[1]})
        self._say({"response": said} if "prompt" in asked else {"choices": [{"message": {"content": said}}]})


@pytest.fixture(scope="module")
def server():
    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_search_pages_find_their_total_and_stop(spark, server, tmp_path):
    spark.dataSource.register(pages.SearchSource)
    read = spark.read.format("paged_search").option("url", f"{server}/?q=x")
    assert read.load().count() == 150 and read.option("limit", 120).load().count() == 120
    stop = tmp_path / "stop"
    stop.write_text("")
    assert read.option("stop", str(stop)).load().count() == 0


@pytest.mark.parametrize("form", ["chat", "generate"])
def test_remote_models(spark, server, form):
    Answers.fails = 1
    endpoint = remote.Endpoint(f"{server}/api", "m", form, wait=0.01)
    one = Category.of({"name": "one", "properties": [{"name": "up", "description": "rises", "type": "bool"}]})
    df = spark.createDataFrame([(1, "scores rise"), (2, "scores fall"), (3, None)], "id long, t string")
    said = base.LanguageModel(one, make=remote.adapter(endpoint)).classify(df, "t")
    assert rows(said.select("id", "answer.up")) == [(1, True), (2, False), (3, False)]
    assert remote.Endpoint("http://127.0.0.1:9/", "m", tries=2, wait=0.01).ask("x") is None


def test_multi_label_heads_are_trained(spark):
    rng = random.Random(1)
    data = [(" ".join(rng.choices(["good", "rise", "score", "up"] if k % 2 else ["bad", "fall", "score", "down"], k=8)), k % 2, 0) for k in range(200)]
    df = spark.createDataFrame(data, "t string, up int, never int")
    with pytest.raises(base.NotTrained):
        base.MultiLabelModel(FLAGS).classify(df, "t")
    model = base.MultiLabelModel(FLAGS).train(df.limit(120), "t")
    said = model.classify(df, "t")
    assert said.filter(F.col("answer.up") == (F.col("up") == 1)).count() >= 190 and said.filter("answer.never").count() == 0


def test_presets_and_aliases():
    for name, cls in [("BGE_Base", base.EmbeddingSVM), ("QWEN_Unified", base.UnifiedModel), ("hf_llm", base.LanguageModel), ("deberta_base", base.MultiLabelModel), ("embedding_svm", base.EmbeddingSVM), ("openai", base.LanguageModel)]:
        assert isinstance(base.make(name, FLAGS), cls)
    assert base.make("bge_advanced", FLAGS).options["shared"] is False and base.make("svm", FLAGS) is base.make("qwen_unified", FLAGS)
    assert len(base.PRESETS) == 10


def test_phrases_that_only_cleaning_shows(spark):
    """A phrase broken by a line end, markup or an entity is found, and such records keep all their windows."""
    texts = ["Our net\npromoter score rose.", "<p>Our net\npromoter score rose.</p>", "Our <i>net</i> <b>promoter</b> score rose.", "Our net&nbsp;promoter score rose.", "Our net promoter score rose."]
    config = process.ProcessConfig(html_rule(), 0.0, process.filters.Scope(None))
    df = spark.createDataFrame(list(enumerate([*texts, "nothing", None, ""])), "id long, core_text string")
    found = process.process(df, config, make=vectors.LetterEmbedder)
    assert rows(found.select("id", "matched_phrase")) == [(k, "net promoter") for k in range(5)]


def html_rule():
    from parchmill.functions.windows import WindowRule

    return WindowRule(("net promoter",))


def test_metric_frames_of_nothing(spark):
    empty = spark.createDataFrame([], "model string, label string, value double")
    assert metrics.head_to_head(empty, ["a", "b"], "a", "b").count() == 0 and metrics.approach_means(empty, {}, "x").count() == 0
    assert html.html_to_text("", html.Phrases(())) == ""


def test_hash_samples_are_the_same_everywhere(spark):
    import hashlib

    df = spark.createDataFrame([(k,) for k in range(200)], "k long")
    want = sorted(range(200), key=lambda k: hashlib.sha256(f"{k}:42".encode()).hexdigest())[:5]
    assert [r[0] for r in sampling.shuffled_head(df, "k", 5).collect()] == want
    test = {r["k"] for r in sampling.hash_split(df, "k").filter("is_test").collect()}
    assert test == {k for k in range(200) if int(hashlib.sha256(f"{k}:42".encode()).hexdigest()[:8], 16) < 2**31}


def test_documents_say_what_they_lack(spark, tmp_path):
    for name in ("a.html", "b.pdf", "c.zip"):
        (tmp_path / name).write_text("text")
    got = {r["container"]: (r["text"], r["problem"]) for r in readers.documents(spark, f"file://{tmp_path}").collect()}
    assert got["html"] == ("text", None) and got["zip"][1] == "unknown container type zip" and got["pdf"][0] is None and got["pdf"][1]


def test_a_flag_stops_a_stream(spark, tmp_path):
    from parchmill.streaming import flows

    flag = threading.Event()
    query = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/mark").start()
    flag.set()
    assert flows.stop_when(query, flag) and not query.isActive
    assert not flows.stop_when(query, threading.Event())


def test_labelling_and_query_configs(spark, tmp_path):
    w = spark.createDataFrame([("a.json", 0, [("x",), ("y",)])], "file string, record_no int, context array<struct<context:string>>")
    assert writers.labelling(w, f"file://{tmp_path}/l") == 2
    assert [json.loads(x)["context_id"] for x in (tmp_path / "l" / "contexts.jsonl").read_text().splitlines()] == ["a__r0__c0", "a__r0__c1"]
    q = spark.createDataFrame([("q1", "nps", ["10-K"]), ("q2", None, None)], "query_id string, keyword string, filing_categories array<string>")
    assert writers.write_query_configs(q, f"file://{tmp_path}/q") == 2
    assert rows(readers.search_queries(spark, f"file://{tmp_path}/q").select("query_id", "keyword", "filing_categories")) == [("q1", "nps", ["10-K"]), ("q2", "", [])]


def test_labelling_beyond_one_sheet(spark, tmp_path):
    """More windows than one sheet holds go into several, none twice and none left out; a later run replaces them."""
    import zipfile

    w = spark.range(40).select(F.format_string("f%02d.json", "id").alias("file"), F.lit(0).alias("record_no"), F.array(*[F.struct(F.lit(t).alias("context"), F.lit(None).alias("empty")) for t in ("é & <x>", "y")]).alias("context"))
    folder, schema = tmp_path / "l", "context_id string, context string, label int"
    want = sorted((f"f{k:02d}__r0__c{j}", t, None) for k in range(40) for j, t in enumerate(("é & <x>", "y")))
    assert writers.labelling(w, f"file://{folder}", 7) == 80
    sheets = sorted(p.name for p in folder.glob("labels*"))
    assert len(sheets) >= 12 and sheets[0] == "labels-00001.xlsx"
    for name in sheets:
        with zipfile.ZipFile(folder / name) as z:
            assert z.testzip() is None and z.comment == b"\n" and z.getinfo("xl/worksheets/sheet1.xml").compress_type == zipfile.ZIP_DEFLATED
        assert 1 < len(list(workbook.rows_of((folder / name).read_bytes()))) <= 8
    assert rows(workbook.read(spark, f"file://{folder}/labels*.xlsx", schema)) == want
    assert sorted(json.loads(x)["context_id"] for p in folder.glob("contexts*.jsonl") for x in p.read_text().splitlines()) == [r[0] for r in want]
    assert writers.labelling(w.limit(1), f"file://{folder}") == 2
    assert writers.labelling(w.limit(0), f"file://{tmp_path}/none") == 0
    assert sorted(p.name for p in folder.glob("[a-z]*")) == ["contexts.jsonl", "labels.xlsx"]
    assert [r[0] for r in rows(workbook.read(spark, f"file://{folder}/*.xlsx", schema))] == ["f00__r0__c0", "f00__r0__c1"]
    assert workbook.read(spark, f"file://{tmp_path}/none/labels.xlsx", schema).count() == 0
    assert list(workbook.rows_of((tmp_path / "none" / "labels.xlsx").read_bytes())) == [["context_id", "label", "notes", "context"]]


def test_a_sheet_is_full_by_its_characters_too(spark, tmp_path):
    long = spark.range(10).coalesce(1).select(F.repeat(F.lit("x"), 1_000).alias("t"), F.when(F.col("id") > 0, F.col("id").cast("int")).alias("n"))
    assert workbook.write_all(long, f"file://{tmp_path}", "w", chars=3_000) == 4
    assert rows(workbook.read(spark, f"file://{tmp_path}/w-*.xlsx", "t string, n int")) == [("x" * 1_000, k) for k in range(1, 10)] + [("x" * 1_000, None)]
