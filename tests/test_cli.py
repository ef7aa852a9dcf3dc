import json

import pytest

from parchmill import config
from parchmill.__main__ import main, parser
from parchmill.operators import filters, metrics
from tests.conftest import rows


def test_arguments(capsys):
    with pytest.raises(SystemExit):
        parser().parse_args(["--version"])
    assert capsys.readouterr().out.strip()
    main(["list"])
    assert "context_windows" in capsys.readouterr().out


def test_process_and_classify(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    for k in range(4):
        text = f"<p>The nps score of {60 + k} rose.</p> It was calm." if k % 2 else "The nps fell today. It rained."
        (tmp_path / "raw" / f"{k}.json").write_text(json.dumps([{"metadata": {"filing": {"id": f"f{k}"}, "keyword": "nps"}, "core_text": text, "url": "u"}]))
    (tmp_path / "c.json").write_text(json.dumps({"scope": {"keywords": None}, "threshold": -1}))
    main(["process", "--records", str(tmp_path / "raw"), "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")])
    assert spark.read.parquet(str(tmp_path / "out/windows")).count() == 4
    assert spark.read.json(str(tmp_path / "out/summary")).first()["records_processed"] == 4
    assert spark.read.json(str(tmp_path / "out/records")).first()["status"] == "accepted"
    (tmp_path / "labels.csv").write_text("text,up\n" + "".join(f'"The nps score of {k} rose.",1\n"The nps fell today.",0\n' for k in range(20)))
    (tmp_path / "cat.json").write_text(json.dumps({"name": "c", "properties": [{"name": "up", "description": "rose", "type": "boolean"}]}))
    main(["classify", "--windows", str(tmp_path / "out/windows"), "--labels", str(tmp_path / "labels.csv"), "--category", str(tmp_path / "cat.json"), "--out", str(tmp_path / "cls")])
    assert rows(spark.read.parquet(str(tmp_path / "cls/filings")).select("id", "up")) == [("f0", False), ("f1", True), ("f2", False), ("f3", True)]


def test_projects(tmp_path):
    projects = config.Projects(tmp_path)
    projects.create("p", {"preprocess": "pre.json"})
    config.save_json(tmp_path / "p" / "pre.json", {"a": {"b": 1}})
    assert projects.load("p", {"preprocess": {"a": {"c": 2}}})["preprocess"] == {"a": {"b": 1, "c": 2}}
    assert projects.update("p", "preprocess", {"a": {"b": 3}}) == {"a": {"b": 3}} and projects.update("p", "crawl", {"x": 1}) == {"x": 1}
    projects.activate("p")
    assert projects.active() == "p" and projects.names() == ["p"]
    projects.activate(None)
    assert projects.active() is None
    with pytest.raises(FileExistsError):
        projects.create("p")
    with pytest.raises(FileNotFoundError):
        projects.activate("q")


def test_routes_and_roles(spark):
    df = spark.createDataFrame([("m", "All", "a", 1.0), ("m", "All", "b", 2.0), ("m", "All", "z", 9.0), ("m", "B", "b", 3.0)], "model string, task string, label string, value double")
    assert rows(metrics.route_labels(df, "All", {"A": ["a"], "B": ["b"]}).select("task", "label", "value")) == [("A", "a", 1.0), ("B", "b", 3.0)]
    ids = spark.createDataFrame([("abc1",), ("abd2",), ("x",)], "h string")
    assert rows(filters.by_prefix(ids, "h", {"abc": "one", "ab": "two"})) == [("abc1", "one"), ("abd2", "two")]
