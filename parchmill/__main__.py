"""Command line: ``python -m parchmill VERB``.

    process  --records DIR --out DIR [--keywords PARQUET] [--config JSON] [--force]
    classify --windows PARQUET --labels CSV --category JSON --out DIR [--model NAME] [--text COLUMN] [--force]
    export   --store DIR --version NAME --out DIR [--relevant]
    query    NAME --data DIR [--out DIR]
    list
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import __version__, catalog
from .config import Category, ProcessConfig, load_json
from .models import base
from .operators.store import Store
from .plans import process
from .session import session
from .sources import readers, writers


def run_process(spark, a) -> None:
    """Raw record files to windows with scores and decisions, nested records by status, and a summary line."""
    config = ProcessConfig.of(load_json(a.config)) if a.config else ProcessConfig()
    records = readers.raw_records(spark, a.records).select(F.col("metadata.filing.id").alias("id"), "core_text").filter("id IS NOT NULL")
    keywords = spark.read.parquet(a.keywords) if a.keywords else None
    decided, excluded = process.run(records, config, keywords)
    mode = "overwrite" if a.force else "errorifexists"
    decided.write.mode(mode).parquet(f"{a.out}/windows")
    kept = spark.read.parquet(f"{a.out}/windows")
    writers.write_processed(process.nested(kept), f"{a.out}/records", config.version, a.force)
    writers.write_summary(process.summary(kept, records, excluded), f"{a.out}/summary")


def run_classify(spark, a) -> None:
    """Train a model on labelled rows, classify windows, and roll them up by filing."""
    category = Category.of(load_json(a.category))
    labelled = readers.csv_rows(spark, a.labels, ", ".join(["text string", *(f"`{p.name}` string" for p in category.properties)]))
    model = base.make(a.model, category).train(labelled, "text")
    windows = spark.read.parquet(a.windows)
    mode = "overwrite" if a.force else "errorifexists"
    process.classify(windows, [(category, model)], text=a.text).write.mode(mode).parquet(f"{a.out}/windows")
    process.roll_up(spark.read.parquet(f"{a.out}/windows"), [category]).write.mode(mode).parquet(f"{a.out}/filings")


def run_export(spark, a) -> None:
    db = Store(spark, a.store, {})
    results = db.read("classifications") if db.exists("classifications") else None
    writers.write_csv(process.export(db.read("filings"), results, a.version, a.relevant), a.out)


def run_query(spark, a) -> None:
    result = catalog.queries()[a.name](spark, a.data)
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    else:
        result.show(truncate=80)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("parchmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--master", default=None)
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("process")
    for n in ("records", "out"):
        v.add_argument(f"--{n}", required=True)
    v.add_argument("--keywords"), v.add_argument("--config"), v.add_argument("--force", action="store_true")
    v = verbs.add_parser("classify")
    for n in ("windows", "labels", "category", "out"):
        v.add_argument(f"--{n}", required=True)
    v.add_argument("--model", default="embedding_svm", choices=sorted(base.REGISTRY)), v.add_argument("--text", default="context"), v.add_argument("--force", action="store_true")
    v = verbs.add_parser("export")
    for n in ("store", "version", "out"):
        v.add_argument(f"--{n}", required=True)
    v.add_argument("--relevant", action="store_true")
    v = verbs.add_parser("query")
    v.add_argument("name"), v.add_argument("--data", required=True), v.add_argument("--out")
    verbs.add_parser("list")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.verb == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = session(a.master)
    {"process": run_process, "classify": run_classify, "export": run_export, "query": run_query}[a.verb](spark, a)


if __name__ == "__main__":
    main()
