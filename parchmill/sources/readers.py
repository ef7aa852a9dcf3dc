"""Readers: semi-structured files with explicit schemas, never inferred ones, so one pass reads everything."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings
from ..schemas import EVALUATION, PROCESSED_RECORD, RAW_RECORD, SCORE, SEARCH_CONFIG, SEARCH_PAGE

#: How the text of each container type is read.
CONTAINERS = {"html": "text", "htm": "text", "txt": "text", "xml": "text", "pdf": "binary"}


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """Records of JSON files (arrays or objects) with their ``file`` and ``path``; files or lines that aren't JSON give no rows.

    The parser sees the whole text, so a plan that needs no field of a record still tells broken files from good ones.
    """
    reader = spark.read.option("wholetext", multi_line).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    texts = reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")
    return texts.select("file", "path", "modified_at", F.explode(F.from_json("value", T.ArrayType(schema))).alias("__r")).filter(F.col("__r").isNotNull()).select("__r.*", "file", "path", "modified_at")


def search_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, settings…, created_at): search queries of a config folder; missing texts are empty, missing lists empty."""
    if "://" not in path and not Path(path).exists():
        Path(path).mkdir(parents=True)
    rows = read_json(spark, path, SEARCH_CONFIG, pattern="*").withColumnRenamed("modified_at", "created_at")
    parts = rows.select("file", "created_at", F.explode("queries").alias("query_id", "q")).select("query_id", "q.*", "file", "created_at")
    texts = {f.name: F.coalesce(f.name, F.lit("")) for f in parts.schema if isinstance(f.dataType, T.StringType) and f.name not in ("query_id", "file")}
    lists = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in parts.schema if isinstance(f.dataType, T.ArrayType)}
    return parts.withColumns(texts | lists)


def search_hits(pages: DataFrame, limit: int = -1) -> DataFrame:
    """Filings of saved search pages, in page order; a limit of -1 or less keeps all."""
    hits = pages.select("file", F.posexplode("hits.hits").alias("position", "hit"))
    rows = hits.select(
        "file", "position", F.col("hit._id").alias("id"), F.col("hit._source.*"), strings.file_of_id("hit._id").alias("file_path_name"),
        F.array_distinct(F.flatten(F.transform("hit._source.display_names", strings.ticker_list))).alias("ticker"), strings.extension(strings.file_of_id("hit._id")).alias("file_container_type"),
    )
    return rows.orderBy("file", "position").limit(limit) if limit >= 0 else rows


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SEARCH_PAGE)


def raw_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Raw records of JSON files; ``lines`` reads one record per line, as the writers here write them."""
    return read_json(spark, path, RAW_RECORD, not lines)


def processed_windows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per context window of processed records; records without windows give none."""
    rows = read_json(spark, path, PROCESSED_RECORD, not lines)
    first = F.col("metadata.filing.display_names")[0]
    return rows.select("file", "metadata.filing.id", strings.company(first).alias("company"), strings.first_ticker(first).alias("ticker"), "url", F.posexplode("context").alias("position", "w")).select("file", "id", "company", "ticker", "url", "position", "w.*")


def ticker_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(cik, ticker, title) of a ticker file, one row per padded cik: its last ticker."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("cik_str", T.LongType()), T.StructField("ticker", T.StringType()), T.StructField("title", T.StringType())]))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("place", "t"))
    keyed = rows.select(strings.padded_key("t.cik_str").alias("cik"), "t.ticker", "t.title", F.col("place").cast("long").alias("place"))
    return keyed.groupBy("cik").agg(F.max(F.struct("place", "ticker", "title")).alias("t")).select("cik", "t.ticker", "t.title")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, container, text, problem): the text of documents by container type; other types say so in ``problem``.

    PDF pages are joined by line ends; without the optional reader ``problem`` says so.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = strings.extension("path")

    @F.pandas_udf("text string, problem string")
    def pdf(contents: pd.Series) -> pd.DataFrame:
        import io

        try:
            from pypdf import PdfReader
        except ImportError:
            return pd.DataFrame({"text": [None] * len(contents), "problem": ["no PDF reader"] * len(contents)})

        def of(content):
            try:
                return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages), None
            except Exception as problem:  # noqa: BLE001 - a broken file is a row, not a failed job
                return None, f"unreadable: {type(problem).__name__}"

        return pd.DataFrame([of(c) for c in contents], columns=["text", "problem"])

    texts = files.filter(kind.isin([k for k, v in CONTAINERS.items() if v == "text"])).select("path", kind.alias("container"), F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("problem"))
    pdfs = files.filter(kind == "pdf").select("path", kind.alias("container"), pdf("content").alias("p")).select("path", "container", "p.text", "p.problem")
    other = files.filter(~kind.isin(list(CONTAINERS))).select("path", kind.alias("container"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("unknown container type "), kind).alias("problem"))
    return texts.unionByName(pdfs).unionByName(other)


def table_rows(spark: SparkSession, name_or_path: str, limit: int | None = None, **jdbc: str) -> DataFrame:
    """A stored table: JDBC if options are given, else parquet or a catalogue table."""
    if jdbc:
        rows = spark.read.format("jdbc").options(dbtable=name_or_path, **jdbc).load()
    elif spark.catalog.tableExists(name_or_path) if "/" not in name_or_path else False:
        rows = spark.table(name_or_path)
    else:
        rows = spark.read.parquet(name_or_path)
    return rows if limit is None else rows.limit(limit)


def table_columns(spark: SparkSession, name: str) -> list[str]:
    """Columns of a catalogue table; an empty list if there is no such table."""
    return [c.name for c in spark.catalog.listColumns(name)] if spark.catalog.tableExists(name) else []


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header, quoted line ends and doubled quotes."""
    return spark.read.csv(path.replace("\\", "/"), header=True, multiLine=True, quote='"', escape='"', schema=schema)


def labels(rows: DataFrame, key: str = "context_id", label: str = "label") -> DataFrame:
    """(key, label) of labelled rows: integers only, the last row of a key (by ``row_no`` if there is one)."""
    good = rows.select(key, F.trim(F.col(label).cast("string")).try_cast("int").alias("label"), *(["row_no"] if "row_no" in rows.columns else [])).filter(F.col(key).isNotNull() & F.col("label").isNotNull())
    order = F.col("row_no") if "row_no" in rows.columns else F.lit(0)
    return good.groupBy(key).agg(F.max(F.struct(order.alias("o"), "label")).alias("r")).select(key, "r.label")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Score lines; run settings that only a file's first line has are filled in for the whole file."""
    rows = read_json(spark, path, SCORE, multi_line=False, pattern="*.jsonl")
    each = Window.partitionBy("file")
    return rows.withColumns({c: F.coalesce(c, F.first(c, ignorenulls=True).over(each)) for c in ("model", "device", "reference_text_id", "reference_text")})


def metric_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of metric files named ``scores_(model)__(reference)_metrics.csv``; others are skipped."""
    schema = "threshold double, TP long, FP long, FN long, TN long, precision double, recall double, F1 double, embedding_seconds_total double, embedding_ms_per_context double"
    rows = spark.read.csv(path, header=True, schema=schema).withColumn("file", F.col("_metadata.file_name"))
    form = r"^scores_(.+)__(.+)_metrics\.csv$"
    return rows.filter(F.rlike("file", F.lit(form))).select(F.regexp_extract("file", form, 1).alias("model"), F.regexp_extract("file", form, 2).alias("reference"), *[f.split()[0] for f in schema.split(", ")])


def evaluations(spark: SparkSession, path: str, skip: tuple[str, ...] = ("graphics", "categories")) -> DataFrame:
    """(file, folder, model_name, task, label, class, metric, value): evaluation reports of a tree in long form."""
    rows = read_json(spark, path, EVALUATION, recursive=True).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    rows = rows.filter(~F.col("folder").isin(list(skip)) & (F.size("evaluation_results") > 0))
    for column, name in (("evaluation_results", "task"), ("v0", "label"), ("v1", "class")):
        depth = {"task": 0, "label": 1, "class": 2}[name]
        keep = [c for c in rows.columns if c not in (column, "kwargs", "class_name", "model_input", "path", "modified_at")]
        rows = rows.select(*keep, F.explode(column).alias(name, f"v{depth}"))
    return rows.select("file", "folder", "model_name", "task", "label", "class", F.explode(F.from_json("v2", "map<string,double>") if isinstance(rows.schema["v2"].dataType, T.StringType) else F.col("v2")).alias("metric", "value"))


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes, modified_at): the runs of an experiment folder, by its subfolders; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified_at"))


def nested_lookup(rows: DataFrame, *paths: str) -> Column:
    """The first of several fields that a record has; fields that the schema lacks are passed over."""

    def has(schema, path):
        for part in path.split("."):
            if not isinstance(schema, T.StructType) or part not in schema.names:
                return False
            schema = schema[part].dataType
        return True

    return F.coalesce(*[F.col(p) for p in paths if has(rows.schema, p)], F.lit(None))


def company_submissions(rows: DataFrame, forms: list[str], arrays: list[str], form: str = "form") -> DataFrame:
    """Parallel arrays of submissions as rows, of the wanted forms."""
    zipped = rows.select(*[c for c in rows.columns if c not in arrays], F.explode(F.arrays_zip(*arrays)).alias("s"))
    return zipped.select(*[c for c in zipped.columns if c != "s"], "s.*").filter(F.col(form).isin(forms))


def keyword_documents(rows: DataFrame, text: str, keywords: list[str], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows whose text has any keyword, in any case; the first ``limit`` by ``order``."""
    low = F.lower(F.col(text))
    some = rows.filter(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k)))
    return some if limit is None else some.orderBy(order or text).limit(limit)


def reference_grid(spark: SparkSession, models: dict[str, str], references: dict[str, str]) -> DataFrame:
    """Every model with every reference text (two small constant tables)."""
    m = spark.createDataFrame(list(models.items()), "model_id string, model string")
    r = spark.createDataFrame(list(references.items()), "reference_id string, reference_text string")
    return m.crossJoin(F.broadcast(r))
