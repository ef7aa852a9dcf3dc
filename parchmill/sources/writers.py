"""Writers of records, tables and reports. Files of one row or one table are only written where results are small."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings
from ..session import cut

#: A selection of more files than this is a table, not a folder of copies.
COPY_FILES = 10_000


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_raw(df: DataFrame, path: str, force: bool = False) -> None:
    """Raw records as JSON, partitioned by a hash of the id; ``file_name`` has the safe name (a random one without id)."""
    name = F.coalesce(strings.safe_file_name("metadata.filing.id"), F.uuid())
    df.withColumn("file_name", F.concat(name, F.lit(".json"))).withColumn("part", F.format_string("%02x", F.pmod(F.xxhash64("metadata.filing.id"), F.lit(256)))).write.mode(_mode(force)).partitionBy("part").json(path)


def write_processed(df: DataFrame, path: str, version: str, force: bool = False) -> None:
    """Processed records without their raw text, by version and status; records without windows aren't written."""
    kept = df.filter(F.size("context") > 0).drop("core_text").withColumn("version", F.lit(version))
    kept.write.mode(_mode(force)).partitionBy("version", "status").json(path)


def relevance(df: DataFrame, key: str = "id") -> DataFrame:
    """(filing_id, project_relevant): whether any record of a filing has a window."""
    return df.groupBy(F.col(key).alias("filing_id")).agg(F.bool_or(F.size("context") > 0).alias("project_relevant"))


def write_classified(df: DataFrame, path: str, version: str, force: bool = False) -> None:
    df.withColumn("version", F.lit(version)).write.mode(_mode(force)).partitionBy("version").json(path)


def write_summary(df: DataFrame, path: str, append: bool = False) -> None:
    """A one-row summary as a JSON line; appended runs stay readable line by line."""
    df.coalesce(1).write.mode("append" if append else "overwrite").json(path)


def csv_ready(df: DataFrame, by: str | None = None) -> DataFrame:
    """Arrays as text, ``['a', 'b']`` or joined by ``by``, so that CSV can hold them."""
    out: dict[str, Column] = {}
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            text = F.array_join(f.name, by) if by is not None else F.concat(F.lit("['"), F.array_join(f.name, "', '"), F.lit("']"))
            out[f.name] = F.when(F.col(f.name).isNull(), F.lit(None)).when(F.size(f.name) == 0, "" if by is not None else "[]").otherwise(text)
    return df.withColumns(out)


def write_csv(df: DataFrame, path: str, force: bool = True, single: bool = False) -> None:
    """CSV with a header; ``single`` writes one file, for small results (with its header even without rows)."""
    ready = csv_ready(df)
    (ready.coalesce(1) if single else ready).write.mode(_mode(force)).csv(path, header=True, escape='"', emptyValue="", quoteAll=False)


def write_excel(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A small result as a workbook, times without zone; more than ``most`` rows raise."""
    naive = df.withColumns({f.name: F.to_timestamp_ntz(F.col(f.name).cast("string")) for f in df.schema if isinstance(f.dataType, T.TimestampType)})
    rows = csv_ready(naive).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write CSV")
    rows.to_excel(path, index=False)
    return len(rows)


def formatted(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as text with a fixed number of digits, null stays null."""
    return df.withColumns({f.name: F.format_string(f"%.{digits}f", f.name) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table; more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write CSV")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def write_named(df: DataFrame, folder: str, name: str, form: str = "csv", **options) -> str:
    """A small result as one file of a given name (CSV with a header, JSON lines or text): written aside, then renamed."""
    spark = df.sparkSession
    aside = f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    ready = csv_ready(df) if form == "csv" else df
    ready.coalesce(1).write.options(**({"header": True, "escape": '"', "emptyValue": ""} if form == "csv" else {}) | options).format(form).save(aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(aside)) if f.getPath().getName().startswith("part-"))
    target = path(f"{folder.rstrip('/')}/{name}")
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(path(aside), True)
    return str(target)


def write_parts(df: DataFrame, folder: str, name: str, ending: str, form: str, **options) -> int:
    """A result of any size as files of a given name, written aside by tasks, then renamed; the number of files with content.

    One file is named ``name.ending``, several ``name-00001.ending`` and so on; those of an earlier run are replaced.
    Without rows there is one empty file.
    """
    spark = df.sparkSession
    folder = folder.rstrip("/")
    aside = f"{folder}/.{uuid.uuid4().hex}"
    df.write.options(**{"compression": "none"} | options).format(form).save(aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = {f.getPath().getName(): f.getLen() for f in fs.listStatus(path(aside)) if f.getPath().getName().startswith("part-")}
    full = sorted(part for part, size in made.items() if size)
    parts = full or sorted(made)[:1]
    earlier = re.compile(re.escape(name) + r"(-\d{5,})?\." + re.escape(ending))
    for f in fs.listStatus(path(folder)):
        if earlier.fullmatch(f.getPath().getName()):
            fs.delete(f.getPath(), False)
    for k, part in enumerate(parts, 1):
        fs.rename(path(f"{aside}/{part}"), path(f"{folder}/{name}.{ending}" if len(parts) == 1 else f"{folder}/{name}-{k:05d}.{ending}"))
    fs.delete(path(aside), True)
    return len(full)


def copy_files(paths: DataFrame, folder: str) -> int:
    """Copy the files that ``paths`` (path) names into a folder, by tasks; the number of files. Names must differ."""
    files = paths.select("path").distinct()
    spark = files.sparkSession
    found = [r["path"] for r in files.limit(COPY_FILES + 1).collect()]
    if len(found) > COPY_FILES:
        raise ValueError(f"more than {COPY_FILES} files: write the selected rows as a table")
    path, util = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = path(folder)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    for one in found:
        source = path(one)
        util.copy(source.getFileSystem(conf), source, fs, path(target, source.getName()), False, True, conf)
    return len(found)


def context_ids(df: DataFrame, windows: str = "context") -> DataFrame:
    """One row per window of a record with its stable id ``stem__r{i}__c{j}``; ``df`` has (file, record_no, windows)."""
    rows = df.select("*", F.posexplode(windows).alias("__j", "window")).drop(windows)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return rows.withColumn("context_id", F.format_string("%s__r%d__c%d", stem, "record_no", "__j")).drop("__j")


def write_query_configs(df: DataFrame, folder: str) -> int:
    """Search queries (query_id, settings…) as config files, one per query; the number of files."""
    settings = [c for c in df.columns if c != "query_id"]
    rows = df.select("query_id", F.to_json(F.struct(F.create_map("query_id", F.struct(*settings)).alias("queries"))).alias("value"))
    ids = [r[0] for r in rows.select("query_id").distinct().limit(COPY_FILES + 1).collect()]
    if len(ids) > COPY_FILES:
        raise ValueError(f"more than {COPY_FILES} queries")
    for one in ids:
        write_named(rows.filter(F.col("query_id") == one).select("value"), folder, f"{one}.json", "text")
    return len(ids)


def labelling(windows: DataFrame, folder: str, most: int = 100_000) -> int:
    """Windows to be labelled, with stable ids: ``contexts.jsonl`` and a sheet ``labels.xlsx`` with empty labels and notes.

    ``windows`` has (file, record_no, context: array of windows). The number of windows; more than ``most`` go into
    several files by ranges of ids, ``contexts-00001.jsonl`` and ``labels-00001.xlsx`` and so on, of at most ``most`` a sheet.
    """
    from . import workbook

    made = context_ids(windows).select("context_id", "file", "window.*")
    rows = cut(made.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in made.dtypes if kind == "void"}), "labelling")
    count = rows.count()
    # a fifth of room, as ranges are sampled
    rows = rows.repartitionByRange(-(-count * 5 // (most * 4)), "context_id") if count > most else rows.coalesce(1)
    write_parts(rows, folder, "contexts", "jsonl", "json")
    sheet = rows.select("context_id", F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("notes"), *[c for c in ("context", "matched_phrase") if c in rows.columns])
    workbook.write_all(sheet, folder, "labels", most)
    return count


def count_files(df: DataFrame) -> DataFrame:
    """(files): the number of files that a frame is read from."""
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().agg(F.count("*").alias("files"))
