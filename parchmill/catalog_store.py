"""Queries of the keyed store and of streams: changes go through it as they would in a run, the SQL says what must be left."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import query
from .operators import joins, store
from .session import scratch, table
from .sources import readers
from .streaming import flows

PROPERTIES = {"kpi_current_value": "boolean", "kpi_trend": "boolean", "nps_value_fix": "float"}


def _store(spark, name: str) -> store.Store:
    return store.Store(spark, scratch(spark, name), PROPERTIES)


def _main(spark, d):
    return table(spark, d, "filings").select("id", "keywords", "form", "url", "blacklisted", "project_relevant", "path_to_preprocessed")


@query("SELECT id, coalesce(url, 'none') AS url, coalesce(blacklisted, FALSE) OR form = '10-K' AS blacklisted, array_to_string(coalesce(keywords, []), '|') AS keywords, form FROM filings")
def stored_filings(spark, d):
    """Filings inserted, then changed by a second batch: flags stick, given values replace, null values don't."""
    db, f = _store(spark, "db"), _main(spark, d)
    db.upsert_filings(f)
    again = f.select("id", F.when(F.col("url").isNull(), "none").alias("url"), (F.col("form") == "10-K").alias("blacklisted"), F.lit(None).cast("array<string>").alias("keywords"))
    out = db.upsert_filings(again)
    return out.select("id", "url", "blacklisted", F.array_join("keywords", "|").alias("keywords"), "form")


@query("""WITH l AS (SELECT filing_id, arg_max(project_relevant, (processed_at, preprocessing_version)) AS relevant, arg_max(coalesce(path_to_preprocessed, ''), (processed_at, preprocessing_version)) AS path FROM preprocessing WHERE processed_at IS NOT NULL GROUP BY filing_id)
SELECT f.id, CASE WHEN l.filing_id IS NULL THEN f.project_relevant ELSE l.relevant END AS project_relevant, CASE WHEN l.filing_id IS NULL THEN coalesce(f.path_to_preprocessed, '') ELSE l.path END AS path FROM filings f LEFT JOIN l ON f.id = l.filing_id""")
def stored_preprocessing(spark, d):
    """Versioned results stored; the newest one overwrites the main row, null paths as well."""
    db = _store(spark, "db")
    db.upsert_filings(_main(spark, d))
    p = table(spark, d, "preprocessing").filter("processed_at IS NOT NULL").join(table(spark, d, "filings").select(F.col("id").alias("filing_id")), "filing_id", "left_semi")
    # the order in which a run stores results: by time, then by version
    changes = p.withColumn("seq", F.concat_ws("|", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "preprocessing_version")).drop("id", "processed_at")
    db.upsert_preprocessing(changes, "seq")
    return db.read("filings").select("id", "project_relevant", F.coalesce("path_to_preprocessed", F.lit("")).alias("path"))


@query("""WITH c AS (SELECT filing_id, experiment_version, kpi_current_value AS a, kpi_trend AS b, nps_value_fix AS v, row_number() OVER (PARTITION BY filing_id, experiment_version ORDER BY id) AS r FROM classifications), o AS (SELECT * FROM c WHERE r = 1)
SELECT filing_id, experiment_version, CASE WHEN experiment_version = 'cls_v1' THEN TRUE ELSE a END AS kpi_current_value, b AS kpi_trend, CASE WHEN isnan(v) THEN NULL ELSE v END AS nps_value_fix, CASE WHEN experiment_version = 'cls_v1' THEN 1.5::DOUBLE END AS extra FROM o""")
def stored_classifications(spark, d):
    """Versions stored side by side; a second run of one changes only what it gives and adds a column."""
    db = _store(spark, "db")
    c = store.latest(table(spark, d, "classifications"), ["filing_id", "experiment_version"], [F.asc("id")]).drop("id", "classified_at")
    db.upsert_classifications(c.withColumn("junk", F.lit(1)), allowed=["kpi_current_value", "kpi_trend", "nps_value_fix"])
    again = c.filter("experiment_version = 'cls_v1'").select("filing_id", "experiment_version", F.lit(True).alias("kpi_current_value"), F.lit(1.5).alias("extra"))
    out = db.upsert_classifications(again)
    return out.select("filing_id", "experiment_version", "kpi_current_value", "kpi_trend", F.nanvl("nps_value_fix", F.lit(None).cast("double")).alias("nps_value_fix"), "extra")


@query("SELECT id, array_to_string(list_concat(coalesce(keywords, []), CASE WHEN list_contains(coalesce(keywords, []), 'NPS!') THEN [] ELSE ['NPS!'] END), '|') AS keywords FROM filings")
def stored_keywords(spark, d):
    """A keyword appended where it is missing, however often it comes."""
    db = _store(spark, "db")
    db.upsert_filings(_main(spark, d))
    one = table(spark, d, "filings").select("id", F.lit("NPS!").alias("keyword"))
    db.add_keywords(one)
    return db.add_keywords(one.unionByName(one)).select("id", F.array_join("keywords", "|").alias("keywords"))


@query("""WITH gone AS (SELECT id FROM filings WHERE form = '8-K') SELECT 'filings' AS name, CAST(count(*) AS BIGINT) AS n FROM filings WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'classifications', CAST(count(DISTINCT (filing_id, experiment_version)) AS BIGINT) FROM classifications WHERE filing_id NOT IN (SELECT id FROM gone)""")
def stored_deletes(spark, d):
    """Filings deleted from the store with what refers to them."""
    db = _store(spark, "db")
    db.upsert_filings(_main(spark, d))
    db.upsert_classifications(table(spark, d, "classifications").drop("id", "classified_at"))
    db.delete(table(spark, d, "filings").filter("form = '8-K'").select("id"))
    counts = [db.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("filings", "classifications")]
    return counts[0].unionByName(counts[1])


@query("SELECT id, TRUE AS blacklisted FROM filings WHERE blacklisted UNION ALL SELECT 'new ' || n_name, TRUE FROM nation")
def stored_blacklist(spark, d):
    """A blacklist set on known ids and inserted for unknown ones."""
    db = _store(spark, "db")
    db.upsert_filings(_main(spark, d))
    db.blacklist(table(spark, d, "nation").select(F.concat(F.lit("new "), "n_name").alias("id")))
    return db.read("filings").filter("blacklisted").select("id", "blacklisted")


@query("SELECT experiment_version, CAST(count(*) AS BIGINT) AS n FROM classifications WHERE filing_id = (SELECT min(filing_id) FROM classifications) GROUP BY ALL")
def versions_of_a_filing(spark, d):
    db = _store(spark, "db")
    c = table(spark, d, "classifications")
    db.upsert_classifications(c.drop("id", "classified_at"))
    one = c.agg(F.min("filing_id")).first()[0]
    stored = db.versions(one).select("experiment_version")
    return c.filter(F.col("filing_id") == one).join(stored, "experiment_version", "left_semi").groupBy("experiment_version").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id = (SELECT min(id) FROM filings) THEN 'changed' ELSE url END AS url, CASE WHEN id = (SELECT min(id) FROM filings) THEN '' ELSE array_to_string(keywords, '|') END AS keywords, CAST(NULL AS BOOLEAN) AS project_relevant FROM filings")
def updated_fields(spark, d):
    """Some columns of one row set, an array emptied, and one column reset for all."""
    f = table(spark, d, "filings").select("id", "url", "keywords", "project_relevant")
    one = f.agg(F.min("id")).first()[0]
    out = store.reset_column(store.update_where(f, "id", one, {"url": "changed", "keywords": None}), "project_relevant")
    return out.withColumn("keywords", F.array_join("keywords", "|"))


@query("SELECT id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS INT) AS stars, CAST(NULL AS BOOLEAN) AS other FROM filings")
def evolved_columns(spark, d):
    return store.evolve(table(spark, d, "filings").select("id"), {"id": "float", "score": "float", "stars": "int", "other": "unknown"})


@query("SELECT CAST(count(*) FILTER (known) AS BIGINT) AS known, CAST(count(*) FILTER (NOT known) AS BIGINT) AS new FROM (SELECT metadata.filing.id IN (SELECT id FROM filings) AS known FROM raw_records WHERE metadata.filing.id IS NOT NULL)")
def new_and_known_records(spark, d):
    """Fetched records of known and of new filings, by two joins."""
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("id"), "record_id").filter("id IS NOT NULL")
    new, known = joins.new_and_known(r, table(spark, d, "filings"), "id")
    both = known.select(F.lit(True).alias("k")).unionByName(new.select(F.lit(False).alias("k")))
    return both.agg(F.count_if("k").alias("known"), F.count_if(~F.col("k")).alias("new"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def streamed_files(spark, d):
    """New files of a folder worked on once, by a stream that remembers what is done; a second run finds nothing new."""
    path, out, mark = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "mark")
    events = table(spark, d, "events")
    events.repartition(4).write.parquet(path)
    for _ in range(2):
        stream = flows.file_stream(spark, path, events.schema, files_per_batch=2)
        flows.transform_stream(stream, out, mark, lambda df: df.select("event_id", "event_type")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """Event-time windows counted by a stream with a watermark, over all files at once."""
    path, mark = scratch(spark, "in"), scratch(spark, "mark")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(path)
    counts = flows.windowed_counts(flows.file_stream(spark, path, events.schema, files_per_batch=10_000), "ts", ["event_type"], delay="1000 days")
    name = "parchmill_windows_" + path[-8:]
    counts.writeStream.format("memory").queryName(name).option("checkpointLocation", mark).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT metadata.filing.id AS id, array_to_string(list_sort(list_distinct(list(metadata.keyword))), '|') AS keywords FROM raw_records WHERE metadata.filing.id IS NOT NULL AND metadata.keyword IS NOT NULL GROUP BY 1")
def streamed_keywords(spark, d):
    """Keywords of records that come in as a stream, kept by filing in the store."""
    path, mark = scratch(spark, "in"), scratch(spark, "mark")
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("id"), F.col("metadata.keyword").alias("keyword")).filter("id IS NOT NULL AND keyword IS NOT NULL")
    r.repartition(3).write.parquet(path)
    db = _store(spark, "db")
    db.upsert_filings(r.select("id").distinct())
    flows.keyword_stream(flows.file_stream(spark, path, r.schema, files_per_batch=2), db, mark).awaitTermination()
    return db.read("filings").select("id", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


@query("SELECT metadata.filing.id AS id, arg_max(url, (crawled_at, record_id)) FILTER (url IS NOT NULL) AS url FROM raw_records WHERE metadata.filing.id IS NOT NULL AND crawled_at IS NOT NULL GROUP BY 1")
def streamed_upserts(spark, d):
    """Records that come in as a stream, merged into the store: the last given address of each filing stays."""
    path, mark = scratch(spark, "in"), scratch(spark, "mark")
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("id"), "url", "crawled_at", "record_id").filter("id IS NOT NULL AND crawled_at IS NOT NULL")
    r.write.parquet(path)
    db = _store(spark, "db")
    schema = T.StructType([r.schema[c] for c in r.columns])

    def last(batch):
        given = batch.groupBy("id").agg(F.max_by("url", F.when(F.col("url").isNotNull(), F.struct("crawled_at", "record_id"))).alias("url"))
        return given.select("id", "url")

    flows.upsert_stream(flows.file_stream(spark, path, schema, files_per_batch=10_000), db, mark, prepare=last).awaitTermination()
    return db.read("filings").select("id", "url")


@query("SELECT filing_id, CAST(count(*) AS BIGINT) AS versions FROM preprocessing GROUP BY filing_id")
def ingested_records(spark, d):
    """Records of files ingested in bulk, grouped by filing."""
    path = scratch(spark, "ingest")
    p = table(spark, d, "preprocessing").select("filing_id", "preprocessing_version", "project_relevant", "path_to_preprocessed")
    p.write.json(path)
    rows = readers.read_json(spark, path, p.schema, multi_line=False)
    return store.ingest(rows, "filing_id", ["preprocessing_version"]).select("filing_id", F.size("items").cast("long").alias("versions"))


@query("SELECT id, coalesce(len(keywords) > 0, FALSE) AS came FROM filings")
def keywords_that_came(spark, d):
    """Whether a keyword came for each filing, also one that it had already."""
    f = table(spark, d, "filings").select("id", "keywords")
    given = f.select("id", F.explode("keywords").alias("keyword"))
    return store.append_keywords(f, given, flag="came").select("id", "came")
