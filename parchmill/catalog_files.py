"""Queries of sources and sinks: what a writer writes, a reader reads back; the SQL says what must come out.

Every query writes whole tables into a folder of its own in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import THRESHOLDS, query
from .operators import aggregates, joins, metrics
from .plans import process
from .session import scratch, table
from .sources import readers, workbook, writers


def _raw(spark, d):
    return table(spark, d, "raw_records").select("metadata", "core_text", "url")


@query("SELECT metadata.filing.id AS id, metadata.keyword AS keyword, CAST(count(*) AS BIGINT) AS records, CAST(sum(length(core_text)) AS BIGINT) AS chars, CAST(count(url) AS BIGINT) AS urls, CAST(sum(len(metadata.filing.ciks)) AS BIGINT) AS ciks FROM raw_records GROUP BY ALL")
def raw_record_files(spark, d):
    """Raw records as JSON files, read back by an explicit schema."""
    path = scratch(spark, "raw")
    writers.write_raw(_raw(spark, d), path)
    back = readers.read_json(spark, path, readers.RAW_RECORD, multi_line=False, recursive=True)
    return back.groupBy(F.col("metadata.filing.id").alias("id"), F.col("metadata.keyword").alias("keyword")).agg(F.count("*").alias("records"), F.sum(F.length("core_text")).alias("chars"), F.count("url").alias("urls"), F.sum(F.when(F.col("metadata.filing.ciks").isNotNull(), F.size("metadata.filing.ciks"))).alias("ciks"))


def _nested(spark, d):
    w = table(spark, d, "context_windows").filter("id IS NOT NULL")
    one = F.struct("matched_phrase", "context", "hit_sentence_index", "context_start_index", "context_end_index", "char_cutoff_applied", F.nanvl("similarity_score", F.lit(None).cast("double")).alias("similarity_score"))
    windows = w.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hit_sentence_index", "window_id", one.alias("w")))).alias("x"))
    f = table(spark, d, "filings").select("id", "display_names", "url")
    rows = windows.join(f, "id").select(F.struct(F.struct("id", "display_names").alias("filing"), F.lit(None).cast("string").alias("keyword")).alias("metadata"), "url", F.col("x.w").alias("context"), F.lit("accepted").alias("status"))
    return rows.withColumn("core_text", F.lit("left out"))


@query("""SELECT f.id, CASE WHEN display_names[1] IS NULL THEN 'Unknown' WHEN instr(display_names[1], ' (') > 0 THEN trim(left(display_names[1], instr(display_names[1], ' (') - 1)) ELSE trim(display_names[1]) END AS company,
  CAST(count(*) AS BIGINT) AS windows, CAST(sum(hit_sentence_index) AS BIGINT) AS hits, CAST(count(CASE WHEN isnan(similarity_score) THEN NULL ELSE similarity_score END) AS BIGINT) AS scored, CAST(sum(length(context)) AS BIGINT) AS chars FROM filings f JOIN context_windows w ON f.id = w.id GROUP BY ALL""")
def processed_record_files(spark, d):
    """Processed records as JSON by version and status, read back and flattened to one row per window."""
    path = scratch(spark, "processed")
    writers.write_processed(_nested(spark, d), path, "v1")
    flat = readers.processed_windows(spark, f"{path}/version=v1/status=accepted", lines=True)
    return flat.groupBy("id", "company").agg(F.count("*").alias("windows"), F.sum("hit_sentence_index").alias("hits"), F.count("similarity_score").alias("scored"), F.sum(F.length("context")).alias("chars"))


@query("SELECT f.id AS filing_id, bool_or(w.id IS NOT NULL) AS project_relevant FROM filings f LEFT JOIN context_windows w ON f.id = w.id GROUP BY f.id")
def relevance_of_filings(spark, d):
    have = table(spark, d, "context_windows").filter("id IS NOT NULL").groupBy("id").agg(F.collect_list("window_id").alias("context"))  # the windows of one filing are one record
    rows = table(spark, d, "filings").select("id").join(have, "id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<long>")))
    return writers.relevance(rows)


@query("SELECT id AS filing_id, experiment_version AS version, CAST(count(*) AS BIGINT) AS n FROM (SELECT filing_id AS id, experiment_version FROM classifications) GROUP BY ALL")
def classified_record_files(spark, d):
    path = scratch(spark, "classified")
    for v in sorted(r[0] for r in table(spark, d, "classifications").select("experiment_version").distinct().collect()):  # versions of experiments are few
        writers.write_classified(table(spark, d, "classifications").filter(F.col("experiment_version") == v).drop("experiment_version"), f"{path}/{v}", v)
    return spark.read.option("recursiveFileLookup", True).json(path, schema="filing_id string, id long").withColumn("version", F.regexp_extract("_metadata.file_path", r"version=([^/]+)", 1)).groupBy("filing_id", "version").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN ticker IS NULL THEN NULL WHEN len(ticker) = 0 THEN '[]' ELSE '[''' || array_to_string(ticker, ''', ''') || ''']' END AS ticker, nullif(form, '') AS form, file_date, project_relevant FROM filings")
def csv_files(spark, d):
    """Filings as CSV with arrays as text, read back with types."""
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, d, "filings").select("id", "ticker", "form", "file_date", "project_relevant"), path)
    return readers.csv_rows(spark, path, "id string, ticker string, form string, file_date date, project_relevant boolean").withColumn("form", F.nullif("form", F.lit("")))


_GRID = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id AS reference, e AS f FROM v ORDER BY vec_id LIMIT 2),
s AS (SELECT reference, vec_id, label, round(list_cosine_similarity(e, f), 6) AS score FROM v CROSS JOIN r),
g AS (SELECT reference, t AS threshold, CAST(count(*) FILTER (score >= t AND label = 5) AS BIGINT) AS "TP", CAST(count(*) FILTER (score >= t AND label <> 5) AS BIGINT) AS "FP", CAST(count(*) FILTER (score < t AND label = 5) AS BIGINT) AS "FN",
  CAST(count(*) FILTER (score < t AND label <> 5) AS BIGINT) AS "TN" FROM s CROSS JOIN (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2, 0.3])::DOUBLE AS t) GROUP BY ALL)"""


def _grid_scores(spark, d):
    from .functions import vectors

    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(2).collect()  # two vectors
    scores = F.array(*[F.struct(F.lit(r["vec_id"]).alias("reference"), F.round(vectors.cosine("embedding", r["embedding"]), 6).alias("score")) for r in first])
    return e.select("vec_id", "label", F.explode(scores).alias("s")).select("vec_id", "label", "s.*")


def _metric_files(spark, d):
    path = scratch(spark, "metrics")
    scores = _grid_scores(spark, d)
    for r in sorted(x[0] for x in scores.select("reference").distinct().collect()):  # two references
        sweep = metrics.threshold_sweep(scores.filter(F.col("reference") == r), "score", F.col("label") == 5, THRESHOLDS)
        named = sweep.select("threshold", *[F.col(c).alias(c.upper()) for c in ("tp", "fp", "fn", "tn")], "precision", "recall", F.col("f1").alias("F1"), F.lit(1.5).alias("embedding_seconds_total"), F.lit(0.25).alias("embedding_ms_per_context"))
        writers.write_named(named, path, f"scores_dense__V{r}_metrics.csv")
    writers.write_named(spark.createDataFrame([("other",)], "a string"), path, "notes.csv")
    return readers.metric_files(spark, path)


@query(f"WITH {_GRID} SELECT 'dense' AS model, 'V' || reference AS reference, threshold, \"TP\", \"FP\", \"FN\", \"TN\", round(coalesce(\"TP\" / nullif(\"TP\" + \"FP\", 0), 0), 6) AS precision, round(coalesce(\"TP\" / nullif(\"TP\" + \"FN\", 0), 0), 6) AS recall FROM g")
def metric_files(spark, d):
    """Threshold sweeps in files whose names say model and reference; other files are passed over."""
    return _metric_files(spark, d).select("model", "reference", "threshold", "TP", "FP", "FN", "TN", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_GRID}, f AS (SELECT 'V' || reference AS reference, threshold, round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 6) AS f1 FROM g), b AS (SELECT reference, max(f1) AS f1 FROM f GROUP BY reference)
SELECT 'dense' AS model, max(f1) FILTER (reference = 'V' || (SELECT min(reference) FROM r)) AS first, max(f1) FILTER (reference = 'V' || (SELECT max(reference) FROM r)) AS second FROM b""")
def best_f1_pivot(spark, d):
    """Best F1 of each model and reference from metric files, as a pivot."""
    best = metrics.best_threshold(_metric_files(spark, d).select("model", "reference", "threshold", F.round("F1", 6).alias("f1")), ["model", "reference"])
    names = sorted((r[0] for r in best.select("reference").distinct().collect()), key=lambda n: int(n[1:]))  # two references
    return aggregates.pivot_best(best, "model", "reference", names, "f1").toDF("model", "first", "second")


@query("SELECT CAST(vec_id AS VARCHAR) AS context_id, label, 'dense' AS model, 'V0' AS reference_text_id FROM embeddings")
def score_line_files(spark, d):
    """Scores as JSON lines, the run's settings on the first line only; read back and filled."""
    path = scratch(spark, "scores")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("context_id"), F.col("label").cast("double").alias("similarity_score"))
    first = rows.orderBy("context_id").limit(1).withColumns({"model": F.lit("dense"), "reference_text_id": F.lit("V0")})
    rest = rows.join(first.select("context_id"), "context_id", "left_anti").withColumns({"model": F.lit(None).cast("string"), "reference_text_id": F.lit(None).cast("string")})
    writers.write_named(first.unionByName(rest), path, "scores_a.jsonl", "json")
    return readers.scores(spark, path).select("context_id", F.col("similarity_score").cast("int").alias("label"), "model", "reference_text_id")


_LABELS = "l AS (SELECT window_id AS k, max_by(CAST(hit_sentence_index % 2 AS INT), processed_at) AS label FROM context_windows WHERE hit_sentence_index % 3 <> 0 GROUP BY 1), s AS (SELECT window_id AS k, max_by({'v': CASE WHEN isnan(similarity_score) THEN NULL ELSE similarity_score END}, processed_at).v AS score FROM context_windows WHERE hit_sentence_index % 5 <> 0 GROUP BY 1)"


def _labelled(spark, d):
    w = table(spark, d, "context_windows").withColumn("s", F.nanvl("similarity_score", F.lit(None).cast("double")))
    last = w.groupBy(F.col("window_id").alias("k")).agg(F.max_by("hit_sentence_index", "processed_at").alias("h"), F.max_by("s", "processed_at").alias("score"))
    path = scratch(spark, "labels")
    given = last.filter("h % 3 <> 0").select(F.col("k").cast("string").alias("context_id"), F.concat(F.lit(" "), (F.col("h") % 2).cast("string")).alias("label"))
    writers.write_csv(given.unionByName(spark.createDataFrame([("x", "maybe"), (None, "1")], "context_id string, label string")), path)
    labels = readers.labels(readers.csv_rows(spark, path, "context_id string, label string"))
    return labels, last.filter("h % 5 <> 0").select(F.col("k").cast("string").alias("context_id"), "score")


@query(f"WITH {_LABELS} SELECT CAST(count(*) FILTER (l.k IS NOT NULL AND s.k IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (s.k IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (l.k IS NULL) AS BIGINT) AS right_only FROM l FULL JOIN s ON l.k = s.k")
def labels_and_scores_matched(spark, d):
    labels, scores = _labelled(spark, d)
    return joins.match_counts(labels, scores, "context_id")


@query(f"""WITH {_LABELS}, j AS (SELECT label, score FROM l JOIN s ON l.k = s.k), t AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold)
SELECT threshold, CAST(count(*) FILTER (coalesce(score >= threshold, FALSE) AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (coalesce(score >= threshold, FALSE) AND label <> 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (NOT coalesce(score >= threshold, FALSE) AND label = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT coalesce(score >= threshold, FALSE) AND label <> 1) AS BIGINT) AS tn FROM j CROSS JOIN t GROUP BY threshold""")
def labels_against_scores(spark, d):
    """Labels from a sheet joined with scores, and their confusion counts at thresholds."""
    labels, scores = _labelled(spark, d)
    return metrics.threshold_sweep(labels.join(scores, "context_id"), "score", F.col("label") == 1, [0.25, 0.5, 0.75]).select("threshold", "tp", "fp", "fn", "tn")


@query(f"WITH {_LABELS}, j AS (SELECT label, score FROM l JOIN s ON l.k = s.k WHERE score BETWEEN 0 AND 1) SELECT label, CAST(least(floor(score * 40), 39) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY ALL")
def scores_by_label(spark, d):
    labels, scores = _labelled(spark, d)
    return aggregates.histogram(labels.join(scores, "context_id"), "score", 40, 0.0, 1.0, ["label"])


@query("""SELECT id, array_to_string(list_sort(list_distinct(flatten(list_transform(coalesce(display_names, []), lambda n: list_filter(list_transform(string_split(regexp_extract(n, '\\(([A-Z,\\s-]+)\\)\\s+\\(CIK', 1), ','), lambda x: trim(x)), lambda x: x <> ''))))), '|') AS ticker,
  lower(regexp_extract(substr(id, instr(id, ':') + 1), '\\.([^./\\\\]+)$', 1)) AS container, form FROM filings""")
def search_pages(spark, d):
    """Filings as pages of a search API, a hundred hits each, read back as filings."""
    path = scratch(spark, "pages")
    f = table(spark, d, "filings")
    source = F.struct("ciks", F.col("period_ending").cast("string").alias("period_ending"), "display_names", "root_forms", F.col("file_date").cast("string").alias("file_date"), "form", "adsh", "film_num", "file_type", "file_description")
    hits = f.select(F.pmod(F.xxhash64("id"), F.lit(64)).alias("page"), F.struct(F.col("id").alias("_id"), F.lit("i").alias("_index"), source.alias("_source")).alias("hit"))
    pages = hits.groupBy("page").agg(F.struct(F.struct(F.count("*").alias("value")).alias("total"), F.collect_list("hit").alias("hits")).alias("hits")).withColumn("query", F.struct(F.lit(100).alias("size")))
    pages.select("query", "hits").write.json(path)
    found = readers.search_hits(readers.read_json(spark, path, readers.SEARCH_PAGE, multi_line=False))
    return found.select("id", F.array_join(F.array_sort("ticker"), "|").alias("ticker"), F.col("file_container_type").alias("container"), "form")


@query("SELECT 'q' || n_nationkey AS query_id, n_name AS keyword, '' AS query_base, '' AS from_date, CAST(0 AS INT) AS categories, n_regionkey AS filing_limit FROM nation")
def search_query_configs(spark, d):
    """Search queries written as config files, one per region, and read back with their defaults."""
    path = scratch(spark, "configs")
    n = table(spark, d, "nation")
    queries = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")), F.struct(F.col("n_name").alias("keyword"), F.col("n_regionkey").alias("filing_limit"))))).alias("queries"))
    for r in sorted(x[0] for x in queries.select("n_regionkey").collect()):  # five regions
        writers.write_named(queries.filter(F.col("n_regionkey") == r).select("queries"), path, f"{r}.json", "json")
    writers.write_named(spark.createDataFrame([("{broken",)], "value string"), path, "broken.json", "text")
    return readers.search_queries(spark, path).select("query_id", "keyword", "query_base", "from_date", F.size("filing_categories").alias("categories"), "filing_limit")


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, 'T' || s_nationkey AS ticker, s_name AS title FROM supplier")
def ticker_file(spark, d):
    """A ticker dimension kept as one JSON object, read back by padded key."""
    path = scratch(spark, "tickers")
    s = table(spark, d, "supplier").select(F.struct(F.row_number().over(_by("s_suppkey")).cast("string").alias("k"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("ticker"), F.col("s_name").alias("title")).alias("v")).alias("e"))
    whole = s.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))  # one file by its format: a dimension
    writers.write_named(whole, path, "tickers.json", "text")
    return readers.ticker_dimension(spark, f"{path}/tickers.json")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # a dimension


@query("""SELECT c.c_custkey, s.s_suppkey AS suppkey FROM customer c LEFT JOIN (SELECT lower(s_name) AS n, max(s_suppkey) AS s_suppkey FROM (SELECT replace(s_name, 'Supplier', 'Customer') AS s_name, s_suppkey FROM supplier) GROUP BY 1) s ON lower(c.c_name) = s.n""")
def ticker_lookup(spark, d):
    """A dimension looked up by name in any case, the last row of a name counting."""
    dimension = table(spark, d, "supplier").select(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name"), F.col("s_suppkey").alias("suppkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return joins.lookup_ignoring_case(c, dimension, "c_name", "name", "suppkey").select("c_custkey", "suppkey")


@query("SELECT CASE n_regionkey WHEN 0 THEN 'html' WHEN 1 THEN 'txt' WHEN 2 THEN 'xml' WHEN 3 THEN 'pdf' ELSE 'zip' END AS container, CASE WHEN n_regionkey < 3 THEN 'Text of ' || n_name END AS text, CASE n_regionkey WHEN 4 THEN 'unknown container type zip' END AS problem FROM nation")
def documents_by_container(spark, d):
    """Documents read by container type; a type that nothing reads says so (PDF needs the optional reader)."""
    path = scratch(spark, "documents")
    kinds = {0: "html", 1: "txt", 2: "xml", 3: "pdf", 4: "zip"}
    for r in table(spark, d, "nation").collect():  # 25 rows
        writers.write_named(spark.createDataFrame([(f"Text of {r['n_name']}",)], "value string"), path, f"{r['n_nationkey']}.{kinds[r['n_regionkey']]}", "text")
    found = readers.documents(spark, path)
    return found.select("container", F.rtrim(F.regexp_replace("text", "\n$", "")).alias("text"), F.when(F.col("container") != "pdf", F.col("problem")).alias("problem"))


@query("SELECT o_orderstatus AS model_name, 'priority' AS task, o_orderpriority AS label, 'True' AS class, 'support' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL")
def evaluation_files(spark, d):
    """Evaluation reports of models as JSON in folders, read back in long form; some folders are passed over."""
    path = scratch(spark, "evaluations")
    per = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    report = F.create_map(F.lit("True"), F.create_map(F.lit("support"), F.col("n").cast("double")))
    labels = per.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", report))).alias("l"))
    files = labels.select(F.lit("x").alias("class_name"), F.col("o_orderstatus").alias("model_name"), F.create_map(F.lit("priority"), "l").alias("evaluation_results"))
    for r in sorted(x[0] for x in files.select("model_name").collect()):  # models are few
        writers.write_named(files.filter(F.col("model_name") == r), f"{path}/run_{r}", "report.json", "json")
    writers.write_named(files.limit(1), f"{path}/graphics", "skipped.json", "json")
    return readers.evaluations(spark, path).select("model_name", "task", "label", "class", "metric", "value")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def workbook_rows(spark, d):
    """A table as a workbook and back (values as text, cast by the reader's schema)."""
    path = scratch(spark, "workbook")
    workbook.write(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{path}/suppliers.xlsx")
    return workbook.read(spark, f"{path}/*.xlsx", "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT w.window_id AS context_key, id || '__r' || 0 || '__c' || 0 AS context_id FROM context_windows w WHERE id IS NOT NULL")
def context_ids(spark, d):
    """Stable ids of the windows of records: stem, record and place."""
    w = table(spark, d, "context_windows").filter("id IS NOT NULL").select(F.concat("id", F.lit(".json")).alias("file"), F.lit(0).alias("record_no"), F.array(F.struct("window_id")).alias("context"))
    return writers.context_ids(w).select(F.col("window.window_id").alias("context_key"), "context_id")


@query("SELECT form, project_relevant, CAST(count(*) AS BIGINT) AS n FROM filings WHERE coalesce(project_relevant, FALSE) AND len(keywords) = 1 AND keywords[1] IN ('nps', '\"nps\"') GROUP BY ALL")
def export_by_keyword(spark, d):
    """The export by relevance and keyword: filings whose only keyword is the wanted one."""
    path = scratch(spark, "export")
    process.export_selected(table(spark, d, "filings").select("id", "ticker", "keywords", "form", "project_relevant"), path, relevant=True, keyword="nps", strict=True)
    return readers.csv_rows(spark, path, "id string, ticker string, keywords string, form string, project_relevant boolean").withColumn("form", F.nullif("form", F.lit(""))).groupBy("form", "project_relevant").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(DISTINCT l_returnflag || l_linestatus) AS BIGINT) AS files FROM lineitem")
def files_counted(spark, d):
    """How many files a copied selection has."""
    path, copies = scratch(spark, "files"), scratch(spark, "copies")
    kinds = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    for r in kinds.collect():  # a handful of kinds
        writers.write_named(kinds.filter((F.col("l_returnflag") == r[0]) & (F.col("l_linestatus") == r[1])), path, f"{r[0]}{r[1]}.csv")
    writers.copy_files(spark.read.text(path).select(F.col("_metadata.file_path").alias("path")), copies)
    return writers.count_files(spark.read.text(copies))


@query("SELECT CAST(count(*) AS BIGINT) AS items, array_to_string(list_sort(list_distinct(list(metadata.keyword) FILTER (metadata.keyword IS NOT NULL))), '|') AS keywords, CAST(count(*) FILTER (metadata.filing.file_container_type = 'htm') AS BIGINT) AS htm FROM raw_records")
def crawl_report(spark, d):
    """The report of a crawl: items, keywords, container types, written as one JSON line and read back."""
    path = scratch(spark, "report")
    r = table(spark, d, "raw_records").select(F.col("metadata.keyword").alias("keyword"), F.col("metadata.filing.file_container_type").alias("container"))
    writers.write_summary(aggregates.crawl_statistics(r, "keyword", "container"), path)
    back = spark.read.json(path, schema="items long, keywords array<string>, containers map<string,long>")
    return back.select("items", F.array_join("keywords", "|").alias("keywords"), F.coalesce(F.try_element_at("containers", F.lit("htm")), F.lit(0).cast("long")).alias("htm"))


@query("SELECT n_name AS link, CAST(n_nationkey AS INT) AS position FROM nation")
def page_links(spark, d):
    """Absolute links of a page in the order of their first place; other schemes and repeats are left out."""
    from .functions import html

    n = table(spark, d, "nation")
    page = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<p><a href='"), F.url_encode(x["n_name"]), F.lit("'>x</a><a href='mailto:q'>m</a>"))), "").alias("h"))
    twice = page.select(F.lit(1).alias("k"), F.concat("h", "h").alias("h"), F.lit("https://h.example/d/").alias("base"))
    return html.links(twice, "k", "h", "base").select(F.replace(F.url_decode(F.replace("link", F.lit("https://h.example/d/"), F.lit(""))), F.lit("+"), F.lit(" ")).alias("link"), "position")


@query("SELECT o_orderkey, o_orderpriority AS form, CAST(o_totalprice AS DOUBLE) AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def parallel_arrays(spark, d):
    """Parallel arrays of submissions as rows of the wanted forms."""
    o = table(spark, d, "orders")
    packed = o.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_totalprice")).alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_orderpriority").alias("form"), F.col("x.o_totalprice").alias("value"))
    return readers.company_submissions(packed, ["1-URGENT", "5-LOW"], ["o_orderkey", "form", "value"]).select("o_orderkey", "form", "value")


@query("SELECT record_id FROM raw_records WHERE contains(lower(core_text), 'net promoter') OR contains(lower(core_text), 'nps')")
def documents_with_keywords(spark, d):
    return readers.keyword_documents(table(spark, d, "raw_records"), "core_text", ["Net Promoter", "NPS"]).select("record_id")


@query("SELECT record_id, coalesce(metadata.keyword, metadata.filing.keyword) AS keyword FROM raw_records")
def aliased_fields(spark, d):
    """A field that records keep in one of several places."""
    r = table(spark, d, "raw_records")
    return r.select("record_id", readers.nested_lookup(r, "keyword", "metadata.keyword", "metadata.filing.keyword", "metadata.none.keyword").alias("keyword"))


@query("SELECT 'q' || n_nationkey AS query_id, n_name AS keyword, 'form-cat' || (n_regionkey + 1) AS filing_category, '' AS from_date FROM nation")
def query_config_sink(spark, d):
    """Search queries saved as files of their own, and read back."""
    path = scratch(spark, "queries")
    n = table(spark, d, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("query_id"), F.col("n_name").alias("keyword"), F.concat(F.lit("form-cat"), (F.col("n_regionkey") + 1).cast("string")).alias("filing_category"))
    writers.write_query_configs(n, path)
    return readers.search_queries(spark, path).select("query_id", "keyword", "filing_category", "from_date")


@query("SELECT s_name || '__r' || s_nationkey || '__c' || k AS context_id, CASE WHEN k = 0 THEN 'first' ELSE 'second' END AS context, CAST(NULL AS INT) AS label FROM supplier, (SELECT unnest(range(2)) AS k)")
def labelling_sheet(spark, d):
    """Windows exported for labelling with stable ids, as JSON lines and as sheets; the sheets are read back."""
    path = scratch(spark, "labelling")
    w = table(spark, d, "supplier").select(F.concat("s_name", F.lit(".json")).alias("file"), F.col("s_nationkey").alias("record_no"), F.array(F.struct(F.lit("first").alias("context")), F.struct(F.lit("second").alias("context"))).alias("context"))
    writers.labelling(w, path)
    return workbook.read(spark, f"{path}/labels*.xlsx", "context_id string, context string, label int")


@query("SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_custkey, CAST(floor(c_acctbal / 1000 + 1e-9) AS INT) AS bucket, row_number() OVER (PARTITION BY CAST(floor(c_acctbal / 1000 + 1e-9) AS INT) ORDER BY c_custkey) AS r FROM customer WHERE CAST(floor(c_acctbal / 1000 + 1e-9) AS INT) < (SELECT ceil(max(c_acctbal) / 1000 - 1e-9) FROM customer)) WHERE r <= 3 GROUP BY bucket")
def sample_sheet(spark, d):
    """A sample by buckets kept as a sheet: how many rows of each bucket it has."""
    from .operators import sampling

    path = scratch(spark, "sample")
    workbook.write(sampling.bucket_sample(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 3, 1000.0), f"{path}/sample.xlsx")
    return workbook.read(spark, f"{path}/sample.xlsx", "bucket int, c_custkey long").groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS folder, 2 AS files FROM orders GROUP BY ALL")
def experiment_folders(spark, d):
    """The runs of an experiment folder with their numbers of files."""
    path = scratch(spark, "runs")
    per = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    for r in per.collect():  # a handful of runs
        for name in ("scores.csv", "report.csv"):
            writers.write_named(per.filter(F.col("o_orderstatus") == r[0]), f"{path}/{r[0]}", name)
    return readers.experiments(spark, path).select("folder", F.col("files").cast("int").alias("files"))


@query("SELECT id, CASE WHEN lower(form) = '10-k' THEN 'form-cat1' WHEN form = '8-K' THEN 'form-cat8' ELSE '' END AS code FROM filings")
def category_codes(spark, d):
    """Groups of forms by name in any case or by code; all for what is neither."""
    from .functions import strings

    given = F.when(F.lower("form") == "10-k", "all_anual_quarterly_and_current_reports").when(F.col("form") == "8-K", "form-cat8").otherwise(F.coalesce("form", F.lit("none")))
    return table(spark, d, "filings").select("id", strings.category_code(given).alias("code"))


@query("SELECT id FROM filings WHERE form IN ('10-K', '10-Q')")
def filings_of_a_category(spark, d):
    from .operators import filters

    dimension = spark.createDataFrame([("reports", "10-K"), ("reports", "10-Q"), ("current", "8-K")], "category string, form string")
    return filters.in_category(table(spark, d, "filings").select("id", "form"), dimension, "reports").select("id")
