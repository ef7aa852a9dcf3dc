"""All queries of the core by name over a data folder, with their SQL. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ProcessConfig, Scope
from .functions import strings, values, vectors, windows
from .functions.windows import WindowRule
from .operators import aggregates, filters, joins, metrics, sampling, store
from .plans import process
from .session import table
from .streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
RULE = WindowRule(("net promoter", "nps"), ("press release", "all rights reserved"))
CONFIG = ProcessConfig(RULE, threshold=0.5, scope=Scope(("nps", "net promoter score"), strict=False))
#: Unicode white space, as a character class for engines whose \s is ASCII only.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _all() -> None:
    from . import catalog_eval, catalog_files, catalog_models, catalog_store, catalog_text  # noqa: F401 - each registers its queries


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' sums can be compared."""
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


# --- sentences and windows -------------------------------------------------------------------------------------

_SENTENCES = f"""
sents AS (SELECT record_id, list_filter(list_transform(string_split(regexp_replace(core_text, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS s FROM raw_records WHERE core_text IS NOT NULL)"""
_WINDOWS = _SENTENCES + f""",
hits AS (SELECT record_id, s, i, p, ['net promoter', 'nps'][p + 1] AS phrase FROM (SELECT record_id, s, i, unnest([0, 1]) AS p FROM (SELECT record_id, s, unnest(range(len(s))) AS i FROM sents))
  WHERE contains(lower(s[i + 1]), ['net promoter', 'nps'][p + 1])),
framed AS (SELECT *, greatest(0, i - 2) AS a, least(len(s), i + 3) AS b FROM hits),
whole AS (SELECT *, trim(regexp_replace(array_to_string(s[a + 1:b], ' '), '{SPACE}+', ' ', 'g')) AS w FROM framed),
placed AS (SELECT *, strpos(lower(w), phrase) AS pos FROM whole),
wins AS (SELECT record_id, phrase AS matched_phrase, p, trim(right(left(w, pos - 1), 600) || substr(w, pos, length(phrase)) || left(substr(w, pos + length(phrase)), 600)) AS context,
  CAST(i AS INT) AS hit_sentence_index, CAST(a AS INT) AS context_start_index, CAST(b AS INT) AS context_end_index, (pos - 1 > 600 OR length(w) - pos - length(phrase) + 1 > 600) AS char_cutoff_applied FROM placed)"""


@query(f"WITH {_SENTENCES} SELECT record_id, CAST(i AS INT) AS sentence_no, s[i + 1] AS sentence FROM (SELECT record_id, s, unnest(range(len(s))) AS i FROM sents)")
def sentences(spark, d):
    return table(spark, d, "raw_records").select("record_id", F.posexplode(windows.split_sentences("core_text")).alias("sentence_no", "sentence"))


@query(f"WITH {_SENTENCES} SELECT record_id, phrase, CAST(count(*) AS BIGINT) AS hits FROM (SELECT record_id, unnest(s) AS t FROM sents) CROSS JOIN (VALUES ('net promoter'), ('nps')) AS v(phrase) WHERE contains(lower(t), phrase) GROUP BY ALL")
def phrase_hits(spark, d):
    return windows.sentence_hits(table(spark, d, "raw_records"), "record_id", "core_text", RULE).groupBy("record_id", "phrase").agg(F.count("*").alias("hits"))


def _found(spark, d):
    return windows.context_windows(table(spark, d, "raw_records"), "record_id", "core_text", RULE)


@query(f"WITH {_WINDOWS} SELECT record_id, matched_phrase, context, hit_sentence_index, context_start_index, context_end_index, char_cutoff_applied FROM wins")
def context_windows(spark, d):
    return _found(spark, d).drop("phrase_no")


@query(f"""WITH {_WINDOWS} SELECT record_id, string_agg(matched_phrase, ', ' ORDER BY hit_sentence_index, p) AS matched_phrase, context, min(hit_sentence_index) AS hit_sentence_index,
  arg_min(context_start_index, (hit_sentence_index, p)) AS context_start_index, arg_min(context_end_index, (hit_sentence_index, p)) AS context_end_index FROM wins GROUP BY record_id, context""")
def folded_windows(spark, d):
    return windows.fold_windows(_found(spark, d), "record_id").drop("char_cutoff_applied")


@query(f"WITH {_WINDOWS} SELECT record_id, CAST(count(*) AS BIGINT) AS excluded_count FROM wins WHERE contains(lower(context), 'press release') OR contains(lower(context), 'all rights reserved') GROUP BY record_id")
def excluded_documents(spark, d):
    return windows.exclude_documents(_found(spark, d), "record_id", RULE.excluded)[1]


@query(f"""WITH {_WINDOWS}, bad AS (SELECT DISTINCT record_id FROM wins WHERE contains(lower(context), 'press release') OR contains(lower(context), 'all rights reserved'))
SELECT record_id, CAST(count(*) AS BIGINT) AS windows FROM wins WHERE record_id NOT IN (SELECT record_id FROM bad) GROUP BY record_id""")
def kept_documents(spark, d):
    return windows.exclude_documents(_found(spark, d), "record_id", RULE.excluded)[0].groupBy("record_id").agg(F.count("*").alias("windows"))


_RANGES = _WINDOWS + """,
marked AS (SELECT record_id, context_start_index AS a, context_end_index AS b, max(context_end_index) OVER (PARTITION BY record_id ORDER BY context_start_index, context_end_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wins),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked),
ranges AS (SELECT record_id, min(a) AS range_start, max(b) AS range_end FROM islands GROUP BY record_id, island)"""


@query(f"WITH {_RANGES} SELECT * FROM ranges")
def merged_ranges(spark, d):
    return windows.merge_ranges(_found(spark, d), "record_id", "context_start_index", "context_end_index")


@query(f"WITH {_RANGES} SELECT record_id, string_agg(array_to_string(s[range_start + 1:range_end], ' '), ' ' ORDER BY range_start) AS all_context_windows FROM ranges JOIN sents USING (record_id) GROUP BY record_id")
def merged_context(spark, d):
    records = table(spark, d, "raw_records")
    return windows.merged_context(_found(spark, d), "record_id", records.select("record_id", windows.split_sentences("core_text").alias("sentences")))


_VECTOR = "[" + ", ".join(f"len({{t}}) - len(replace({{t}}, '{ch}', ''))" for ch in "abcdefghijklmnopqrstuvwxyz") + "]::DOUBLE[]"
_CLEANED = _WINDOWS.replace("FROM raw_records WHERE core_text IS NOT NULL", r"FROM (SELECT record_id, regexp_replace(regexp_replace(trim(translate(core_text, chr(160) || chr(10) || chr(13), '   ')), 'By:\s*/s/\s*[A-Za-z .-]+', '', 'gi'), '/s/\s*[A-Za-z .-]+', '', 'g') AS core_text FROM raw_records) WHERE core_text IS NOT NULL")
_PROCESSED = _CLEANED + f""",
bad AS (SELECT record_id, count(*) AS excluded FROM wins WHERE contains(lower(context), 'press release') OR contains(lower(context), 'all rights reserved') GROUP BY record_id),
folded AS (SELECT record_id, string_agg(matched_phrase, ', ' ORDER BY hit_sentence_index, p) AS matched_phrase, context, min(hit_sentence_index) AS hit_sentence_index, arg_min(context_start_index, (hit_sentence_index, p)) AS context_start_index,
  arg_min(context_end_index, (hit_sentence_index, p)) AS context_end_index, arg_min(char_cutoff_applied, (hit_sentence_index, p)) AS char_cutoff_applied FROM wins WHERE record_id NOT IN (SELECT record_id FROM bad) GROUP BY record_id, context),
scored AS (SELECT *, round(list_cosine_similarity({_VECTOR.format(t="lower(context)")}, {_VECTOR.format(t=f"'{CONFIG.reference.lower()}'")}), 4) AS similarity_score FROM folded)"""
_PROCESS_SQL = f"""WITH {_PROCESSED}, f AS (SELECT r.record_id, len(list_intersect(list_distinct(list_transform(keywords, lambda k: lower(trim(k, '"''')))), ['nps', 'net promoter score'])) > 0 AS scope FROM raw_records r JOIN filings ON r.metadata.filing.id = filings.id),
j AS (SELECT s.* EXCLUDE (similarity_score), coalesce(f.scope, FALSE) AS scope, CASE WHEN coalesce(f.scope, FALSE) THEN similarity_score END AS similarity_score FROM scored s LEFT JOIN f ON s.record_id = f.record_id)
SELECT record_id, matched_phrase, context, hit_sentence_index, context_start_index, context_end_index, char_cutoff_applied, similarity_score, CASE WHEN NOT scope OR similarity_score >= 0.5 THEN 'accept' ELSE 'reject' END AS decision FROM j"""


@query(_PROCESS_SQL)
def process_records(spark, d):
    """The whole plan from raw records to decisions, with the plainest embedder, which SQL can count as well."""
    filings = table(spark, d, "filings").select(F.col("id").alias("filing_id"), "keywords")
    records = table(spark, d, "raw_records").select(F.col("record_id"), "core_text", F.col("metadata.filing.id").alias("filing_id"))
    keywords = records.join(filings, "filing_id").select("record_id", "keywords")
    return process.process(records, CONFIG, keywords, "record_id", make=vectors.LetterEmbedder).drop("in_scope")


@query(f"""WITH {_PROCESSED}, per AS (SELECT record_id, count(*) AS total, count(*) FILTER (similarity_score >= 0.8) AS acc, count(*) FILTER (similarity_score < 0.8) AS rej, avg(similarity_score) AS a, min(similarity_score) AS lo, max(similarity_score) AS hi, sum(similarity_score) AS s FROM scored GROUP BY record_id),
u AS (SELECT r.record_id, coalesce(total, 0) AS total, coalesce(acc, 0) AS acc, coalesce(rej, 0) AS rej, a, lo, hi, s, coalesce(excluded, 0) AS excluded FROM raw_records r LEFT JOIN per USING (record_id) LEFT JOIN bad USING (record_id))
SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (excluded > 0) AS BIGINT) AS records_excluded, CAST(count(*) FILTER (excluded = 0 AND total = 0) AS BIGINT) AS records_skipped, CAST(count(*) FILTER (total > 0) AS BIGINT) AS records_processed,
  CAST(count(*) FILTER (acc > 0) AS BIGINT) AS accepted_total, CAST(count(*) FILTER (total > 0 AND acc = total) AS BIGINT) AS accepted_full, CAST(count(*) FILTER (acc > 0 AND rej > 0) AS BIGINT) AS accepted_partial, CAST(count(*) FILTER (rej > 0) AS BIGINT) AS rejected_total,
  CAST(sum(total) AS BIGINT) AS windows, CAST(sum(acc) AS BIGINT) AS windows_accepted, CAST(sum(rej) AS BIGINT) AS windows_rejected, CAST(sum(excluded) AS BIGINT) AS windows_excluded, round(min(lo), 3) AS min_score, round(max(hi), 3) AS max_score, round(sum(s) / sum(total), 3) AS avg_score, round(avg(a), 3) AS avg_filing FROM u""")
def process_summary(spark, d):
    records = table(spark, d, "raw_records").select("record_id", "core_text")
    decided, excluded = process.run(records, ProcessConfig(RULE, 0.8, Scope(None)), None, "record_id", make=vectors.LetterEmbedder)
    return rounded(process.summary(decided, records, excluded, "record_id"), 3)


# --- scores, thresholds and scopes -----------------------------------------------------------------------------

_SCORE = "CASE WHEN isnan(similarity_score) THEN NULL ELSE similarity_score END"


@query(f"SELECT window_id, id, CASE WHEN coalesce({_SCORE}, 0) >= 0.5 THEN 'accept' ELSE 'reject' END AS decision FROM context_windows")
def threshold_split(spark, d):
    return table(spark, d, "context_windows").select("window_id", "id", filters.decision("similarity_score", 0.5).alias("decision"))


_KEYS = "list_sort(list_distinct(list_transform(keywords, lambda k: lower(trim(k, '\"''')))))"


@query(f"""SELECT id, array_to_string({_KEYS}, '|') AS keys, len(list_intersect({_KEYS}, ['nps', 'net promoter score'])) > 0 AS in_scope, {_KEYS} = ['nps'] AS in_strict_scope,
  len({_KEYS}) = 1 AND {_KEYS}[1] IN ('nps', 'net promoter') AS wanted FROM filings WHERE keywords IS NOT NULL""")
def scopes(spark, d):
    f = table(spark, d, "filings").filter("keywords IS NOT NULL")
    return f.select("id", F.array_join(filters.keyword_set("keywords"), "|").alias("keys"), filters.in_scope("keywords", Scope(("nps", "net promoter score"), False)).alias("in_scope"), filters.in_scope("keywords", Scope(("nps",))).alias("in_strict_scope"), filters.included("keywords", ["nps", "net promoter"], True).alias("wanted"))


@query(f"""SELECT w.id, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (len(list_intersect({_KEYS}, ['nps', 'net promoter score'])) = 0 OR coalesce({_SCORE}, 0) >= 0.5) AS BIGINT) AS accepted
FROM context_windows w JOIN filings f ON w.id = f.id WHERE keywords IS NOT NULL GROUP BY w.id""")
def scope_split(spark, d):
    f = table(spark, d, "filings").filter("keywords IS NOT NULL").select("id", filters.in_scope("keywords", CONFIG.scope).alias("scope"))
    w = table(spark, d, "context_windows").select("id", "similarity_score").join(f, "id")
    return w.groupBy("id").agg(F.count("*").alias("windows"), F.count_if(filters.decision("similarity_score", 0.5, F.col("scope")) == "accept").alias("accepted"))


@query(f"""SELECT id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (coalesce({_SCORE}, 0) >= 0.5) AS BIGINT) AS accepted, CAST(count(*) FILTER (coalesce({_SCORE}, 0) < 0.5) AS BIGINT) AS rejected,
  floor((2 * sum(CAST(round({_SCORE} * 10000) AS BIGINT)) + count({_SCORE})) / (2 * count({_SCORE}))) / 10000 AS filings_average FROM context_windows GROUP BY id""")
def record_scores(spark, d):
    return aggregates.record_scores(table(spark, d, "context_windows"), ["id"], "similarity_score", 0.5)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT e FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
SELECT v.vec_id, round(list_cosine_similarity(v.e, r.e), 6) AS score FROM v CROSS JOIN r""")
def cosine_scores(spark, d):
    return _scores(spark, d).select("vec_id", "score")


def _scores(spark, d):
    e = table(spark, d, "embeddings")
    reference = e.orderBy("vec_id").first()["embedding"]  # one vector
    return e.select("vec_id", "label", F.round(vectors.cosine("embedding", reference), 6).alias("score"))


_SCORES = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT e AS f FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)),
s AS (SELECT vec_id, label, round(list_cosine_similarity(e, f), 6) AS score FROM v CROSS JOIN r)"""
_SWEEP = _SCORES + """,
sweep AS (SELECT t AS threshold, CAST(count(*) FILTER (score >= t AND label = 5) AS BIGINT) AS tp, CAST(count(*) FILTER (score >= t AND label <> 5) AS BIGINT) AS fp, CAST(count(*) FILTER (score < t AND label = 5) AS BIGINT) AS fn,
  CAST(count(*) FILTER (score < t AND label <> 5) AS BIGINT) AS tn FROM s CROSS JOIN (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2, 0.3])::DOUBLE AS t) GROUP BY t),
rates AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM sweep)"""
THRESHOLDS = [-0.2, -0.1, 0.0, 0.1, 0.2, 0.3]


@query(f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM rates")
def threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(_scores(spark, d), "score", F.col("label") == 5, THRESHOLDS))


@query(f"WITH {_SWEEP}, f AS (SELECT threshold, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM rates) SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(threshold_sweep(spark, d)).select("threshold", "f1")


_CURVE = _SCORES + """,
steps AS (SELECT score, count(*) FILTER (label = 5) AS p, count(*) FILTER (label <> 5) AS n FROM s GROUP BY score),
curve AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, sum(p) OVER () AS total FROM steps WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT score, tp, fp, tp / (tp + fp) AS precision, tp / total AS recall FROM curve)"""


@query(f"WITH {_CURVE} SELECT score, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(_scores(spark, d).withColumn("all", F.lit(1)), "score", F.col("label") == 5, ["all"]).drop("all"))


@query(f"WITH {_CURVE}, st AS (SELECT precision, recall - coalesce(lag(recall) OVER (ORDER BY score DESC), 0) AS step FROM pr) SELECT round(sum(step * precision), 6) AS average_precision FROM st")
def average_precision(spark, d):
    curve = metrics.pr_curve(_scores(spark, d).withColumn("all", F.lit(1)), "score", F.col("label") == 5, ["all"])
    return rounded(metrics.average_precision(curve, ["all"]).drop("all"))


@query(f"WITH {_SCORES}, b AS (SELECT label, CAST(least(floor((score + 1) * 40 / 2), 39) AS INT) AS bin FROM s WHERE score BETWEEN -1 AND 1) SELECT label, bin, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL")
def score_histogram(spark, d):
    return aggregates.histogram(_scores(spark, d), "score", 40, -1.0, 1.0, ["label"])


@query(f"(WITH {_SCORES} SELECT vec_id, score, 'top' AS side FROM s ORDER BY score DESC, vec_id LIMIT 10) UNION ALL (WITH {_SCORES} SELECT vec_id, score, 'bottom' AS side FROM s ORDER BY score, vec_id LIMIT 10)")
def top_and_bottom_scores(spark, d):
    return sampling.top_and_bottom(_scores(spark, d).drop("label"), "score", "vec_id", 10)


# --- evaluation of versions against each other -----------------------------------------------------------------


def _versions(spark, d):
    c = table(spark, d, "classifications")
    v = c.groupBy("experiment_version").count().orderBy(F.desc("count"), "experiment_version").limit(2).collect()
    names = sorted(r["experiment_version"] for r in v)
    a, b = (metrics.best_per_group(c.filter(F.col("experiment_version") == n), "filing_id", ["id"]).select("filing_id", *[F.col(k).alias(f"{k}_{s}") for k in ("kpi_current_value", "kpi_trend", "nps_value_fix")]) for n, s in zip(names, "ab", strict=True))
    return a.join(b, "filing_id")


_VERSIONS = """names AS (SELECT experiment_version AS v FROM classifications GROUP BY v ORDER BY count(*) DESC, v LIMIT 2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, experiment_version ORDER BY id) AS rn FROM classifications WHERE experiment_version IN (SELECT v FROM names)) WHERE rn = 1),
pairs AS (SELECT a.filing_id, a.kpi_current_value AS t1, b.kpi_current_value AS s1, a.kpi_trend AS t2, b.kpi_trend AS s2, a.nps_value_fix AS x, b.nps_value_fix AS y FROM one a JOIN one b ON a.filing_id = b.filing_id AND a.experiment_version = (SELECT min(v) FROM names) AND b.experiment_version = (SELECT max(v) FROM names))"""


@query(f"""WITH {_VERSIONS}, cells AS (SELECT coalesce(t1, FALSE)::VARCHAR AS t, coalesce(s1, FALSE)::VARCHAR AS s FROM pairs),
cls AS (SELECT t AS class FROM cells UNION SELECT s FROM cells),
per AS (SELECT class, count(*) FILTER (t = class) AS support, count(*) FILTER (s = class) AS guessed, count(*) FILTER (t = class AND s = class) AS tp FROM cls CROSS JOIN cells GROUP BY class),
r AS (SELECT class, coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, support, tp FROM per), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, d):
    v = _versions(spark, d).select(F.coalesce("kpi_current_value_a", F.lit(False)).alias("t"), F.coalesce("kpi_current_value_b", F.lit(False)).alias("s"))
    return rounded(metrics.classification_report(v, "t", "s"))


@query(f"""WITH {_VERSIONS}, c AS (SELECT t2 AS truth, s2 AS said, count(*) AS n FROM pairs GROUP BY ALL)
SELECT truth, said, CAST(n AS BIGINT) AS n, round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 6) AS share FROM c""")
def normalised_confusion(spark, d):
    return rounded(metrics.normalised_confusion(_versions(spark, d), "kpi_trend_a", "kpi_trend_b"))


@query(f"""WITH {_VERSIONS}, l AS (SELECT 'kpi_current_value' AS property, coalesce(t1, FALSE) AS t, coalesce(s1, FALSE) AS s FROM pairs UNION ALL SELECT 'kpi_trend', coalesce(t2, FALSE), coalesce(s2, FALSE) FROM pairs)
SELECT property, CAST(count(*) FILTER (t AND s) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT t AND s) AS BIGINT) AS fp, CAST(count(*) FILTER (t AND NOT s) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT t AND NOT s) AS BIGINT) AS tn FROM l GROUP BY property""")
def agreement(spark, d):
    v = _versions(spark, d)
    named = v.select(*[F.col(f"{k}_a").alias(k) for k in ("kpi_current_value", "kpi_trend")], *[F.col(f"{k}_b").alias(f"{k}_said") for k in ("kpi_current_value", "kpi_trend")])
    return metrics.agreement(named, [(k, f"{k}_said") for k in ("kpi_current_value", "kpi_trend")]).select("property", "tp", "fp", "fn", "tn")


@query(f"""WITH {_VERSIONS}, n AS (SELECT filing_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS x, CASE WHEN isnan(y) THEN NULL ELSE y END AS y FROM pairs)
SELECT CASE WHEN y IS NULL THEN 'no_value' WHEN x IS NOT NULL AND abs(x - y) <= greatest(1e-9 * greatest(abs(x), abs(y)), 1e-5) THEN 'correct_value' ELSE 'wrong_value' END AS label, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY ALL""")
def value_labels(spark, d):
    v = _versions(spark, d)
    x, y = (values.as_number(F.col(f"nps_value_fix_{s}")) for s in "ab")
    return v.groupBy(values.value_label(x, y).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT experiment_version, CAST(count(*) AS BIGINT) AS rows, CAST(sum(coalesce(kpi_current_value::INT, 0)) AS BIGINT) AS kpi_current_value, CAST(sum(coalesce(kpi_trend::INT, 0)) AS BIGINT) AS kpi_trend,
  CAST(count(*) FILTER (nps_value_fix IS NOT NULL AND NOT isnan(nps_value_fix)) AS BIGINT) AS nps_value_fix FROM classifications GROUP BY ALL""")
def label_composition(spark, d):
    return aggregates.composition(table(spark, d, "classifications"), ["kpi_current_value", "kpi_trend"], ["nps_value_fix"], ["experiment_version"])


@query("SELECT experiment_version, round(sum(v * id) / sum(id) FILTER (v IS NOT NULL), 6) AS mean FROM (SELECT *, CASE WHEN isnan(nps_value_fix) THEN NULL ELSE nps_value_fix END AS v FROM classifications) GROUP BY ALL")
def weighted_means(spark, d):
    return rounded(table(spark, d, "classifications").groupBy("experiment_version").agg(metrics.weighted_mean("nps_value_fix", "id").alias("mean")))


@query("""SELECT filing_id, coalesce(bool_or(kpi_current_value), FALSE) AS kpi_current_value, coalesce(bool_or(kpi_trend), FALSE) AS kpi_trend,
  arg_max(v, (classified_at, id)) FILTER (v IS NOT NULL) AS nps_value_fix FROM (SELECT *, CASE WHEN isnan(nps_value_fix) THEN NULL ELSE nps_value_fix END AS v FROM classifications) GROUP BY filing_id""")
def last_non_default(spark, d):
    c = table(spark, d, "classifications").withColumn("nps_value_fix", values.as_number(F.col("nps_value_fix")))
    return aggregates.last_non_default(c, "filing_id", ["classified_at", "id"], {"kpi_current_value": False, "kpi_trend": False, "nps_value_fix": None})


# --- keywords and relevance ------------------------------------------------------------------------------------


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (project_relevant) AS BIGINT) AS is_true, CAST(count(*) FILTER (NOT project_relevant) AS BIGINT) AS is_false, CAST(count(*) FILTER (project_relevant IS NULL) AS BIGINT) AS is_null FROM filings")
def relevance_counts(spark, d):
    return aggregates.three_valued_counts(table(spark, d, "filings"), "project_relevant")


@query("SELECT trim(k) AS keyword, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(keywords) AS k FROM filings) GROUP BY ALL")
def keyword_counts(spark, d):
    return aggregates.keyword_counts(table(spark, d, "filings"), "keywords")


@query("SELECT CASE WHEN keywords IS NULL OR len(keywords) = 0 THEN '[no keywords]' ELSE '[''' || array_to_string(list_sort(list_transform(keywords, lambda k: trim(k))), ''', ''') || ''']' END AS combination, CAST(count(*) AS BIGINT) AS n FROM filings GROUP BY ALL")
def keyword_combinations(spark, d):
    return aggregates.combination_counts(table(spark, d, "filings"), "keywords")


@query("""WITH p AS (SELECT DISTINCT metadata.filing.id AS g, coalesce(metadata.keyword, metadata.filing.keyword) AS k FROM raw_records), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM p WHERE k IS NOT NULL)
SELECT k AS keyword, CAST(count(*) AS BIGINT) AS groups, CAST(count(*) FILTER (c = 1) AS BIGINT) AS alone FROM n GROUP BY ALL""")
def keywords_alone(spark, d):
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("g"), F.coalesce("metadata.keyword", "metadata.filing.keyword").alias("k"))
    return aggregates.keywords_alone(r, "g", "k")


@query("""WITH k AS (SELECT id, trim(unnest(keywords)) AS keyword, path_to_raw FROM filings WHERE project_relevant IS NULL AND keywords IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY id, path_to_raw) AS rank FROM (SELECT DISTINCT * FROM k))
SELECT keyword, id, path_to_raw, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def unrated_per_keyword(spark, d):
    f = table(spark, d, "filings").filter("project_relevant IS NULL AND keywords IS NOT NULL")
    rows = f.select("id", "path_to_raw", F.explode("keywords").alias("k")).select(F.trim("k").alias("keyword"), "id", "path_to_raw").distinct()
    return aggregates.first_per_key(rows, "keyword", ["id", F.col("path_to_raw").asc_nulls_last()], 5)


@query("""SELECT id, list_has_any(keywords, ['nps', '"nps"']) AS has_nps, len(keywords) = 1 AND keywords[1] IN ('nps', '"nps"') AS only_nps, path_to_raw IS NOT NULL AND path_to_raw <> '' AS raw, coalesce(blacklisted, FALSE) AS blacklisted FROM filings WHERE keywords IS NOT NULL""")
def filing_flags(spark, d):
    f = table(spark, d, "filings").filter("keywords IS NOT NULL")
    return f.select("id", filters.has_keyword("keywords", "nps").alias("has_nps"), filters.has_keyword("keywords", "nps", True).alias("only_nps"), filters.non_empty("path_to_raw").alias("raw"), filters.flag("blacklisted").alias("blacklisted"))


# --- keyed store -----------------------------------------------------------------------------------------------


@query("SELECT filing_id, preprocessing_version, project_relevant, path_to_preprocessed FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY processed_at DESC NULLS LAST, id DESC) AS rn FROM preprocessing) WHERE rn = 1")
def latest_preprocessing(spark, d):
    p = table(spark, d, "preprocessing")
    return store.latest(p, ["filing_id"], [F.col("processed_at").desc_nulls_last(), F.desc("id")]).select("filing_id", "preprocessing_version", "project_relevant", "path_to_preprocessed")


_NEWS = """n AS (SELECT * FROM (SELECT metadata.filing.id AS id, url, metadata.filing.form AS form, crawled_at AS last_crawled, record_id, row_number() OVER (PARTITION BY metadata.filing.id ORDER BY crawled_at DESC NULLS LAST, record_id DESC) AS rn FROM raw_records WHERE metadata.filing.id IS NOT NULL) WHERE rn = 1)"""


@query(f"""WITH {_NEWS} SELECT coalesce(f.id, n.id) AS id, coalesce(n.url, f.url) AS url, coalesce(n.form, f.form) AS form, CASE WHEN f.id IS NULL THEN FALSE ELSE f.blacklisted END AS blacklisted, CASE WHEN f.id IS NULL THEN '' ELSE array_to_string(f.keywords, '|') END AS keywords
FROM filings f FULL JOIN n ON f.id = n.id""")
def upsert_filings(spark, d):
    f = table(spark, d, "filings").select("id", "url", "form", "blacklisted", "keywords")
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("id"), "url", F.col("metadata.filing.form").alias("form"), "crawled_at", "record_id")
    news = store.latest(r.filter("id IS NOT NULL"), ["id"], [F.col("crawled_at").desc_nulls_last(), F.desc("record_id")]).select("id", "url", "form")
    merged = store.upsert(f, news, ["id"], {"url": store.KEEP_UNLESS_GIVEN, "form": store.KEEP_UNLESS_GIVEN, "blacklisted": store.STICKY})
    return merged.withColumn("keywords", F.array_join("keywords", "|"))


@query("""WITH a AS (SELECT metadata.filing.id AS id, list_sort(list_distinct(list(metadata.keyword))) AS ks FROM raw_records WHERE metadata.filing.id IS NOT NULL AND metadata.keyword IS NOT NULL GROUP BY 1)
SELECT f.id, array_to_string(list_concat(coalesce(f.keywords, []), coalesce(list_filter(a.ks, lambda k: NOT list_contains(coalesce(f.keywords, []), k)), [])), '|') AS keywords FROM filings f LEFT JOIN a USING (id) WHERE f.keywords IS NOT NULL OR a.id IS NOT NULL""")
def append_keywords(spark, d):
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("id"), F.col("metadata.keyword").alias("keyword"))
    out = store.append_keywords(table(spark, d, "filings").select("id", "keywords"), r)
    return out.filter("keywords IS NOT NULL").withColumn("keywords", F.array_join("keywords", "|"))


@query("""WITH gone AS (SELECT id FROM filings WHERE blacklisted) SELECT 'filings' AS name, CAST(count(*) AS BIGINT) AS n FROM filings WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'preprocessing', CAST(count(*) AS BIGINT) FROM preprocessing WHERE filing_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'classifications', CAST(count(*) AS BIGINT) FROM classifications WHERE filing_id NOT IN (SELECT id FROM gone)""")
def delete_cascade(spark, d):
    f = table(spark, d, "filings")
    left = store.delete_keys({"filings": (f, "id"), "preprocessing": (table(spark, d, "preprocessing"), "filing_id"), "classifications": (table(spark, d, "classifications"), "filing_id")}, f.filter("blacklisted"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT f.id, CASE WHEN len(f.ticker) > 0 THEN '[''' || t || ''']' WHEN f.ticker IS NULL THEN NULL ELSE '[]' END AS ticker, c.kpi_current_value, c.kpi_trend FROM (SELECT id, ticker, CASE WHEN len(ticker) > 0 THEN unnest(ticker) ELSE unnest(['']) END AS t FROM filings WHERE coalesce(project_relevant, FALSE)) f
LEFT JOIN classifications c ON f.id = c.filing_id AND c.experiment_version = 'cls_v1'""")
def export_filings(spark, d):
    main = table(spark, d, "filings").select("id", "ticker", "project_relevant")
    return process.export(main, table(spark, d, "classifications").select("filing_id", "experiment_version", "kpi_current_value", "kpi_trend"), "cls_v1", True).select("id", "ticker", "kpi_current_value", "kpi_trend")


# --- joins and sets --------------------------------------------------------------------------------------------


@query("SELECT id FROM filings WHERE NOT EXISTS (SELECT 1 FROM raw_records WHERE trim(metadata.filing.id) = trim(filings.id))")
def missing_records(spark, d):
    return joins.missing_from(table(spark, d, "filings"), table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("fid")), "id", "fid").select("id")


@query("SELECT record_id FROM raw_records WHERE trim(url) IN (SELECT trim(url) FROM filings WHERE url IS NOT NULL)")
def matching_urls(spark, d):
    return joins.present_in(table(spark, d, "raw_records").select("record_id", "url"), table(spark, d, "filings").select("url"), "url").select("record_id")


@query("SELECT CAST(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (b.k IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (a.k IS NULL) AS BIGINT) AS right_only FROM (SELECT DISTINCT id AS k FROM context_windows WHERE id IS NOT NULL) a FULL JOIN (SELECT DISTINCT filing_id AS k FROM preprocessing) b ON a.k = b.k")
def match_counts(spark, d):
    return joins.match_counts(table(spark, d, "context_windows").select("id").dropna().distinct(), table(spark, d, "preprocessing").select(F.col("filing_id").alias("id")).distinct(), "id")


@query("""SELECT metadata.filing.id AS id, record_id, row_number() OVER (PARTITION BY metadata.filing.id ORDER BY crawled_at NULLS FIRST, record_id) > 1 AS is_duplicate FROM raw_records""")
def first_wins(spark, d):
    r = table(spark, d, "raw_records").select(F.col("metadata.filing.id").alias("id"), "record_id", "crawled_at")
    return aggregates.first_wins(r, ["id"], ["crawled_at", "record_id"]).drop("crawled_at")


@query("""WITH q AS (SELECT DISTINCT p_name AS query FROM part WHERE p_partkey % 50 = 0), n AS (SELECT DISTINCT s_name AS name FROM supplier),
s AS (SELECT query, name, round(1 - levenshtein(lower(query), lower(name)) / greatest(length(query), length(name), 1), 6) AS score FROM q CROSS JOIN n)
SELECT query, name, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS rank FROM s) WHERE rank <= 5""")
def similar_names(spark, d):
    return joins.similar_names(table(spark, d, "part").filter("p_partkey % 50 = 0"), table(spark, d, "supplier").select("s_name").distinct(), "p_name", "s_name")


@query("SELECT o_orderstatus, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS DOUBLE) AS \"1-URGENT\", CAST(max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS DOUBLE) AS \"2-HIGH\", CAST(max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS DOUBLE) AS \"5-LOW\" FROM orders GROUP BY ALL")
def pivot_best(spark, d):
    return aggregates.pivot_best(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "o_totalprice")


# --- distributions, samples and frontiers ----------------------------------------------------------------------


@query("WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT CAST(least(floor((l_quantity - a) * 50 / (b - a)), 49) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem CROSS JOIN e GROUP BY ALL")
def quantity_histogram(spark, d):
    return aggregates.histogram(table(spark, d, "lineitem"), "l_quantity", 50)


@query("""WITH c AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY ALL), n AS (SELECT k AS value, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT unnest(range((SELECT min(value) FROM n), (SELECT max(value) FROM n) + 1)) AS value)
SELECT g.value, CAST(coalesce(n, 0) AS BIGINT) AS n, round(sum(coalesce(n, 0)) OVER (ORDER BY g.value) / sum(coalesce(n, 0)) OVER (), 6) AS share FROM g LEFT JOIN n USING (value)""")
def lines_per_order(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return rounded(aggregates.counts_with_cumulative(per, "k"))


@query("""SELECT p_partkey, p_size, p_retailprice FROM (SELECT *, max(q) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT p_size, max(p_retailprice) AS q FROM part GROUP BY ALL)) f JOIN part USING (p_size) WHERE p_retailprice = q AND (b IS NULL OR q > b)""")
def pareto_parts(spark, d):
    return metrics.pareto(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("(SELECT c_custkey, c_acctbal, 'top' AS side FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION ALL (SELECT c_custkey, c_acctbal, 'bottom' AS side FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)")
def top_and_bottom_customers(spark, d):
    return sampling.top_and_bottom(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)


@query("""WITH b AS (SELECT c_custkey, c_acctbal, CAST(floor((c_acctbal - 0) / 1000 + 1e-9) AS INT) AS bucket FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 9000),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM b)
SELECT c_custkey, c_acctbal, bucket FROM r WHERE n <= 8 OR list_contains(list_transform(range(1, 9), lambda k: CAST(round_even(k * n / 9.0, 0) AS BIGINT)), i)""")
def systematic_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return sampling.systematic_sample(c, "c_acctbal", "c_custkey", 8, sampling.bucket("c_acctbal", 1000.0, 0.0, 9000.0))


# --- scalar functions ------------------------------------------------------------------------------------------


@query("""SELECT id, CASE WHEN instr(n, ' (') > 0 THEN trim(left(n, instr(n, ' (') - 1)) ELSE trim(n) END AS company, coalesce(nullif(regexp_extract(n, '\\(([A-Z0-9\\-.]+)\\)', 1), ''), 'N/A') AS ticker, nullif(regexp_extract(n, '^(.+?)\\s*\\(([^)]+)\\)\\s*\\(CIK\\s+[^)]+\\)', 2), '') AS strict_ticker,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(n, '\\(([A-Z,\\s-]+)\\)\\s+\\(CIK', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tickers FROM (SELECT id, display_names[1] AS n FROM filings) WHERE n IS NOT NULL""")
def display_names(spark, d):
    f = table(spark, d, "filings").select("id", F.try_element_at("display_names", F.lit(1)).alias("n")).filter("n IS NOT NULL")
    return f.select("id", strings.company("n").alias("company"), strings.first_ticker("n").alias("ticker"), strings.strict_name("n")["tickers"].alias("strict_ticker"), F.array_join(strings.ticker_list("n"), "|").alias("tickers"))


@query("""SELECT id, translate(id, ':*?"<>|/\\', '_________') AS file_name, substr(id, instr(id, ':') + 1) AS file, lower(regexp_extract(id, '\\.([^./\\\\]+)$', 1)) AS extension,
  trim(regexp_replace(id, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug, array_to_string(list_transform(ciks, lambda c: 'https://archive.example/' || c || '/' || replace(adsh, '-', '') || '/' || substr(id, instr(id, ':') + 1)), ' ') AS urls FROM filings WHERE ciks IS NOT NULL""")
def file_names(spark, d):
    f = table(spark, d, "filings").filter("ciks IS NOT NULL")
    file = strings.file_of_id("id")
    return f.select("id", strings.safe_file_name("id").alias("file_name"), file.alias("file"), strings.extension("id").alias("extension"), strings.slug("id").alias("slug"), F.array_join(strings.document_urls("ciks", "adsh", file, "https://archive.example"), " ").alias("urls"))


@query("SELECT id, CAST(file_date - INTERVAL 1 YEAR AS DATE) AS one_year, CAST(file_date - INTERVAL 30 DAY AS DATE) AS thirty_days FROM filings WHERE file_date IS NOT NULL")
def date_ranges(spark, d):
    f = table(spark, d, "filings").filter("file_date IS NOT NULL")
    return f.select("id", strings.range_start(F.lit("1y"), "file_date").alias("one_year"), strings.range_start(F.lit("30d"), "file_date").alias("thirty_days"))


@query("SELECT record_id, TRY_CAST(metadata.filing.file_date AS DATE) AS file_date, CASE WHEN isnan(v) THEN NULL ELSE v END AS amount, CAST(round_even(CASE WHEN isnan(v) THEN NULL ELSE v END, 0) AS INT) AS whole FROM (SELECT *, TRY_CAST(replace(trim(metadata.filing.sequence), ',', '.') AS DOUBLE) AS v FROM raw_records)")
def casts(spark, d):
    r, s = table(spark, d, "raw_records"), F.col("metadata.filing.sequence")
    return r.select("record_id", F.col("metadata.filing.file_date").try_cast("date").alias("file_date"), values.as_property(s, "float").alias("amount"), values.as_property(s, "int").alias("whole"))


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def hourly_events(spark, d):
    return flows.windowed_counts(table(spark, d, "events"), "ts", ["event_type"])


@query("SELECT metadata.filing.file_container_type AS container, CAST(count(*) AS BIGINT) AS n FROM raw_records GROUP BY ALL")
def container_counts(spark, d):
    return table(spark, d, "raw_records").groupBy(F.col("metadata.filing.file_container_type").alias("container")).agg(F.count("*").alias("n"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(count(DISTINCT text) AS BIGINT) AS texts, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL""")
def source_sizes(spark, d):
    # distinct texts by their digest: the texts themselves stay out of the shuffle
    t = table(spark, d, "documents").select("source", "n_chars", F.md5(F.col("text").cast("binary")).alias("t"))
    return rounded(t.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("t").alias("texts"), F.avg("n_chars").alias("mean")))
