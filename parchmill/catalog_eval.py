"""Queries of evaluation frames, samples and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, rounded
from .functions import strings
from .operators import aggregates, filters, joins, metrics, sampling
from .session import table

_REPORT = """cells AS (SELECT o_orderstatus AS model, o_orderpriority AS label, count(*)::DOUBLE AS n, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS f FROM orders GROUP BY ALL),
rep AS (SELECT model, label, 'True' AS class, 'support' AS metric, n AS value FROM cells UNION ALL SELECT model, label, 'True', 'f1-score', f FROM cells UNION ALL SELECT model, label, 'False', 'support', n + 1 FROM cells
  UNION ALL SELECT model, label, 'macro avg', 'support', 2 * n FROM cells UNION ALL SELECT model, label, 'correct_value', 'support', n % 7 FROM cells UNION ALL SELECT model, label, 'wrong_value', 'support', CASE WHEN model = 'P' THEN n % 2 ELSE 0 END FROM cells)"""
LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _report(spark, d):
    """An evaluation report in long form: models by status, labels by priority."""
    per = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("label")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg(F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)), 6).alias("f"))
    rows = [("True", "support", F.col("n")), ("True", "f1-score", F.col("f")), ("False", "support", F.col("n") + 1), ("macro avg", "support", 2 * F.col("n")), ("correct_value", "support", F.col("n") % 7), ("wrong_value", "support", F.when(F.col("model") == "P", F.col("n") % 2).otherwise(0.0))]
    return per.select("model", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric"), v.alias("value")) for c, m, v in rows])).alias("r")).select("model", "label", "r.*")


@query(f"WITH {_REPORT} SELECT model, label, f AS value FROM cells")
def positive_f1(spark, d):
    return metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"])


@query(f"WITH {_REPORT} SELECT model, label, max(n) AS support, max(n % 7) AS value_support, max(2 * n) AS n_test FROM cells GROUP BY ALL")
def label_supports(spark, d):
    return metrics.supports(_report(spark, d), ["model", "label"])


@query(f"""WITH {_REPORT} SELECT model, {', '.join(f"max(f) FILTER (label = '{x}') AS \"{x}\"" for x in LABELS)}, round(avg(f), 6) AS mean FROM cells GROUP BY model""")
def f1_frame(spark, d):
    """One row per model, one column per label, and the mean of the labels."""
    return rounded(metrics.metric_frame(metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"]), LABELS))


@query(f"""WITH {_REPORT} SELECT model, {', '.join(f"max(f) FILTER (label = '{x}') AS \"{x}\"" for x in LABELS)}, round(sum(f * s) / sum(s), 6) AS weighted_mean FROM cells JOIN (SELECT label, sum(n) AS s FROM cells GROUP BY label) USING (label) GROUP BY model""")
def f1_matrix(spark, d):
    """The frame with a last column weighted by each label's support."""
    values = metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"])
    supports = metrics.supports(_report(spark, d), ["model", "label"]).groupBy("label").agg(F.sum("support").alias("support"))
    return rounded(metrics.matrix_with_weighted_mean(values, supports, LABELS))


@query(f"WITH {_REPORT} SELECT model, max(CASE WHEN model = 'P' THEN n % 2 ELSE 0 END) > 0 AS stale FROM cells GROUP BY model")
def stale_models(spark, d):
    return filters.stale_reports(_report(spark, d))


@query(f"""WITH {_REPORT} SELECT model, CASE WHEN label IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS task, label, value FROM rep WHERE class = 'True' AND metric = 'support' AND label <> '5-LOW' AND NOT (model = 'F' AND label IN ('1-URGENT', '2-HIGH'))
UNION ALL SELECT 'F', 'fast', 'own', 1.0""")
def routed_labels(spark, d):
    """A report's block of all labels handed to the tasks that own them; a model's own report of a task counts first."""
    rep = _report(spark, d).filter("class = 'True' AND metric = 'support'").select("model", F.lit("all").alias("task"), "label", "class", "metric", "value")
    own = spark.createDataFrame([("F", "fast", "own", "True", "support", 1.0)], rep.schema)
    return metrics.route_labels(rep.unionByName(own), "all", {"fast": ["1-URGENT", "2-HIGH", "own"], "slow": ["3-MEDIUM", "4-NOT SPECIFIED"]}).select("model", "task", "label", "value")


@query(f"WITH {_REPORT} SELECT label, min(f) AS least, max(f) AS most FROM cells GROUP BY label")
def f1_ranges(spark, d):
    return aggregates.value_range(metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"]), "label", "value")


@query(f"WITH {_REPORT}, m AS (SELECT model, label, f FROM cells) SELECT model, label, f AS value FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC, label) AS r FROM m) WHERE r = 1")
def best_label_per_model(spark, d):
    return metrics.best_per_group(metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"]), "model", [F.desc("value"), "label"])


@query(f"WITH {_REPORT}, m AS (SELECT model, avg(f) AS mean FROM cells GROUP BY model) SELECT model, round(mean, 6) AS mean FROM m ORDER BY mean DESC, model LIMIT 2")
def top_two_models(spark, d):
    frame = metrics.metric_frame(metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"]), LABELS).select("model", "mean")
    return rounded(sampling.first_n(frame, [F.desc("mean"), "model"], 2))


@query(f"""WITH {_REPORT}, p AS (SELECT label, max(f) FILTER (model = 'F') AS f, max(f) FILTER (model = 'O') AS o, max(f) FILTER (model = 'P') AS p FROM cells GROUP BY label)
SELECT label, f AS "F", o AS "O", p AS "P", round(f - o, 6) AS lead, CASE WHEN f > o THEN 'F' WHEN f < o THEN 'O' ELSE 'even' END AS winner FROM p""")
def head_to_head(spark, d):
    """Two approaches against each other, label by label."""
    return rounded(metrics.head_to_head(metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"]), ["F", "O", "P"], "F", "O"))


@query(f"""WITH {_REPORT} SELECT CASE WHEN model IN ('F', 'O') THEN 'main' ELSE 'other' END AS "group", model, round(avg(f), 6) AS mean, CAST(count(*) AS BIGINT) AS labels FROM cells GROUP BY ALL""")
def approach_means(spark, d):
    """Mean of each model within its group of approaches, groups in order and the best first."""
    return rounded(metrics.approach_means(metrics.positive_metric(_report(spark, d), "f1-score", ["model", "label"]), {"F": "main", "O": "main"}, "other"))


@query(f"WITH {_REPORT} SELECT model, max(n % 7) FILTER (label = '1-URGENT') AS value FROM cells WHERE model NOT IN (SELECT model FROM cells WHERE model = 'P' AND n % 2 > 0) GROUP BY model")
def values_of_current_models(spark, d):
    """Value extraction of the models whose reports are no older than the rule that counts wrong values."""
    rep = _report(spark, d)
    current = filters.stale_reports(rep).filter("NOT stale").select("model")
    return rep.join(current, "model", "left_semi").filter("class = 'correct_value' AND label = '1-URGENT'").groupBy("model").agg(F.max("value").alias("value"))


_SWEPT = "o AS (SELECT o_orderkey, o_totalprice / 600000 AS s, o_orderstatus = 'F' AS t, o_orderpriority AS model FROM orders), g AS (SELECT model, threshold, CAST(count(*) FILTER (s >= threshold AND t) AS BIGINT) AS tp, CAST(count(*) FILTER (s >= threshold AND NOT t) AS BIGINT) AS fp, CAST(count(*) FILTER (s < threshold AND t) AS BIGINT) AS fn FROM o CROSS JOIN (SELECT unnest([0.1, 0.5, 0.99])::DOUBLE AS threshold) GROUP BY ALL)"


@query(f"WITH {_SWEPT} SELECT model, threshold, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM g")
def sweep_with_gaps(spark, d):
    """A sweep whose precision is null where nothing is predicted."""
    o = table(spark, d, "orders").withColumn("s", F.col("o_totalprice") / 600000)
    return rounded(metrics.threshold_sweep(o, "s", F.col("o_orderstatus") == "F", [0.1, 0.5, 0.99], ["o_orderpriority"], empty=None).select(F.col("o_orderpriority").alias("model"), "threshold", "precision", "recall"))


@query(f"WITH {_SWEPT}, f AS (SELECT model, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g), b AS (SELECT model, max(f1) AS f1 FROM f GROUP BY model) SELECT model, f1, CAST(left(model, 1) AS INT) - 1 AS ms FROM b WHERE left(model, 1) <> '1'")
def quality_and_cost(spark, d):
    """Best quality of each model with its cost; models without a cost are left out."""
    o = table(spark, d, "orders").withColumn("s", F.col("o_totalprice") / 600000)
    sweep = rounded(metrics.threshold_sweep(o, "s", F.col("o_orderstatus") == "F", [0.1, 0.5, 0.99], ["o_orderpriority"]))
    best = metrics.best_threshold(sweep, ["o_orderpriority"]).select(F.col("o_orderpriority").alias("model"), "f1", (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("ms"))
    return metrics.quality_and_cost(best)


@query("""WITH c AS (SELECT kpi_current_value AS a, kpi_trend AS b FROM classifications), l AS (SELECT 'current' AS property, coalesce(a, FALSE) AS t, coalesce(b, FALSE) AS s FROM c UNION ALL SELECT 'trend', coalesce(b, FALSE), coalesce(a, FALSE) FROM c)
SELECT property, round(count(*) FILTER (t AND s) / nullif(count(*) FILTER (s), 0), 6) AS precision, round(count(*) FILTER (t AND s) / nullif(count(*) FILTER (t), 0), 6) AS recall, CAST(count(*) FILTER (t) AS BIGINT) AS support FROM l GROUP BY property""")
def property_rates(spark, d):
    """Precision, recall and support of properties from aligned truths and predictions."""
    c = table(spark, d, "classifications").select(F.col("kpi_current_value").alias("current"), F.col("kpi_trend").alias("trend"))
    return rounded(metrics.agreement(c, [("current", "trend"), ("trend", "current")]).withColumn("property", F.col("property")).select("property", "precision", "recall", "support"))


@query("SELECT p_partkey, round((p_size + p_retailprice) / 2, 6) AS mean FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, round(p_retailprice, 6) FROM part WHERE p_size % 2 = 1")
def row_means(spark, d):
    """The mean of a row's columns that have a value."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.lit(float("nan"))).alias("a"), F.lit(None).cast("double").alias("b"), F.col("p_retailprice").alias("c"))
    return rounded(p.select("p_partkey", aggregates.row_mean(["a", "b", "c"]).alias("mean")))


@query("""WITH n AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS folder, CASE WHEN s_acctbal < 0 THEN 'A' WHEN s_nationkey % 2 = 0 THEN 'B' ELSE 'A' END AS cls FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY folder, cls) AS same, row_number() OVER (PARTITION BY folder, cls ORDER BY s_suppkey) AS k FROM n),
k AS (SELECT folder, count(DISTINCT cls) AS kinds FROM n GROUP BY folder)
SELECT s_suppkey, folder || CASE WHEN kinds > 1 THEN ' (' || cls || ')' ELSE '' END || CASE WHEN same > 1 THEN ' #' || k ELSE '' END AS display_name FROM c JOIN k USING (folder)""")
def told_apart_names(spark, d):
    """Names of runs: the folder, its class where it has several, a number where both agree."""
    cls = F.when(F.col("s_acctbal") < 0, "A").when(F.col("s_nationkey") % 2 == 0, "B").otherwise("A")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("folder"), cls.alias("cls"))
    return aggregates.display_names(s, "folder", "cls", ["s_suppkey"]).select("s_suppkey", "display_name")


@query("SELECT l_orderkey AS text, l_returnflag AS label, l_linenumber AS position, l_extendedprice AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def winning_candidates(spark, d):
    """Per text and label the candidate of the greatest confidence, the first of equals."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("text"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("position"), F.col("l_extendedprice").alias("confidence"))
    return metrics.best_candidates(rows, "text", "label", "confidence", "position")


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN starts_with(o_orderpriority, '1') THEN 'first' WHEN starts_with(o_orderpriority, '2-H') THEN 'second' ELSE 'rest' END AS role FROM orders WHERE NOT starts_with(o_orderpriority, '3')")
def roles_by_prefix(spark, d):
    return filters.by_prefix(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"1": "first", "2-H": "second", "2": "never", "4": "rest", "5": "rest"})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def not_processed_yet(spark, d):
    done = table(spark, d, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.unprocessed(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT record_id FROM raw_records WHERE core_text IS NOT NULL AND trim(core_text) <> ''")
def non_blank_texts(spark, d):
    r = table(spark, d, "raw_records")
    return r.filter(filters.non_blank("core_text")).select("record_id")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def one_row_by_key(spark, d):
    """The columns of one key, and only those that a caller may ask for."""
    n = table(spark, d, "nation")
    return filters.allowed_columns(filters.point(n, "n_nationkey", 7, "n_name", "n_regionkey"), ["n_name", "n_regionkey", "other"])


@query("SELECT array_to_string(['kpi_current_value', 'kpi_trend', 'nps_value_fix'], '|') AS columns, CAST(count(*) AS BIGINT) AS n FROM classifications")
def result_columns(spark, d):
    """The columns of results beside the keys, in order."""
    c = table(spark, d, "classifications")
    return c.agg(F.count("*").alias("n")).select(F.lit("|".join(filters.result_columns(c))).alias("columns"), "n")


@query("SELECT o_orderstatus, 'batch=8, key=' || o_orderstatus || ', quick' AS options FROM orders GROUP BY ALL")
def compacted_options(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus").distinct()
    made = F.create_map(F.lit("quick"), F.lit("True"), F.lit("key"), F.col("o_orderstatus"), F.lit("batch"), F.lit("8"))
    return o.select("o_orderstatus", strings.compact_options(made).alias("options"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_extendedprice - l_quantity * 1000) <= 5 THEN 'a' WHEN abs(l_extendedprice - l_quantity * 2000) <= 5 THEN 'b' END AS named FROM (SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice / 1000) * 1000 AS l_extendedprice FROM lineitem)")
def values_matched(spark, d):
    """The first of several columns that a number agrees with, up to a tolerance."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.round(F.col("l_extendedprice") / 1000) * 1000).alias("v"), (F.col("l_quantity") * 1000).alias("a"), (F.col("l_quantity") * 2000).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", joins.first_close_column(rows, "v", ["a", "b"]).alias("named"))


@query("SELECT decision, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'accepted' AS decision FROM context_windows WHERE similarity_score >= 0.5 AND NOT isnan(similarity_score) UNION ALL SELECT 'rejected' FROM context_windows WHERE NOT coalesce(similarity_score >= 0.5 AND NOT isnan(similarity_score), FALSE)) GROUP BY ALL")
def both_decisions(spark, d):
    """Accepted and rejected windows in one bag."""
    w = table(spark, d, "context_windows").select(filters.decision("similarity_score", 0.5).alias("x"))
    both = w.filter("x = 'accept'").select(F.lit("accepted").alias("decision")).unionByName(w.filter("x = 'reject'").select(F.lit("rejected").alias("decision")))
    return both.groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_acctbal, CAST(floor(c_acctbal / 1000 + 1e-9) AS INT) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(c_acctbal / 1000 + 1e-9) AS INT) ORDER BY sha256(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey) AS r FROM customer WHERE CAST(floor(c_acctbal / 1000 + 1e-9) AS INT) < (SELECT ceil(max(c_acctbal) / 1000 - 1e-9) FROM customer)) WHERE r <= 5")
def bucket_sample(spark, d):
    """Up to five rows of each bucket of the data's own range, by a hash of the key."""
    return sampling.bucket_sample(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5, 1000.0)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 20")
def shuffled_head(spark, d):
    """The head of a seeded order."""
    return sampling.shuffled_head(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 20)


@query("SELECT c_custkey, ('0x' || left(sha256(CAST(c_custkey AS VARCHAR) || ':42'), 8))::BIGINT < 4294967296 * 0.5 AS is_test FROM customer")
def hashed_split(spark, d):
    """A split into halves by a hash of the key, the same at any size and in any engine."""
    return sampling.hash_split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(t) AS BIGINT) AS tests FROM (SELECT CASE WHEN row_number() OVER (ORDER BY id) <= ceil(count(*) OVER () * 0.5) THEN 1 ELSE 0 END AS t FROM classifications)")
def holdout_sizes(spark, d):
    """A seeded permutation's halves have the sizes that they must have (which rows is tested against numpy)."""
    h = sampling.holdout(table(spark, d, "classifications").select("id"), ["id"])
    return h.agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("long")).alias("tests"))


@query("SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(rank() OVER (ORDER BY sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) DESC) AS INT) AS place FROM orders GROUP BY o_orderpriority")
def label_counts(spark, d):
    per = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return per.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))  # five labels
