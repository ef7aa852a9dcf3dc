"""Queries that apply models to windows, and how well and how fast they do."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from .catalog import query, rounded
from .config import Category
from .functions import values, vectors
from .models import base
from .operators import aggregates, metrics, sampling
from .plans import process
from .session import table

ANSWERS = Category.of({"name": "answers", "properties": [{"name": "rose", "description": "rose", "type": "bool"}, {"name": "fell", "description": "fell", "type": "bool"}, {"name": "letters", "description": "letters", "type": "int"}]})
FLAGS = Category.of({"name": "flags", "properties": [{"name": "rose", "description": "rose", "type": "bool"}, {"name": "long", "description": "long", "type": "bool"}]})
#: Labelled windows that a classifier of a query is fitted on at most; all windows are classified.
TRAINING_ROWS = 2_000


def answering():
    """An adapter in place of a language model: it answers by plain rules, in the forms that models answer in."""

    def complete(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            text = prompt.rsplit("\n\nText: ", 1)[1].lower()
            answer = json.dumps({"rose": "rose" in text, "fell": "fell" in text, "letters": text.count("e")})
            out.append(f"<think>{{}} hm</think>```json\n{answer}\n```" if len(text) % 3 else answer if len(text) % 2 else f"Sure: {answer}")
        return out

    return complete


def letter_logits():
    return lambda texts: np.array([[t.lower().count("e") - 30, t.lower().count("n") - 60] for t in texts], np.float32)


_ANSWERED = """a AS (SELECT window_id, id, context, lower(context) AS t, length(context) % 3 <> 0 OR length(context) % 2 <> 0 AS ok FROM context_windows WHERE context IS NOT NULL AND context <> ''),
b AS (SELECT window_id, id, coalesce(ok AND contains(t, 'rose'), FALSE) AS rose, coalesce(ok AND contains(t, 'fell'), FALSE) AS fell, CASE WHEN ok THEN CAST(length(t) - length(replace(t, 'e', '')) AS INT) END AS letters FROM a)"""


@query(f"WITH {_ANSWERED} SELECT window_id, rose, fell, letters, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL")
def language_answers(spark, d):
    """Windows classified by a language model's answers: fences and reasoning cut off, prose gives the defaults."""
    w = table(spark, d, "context_windows").filter("context IS NOT NULL AND context <> ''").select("window_id", "context")
    said = base.make("llm", ANSWERS, make=answering).classify(w, "context")
    return said.select("window_id", "answer.*").groupBy("window_id", "rose", "fell", "letters").agg(F.count("*").alias("n"))


@query("SELECT window_id, coalesce(length(context) - length(replace(lower(context), 'e', '')) - 30 >= 0, FALSE) AS rose, coalesce(length(context) - length(replace(lower(context), 'n', '')) - 60 >= 0, FALSE) AS long, CAST(count(*) AS BIGINT) AS n FROM context_windows GROUP BY ALL")
def multi_label_answers(spark, d):
    """Windows classified by an encoder's logits."""
    w = table(spark, d, "context_windows").select("window_id", "context")
    said = base.make("multi_label", FLAGS, logits=letter_logits).classify(w, "context")
    return said.select("window_id", "answer.*").groupBy("window_id", "rose", "long").agg(F.count("*").alias("n"))


@query(f"WITH {_ANSWERED} SELECT id, bool_or(rose) AS rose, bool_or(fell) AS fell FROM b WHERE id IS NOT NULL GROUP BY id")
def classified_filings(spark, d):
    """Several categories applied to windows, rolled up by filing: a flag that any window has stays."""
    w = table(spark, d, "context_windows").filter("context IS NOT NULL AND context <> '' AND id IS NOT NULL").select("id", "window_id", "context", "hit_sentence_index")
    flags = Category.of({"name": "long", "properties": [{"name": "wide", "description": "wide", "type": "bool"}]})
    models = [(ANSWERS, base.make("llm", ANSWERS, make=answering)), (flags, base.make("multi_label", flags, logits=letter_logits))]
    out = process.classify(w, models)
    return process.roll_up(out, [ANSWERS, flags], "id", ("hit_sentence_index", "window_id")).select("id", "rose", "fell")


@query("SELECT class, CAST(count(*) AS BIGINT) AS support FROM (SELECT CASE WHEN contains(lower(context), 'rose') THEN 'true' ELSE 'false' END AS class FROM context_windows WHERE context IS NOT NULL AND context <> '') GROUP BY ALL")
def evaluated_model(spark, d):
    """A model held against labelled rows: the supports of its report."""
    w = table(spark, d, "context_windows").filter("context IS NOT NULL AND context <> ''").select("context", F.contains(F.lower("context"), F.lit("rose")).cast("int").alias("rose"), F.lit(0).alias("long"))
    report, _ = base.make("multi_label", FLAGS, logits=letter_logits).evaluate(w, "context")
    return report.filter("property = 'rose' AND class IN ('true', 'false')").select("class", F.col("support").cast("long").alias("support"))


@query("SELECT window_id FROM context_windows")
def classified_windows(spark, d):
    """All windows classified by linear machines fitted on a bounded sample of labelled ones (their answers are tested on held-out rows)."""
    w = table(spark, d, "context_windows").select("window_id", "context")
    labelled = sampling.shuffled_head(w.filter("context IS NOT NULL").withColumns({"rose": F.contains(F.lower("context"), F.lit("score")).cast("string"), "long": (F.length("context") > 700).cast("string")}), "window_id", TRAINING_ROWS)
    model = base.EmbeddingSVM(FLAGS).train(labelled, "context")
    return model.classify(w, "context").filter("answer.rose IS NOT NULL AND answer.long IS NOT NULL").select("window_id")


@query("SELECT model, reference_text_id, CAST(count(*) AS BIGINT) AS n, round(sum(s), 3) AS total FROM (SELECT 'letters' AS model, 'V1' AS reference_text_id, round(coalesce(list_cosine_similarity(v, r), 0), 6) AS s FROM (SELECT " + "[" + ", ".join(f"len(lower(context)) - len(replace(lower(context), '{ch}', ''))" for ch in "abcdefghijklmnopqrstuvwxyz") + "]::DOUBLE[] AS v, " + "[" + ", ".join(str("customer loyalty".count(ch)) for ch in "abcdefghijklmnopqrstuvwxyz") + "]::DOUBLE[] AS r FROM context_windows WHERE context IS NOT NULL)) GROUP BY ALL")
def score_grid(spark, d):
    """Windows scored by every embedder against every reference text."""
    w = table(spark, d, "context_windows").filter("context IS NOT NULL").select("window_id", "context")
    grid = process.score_grid(w, {"V1": "customer loyalty"}, {"letters": vectors.LetterEmbedder})
    return rounded(grid.groupBy("model", "reference_text_id").agg(F.count("*").alias("n"), F.sum("similarity_score").alias("total")), 3)


@query("SELECT window_id, 26 AS size, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN context IS NULL THEN NULL ELSE length(context) - length(replace(lower(context), 'e', '')) END)::INT AS e FROM context_windows WHERE context IS NOT NULL GROUP BY window_id")
def embedded_windows(spark, d):
    """Texts embedded in batches by length, each vector with its own text."""
    w = table(spark, d, "context_windows").filter("context IS NOT NULL")
    v = w.select("window_id", vectors.embed("context", vectors.LetterEmbedder, 64).alias("v"))
    return v.groupBy("window_id").agg(F.max(F.size("v")).alias("size"), F.count("*").alias("n"), F.max(F.col("v")[4].cast("int")).alias("e"))


@query("SELECT o_orderpriority AS class, CAST(count(*) AS BIGINT) AS n, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most FROM orders GROUP BY ALL")
def class_counts(spark, d):
    """How many rows each class has, as training checks it, and the range of its values."""
    o = table(spark, d, "orders")
    return rounded(aggregates.value_range(o.select(F.col("o_orderpriority").alias("class"), "o_totalprice"), "class", "o_totalprice").join(o.groupBy(F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("n")), "class").select("class", "n", "least", "most"), 2)


@query("WITH c AS (SELECT filing_id, experiment_version, nps_value_fix AS v, row_number() OVER (PARTITION BY filing_id, experiment_version ORDER BY id) AS r FROM classifications) SELECT experiment_version, CAST(count(*) FILTER (v IS NOT NULL AND NOT isnan(v)) AS BIGINT) AS given, CAST(count(*) FILTER (v IS NULL OR isnan(v)) AS BIGINT) AS missing FROM c WHERE r = 1 GROUP BY ALL")
def labels_with_values(spark, d):
    """Of each version's first rows: those with a number and those without."""
    first = metrics.best_per_group(table(spark, d, "classifications").withColumn("k", F.concat_ws("|", "filing_id", "experiment_version")), "k", ["id"])
    v = values.as_number(F.col("nps_value_fix"))
    return first.groupBy("experiment_version").agg(F.count(v).alias("given"), F.count_if(v.isNull()).alias("missing"))
