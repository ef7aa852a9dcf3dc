"""Plans: raw records to scored windows, windows to classified filings, filings to exports."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Category, ProcessConfig
from ..functions import html, vectors, windows
from ..models.base import Model
from ..operators import aggregates, filters, joins
from ..session import cut
from ..sources import writers


def may_mention(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text with markup can mention a phrase once it is cleaned; never false for one that does.

    Cleaning parts words but never joins letters, but for signatures and references (``&#110;``, ``&fjlig;``), which pass
    as they are. So the letters and digits between a phrase's other characters must stand in the text already.
    """
    low, letters = F.lower(text), set("".join(phrases))
    out = F.contains(low, F.lit("&#")) | F.contains(low, F.lit("/s/"))
    names = sorted(n for n, v in html5.items() if any(ch.isalnum() and ch in letters for ch in v.lower()))
    if names:
        out = out | text.rlike("&(?:" + "|".join(names) + ")")
    for p in phrases:
        every = F.lit(True)
        for word in re.findall(r"[^\W_]+", p):
            every = every & F.contains(low, F.lit(word))
        out = out | every
    return out


def clean(records: DataFrame, config: ProcessConfig, key: str = "id", text: str = "core_text") -> DataFrame:
    """``records`` with cleaned texts; those whose cleaned text can't mention a phrase are left out, as they give no window.

    The tests are native. They look at the text as cleaning leaves it: with plain spaces, or by the phrases' words where
    there is markup. A text without markup is only respaced, in the JVM.
    """
    phrases, plain_text = config.rule.phrases, html.plain_spaces(F.col(text))
    some = F.contains(F.lower(F.col(text)), F.lit("/s/"))  # a signature's end may join what stood around it
    for p in phrases:
        some = some | F.contains(F.lower(plain_text), F.lit(p))
    marked = F.contains(F.col(text), F.lit("<")) | F.contains(F.col(text), F.lit("&"))
    parsed = records.filter(marked & may_mention(F.col(text), phrases)).withColumn(text, html.clean_html(text, list(phrases), list(config.rule.excluded)))
    plain = records.filter(~marked & some).withColumn(text, html.strip_signatures(F.trim(plain_text)))
    return parsed.unionByName(plain)


def extract(records: DataFrame, config: ProcessConfig, key: str = "id", text: str = "core_text") -> tuple[DataFrame, DataFrame]:
    """The folded windows of records, and (key, excluded_count) of the records that an excluded phrase drops.

    The windows are cut into a table once, as several steps read them; they are small beside the texts.
    """
    found = cut(windows.context_windows(records, key, text, config.rule), "windows")
    kept, excluded = windows.exclude_documents(found, key, config.rule.excluded)
    return windows.fold_windows(kept, key), excluded


def score(found: DataFrame, config: ProcessConfig, make: Callable = vectors.HashingEmbedder, text: str = "context", into: str = "similarity_score") -> DataFrame:
    """Windows with their cosine to the reference text, rounded to 4 digits; each distinct text is embedded once."""
    reference = np.asarray(make()([config.reference])[0], float).tolist()
    keyed = found.withColumn("__d", F.md5(F.col(text).cast("binary")))  # texts are told apart by digest, so that few are shuffled
    distinct = keyed.groupBy("__d").agg(F.first(text).alias("__t")).withColumn("__v", vectors.embed("__t", make))
    scored = distinct.select("__d", vectors.round_exactly(vectors.cosine("__v", reference), 4).alias(into))
    return keyed.join(scored, "__d", "left").drop("__d")


def run(records: DataFrame, config: ProcessConfig, keywords: DataFrame | None = None, key: str = "id", text: str = "core_text", make: Callable = vectors.HashingEmbedder) -> tuple[DataFrame, DataFrame]:
    """(key, window columns, similarity_score, in_scope, decision) of all windows, and (key, excluded_count) of excluded records.

    ``keywords`` has (key, keywords); filings out of the threshold's scope are accepted and never embedded.
    """
    found, excluded = extract(clean(records, config, key, text), config, key, text)
    if keywords is None:
        scoped = found.withColumn("in_scope", F.lit(config.scope.keywords is None))
    else:
        scope = keywords.select(key, filters.in_scope("keywords", config.scope).alias("in_scope"))
        scoped = found.join(scope, key, "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(config.scope.keywords is None)))
    scored = score(scoped.filter("in_scope"), config, make)
    free = scoped.filter("NOT in_scope").withColumn("similarity_score", F.lit(None).cast("double"))
    both = scored.unionByName(free)
    return both.withColumn("decision", filters.decision("similarity_score", config.threshold, F.col("in_scope"))), excluded


def process(records: DataFrame, config: ProcessConfig, keywords: DataFrame | None = None, key: str = "id", text: str = "core_text", make: Callable = vectors.HashingEmbedder) -> DataFrame:
    """The windows of :func:`run` alone."""
    return run(records, config, keywords, key, text, make)[0]


def nested(decided: DataFrame, key: str = "id") -> DataFrame:
    """(key, status, context): a record per filing and status with its windows in order."""
    one = F.struct("hit_sentence_index", "matched_phrase", "context", "context_start_index", "context_end_index", "char_cutoff_applied", "similarity_score")
    return decided.groupBy(key, F.concat("decision", F.lit("ed")).alias("status")).agg(F.array_sort(F.collect_list(one)).alias("context"))


def summary(decided: DataFrame, all_keys: DataFrame, excluded: DataFrame, key: str = "id") -> DataFrame:
    """One row of run counters over all records."""
    s = F.col("similarity_score")
    per = decided.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "accept").alias("accepted"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.round(F.avg(s), 4).alias("filings_average"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.sum(s).alias("sum_score"))
    rows = all_keys.select(key).distinct().join(per, key, "left").join(excluded.select(key, F.col("excluded_count").alias("excluded")), key, "left")
    return aggregates.run_summary(rows.fillna(0, ["total", "accepted", "rejected", "excluded"]))


def classify(decided: DataFrame, models: list[tuple[Category, Model]], key: str = "id", text: str = "context") -> DataFrame:
    """Windows with one column per property of all categories."""
    out = decided
    for k, (category, model) in enumerate(models):
        out = model.classify(out, text, f"__m{k}")
        out = out.withColumns({p.name: F.col(f"__m{k}.{p.name}") for p in category.properties}).drop(f"__m{k}")
    return out


def roll_up(classified: DataFrame, categories: list[Category], key: str = "id", order: tuple[str, ...] = ("hit_sentence_index", "context_start_index", "matched_phrase")) -> DataFrame:
    """One row per filing: per property the last value, in window order, that isn't the default."""
    defaults = {p.name: p.default for c in categories for p in c.properties}
    return aggregates.last_non_default(classified, key, list(order), defaults)


def export(main: DataFrame, results: DataFrame | None, version: str, only_relevant: bool = False) -> DataFrame:
    """The main table with one version's results, one row per ticker."""
    rows = main.filter(filters.flag("project_relevant")) if only_relevant else main
    joined = rows if results is None else joins.with_version(rows, results, version)
    return writers.csv_ready(joins.atoms(joined, "ticker"))


def export_selected(main: DataFrame, path: str, results: DataFrame | None = None, version: str = "", relevant: bool = False, keyword: str | None = None, strict: bool = False) -> None:
    """The export as CSV of filings chosen by relevance and by a keyword (``strict``: their only one)."""
    rows = main if keyword is None else main.filter(filters.has_keyword("keywords", keyword, strict))
    writers.write_csv(export(rows, results, version, relevant), path)


def score_grid(contexts: DataFrame, references: dict[str, str], makes: dict[str, Callable], text: str = "context") -> DataFrame:
    """Every context's score by every embedder and reference text: each text is embedded once per embedder."""
    out = None
    for model, make in makes.items():
        embedded = contexts.withColumn("__v", vectors.embed(text, make))
        vectors_of = {r: np.asarray(make()([t])[0], float).tolist() for r, t in references.items()}
        cells = F.array(*[F.struct(F.lit(model).alias("model"), F.lit(r).alias("reference_text_id"), F.round(vectors.cosine("__v", v), 6).alias("similarity_score")) for r, v in vectors_of.items()])
        part = embedded.select(*contexts.columns, F.explode(cells).alias("s")).select(*contexts.columns, "s.*")
        out = part if out is None else out.unionByName(part)
    return out

