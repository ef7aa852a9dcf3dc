"""Evaluation: thresholds, reports, curves, frontiers. All are aggregates; labels and scores are joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import grid, small
from .running import running, spread


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    out = F.try_divide(a, b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def with_rates(df: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """(tp, fp, fn, tn) with precision, recall and f1; ``empty`` is precision's value without predictions."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    shown = p if empty == 0.0 else F.when(F.col("tp") + F.col("fp") > 0, p)
    return df.withColumn("precision", shown).withColumn("recall", r).withColumn("f1", f1(p, r))


def confusion(df: DataFrame, truth: Column, said: Column, by: list[str]) -> DataFrame:
    """(by…, tp, fp, fn, tn); null counts as false."""
    t, s = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))


def threshold_sweep(df: DataFrame, score: str, truth: Column, thresholds: list[float], by: list[str] | None = None, empty: float | None = 0.0) -> DataFrame:
    """(by…, threshold, tp, fp, fn, tn, precision, recall, f1) of a score at each threshold; a null score is below all.

    Rows fold into one count per (group, truth, number of thresholds reached) first, so the grid never multiplies rows.
    """
    by = by or []
    steps = sorted(set(map(float, thresholds)))
    reached = sum((F.coalesce(F.col(score) >= t, F.lit(False)).cast("int") for t in steps), F.lit(0))
    folded = df.groupBy(*by, F.coalesce(truth, F.lit(False)).alias("__t"), reached.alias("__r")).agg(F.count("*").alias("__n"))
    wide = folded.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(len(steps))))).withColumn("threshold", F.element_at(F.array(*map(F.lit, steps)), F.col("__k")))
    said = F.col("__r") >= F.col("__k")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("__n"))), F.lit(0)).cast("long")

    counts = wide.groupBy(*by, "threshold").agg(total(F.col("__t") & said).alias("tp"), total(~F.col("__t") & said).alias("fp"), total(F.col("__t") & ~said).alias("fn"), total(~F.col("__t") & ~said).alias("tn"))
    return with_rates(counts, empty)


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group the row of the greatest f1; the lowest threshold of equals."""
    by = by or []
    rest = [c for c in sweep.columns if c not in by]
    return sweep.groupBy(*by).agg(F.max(F.struct(F.col("f1").alias("a"), (-F.col("threshold")).alias("b"), F.struct(*rest).alias("r"))).alias("m")).select(*by, "m.r.*")


def classification_report(df: DataFrame, truth: str, said: str, by: list[str] | None = None) -> DataFrame:
    """(by…, class, precision, recall, f1, support): one row per class, and rows ``accuracy``, ``macro avg``, ``weighted avg``.

    Classes are those of truth or prediction. Rates are 0 on a zero denominator.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(truth).cast("string").alias("t"), F.col(said).cast("string").alias("s")).agg(F.count("*").alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit(True).alias("real"), F.lit(False).alias("guess"), "t", "s", "n"), F.struct(F.col("s").alias("class"), F.lit(False).alias("real"), F.lit(True).alias("guess"), "t", "s", "n"))).alias("x")).select(*by, "x.*").filter(F.col("class").isNotNull())

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    per = sides.groupBy(*by, "class").agg(total(F.col("real")).alias("support"), total(F.col("guess")).alias("guessed"), total(F.col("real") & (F.col("t") == F.col("s"))).alias("tp"))
    p, r = _ratio(F.col("tp"), F.col("guessed")), _ratio(F.col("tp"), F.col("support"))
    rows = per.select(*by, "class", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), F.col("support").cast("long").alias("support"), "tp")
    whole = rows.groupBy(*by).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").cast("long").alias("support"), _ratio(F.sum("tp"), F.sum("support")).alias("a"),
    )
    extra = whole.select(*by, "support", F.explode(F.array(*[F.struct(F.lit(n).alias("class"), *[F.col(f"{k}_{c}" if k else "a").alias(c) for c in ("precision", "recall", "f1")]) for n, k in (("accuracy", ""), ("macro avg", "m"), ("weighted avg", "w"))])).alias("x"))
    return rows.drop("tp").unionByName(extra.select(*by, "x.class", "x.precision", "x.recall", "x.f1", "support"))


def normalised_confusion(df: DataFrame, truth: str, said: str, by: list[str] | None = None) -> DataFrame:
    """(by…, truth, said, n, share): counts, and shares of their truth's row."""
    by = by or []
    cells = df.groupBy(*by, F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(*by, "truth")), F.lit(1)))


def pr_curve(df: DataFrame, score: str, truth: Column, by: list[str]) -> DataFrame:
    """(by…, score, tp, fp, precision, recall): one row per distinct score, from the greatest down.

    Rows fold by score before the running sums, which pass over distinct scores only.
    """
    steps = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(truth).alias("p"), F.count_if(~F.coalesce(truth, F.lit(False))).alias("n"))
    steps = cut(steps.withColumn("__one", F.lit(0)), "steps")
    place, groups = spread(steps, "score", descending=True), [*by, "__one"]
    sums = running(running(steps, groups, place, [F.desc("score")], "p", "tp"), groups, place, [F.desc("score")], "n", "fp")
    whole = steps.groupBy(*groups).agg(F.sum("p").alias("__all"))
    sums = sums.join(small(whole), groups)
    return sums.select(*by, "score", "tp", "fp", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("__all")).alias("recall"))


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by…, average_precision): sum of the steps of recall times precision."""
    # a step of recall is the true cases of its score over all of them; the last row has all of them
    last = curve.groupBy(*by).agg(F.max("tp").alias("__all"))
    once = curve.withColumn("__one", F.lit(0))
    before = running(once, [*by, "__one"], spread(once, "score", descending=True), [F.desc("score")], "tp", "__prior", "max", inclusive=False)
    step = (F.col("tp") - F.coalesce("__prior", F.lit(0))) / F.col("__all")
    return before.join(small(last), by).groupBy(*by).agg(F.coalesce(F.sum(step * F.col("precision")), F.lit(0.0)).alias("average_precision"))


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean without null and NaN values; null if no weight is left."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    w = F.when(v.isNotNull(), F.col(weight))
    return F.try_divide(F.sum(v * w), F.nullif(F.sum(w), F.lit(0)))


def pareto(df: DataFrame, cost: str, quality: str, by: list[str] | None = None) -> DataFrame:
    """Rows whose quality is greater than that of every cheaper row (or equally cheap row of better quality).

    Rows fold to the best of each cost before the running maximum.
    """
    by = by or []
    best = cut(df.filter(F.col(cost).isNotNull() & F.col(quality).isNotNull()).groupBy(*by, cost).agg(F.max(quality).alias(quality)).withColumn("__one", F.lit(0)), "best")
    ran = running(best, [*by, "__one"], spread(best, cost), [cost], quality, "__b", "max", inclusive=False)
    front = cut(ran.filter(F.col("__b").isNull() | (F.col(quality) > F.col("__b"))).drop("__b", "__one"), "front")
    return df.join(small(front), [*by, cost, quality], "left_semi")


def best_per_group(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__n = 1").drop("__n")


def best_candidates(df: DataFrame, text: str, label: str, confidence: str, position: str) -> DataFrame:
    """Per text and label the candidate of the greatest confidence, the first of equals."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(text, label).orderBy(F.desc(confidence), position))).filter("__n = 1").drop("__n")


def positive_metric(report: DataFrame, metric: str = "f1-score", keys: list[str] = ("model", "label")) -> DataFrame:
    """(keys…, value): a metric of the positive class, named ``1`` or ``True``; null where its support is 0."""
    named = report.filter(F.col("class").isin("1", "True"))
    wide = named.groupBy(*keys, "class").agg(F.max(F.when(F.col("metric") == metric, F.col("value"))).alias("v"), F.max(F.when(F.col("metric") == "support", F.col("value"))).alias("n"))
    one = wide.groupBy(*keys).agg(F.min(F.struct(F.when(F.col("class") == "1", 0).otherwise(1).alias("o"), "v", "n")).alias("x"))
    return one.select(*keys, F.when(F.col("x.n") > 0, F.col("x.v")).alias("value"))


def route_labels(report: DataFrame, block: str, tasks: dict[str, list[str]], keys: list[str] = ("model",)) -> DataFrame:
    """A report in long form with the labels of one task ``block`` given to the tasks that own them.

    Where a model's report has the owning task already, that counts and the block's part is left out. Labels that no
    task owns are left out as well.
    """
    owner = F.lit(None).cast("string")
    for task, labels in tasks.items():
        owner = F.when(F.col("label").isin(labels), F.lit(task)).otherwise(owner)
    own = report.filter(F.col("task") != block)
    moved = report.filter(F.col("task") == block).withColumn("task", owner).filter(F.col("task").isNotNull())
    return own.unionByName(moved.join(own.select(*keys, "task").distinct(), [*keys, "task"], "left_anti").select(own.columns))


def supports(report: DataFrame, keys: list[str] = ("label",)) -> DataFrame:
    """(keys…, support, value_support, n_test) of reports in long form."""
    s = F.when(F.col("metric") == "support", F.col("value"))
    return report.groupBy(*keys).agg(F.max(F.when(F.col("class").isin("1", "True"), s)).alias("support"), F.max(F.when(F.col("class") == "correct_value", s)).alias("value_support"), F.max(F.when(F.col("class") == "macro avg", s)).alias("n_test"))


def metric_frame(values: DataFrame, labels: list[str], row: str = "model", label: str = "label", value: str = "value") -> DataFrame:
    """One row per model, one column per label, and the mean of the labels that have a value."""
    from .aggregates import pivot_best, row_mean

    wide = pivot_best(values, row, label, labels, value)
    return wide.withColumn("mean", row_mean(labels)).orderBy(F.desc_nulls_last("mean"), row)


def matrix_with_weighted_mean(values: DataFrame, weights: DataFrame, labels: list[str], row: str = "model") -> DataFrame:
    """The metric frame with a trailing mean weighted by support, rows without one last."""
    weighted = values.join(weights, "label").groupBy(row).agg(weighted_mean("value", "support").alias("weighted_mean"))
    return metric_frame(values, labels, row).drop("mean").join(weighted, row, "left").orderBy(F.desc_nulls_last("weighted_mean"), row)


def quality_and_cost(best: DataFrame, cost: str = "ms") -> DataFrame:
    """Points with a positive cost."""
    return best.filter(F.col(cost) > 0)


def head_to_head(values: DataFrame, models: list[str], a: str, b: str, label: str = "label", model: str = "model", value: str = "value") -> DataFrame:
    """(label, models…, lead, winner): one column per model, the lead of ``a`` over ``b``, and which of them is ahead."""
    from .aggregates import pivot_best

    wide = pivot_best(values, label, model, models, value)
    return wide.withColumn("lead", F.col(a) - F.col(b)).withColumn("winner", F.when(F.col(a) > F.col(b), a).when(F.col(a) < F.col(b), b).otherwise("even"))


def approach_means(values: DataFrame, groups: dict[str, str], otherwise: str, model: str = "model", value: str = "value") -> DataFrame:
    """(group, model, mean, labels): mean over the labels with a value, groups in order, the best model of each first."""
    group = F.lit(otherwise)
    for name, of in groups.items():
        group = F.when(F.col(model) == name, F.lit(of)).otherwise(group)
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return values.groupBy(group.alias("group"), model).agg(F.avg(known).alias("mean"), F.count(known).alias("labels")).orderBy("group", F.desc_nulls_last("mean"), model)


def agreement(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(property, tp, fp, fn, tn, precision, recall, support) of truth and prediction columns; null rates on a zero denominator."""
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("property"), F.col(t).alias("t"), F.col(s).alias("s")) for t, s in pairs]))
    counts = confusion(df.select(parts.alias("x")).select("x.*"), F.col("t"), F.col("s"), ["property"])
    return counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "support": F.col("tp") + F.col("fn")})


__all__ = [n for n in dir() if not n.startswith("_")] + ["grid"]
