"""Classification models: one interface, a registry, and training on labelled tables.

A model turns a text column into a struct of its category's properties. Models are trained with ``pyspark.ml`` on the
labelled table (hundreds to some thousands of rows) and applied to any number of rows in the JVM or by Arrow batches.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Category, stable_id
from ..functions import values
from ..functions.vectors import HashingEmbedder, dot, embed
from ..operators.metrics import best_candidates, classification_report
from ..session import cut

REGISTRY: dict[str, type[Model]] = {}
_made: dict[str, Model] = {}
#: Usual model names, as a model here with its options, and other names for them.
PRESETS: dict[str, tuple[str, dict]] = {
    "bge_base": ("embedding_svm", {}),
    "bge_advanced": ("embedding_svm", {"shared": False, "instruction": "{property}: "}),
    "bge_svm": ("unified", {}),
    "qwen_advanced": ("embedding_svm", {"shared": False, "instruction": "Instruct: {property}\nQuery: "}),
    "qwen_candidate": ("numeric_candidates", {}),
    "svm": ("unified", {}),
    "deberta_base": ("multi_label", {}),
    "llm": ("language_model", {}),
    "ollama_llm": ("language_model", {}),
    "openai": ("language_model", {}),
}
ALIASES = {"hf_llm": "llm", "qwen_unified": "svm"}


class NotTrained(RuntimeError):
    """A model that has to be trained is asked to classify."""


class NotSupported(RuntimeError):
    """A model can't handle a category's properties."""


class Model(ABC):
    """Base of all models; subclasses are registered by name."""

    name = ""

    def __init_subclass__(cls, **kwargs) -> None:
        super().__init_subclass__(**kwargs)
        if cls.name:
            REGISTRY[cls.name] = cls

    def __init__(self, category: Category, **options) -> None:
        self.category, self.options = category, options
        unsupported = [p.name for p in category.properties if not self.supports(p.type)]
        if unsupported:
            raise NotSupported(f"{self.name or type(self).__name__}: {', '.join(unsupported)}")

    def supports(self, kind: str) -> bool:
        return True

    @property
    def is_trained(self) -> bool:
        return True

    def train(self, df: DataFrame, text: str) -> Model:
        return self

    @abstractmethod
    def classify(self, df: DataFrame, text: str, into: str = "answer") -> DataFrame:
        """``df`` with a struct of the properties; null and empty texts get the defaults."""

    def evaluate(self, df: DataFrame, text: str, into: str = "answer") -> tuple[DataFrame, float]:
        """(report in long form by property, seconds per row): how the model does on labelled rows."""
        if not self.is_trained:
            raise NotTrained(self.name)
        began = time.monotonic()
        said = cut(self.classify(df, text, into), "said")
        rows = said.count()
        seconds = (time.monotonic() - began) / max(1, rows)
        parts = []
        for p in self.category.properties:
            truth = values.as_property(F.col(p.name), p.type)
            guess = F.col(f"{into}.{p.name}")
            if p.default is None:
                truth, guess = values.value_label(truth, truth), values.value_label(truth, guess)
            parts.append(F.struct(F.lit(p.name).alias("property"), truth.cast("string").alias("truth"), guess.cast("string").alias("said")))
        long = said.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
        return classification_report(long, "truth", "said", ["property"]), seconds

    def to_dict(self) -> dict:
        return {"class_name": type(self).name, "category": self.category.to_dict(), "options": {k: v for k, v in self.options.items() if isinstance(v, (str, int, float, bool, type(None)))}}


def make(name: str, category: Category, **options) -> Model:
    """A model by name or preset, in any case; the same name, category and plain options give the same instance."""
    name = ALIASES.get(name.lower(), name.lower())
    name, preset = PRESETS.get(name, (name, {}))
    cls, options = REGISTRY[name], {**preset, **options}
    key = stable_id([name, category.to_dict(), {k: repr(v) for k, v in sorted(options.items())}])
    if key not in _made:
        _made[key] = cls(category, **options)
    return _made[key]


def from_dict(values_: dict, **options) -> Model:
    return make(values_["class_name"], Category.of(values_["category"]), **{**values_.get("options", {}), **options})


class EmbeddingSVM(Model):
    """One linear SVM per boolean property over an embedding, shared or one per property with its instruction.

    Options: ``make`` (embedder factory), ``shared`` (default true), ``instruction`` (prefix, ``{property}`` is filled),
    ``normalise`` (default true), ``reg``, ``iterations``.
    """

    name = "embedding_svm"

    def __init__(self, category: Category, **options) -> None:
        super().__init__(category, **options)
        self.models: dict[str, tuple[object, LinearSVCModel]] = {}

    def supports(self, kind: str) -> bool:
        return values.property_type(kind).typeName() == "boolean"

    @property
    def is_trained(self) -> bool:
        return len(self.models) == len(self.category.properties)

    def _vector(self, text: str, prop: str) -> Column:
        factory: Callable = self.options.get("make", HashingEmbedder)
        prefix = self.options.get("instruction", "").format(property=prop)
        said = F.coalesce(F.col(text), F.lit(""))
        return embed(F.concat(F.lit(prefix), said) if prefix and not self.options.get("shared", True) else said, factory, unit=self.options.get("normalise", True))

    def train(self, df: DataFrame, text: str) -> EmbeddingSVM:
        """Fit on the rows with a text; per property on those with a label. A label of one kind gives a constant."""
        rows = df.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
        # embedded once for all properties
        shared = cut(rows.withColumn("__a", self._vector(text, "")), "embedded").withColumn("__v", array_to_vector("__a")) if self.options.get("shared", True) else None
        for p in self.category.properties:
            base = shared if shared is not None else rows.withColumn("__v", array_to_vector(self._vector(text, p.name)))
            labelled = base.filter(F.col(p.name).isNotNull()).withColumn("__y", values.truthy(F.col(p.name)))
            kinds = [r["__y"] for r in labelled.select("__y").distinct().limit(2).collect()]
            if len(kinds) < 2:
                self.models[p.name] = (None, bool(kinds and kinds[0]))
                continue
            scaler = StandardScaler(inputCol="__v", outputCol="__x", withMean=True, withStd=True).fit(labelled)
            svm = LinearSVC(featuresCol="__x", labelCol="__y", regParam=self.options.get("reg", 0.01), maxIter=self.options.get("iterations", 50)).fit(scaler.transform(labelled))
            self.models[p.name] = (scaler, svm)
        return self

    def classify(self, df: DataFrame, text: str, into: str = "answer") -> DataFrame:
        if not self.is_trained:
            raise NotTrained(self.name)
        shared, out = self.options.get("shared", True), df
        if shared:
            out = out.withColumn("__v", array_to_vector(self._vector(text, "")))
        fields = []
        for n, p in enumerate(self.category.properties):
            scaler, svm = self.models[p.name]
            if scaler is None:
                fields.append(F.lit(svm).alias(p.name))
                continue
            if not shared:
                out = out.withColumn("__v", array_to_vector(self._vector(text, p.name)))
            out = scaler.copy({scaler.outputCol: f"__x{n}"}).transform(out)
            out = svm.copy({svm.featuresCol: f"__x{n}", svm.predictionCol: f"__p{n}", svm.rawPredictionCol: f"__r{n}"}).transform(out)
            fields.append((F.col(f"__p{n}") == 1).alias(p.name))
        return out.withColumn(into, F.struct(*fields)).select(*df.columns, into)


class CandidateModel(Model):
    """Numeric properties: every number of a text is classified with its surroundings; per property the surest wins.

    Options: ``make``, ``low``, ``high`` (range of the numbers), ``reg``. The classes are the properties and ``none``.
    """

    name = "numeric_candidates"

    def __init__(self, category: Category, **options) -> None:
        super().__init__(category, **options)
        self.model, self.classes = None, []

    def supports(self, kind: str) -> bool:
        return values.property_type(kind).typeName() in ("double", "integer")

    @property
    def is_trained(self) -> bool:
        return self.model is not None

    def _candidates(self, df: DataFrame, key: str, text: str) -> DataFrame:
        found = values.numeric_candidates(df, key, text, self.options.get("low"), self.options.get("high"))
        return found.withColumn("__x", array_to_vector(embed("context", self.options.get("make", HashingEmbedder), unit=True)))

    def train(self, df: DataFrame, text: str) -> CandidateModel:
        """A candidate's class is the first property whose value it equals; labels of fewer than two kinds raise."""
        from ..operators.joins import first_close_column

        names = [p.name for p in self.category.properties]
        rows = cut(df.withColumn("__key", F.monotonically_increasing_id()), "labelled")
        own = {f"__t{k}": n for k, n in enumerate(names)}  # apart from the candidates' columns
        truth = rows.select("__key", *[values.as_number(F.col(n)).alias(t) for t, n in own.items()])
        close = first_close_column(truth, "value", list(own))
        named = F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), close)
        labelled = self._candidates(rows, "__key", text).join(truth, "__key").withColumn("__c", F.coalesce(named, F.lit("none")))
        counts = {r["__c"]: r["count"] for r in labelled.groupBy("__c").count().collect()}
        if len(counts) < 2:
            raise ValueError("the labels have fewer than two classes")
        self.classes = sorted(counts)
        total = sum(counts.values())
        index = F.element_at(F.create_map(*[x for k, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(k)))]), F.col("__c"))
        weight = F.element_at(F.create_map(*[x for c in self.classes for x in (F.lit(c), F.lit(total / len(self.classes) / counts[c]))]), F.col("__c"))
        self.model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=self.options.get("reg", 0.01), family="multinomial", maxIter=50).fit(labelled.withColumn("__y", index).withColumn("__w", weight))
        return self

    def classify(self, df: DataFrame, text: str, into: str = "answer") -> DataFrame:
        """Texts are classified once each; rows with the same text share the answer."""
        if not self.is_trained:
            raise NotTrained(self.name)
        from pyspark.ml.functions import vector_to_array

        texts = df.select(F.col(text).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
        scored = self.model.transform(self._candidates(texts, "__t", "__t")).withColumn("__c", F.element_at(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int") + 1)).withColumn("__s", F.array_max(vector_to_array("probability"))).filter("__c <> 'none'")
        best = best_candidates(scored, "__t", "__c", "__s", "position")
        wide = best.groupBy("__t").agg(*[F.max(F.when(F.col("__c") == p.name, F.col("value"))).cast(values.property_type(p.type)).alias(f"__a{k}") for k, p in enumerate(self.category.properties)])
        answer = F.struct(*[F.col(f"__a{k}").alias(p.name) for k, p in enumerate(self.category.properties)])
        return df.join(wide, F.col(text) == F.col("__t"), "left").withColumn(into, answer).select(*df.columns, into)


class UnifiedModel(Model):
    """Boolean properties by :class:`EmbeddingSVM`, numeric ones by :class:`CandidateModel`, as one answer."""

    name = "unified"

    def __init__(self, category: Category, **options) -> None:
        super().__init__(category, **options)
        kinds = {p: values.property_type(p.type).typeName() == "boolean" for p in category.properties}
        parts = [(EmbeddingSVM, tuple(p for p in category.properties if kinds[p])), (CandidateModel, tuple(p for p in category.properties if not kinds[p]))]
        self.parts = [cls(Category(category.name, props), **options) for cls, props in parts if props]

    @property
    def is_trained(self) -> bool:
        return all(p.is_trained for p in self.parts)

    def train(self, df: DataFrame, text: str) -> UnifiedModel:
        for part in self.parts:
            part.train(df, text)
        return self

    def classify(self, df: DataFrame, text: str, into: str = "answer") -> DataFrame:
        out = df
        for k, part in enumerate(self.parts):
            out = part.classify(out, text, f"__part{k}")
        of = {p.name: k for k, part in enumerate(self.parts) for p in part.category.properties}
        return out.withColumn(into, F.struct(*[F.col(f"__part{of[p.name]}.{p.name}").alias(p.name) for p in self.category.properties])).select(*df.columns, into)


class MultiLabelModel(Model):
    """An encoder with one logit per boolean property; a property is true from a probability of one half.

    Options: ``logits``, a factory of a function from texts to logits (rows of one number per property), needs no
    training. Without it a logistic head per property is trained over an embedding: ``make`` (embedder factory), ``reg``,
    ``iterations``, and ``threshold`` (default one half).
    """

    name = "multi_label"

    def __init__(self, category: Category, **options) -> None:
        super().__init__(category, **options)
        self.heads: dict[str, object] = {}

    def supports(self, kind: str) -> bool:
        return values.property_type(kind).typeName() == "boolean"

    @property
    def is_trained(self) -> bool:
        return "logits" in self.options or len(self.heads) == len(self.category.properties)

    def _vector(self, text: str) -> Column:
        return embed(F.coalesce(F.col(text), F.lit("")), self.options.get("make", HashingEmbedder), unit=True)

    def train(self, df: DataFrame, text: str) -> MultiLabelModel:
        """Fit each property's head on its labelled rows; a label of one kind gives a constant."""
        if "logits" in self.options:
            return self
        rows = cut(df.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("__a", self._vector(text)), "embedded").withColumn("__v", array_to_vector("__a"))
        for p in self.category.properties:
            labelled = rows.filter(F.col(p.name).isNotNull()).withColumn("__y", values.truthy(F.col(p.name)))
            kinds = [r["__y"] for r in labelled.select("__y").distinct().limit(2).collect()]
            if len(kinds) < 2:
                self.heads[p.name] = 50.0 if kinds and kinds[0] else -50.0
                continue
            fitted = LogisticRegression(featuresCol="__v", labelCol="__y", regParam=self.options.get("reg", 0.001), maxIter=self.options.get("iterations", 50)).fit(labelled)
            self.heads[p.name] = (fitted.coefficients.toArray().tolist(), float(fitted.intercept))
        return self

    def classify(self, df: DataFrame, text: str, into: str = "answer") -> DataFrame:
        if not self.is_trained:
            raise NotTrained("multi_label needs an encoder or labels")
        least = self.options.get("threshold", 0.5)
        if "logits" in self.options:
            out = df.withColumn("__l", embed(F.coalesce(F.col(text), F.lit("")), self.options["logits"]))
            logits = [F.col("__l")[k].cast("double") for k in range(len(self.category.properties))]
        else:
            out = df.withColumn("__l", self._vector(text))
            logits = [F.lit(h) if isinstance(h, float) else dot(F.col("__l"), F.array(*map(F.lit, h[0]))) + F.lit(h[1]) for h in (self.heads[p.name] for p in self.category.properties)]
        fields = [F.coalesce(values.sigmoid(x) >= least, F.lit(False)).alias(p.name) for x, p in zip(logits, self.category.properties, strict=True)]
        return out.withColumn(into, F.struct(*fields)).select(*df.columns, into)


class LanguageModel(Model):
    """A language model that answers with a JSON object; the adapter is a factory of ``complete(prompts) -> answers``.

    Options: ``make`` (adapter factory, local or remote), ``batch`` (default 8). Reasoning in ``<think>`` is cut off.
    """

    name = "language_model"

    def classify(self, df: DataFrame, text: str, into: str = "answer") -> DataFrame:
        factory, size, system = self.options.get("make"), self.options.get("batch", 8), self.category.prompt()
        if factory is None:
            raise NotTrained("language_model needs an adapter")

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            complete = factory()
            for series in batches:
                texts = series.tolist()
                wanted = [k for k, t in enumerate(texts) if t]
                out: list = [None] * len(texts)
                for at in range(0, len(wanted), size):
                    part = wanted[at : at + size]
                    for k, answer in zip(part, complete([f"{system}\n\nText: {texts[j]}" for j in part]), strict=True):
                        out[k] = answer
                yield pd.Series(out, dtype=object)

        bare = F.regexp_replace(F.col("__a"), r"(?s)<think>.*?</think>", "")
        return df.withColumn("__a", ask(text)).withColumn(into, values.parse_answer(bare, self.category.types)).drop("__a")


def examples(df: DataFrame, text: str, category: Category, n: int, order: list[str], test: float = 0.5, seed: int = 42) -> DataFrame:
    """(text, answer): ``n`` rows of the training half as few-shot examples, in the seed's order."""
    from ..operators.sampling import holdout, shuffled_head

    train = holdout(df, order, test, seed).filter(~F.col("is_test")).filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    answer = F.array(*[F.struct(F.lit(p.name).alias("column_name"), values.as_property(F.col(p.name), p.type).cast("string").alias("value")) for p in category.properties])
    return shuffled_head(train, order[0], n, seed).select(F.col(text).alias("text"), answer.alias("answer"))
