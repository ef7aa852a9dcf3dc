"""A keyed store of filings with versioned results, as parquet in hash buckets.

Parquet has no MERGE, so a change is a plan (old full outer join new, one merge rule per column) over the buckets that
the changed keys fall in; the other buckets stay as they are. A manifest names the folder of every bucket and becomes
current by one rename. Readers of an older state are not disturbed while it is kept, and a lost executor or driver
leaves the old state current. Changes of one batch fold by key before the join.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import property_type
from ..session import cut
from ..schemas import CLASSIFICATIONS_KEY, FILINGS, PREPROCESSING

#: Merge rules: what a column is when a row exists and a new one comes.
STICKY, KEEP_UNLESS_GIVEN, REPLACE, TOUCH = "sticky", "keep unless given", "replace", "touch"
#: The rules of the main table. Arrays are replaced by given ones, also by empty ones.
FILING_RULES = {f.name: KEEP_UNLESS_GIVEN for f in FILINGS.fields} | {"blacklisted": STICKY, "last_crawled": TOUCH}


def merged(old: Column, new: Column, rule: str) -> Column:
    if rule == STICKY:
        return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
    if rule == REPLACE:
        return new
    return F.coalesce(new, old)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str], order: str | None = None, now: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: per column its rule where the key exists, the new values where it doesn't.

    Columns that ``new`` lacks stay; columns that only ``new`` has are added, null for old rows. Of several new rows
    of a key the last by ``order`` counts (all columns decide between equals). Null keys never match and are dropped.
    """
    given = [c for c in new.columns if c not in keys]
    extra = [c for c in given if c not in old.columns]
    place = [F.col(order).desc_nulls_last()] if order else []
    ties = [F.col(c).desc_nulls_last() for c in new.columns if c != order and not isinstance(new.schema[c].dataType, (T.MapType,))]
    known = new.dropna(subset=keys)
    last = known.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*place, *ties))).filter("__n = 1").drop("__n")
    fresh = last.select(*[F.col(k).alias(f"__k{k}") for k in keys], *[F.col(c).alias(f"__v{c}") for c in given], F.lit(True).alias("__new"))
    have = old.withColumn("__old", F.lit(True))
    both = have.join(fresh, [F.col(k) == F.col(f"__k{k}") for k in keys], "full_outer")
    out = []
    for f in [*old.schema.fields, *(new.schema[c] for c in extra)]:
        c = f.name
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"__k{c}")).alias(c))
        elif c in given:
            was = F.col(c) if c not in extra else F.lit(None).cast(f.dataType)
            now_value = F.col(f"__v{c}")
            rule = rules.get(c, KEEP_UNLESS_GIVEN)
            inserted = now_value
            if isinstance(f.dataType, T.ArrayType):
                inserted = F.coalesce(now_value, F.array().cast(f.dataType))
            elif rule == STICKY:
                inserted = F.coalesce(now_value, F.lit(False))
            elif rule == TOUCH and now is not None:
                now_value = inserted = now
            value = F.when(F.col("__new").isNull(), was).when(F.col("__old").isNull(), inserted).otherwise(merged(was, now_value, rule))
            out.append(value.alias(c))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.when(F.col("__old").isNull(), F.array().cast(f.dataType)).otherwise(F.col(c)).alias(c))
        elif rules.get(c) == STICKY:
            out.append(F.when(F.col("__old").isNull(), F.lit(False)).otherwise(F.col(c)).alias(c))
        elif rules.get(c) == TOUCH and now is not None:
            out.append(F.when(F.col("__new").isNotNull(), now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def update_where(df: DataFrame, key: str, value, changes: dict, touch: str | None = None, now: Column | None = None) -> DataFrame:
    """``df`` with some columns of one row set; None empties an array and nulls another column. Unknown columns raise."""
    unknown = [c for c in changes if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    hit = F.col(key) == F.lit(value)
    columns = {}
    for c, v in changes.items():
        kind = df.schema[c].dataType
        new = F.array().cast(kind) if v is None and isinstance(kind, T.ArrayType) else F.array(*map(F.lit, v)).cast(kind) if isinstance(v, (list, tuple)) else F.lit(v).cast(kind)
        columns[c] = F.when(hit, new).otherwise(F.col(c))
    if touch:
        columns[touch] = F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col(touch))
    return df.withColumns(columns)


def append_keywords(df: DataFrame, added: DataFrame, key: str = "id", column: str = "keywords", keyword: str = "keyword", flag: str | None = None) -> DataFrame:
    """``df`` with keywords appended where they are missing, in sorted order; a null array counts as empty.

    ``flag`` names a further column: whether a keyword came for the row, also one that it had.
    """
    news = added.dropna(subset=[key, keyword]).groupBy(key).agg(F.array_sort(F.collect_set(keyword)).alias("__news"))
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return df.join(news, key, "left").withColumn(column, F.when(F.col("__news").isNull(), F.col(column)).otherwise(F.concat(have, F.array_except("__news", have)))).select(*df.columns, *([F.col("__news").isNotNull().alias(flag)] if flag else []))


def ingest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, items): the rows of each key as one record, in order. A key's rows must fit in a row: versions of one filing."""
    rest = [c for c in rows.columns if c != key and c not in ("file", "path", "modified_at")]
    item = F.struct(*order, *[c for c in rest if c not in order])
    return rows.dropna(subset=[key]).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the missing ones of these property columns, null for its rows."""
    return df.withColumns({c: F.lit(None).cast(property_type(k)) for c, k in columns.items() if c not in df.columns})


def delete_keys(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Rows of these keys deleted from a table and from all that refer to it: name -> (table, its key column)."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    return {n: df.join(keys, F.col(k) == F.col("__gone"), "left_anti") for n, (df, k) in tables.items()}


def reset_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


@dataclass
class Store:
    """Three tables under ``root``: filings, preprocessing and classifications (which gains columns as needed)."""

    spark: SparkSession
    root: str
    properties: dict[str, str]
    buckets: int = 16
    keep: int = 3

    SCHEMAS = {"filings": FILINGS, "preprocessing": PREPROCESSING}
    KEYS = {"filings": ["id"], "preprocessing": ["filing_id", "preprocessing_version"], "classifications": ["filing_id", "experiment_version"]}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, name: str, n: int) -> dict[str, str]:
        """Bucket -> the folder that holds its rows."""
        return json.loads(self.spark.read.text(f"{self.root}/{name}/manifest-{n:09d}.json", wholetext=True).first()[0])

    def exists(self, name: str) -> bool:
        return bool(self._manifests(name))

    def schema(self, name: str) -> T.StructType:
        if name in self.SCHEMAS:
            return self.SCHEMAS[name]
        return T.StructType([*CLASSIFICATIONS_KEY.fields, *(T.StructField(c, property_type(k)) for c, k in self.properties.items()), T.StructField("classified_at", T.TimestampType())])

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The current rows, or those of some buckets; an empty table of its schema before the first change."""
        have = self._manifests(name)
        at = self._manifest(name, have[-1]) if have else {}
        paths = sorted({at[b] for b in at if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        key = self.KEYS[name][0]
        return sorted(r[0] for r in keys.filter(F.col(key).isNotNull()).select(self._bucket(key)).distinct().collect())

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, name: str, df: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """``df`` as the rows of the table, or of some of its buckets; the others stay where they are.

        Rows are written first; then a manifest is written aside and renamed, so readers see the old state or the new.
        A manifest that is there already means that someone else wrote meanwhile, which raises. Of folders and
        manifests the last ``keep`` states stay.
        """
        have = self._manifests(name)
        n = have[-1] + 1 if have else 0
        path = f"{self.root}/{name}/data-{n:09d}-{uuid.uuid4().hex[:8]}"
        placed = df.select("*", self._bucket(self.KEYS[name][0]).alias("__bucket"))
        placed.repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        fs, p = self._fs(path)
        new = {str(k): f"{path}/__bucket={k}" for k in (int(f.getPath().getName()[9:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("__bucket="))}
        old = self._manifest(name, have[-1]) if have and buckets is not None else {}
        kept = {b: q for b, q in old.items() if buckets is None or int(b) not in buckets}
        _, aside = self._fs(f"{self.root}/{name}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(kept | new).encode()))
        out.close()
        _, target = self._fs(f"{self.root}/{name}/manifest-{n:09d}.json")
        if fs.exists(target) or not fs.rename(aside, target):
            raise RuntimeError(f"{name} was changed by someone else")
        self._forget(name)
        return self.read(name)

    def _forget(self, name: str) -> None:
        have = self._manifests(name)
        live = {q.rsplit("/", 1)[0].rsplit("/", 1)[-1] for n in have[-self.keep :] for q in self._manifest(name, n).values()}
        fs, p = self._fs(f"{self.root}/{name}")
        for f in fs.listStatus(p):
            at = f.getPath().getName()
            if at.startswith("data-") and at not in live and int(at.split("-")[1]) <= have[-1] or at.startswith("manifest-") and int(at[9:-5]) in have[: -self.keep]:
                fs.delete(f.getPath(), True)

    def _upsert(self, name: str, new: DataFrame, rules: dict[str, str], order: str | None = None, now: Column | None = None) -> DataFrame:
        """Only the buckets that the new rows fall in are read, merged and written."""
        new = cut(new, "change")
        buckets = self.touched(name, new)
        old = self.read(name, buckets)
        return self.write(name, upsert(old, new, self.KEYS[name], rules, order, now), buckets)

    def upsert_filings(self, new: DataFrame, order: str | None = None) -> DataFrame:
        return self._upsert("filings", new, FILING_RULES, order, F.current_timestamp())

    def upsert_preprocessing(self, new: DataFrame, order: str | None = None) -> DataFrame:
        """Versioned results; the main table's relevance and path take the newest values, null paths as well."""
        rules = {"project_relevant": REPLACE, "path_to_preprocessed": REPLACE}
        self._upsert("preprocessing", new, rules, order)
        main = latest(new, ["filing_id"], [F.col(order).desc_nulls_last()] if order else [F.col("preprocessing_version").desc_nulls_last()])
        main = main.select(F.col("filing_id").alias("id"), "project_relevant", "path_to_preprocessed")
        return self._upsert("filings", main, {**FILING_RULES, **rules})

    def upsert_classifications(self, new: DataFrame, allowed: list[str] | None = None, order: str | None = None) -> DataFrame:
        """Versioned results; only given columns change, columns outside ``allowed`` are ignored, new ones are added."""
        keep = [c for c in new.columns if c in self.KEYS["classifications"] or c == order or allowed is None or c in allowed]
        return self._upsert("classifications", new.select(keep), {}, order)

    def add_keywords(self, added: DataFrame) -> DataFrame:
        added = cut(added, "change")
        buckets = self.touched("filings", added)
        return self.write("filings", append_keywords(self.read("filings", buckets), added), buckets)

    def blacklist(self, ids: DataFrame) -> DataFrame:
        return self.upsert_filings(ids.select("id").withColumn("blacklisted", F.lit(True)))

    def delete(self, ids: DataFrame) -> None:
        """Delete filings with their versioned results: the children first, so that none is ever orphaned."""
        for name, column in (("classifications", "filing_id"), ("preprocessing", "filing_id"), ("filings", "id")):
            if self.exists(name):
                buckets = self.touched(name, ids.select(F.col("id").alias(self.KEYS[name][0])))
                self.write(name, delete_keys({name: (self.read(name, buckets), column)}, ids)[name], buckets)

    def versions(self, filing_id: str) -> DataFrame:
        return self.read("classifications").filter(F.col("filing_id") == filing_id)
