"""Session settings and the shared working folder.

Nothing here keeps data on one machine: cut points are parquet tables in the folder that
``spark.checkpoint.dir`` names, so a lost executor never takes them with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session made by this package (a given session is left as it is).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(master: str | None = None, app: str = "parchmill", **conf: str) -> SparkSession:
    """A session with the package's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="parchmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    _written.insert(0, (spark, made))
    return made


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


atexit.register(_clean)


def cut(df: DataFrame, name: str = "cut", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: one computation, no lineage.

    ``by`` repartitions on these columns first. The table is deleted when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parchmill-{name}-{uuid.uuid4().hex}"
    (df.repartition(*by) if by else df).write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/parchmill-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
