"""Spark session with the settings the library expects."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "folia", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; other settings come from the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a single machine, where none is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held)


def _state(df: DataFrame) -> str:
    """A hash of the files that df reads: paths, sizes and times of change, listed by folder."""
    spark, found = df.sparkSession, []
    files = set(df.inputFiles())
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(path) if s.isFile()]
    return hashlib.sha256(repr((sorted(files), found)).encode()).hexdigest()


#: Rows of whole texts that travel between Spark and Python at a time.
BATCH_ROWS = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Lets at most BATCH_ROWS rows of texts travel to Python at a time, in all that this session runs from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


_stored: dict[tuple[str, str, str], str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written once in an application, under its name, and read from then on; anew if it was removed or df's files changed."""
    spark = df.sparkSession
    in_small_batches(spark)
    key = (spark.sparkContext.applicationId, name, _state(df))
    if key not in _stored or not _exists(spark, _stored[key]):
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        _stored[key] = path
    return spark.read.schema(df.schema).parquet(_stored[key])


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what a query reads several times; it stays until the folder is cleared."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
