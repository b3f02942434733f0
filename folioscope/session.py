"""Session helpers: local sessions for tests and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

LOCAL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **options: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("folioscope")
    settings = {**LOCAL_OPTIONS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **options}
    settings.setdefault("spark.folioscope.spread", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{_shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def listed_path(spark: SparkSession, path: str) -> str:
    """A path in a folder that Spark can write to, with its file system, as tasks without Spark's settings need it."""
    mark = f"{path}-mark"
    spark.range(1).write.mode("overwrite").parquet(mark)
    (file,) = spark.read.parquet(mark).inputFiles()[:1]
    return unquote(file.rsplit("/", 2)[0]) + "/" + path.rsplit("/", 1)[1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never has to replay earlier rounds."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Share a one-split test file over the cores, in sessions that ask for it.

    Only ``local_session`` sets the option; on a cluster nothing is shuffled.
    """
    parts = df.sparkSession.conf.get("spark.folioscope.spread", None)
    return df.repartition(int(parts)) if parts else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows with much work each (keys, numbers) dealt over all cores, by ``keys`` if given: a small file is one task
    otherwise, since splits are cut by bytes and a row group is read by one task. Adaptive execution leaves the number alone."""
    spark = df.sparkSession
    parts = spark.conf.get("spark.folioscope.spread", None) or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(int(parts), *keys)


def short_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand rows at a time, unless the session says otherwise: a worker holds one batch and
    what is made of it, which for whole texts as objects is many times their bytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def many_small_files(spark: SparkSession) -> None:
    """Let a task read some thousand small files, unless the session says otherwise: opening one counts as 4 MB by
    default, which makes a task of every 32 files."""
    setting = "spark.sql.files.openCostInBytes"
    if spark.conf.get(setting) in ("4194304", "4194304b", "4MB"):
        spark.conf.set(setting, "65536")
