"""Session helpers: the settings the library relies on and the shared scratch folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("harvestlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_with_tasks(module: str) -> None:
    """Send a module's functions inside the tasks, so workers need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_with_tasks(__name__)  # modules that travel refer to it


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a
    folder would exist on one machine only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"harvestlake-{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists, in which case nothing changes and the answer is no."""
    fs, at = _file(spark, path)
    try:
        out = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def small_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and texts of the small files in a folder; none if there is no such folder."""
    fs, at = _file(spark, folder)
    if not fs.exists(at):
        return {}
    out = {}
    for status in fs.listStatus(at):
        stream = fs.open(status.getPath())
        try:
            out[status.getPath().getName()] = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared folder."""
    fs, at = _file(spark, path)
    fs.delete(at, True)
