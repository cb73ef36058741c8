"""Exports and append logs."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harvestlake.operators import records
from harvestlake.session import create_once, materialize, remove, small_files

FORMATS = ("json", "csv", "parquet", "orc")
# text as it is: no trimming, line breaks kept, empty text (quoted) and null kept apart
CSV = {
    "header": "true", "escape": '"', "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true",
}


def sink_export(products: DataFrame, path: str, fmt: str, mapping: dict[str, str] | None = None) -> None:
    """Write export rows; files are written by the tasks, nothing passes the driver."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    writer = records.export_rows(products, mapping).write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.options(**{k: v for k, v in CSV.items() if k not in ("multiLine", "emptyValue")})
    writer.format(fmt).save(path)


def read_export(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV)
    return reader.format(fmt).load(path)


# ---------------------------------------------------------------- tables with commits
def _commits(spark: SparkSession, path: str) -> dict[str, dict]:
    """Complete commits of a table by name; a broken-off one, which lacks its end, does not count."""
    out = {}
    for name, text in small_files(spark, f"{path}/commits").items():
        if text.endswith(_END):
            out[name] = json.loads(text[: -len(_END)])
    return out


_END = "\n-- complete\n"


def _commit(spark: SparkSession, path: str, name: str, content: dict) -> bool:
    """Write a commit, the last step of a change; no if another one has the name already."""
    at = f"{path}/commits/{name}"
    text = json.dumps(content) + _END
    if create_once(spark, at, text):
        return True
    if name in _commits(spark, path):
        return False
    remove(spark, at)  # broken off by a lost driver
    return create_once(spark, at, text)


def _attempt(rows: DataFrame, path: str, by: str) -> list[str]:
    """Files of a new attempt to write rows; nobody reads them before a commit names them."""
    at = f"{path}/data/attempt={uuid.uuid4().hex}"
    rows.write.partitionBy(by).parquet(at)
    files = rows.sparkSession.read.option("basePath", f"{path}/data").schema(rows.schema).parquet(at).inputFiles()
    return [unquote(f[f.index("/data/attempt=") + len("/data/"):]) for f in files]


def _read(spark: SparkSession, path: str, schema: StructType, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in files]).select(*schema.names)


def append_log(rows: DataFrame, path: str, by: str = "run_id", batch: str | int | None = None) -> bool:
    """Append event, item or failure rows, one folder per run.

    The rows are there for readers once their commit is, all at once.  A batch number that has a commit is not
    written again, so a repeated append leaves one copy; without a number every call is a batch of its own.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex if batch is None else f"batch-{batch}"
    if name in _commits(spark, path):
        return False
    return _commit(spark, path, name, {"files": _attempt(rows, path, by)})


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches."""
    return _read(spark, path, schema, [f for c in _commits(spark, path).values() for f in c["files"]])


def bucket_of(task: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(task), F.lit(buckets)).cast("int")


def _newest(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """Number and content of a table's newest version: its files by bucket."""
    versions = {int(name): c["buckets"] for name, c in _commits(spark, path).items()}
    top = max(versions, default=-1)
    return top, versions.get(top, {})


def save_task_result(spark: SparkSession, path: str, items: DataFrame, buckets: int = 16) -> int:
    """Replace all item rows of the given tasks; rows of other tasks stay.  The number of the new version.

    Only the buckets of those tasks are written, to new files; the version that names them is committed last,
    so readers see the table before or after a save and never between.  Of two saves at once the later one
    starts again from the other's version.
    """
    items = materialize(items, "task-items")
    schema = items.withColumn("bucket", F.lit(0)).schema
    fresh = items.withColumn("bucket", bucket_of(F.col("task_id"), buckets))
    touched = [str(r["bucket"]) for r in fresh.select("bucket").distinct().collect()]
    tasks = fresh.select("task_id").distinct()
    while True:
        version, files = _newest(spark, path)
        stored = _read(spark, path, schema, [f for b in touched for f in files.get(b, [])])
        rows = fresh.unionByName(stored.join(tasks, "task_id", "left_anti"))
        now = {**files, **{b: [] for b in touched}}
        for f in _attempt(rows, path, "bucket"):
            now[re.search(r"/bucket=(\d+)/", f)[1]].append(f)
        if _commit(spark, path, str(version + 1), {"buckets": now}):
            return version + 1


def read_tasks(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The item rows of the newest version of a table, or of an earlier one."""
    files = _newest(spark, path)[1] if version is None else _commits(spark, path)[str(version)]["buckets"]
    return _read(spark, path, schema, [f for of in files.values() for f in of])
