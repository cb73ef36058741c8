"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.session import fresh_path, ship_with_tasks

ship_with_tasks(__name__)

#: Spark's setting for the bytes that travel to Python at once, and what ``bound_batches`` sets.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def bound_batches(spark: SparkSession) -> None:
    """Long texts go to Python a few megabytes at a time instead of 10 000 rows; a limit that the session has stays.

    Python workers wait for further tasks and keep the memory of their largest batch, so this is what all of them hold.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and lost executors redo no more than this."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that is made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def payload(col: str | Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame, col: str, bits: int = 23) -> bytes:
    """One bit for each hash slot of the long keys in ``col``: at most 2^bits / 8 bytes reach the driver, for any input.

    Rows whose slot is empty cannot join, so they need not be shuffled; a full filter only lets more rows pass.
    """
    words = 1 << (bits - 6)

    def fold(batches):
        import pyarrow as pa

        local = np.zeros(words, np.uint64)
        for batch in batches:
            slots = _slot(np.asarray(batch.column(0).fill_null(0)), bits)
            np.bitwise_or.at(local, slots >> 6, np.uint64(1) << (slots & 63).astype(np.uint64))
        at = np.flatnonzero(local)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(local[at].view(np.int64))], names=["word", "bits"])

    rows = keys.select(F.col(col).cast("bigint").alias(col)).mapInArrow(fold, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(words, np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.tobytes()


def passes(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the long keys may be in the filter; null keys are to be given as 0."""
    words = np.frombuffer(filter_bytes, np.uint64)
    bits = int(len(words)).bit_length() + 5
    slots = _slot(keys, bits)
    return (words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def may_join(filter_bytes: bytes):
    """Column function: whether a long key may be among those of ``key_filter``."""

    @F.pandas_udf(T.BooleanType())
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(filter_bytes, keys.fillna(0).to_numpy(np.int64)))

    return test


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node of the links (``a``, ``b``).

    Alternates large-star and small-star steps until nothing changes.  Each step is a minimum per
    node and a join, so a node with very many links is folded before the shuffle and split in the join.
    The driver plans every step, so plans are kept short: what a step reads twice is stored, rows are doubled in place
    and not by unions, and links that are stars already, such as an earlier answer's, take one round.
    """
    a, b = F.col("a"), F.col("b")

    def mark(table: DataFrame):
        return table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    def pairs(*rows) -> Column:
        return F.inline(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in rows]))

    edges = stored(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    now = mark(edges)
    while True:
        before, was = edges, now
        both = edges.select(pairs((a, b), (b, a)))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")), "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(pairs((b, F.col("m")), (a, F.col("m")))).where(a != b)
        edges = stored(star.distinct(), "links")
        discard(before, large)
        now = mark(edges)
        if now == was:
            break
    roots = edges.select(b.alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(a.alias("node"), b.alias("root")).unionByName(roots)
