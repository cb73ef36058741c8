"""Running values over ordered groups of any size.

A plain window puts a whole group into one task, which fails when one endpoint or run
holds a large part of the log.  Here a group is cut into chunks by a caller-given
expression that follows the row order (usually a span of time).  Windows run inside
(group, chunk); one small row per chunk carries sums and maxima across chunk borders.
The log is shuffled once, on (group, chunk); only the chunk rows move for the carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOUR_US = 3_600_000_000


def time_chunk(ts_us: str = "ts_us", width_us: int = HOUR_US) -> Column:
    """Chunk number of a time in microseconds."""
    return F.floor(F.col(ts_us) / F.lit(width_us)).cast("bigint")


def _chunked(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Rows with their chunk and their keys as one struct, which is never null: rows without a key are a group of their own."""
    return df.withColumn("_chunk", F.coalesce(chunk, F.lit(-1).cast("bigint"))).withColumn("_key", F.struct(*keys))


def _windows(order: list[str]):
    within = W.partitionBy("_key", "_chunk").orderBy(*order)
    earlier = W.partitionBy("_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return within, within.rowsBetween(W.unboundedPreceding, 0), earlier


def _attach(local: DataFrame, carry: DataFrame) -> DataFrame:
    """Each row with what its chunk gets from earlier ones; rows already lie by these columns, so they do not move again."""
    return local.join(carry, ["_key", "_chunk"])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and maxima up to each row, and values of the row before it."""
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    within, upto, earlier = _windows(order)
    local = _chunked(df, keys, chunk)
    local = local.select(
        "*",
        *[F.sum(e).over(upto).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.max(e).over(upto).alias(f"_m_{n}") for n, e in maxes.items()],
        *[F.struct(e.alias("v")).alias(f"_v_{n}") for n, e in lags.items()],
    )
    local = local.select("*", *[F.lag(f"_v_{n}").over(within).alias(f"_p_{n}") for n in lags])
    last = F.struct(*order)
    per_chunk = local.groupBy("_key", "_chunk").agg(
        F.count("*").alias("_rows"),
        *[F.max_by(f"_s_{n}", last).alias(f"_cs_{n}") for n in sums],
        *[F.max(f"_m_{n}").alias(f"_cm_{n}") for n in maxes],
        *[F.max_by(f"_v_{n}", last).alias(f"_cv_{n}") for n in lags],
    )
    carry = per_chunk.select(
        "_key",
        "_chunk",
        *[F.sum(f"_cs_{n}").over(earlier).alias(f"_bs_{n}") for n in sums],
        *[F.max(f"_cm_{n}").over(earlier).alias(f"_bm_{n}") for n in maxes],
        *[F.last(f"_cv_{n}").over(earlier).alias(f"_bv_{n}") for n in lags],
    )
    joined = _attach(local, carry)
    return joined.select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_bs_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(f"_m_{n}"), F.col(f"_bm_{n}")).alias(n) for n in maxes],
        *[F.coalesce(F.col(f"_p_{n}"), F.col(f"_bv_{n}"))["v"].alias(n) for n in lags],
    )


def streak(df: DataFrame, keys: list[str], order: list[str], chunk: Column, breaks: Column, name: str, index: str | None = None) -> DataFrame:
    """Add the number of rows since the last row for which ``breaks`` holds, 0 on such a row."""
    within, upto, earlier = _windows(order)
    local = _chunked(df, keys, chunk).withColumn("_rn", F.row_number().over(within))
    local = local.withColumn("_at", F.max(F.when(breaks, F.col("_rn"))).over(upto))
    per_chunk = local.groupBy("_key", "_chunk").agg(F.count("*").alias("_n"), F.max("_at").alias("_last"))
    counted = per_chunk.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carry = counted.withColumn("_hit", F.max(F.col("_before") + F.col("_last")).over(earlier)).select("_key", "_chunk", "_before", "_hit")
    joined = _attach(local, carry)
    place = F.col("_before") + F.col("_rn")
    since = F.when(F.col("_at").isNotNull(), F.col("_rn") - F.col("_at")).otherwise(place - F.coalesce(F.col("_hit"), F.lit(0)))
    extra = [place.cast("bigint").alias(index)] if index else []
    return joined.select(*df.columns, since.cast("bigint").alias(name), *extra)


def spaced_starts(df: DataFrame, keys: list[str], order: list[str], chunk: Column, arrival: str, delay: Column, name: str) -> DataFrame:
    """Earliest start of each row when rows of a group must start ``delay`` apart.

    start_i = max(arrival_i, start_{i-1} + delay) has the closed form
    max over j ≤ i of (arrival_j − j·delay) + i·delay, a running maximum.
    """
    within, upto, earlier = _windows(order)
    local = _chunked(df, keys, chunk).withColumn("_rn", F.row_number().over(within)).withColumn("_d", delay)
    local = local.withColumn("_m", F.max(F.col(arrival) - F.col("_rn") * F.col("_d")).over(upto))
    per_chunk = local.groupBy("_key", "_chunk").agg(F.count("*").alias("_n"), F.max("_m").alias("_top"), F.max("_d").alias("_cd"))
    counted = per_chunk.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carry = counted.withColumn("_g", F.max(F.col("_top") - F.col("_before") * F.col("_cd")).over(earlier)).select("_key", "_chunk", "_before", "_g")
    joined = _attach(local, carry)
    here = F.col("_m") + F.col("_rn") * F.col("_d")
    before = F.col("_g") + (F.col("_before") + F.col("_rn")) * F.col("_d")
    return joined.select(*df.columns, F.greatest(here, before).alias(name))


def sliding(
    df: DataFrame, keys: list[str], ts_us: str, span_us: int, aggregates: dict[str, Column], bucket_us: int = HOUR_US
) -> DataFrame:
    """Aggregates over the last ``span_us`` before each row, row included.

    Rows near the end of a bucket are copied into the next one as context, so a bucket
    is complete by itself and a hot group spreads over its buckets.
    """
    bucket_us = max(bucket_us, span_us)
    own = F.floor(F.col(ts_us) / F.lit(bucket_us)).cast("bigint")
    reaches = F.floor((F.col(ts_us) + F.lit(span_us)) / F.lit(bucket_us)).cast("bigint")
    spread = df.withColumn("_own", own).withColumn(
        "_bucket", F.explode(F.when(reaches > own, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = W.partitionBy(*keys, "_bucket").orderBy(ts_us).rangeBetween(-span_us, 0)
    return spread.select("*", *[e.over(w).alias(n) for n, e in aggregates.items()]).where("_bucket = _own").drop("_own", "_bucket")


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, width: float, name: str) -> DataFrame:
    """Exact order statistic per group: the value at 0-based ``rank(n)`` of the sorted values.

    ``rank`` is an expression over the column ``n`` (group size).  Equal values are counted
    first, so a value that fills a group is one row; bands of ``width`` are then summed up
    and only the band that holds the rank is sorted.
    """
    band = F.floor(F.col(value) / F.lit(width)).cast("bigint")
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"), F.max(band).alias("_band"))
    bands = counted.groupBy(*keys, "_band").agg(F.sum("_c").alias("_bc"))
    by_band = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, 0)
    placed = bands.select("*", F.sum("_bc").over(by_band).alias("_upto"), F.sum("_bc").over(W.partitionBy(*keys)).alias("n")).withColumn("_r", rank)
    hit = placed.where((F.col("_upto") > F.col("_r")) & (F.col("_upto") - F.col("_bc") <= F.col("_r"))).select(
        *keys, "_band", (F.col("_r") - (F.col("_upto") - F.col("_bc"))).alias("_k")
    )
    in_band = W.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    inside = counted.join(hit, [*keys, "_band"]).withColumn("_sum", F.sum("_c").over(in_band))
    return inside.where((F.col("_sum") > F.col("_k")) & (F.col("_sum") - F.col("_c") <= F.col("_k"))).select(*keys, F.col("_v").alias(name))
