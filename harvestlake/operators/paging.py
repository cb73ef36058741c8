"""Ordered API pages of a job put together: where reading stops and which items count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harvestlake.operators import records, scans
from harvestlake.session import materialize

JOB_CHUNK_US = 60 * 24 * scans.HOUR_US  # pages of a job per chunk: sixty days of fetch time


def _ordered(pages: DataFrame, chunk_us: int) -> DataFrame:
    """Page facts with position, empty streak and the cursor the page was asked with."""
    facts = records.with_payload_items(pages).select("job", "page_key", "fetched_us", "url", "cursor", F.size("_items").alias("found"))
    chunk = scans.time_chunk("fetched_us", chunk_us)
    placed = scans.streak(facts, ["job"], ["fetched_us", "page_key"], chunk, F.col("found") > 0, "empties", index="pos")
    return scans.running(placed, ["job"], ["fetched_us", "page_key"], chunk, lags={"asked": F.col("cursor")})


def paged_assembly(pages: DataFrame, max_items: int = 0, empty_pages: int = 2, chunk_us: int = JOB_CHUNK_US) -> tuple[DataFrame, DataFrame]:
    """(stops, items): the stop of each job with its reason, and the distinct items before it.

    A page is not read if enough items are there or its address was read before; reading
    ends after a page that completes the empty streak, repeats its cursor or names none.
    """
    # page facts feed four joins; written once, the payloads are not parsed again for each
    ordered = materialize(_ordered(pages, chunk_us), "paged-facts")
    first_url = ordered.groupBy("job", "url").agg(F.min("pos").alias("first_pos"))
    items = records.normalize_api_records(records.scan_api_payloads(pages.select("job", "page_key", "payload")))
    placed = items.join(ordered.select("job", "page_key", "pos"), ["job", "page_key"])
    first_item = placed.groupBy("job", "item_key").agg(
        F.min_by(F.struct("pos", "item_no", "title", "link"), F.struct("pos", "item_no")).alias("_f"), F.count("*").alias("copies")
    ).select("job", "item_key", "_f.*", "copies")
    fresh = first_item.groupBy("job", "pos").agg(F.count("*").alias("new_items"))
    facts = ordered.join(first_url, ["job", "url"]).join(fresh, ["job", "pos"], "left").fillna(0, ["new_items"])
    counted = scans.running(facts, ["job"], ["fetched_us", "page_key"], scans.time_chunk("fetched_us", chunk_us), sums={"items_after": F.col("new_items")})
    before = F.col("items_after") - F.col("new_items")
    event = lambda test, after, rank, reason: F.when(test, F.struct((F.col("pos") * 2 + after).alias("at"), F.lit(rank).alias("rank"), F.lit(reason).alias("reason"), (F.col("pos") - 1 + after).alias("last_pos")))
    stops = F.filter(
        F.array(
            event((before >= max_items) if max_items else F.lit(False), 0, 0, "max_items"),
            event(F.col("first_pos") < F.col("pos"), 0, 1, "repeated_url"),
            event(F.col("empties") >= empty_pages, 1, 2, "empty_pages"),
            event((F.col("cursor") != "") & (F.col("cursor") == F.col("asked")), 1, 3, "cursor_stuck"),
            event(F.col("cursor") == "", 1, 4, "no_next_hint"),
        ),
        lambda e: e.isNotNull(),
    )
    per_job = counted.groupBy("job").agg(F.min(F.array_min(stops)).alias("_stop"), F.max("pos").alias("_end"))
    stop = per_job.select("job", F.coalesce(F.col("_stop.reason"), F.lit("")).alias("stop_reason"), F.coalesce(F.col("_stop.last_pos"), F.col("_end")).alias("pages_read"))
    kept = first_item.join(stop.select("job", "pages_read"), "job").where(F.col("pos") <= F.col("pages_read"))
    if max_items:
        # only the page that crosses the limit can hold items beyond it
        reach = counted.select("job", "pos", before.alias("_before"))
        w = W.partitionBy("job", "pos").orderBy("item_no")
        kept = kept.join(reach, ["job", "pos"]).withColumn("_n", F.col("_before") + F.row_number().over(w)).where(F.col("_n") <= max_items).drop("_before", "_n")
    result = kept.select("job", "pos", "item_no", "item_key", "title", "link")
    totals = result.groupBy("job").agg(F.count("*").alias("items"))
    return stop.join(totals, "job", "left").fillna(0, ["items"]), result
