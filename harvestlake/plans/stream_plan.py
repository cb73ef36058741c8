"""Queries that run as streams over the event and line item tables, and the sinks."""

from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.operators import frontier as FR
from harvestlake.operators import oplog as O
from harvestlake.operators import quality as Q
from harvestlake.operators import records as R
from harvestlake.plans import oplog_plan as OP
from harvestlake.plans import records_plan as RP
from harvestlake.plans.registry import query
from harvestlake.session import fresh_path, materialize
from harvestlake.sources import sinks
from harvestlake.streaming import streams as ST

FL = ("fetch_log",)
# windows that the watermark has closed when all events have been read
_CLOSED = "(SELECT max(ts_us) - 600000000 FROM fetch_log)"

query(
    "stream_fetch_metrics",
    f"""SELECT * FROM (SELECT floor(ts_us / 3600000000)::bigint * 3600000000 AS start_us, floor(ts_us / 3600000000)::bigint * 3600000000 + 3600000000 AS end_us, domain, count(*) AS requests, count(*) FILTER (ok) AS ok_count, count(*) FILTER (NOT ok) AS fail_count,
  count(*) FILTER (retried) AS retries, sum(records)::bigint AS records, sum(discovered)::bigint AS discovered FROM fetch_log GROUP BY ALL) x WHERE end_us <= {_CLOSED}""",
    FL,
)(lambda t: ST.run_to_table(ST.stream_fetch_metrics(t.stream("fetch_log")), "fetch-metrics"))

_SC = OP._SCORE
query(
    "stream_profile_health",
    f"""WITH w AS (SELECT endpoint, (floor(ts_us / 60000000)::bigint + i) * 60000000 AS end_us, ok, failure_category FROM fetch_log, (SELECT unnest(range(1, 6)) AS i) r)
SELECT end_us, endpoint, w_total AS requests, {_SC} AS health_score FROM (SELECT end_us, endpoint, {OP._CNT.replace(' OVER w', '')} FROM w GROUP BY ALL) x WHERE end_us <= {_CLOSED}""",
    FL,
)(lambda t: ST.run_to_table(ST.stream_profile_health(t.stream("fetch_log")), "profile-health"))
query(
    "stream_crawl_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY domain ORDER BY ts_us) < 300000000 THEN 0 ELSE 1 END AS brk FROM fetch_log),
s AS (SELECT *, sum(brk) OVER (PARTITION BY domain ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT * FROM (SELECT min(ts_us) AS start_us, max(ts_us) + 300000000 AS end_us, domain, count(*) AS requests, count(*) FILTER (ok) AS ok_count FROM s GROUP BY domain, sid) x WHERE end_us <= {_CLOSED}""",
    FL,
)(lambda t: ST.run_to_table(ST.stream_crawl_sessions(t.stream("fetch_log")), "sessions"))
query(
    "stream_dedupe_records",
    "SELECT domain, k, arg_min(request_id, (ts_us, request_id)) AS request_id, min(ts_us) AS ts_us, count(*) - 1 AS dropped FROM fetch_log GROUP BY domain, k",
    FL,
)(lambda t: ST.stream_dedupe_records(t.stream("fetch_log").select("ts_us", "domain", "k", "request_id"), ["domain", "k"], ["ts_us", "request_id"]))
query("stream_endpoint_cooldown", f"WITH {OP._COOL} SELECT endpoint, failure_count AS failures, cooldown_until_us, last_used_us AS last_us, success_count FROM st", FL)(
    lambda t: ST.stream_endpoint_cooldown(t.stream("fetch_log"))
)


def _batch_stream(t):
    """The work batches as a table that grows, read as a stream."""
    path = fresh_path(t.spark, "batches")
    batches = t("batches")
    batches.write.parquet(path)
    return t.spark.readStream.schema(batches.schema).parquet(path)


query("stream_pressure", f"WITH {OP._TOT} SELECT run_id, {OP._SIG} FROM tot", ("batches",))(lambda t: ST.stream_pressure(_batch_stream(t)))
query("stream_supervisor", f"WITH {OP._SUP} SELECT * FROM sup2", ("batches",))(lambda t: ST.stream_supervisor(_batch_stream(t)).drop("micro_batch"))


def _gate_stream(t):
    lean = lambda df: R.normalize_products(df).select("run_id", "dedupe_key", "title", "category", "description", "image_urls", "highest_price", "status", "source_url")
    failed = lambda df: df.where("status = 'failed'").select("run_id", F.col("source_url").alias("url"))
    return ST.stream_quality_gate(t.stream("offers", streamed="lineitem"), RP.POLICY, lean, failed)


query(
    "stream_quality_gate",
    f"""WITH {RP._CHECKS} SELECT run_id, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed_checks, CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS severity, NOT bool_and(passed) AS should_fail, 0::bigint AS micro_batch FROM checks GROUP BY run_id""",
    ("offers",),
)(_gate_stream)


def _resume(t):
    """Read the first half of the event time, stop, add the rest, go on from the checkpoint."""
    spark = t.spark
    log = t("fetch_log").select("request_id", "domain", "ts", "ts_us", "ok")
    middle = F.lit(t("fetch_log").agg(((F.min("ts_us") + F.max("ts_us")) / 2).alias("m")).first()["m"])
    source, out, mark = (fresh_path(spark, x) for x in ("resume-source", "resume-out", "resume-checkpoint"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(source)
    log.where(F.col("ts_us") < middle).write.mode("append").parquet(source)
    ST.run_to_table(stream(), "resume", checkpoint=mark, path=out)
    log.where(F.col("ts_us") >= middle).write.mode("append").parquet(source)
    return ST.resume_counts(ST.run_to_table(stream(), "resume", checkpoint=mark, path=out), F.col("request_id"))


query("stream_resume", "SELECT count(*) AS total, count(DISTINCT request_id) AS distinct_keys, 0::bigint AS duplicates FROM fetch_log", FL)(_resume)

# ---------------------------------------------------------------- sinks
_EXPORT = {"title": "name", "highest_price": "price", "currency": "currency", "image_urls": "images", "category_level_1": "l1", "category_level_2": "l2"}
_EXPORT_SCHEMA = "name string, price double, currency string, images string, l1 string, l2 string"


def _exported(t):
    # the offers are joined and their prices read once, for all formats
    rows = materialize(RP.lean(t).select("title", "highest_price", "currency", "image_urls", "category"), "export-rows")
    out = None
    for fmt in ("json", "csv", "parquet"):
        path = fresh_path(t.spark, f"export-{fmt}")
        sinks.sink_export(rows, path, fmt, _EXPORT)
        back = sinks.read_export(t.spark, path, fmt, _EXPORT_SCHEMA).select(F.lit(fmt).alias("format"), "*")
        out = back if out is None else out.unionByName(back)
    return out.groupBy("format", "l1").agg(F.count("*").alias("rows"), F.count("price").alias("priced"), F.sum(F.length("name") + F.length("images") + F.length("l2")).alias("chars"))


query(
    "sink_export",
    f"""WITH {RP.LEAN}, lv AS (SELECT *, [x for x in string_split(category, '>') if trim(x) <> ''] AS parts FROM prod),
e AS (SELECT title AS name, highest_price AS price, array_to_string(image_urls, '; ') AS images, coalesce(parts[1], '') AS l1, coalesce(parts[2], '') AS l2 FROM lv)
SELECT format, l1, count(*) AS rows, count(price) AS priced, sum(length(name) + length(images) + length(l2))::bigint AS chars FROM e, (VALUES ('json'), ('csv'), ('parquet')) f(format) GROUP BY ALL""",
    ("offers",),
)(_exported)


def _logs(t, name, rows):
    path = fresh_path(t.spark, name)
    for _ in range(2):  # a repeated write leaves one copy
        sinks.append_log(rows, path, batch=0)
    return sinks.read_log(t.spark, path, rows.schema).select(*sorted(rows.columns))


query("append_item_log", "SELECT run_id, request_id, 'purchase' AS record_type, 'd' || k AS dedupe_key FROM fetch_log WHERE records > 0", FL)(
    lambda t: _logs(t, "item-log", t("fetch_log").where("records > 0").select("run_id", "request_id", F.lit("purchase").alias("record_type"), F.concat(F.lit("d"), "k").alias("dedupe_key")))
)
query(
    "append_failure_log",
    f"SELECT run_id, request_id, failure_category AS bucket, {RP._red('error')} AS error, retried FROM fetch_log WHERE NOT ok",
    FL,
)(lambda t: _logs(t, "failure-log", O.append_failure_rows(t("fetch_log"))))
query("append_event_log", "SELECT run_id, request_id, event_type, domain, ts_us FROM fetch_log", FL)(
    lambda t: ST.run_to_table(t.stream("fetch_log").select("run_id", "request_id", "event_type", "domain", "ts_us"), "event-log")
)


def _saved(t):
    """Save all tasks, then save the failed ones again with other items."""
    path = fresh_path(t.spark, "tasks")
    items = t("task_items").join(t("jobs").select("task_id", "status"), "task_id").select("task_id", "item_index", "title", "link", "l_partkey", "l_suppkey", "status")
    sinks.save_task_result(t.spark, path, items)
    # the failed ones are read from the saved table, so the items are not joined anew
    again = sinks.read_tasks(t.spark, path, items.schema).where("status = 'failed'").select("task_id", "item_index", F.upper("title").alias("title"), F.lit("").alias("link"), "l_partkey", "l_suppkey", F.lit("retried").alias("status"))
    sinks.save_task_result(t.spark, path, again)
    return sinks.read_tasks(t.spark, path, items.schema)


query(
    "save_task_result",
    """SELECT i.task_id, item_index, CASE WHEN status = 'failed' THEN upper(title) ELSE title END AS title, CASE WHEN status = 'failed' THEN '' ELSE link END AS link, l_partkey, l_suppkey, CASE WHEN status = 'failed' THEN 'retried' ELSE status END AS status FROM task_items i JOIN jobs j ON i.task_id = j.task_id""",
    ("task_items", "jobs"),
)(_saved)
