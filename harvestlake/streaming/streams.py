"""Structured Streaming forms of the log operators.

Event time is the request time; rows later than the watermark are dropped.  Windowed
results are appended once their window has closed.  State that must survive across
micro-batches without a window is a small table per micro-batch in the shared folder,
written under the batch number, so a repeated batch rewrites its own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.operators import oplog, quality, scans
from harvestlake.session import fresh_path, materialize

WATERMARK = "10 minutes"


def run_to_table(stream: DataFrame, label: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over what is available, append to a table and read it."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """Run a stream over what is available with one callback per micro-batch."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, f"{label}-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# ---------------------------------------------------------------- windows
def stream_fetch_metrics(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests, outcomes and records per domain and tumbling window."""
    w = log.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "domain")
    return w.agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("ok_count"), F.count_if(~F.col("ok")).alias("fail_count"), F.count_if("retried").alias("retries"),
        F.sum("records").alias("records"), F.sum("discovered").alias("discovered"),
    ).select(F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "domain", "requests", "ok_count", "fail_count", "retries", "records", "discovered")


def stream_profile_health(log: DataFrame) -> DataFrame:
    """Health of each endpoint over sliding windows of 300 s, every 60 s."""
    counts = oplog._health_counts()
    agg = log.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "300 seconds", "60 seconds"), "endpoint").agg(*[v.alias(k) for k, v in counts.items()])
    score = oplog._health(*[F.col(c) for c in ("w_ok", "w_total", "w_timeouts", "w_challenges", "w_blocked")])
    return agg.select(F.unix_micros("window.end").alias("end_us"), "endpoint", F.col("w_total").alias("requests"), score.alias("health_score"))


def stream_crawl_sessions(log: DataFrame, gap: str = "300 seconds") -> DataFrame:
    """Bursts of work per domain: rows closer than the lease time belong together."""
    agg = log.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), "domain").agg(F.count("*").alias("requests"), F.count_if("ok").alias("ok_count"))
    return agg.select(F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "domain", "requests", "ok_count")


# ---------------------------------------------------------------- carried state
def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that micro-batches write, empty before the first of them."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class StateTable:
    """Small keyed table carried from one micro-batch to the next.

    Give the same path as before to go on from a checkpoint after a restart.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str, path: str | None = None):
        self.spark, self.schema, self.path = spark, schema, path or fresh_path(spark, label)

    def before(self, batch: int) -> DataFrame:
        """State left by the batch before, empty for the first."""
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch - 1}").select(*self.names())

    def after(self, batch: int, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def latest(self) -> DataFrame:
        """State of the newest micro-batch of this or an earlier run, empty if there was none."""
        every = read_or_empty(self.spark, self.path, f"{self.schema}, batch long")
        newest = every.agg(F.max("batch").alias("b")).first()["b"]
        return every.where(F.col("batch") == newest).drop("batch")

    def names(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns


class DeltaLog:
    """Partial results of micro-batches in a table that only grows; reading folds them.

    A repeated micro-batch rewrites its own part.  Every ``every`` batches the parts so far are folded into a
    base, so a read meets one base and at most ``every`` parts, however long the stream runs.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str, fold: Callable[[DataFrame], DataFrame], path: str | None = None, every: int = 16):
        self.spark, self.schema, self.fold, self.path, self.every = spark, schema, fold, path or fresh_path(spark, label), every

    def add(self, batch: int, part: DataFrame) -> None:
        part.write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")
        if (batch + 1) % self.every == 0:
            self.upto(batch).write.mode("overwrite").parquet(f"{self.path}/bases/batch={batch}")

    def upto(self, batch: int | None = None) -> DataFrame:
        """Everything up to a batch, or so far; a base that this or a later batch is still to rewrite is not read."""
        bases, parts = (read_or_empty(self.spark, f"{self.path}/{x}", f"{self.schema}, batch long") for x in ("bases", "parts"))
        if batch is not None:
            bases, parts = bases.where(F.col("batch") < batch), parts.where(F.col("batch") <= batch)
        base = bases.agg(F.max("batch").alias("b")).first()["b"]
        rows = parts if base is None else bases.where(F.col("batch") == base).unionByName(parts.where(F.col("batch") > base))
        return self.fold(rows.drop("batch"))


class SeenKeys:
    """Keys met so far, in buckets of their hash, a folder for each micro-batch.

    A micro-batch is joined only with the buckets that its own keys fall into, and only with earlier
    batches, so a repeated one gives what it gave before.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str, path: str | None = None, buckets: int = 64):
        self.spark, self.schema, self.path, self.buckets = spark, schema, path or fresh_path(spark, label), buckets
        self.keys = [f.strip().split()[0] for f in schema.split(",")]

    def fresh(self, batch: int, rows: DataFrame) -> DataFrame:
        """The distinct keys of the rows that no earlier batch had; they are seen from now on."""
        own = rows.select(*self.keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        own = materialize(own, "keys")
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        seen = read_or_empty(self.spark, self.path, f"{self.schema}, bucket int, batch long").where((F.col("batch") < batch) & F.col("bucket").isin(touched))
        there = seen.select(*[F.col(k).alias(f"seen_{k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"seen_{k}")) for k in self.keys]
        new = own.join(there, same, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/batch={batch}").select(*self.keys)


def stream_dedupe_records(rows: DataFrame, keys: list[str], order: list[str], state_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The first row of each key by ``order`` over all that the stream has brought, with the number of later copies as ``dropped``.

    Keys are never forgotten, and a copy that arrives late but comes first by ``order`` takes the place.  A micro-batch
    is folded by key before it is written.  Pass the same paths to go on after a restart.
    """
    spark = rows.sparkSession
    rest = [f for f in rows.schema if f.name not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = ", ".join(f"{f.name}:{kinds[f.name]}" for f in rest)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"first struct<{packed}>", "n long"])

    def fold(parts: DataFrame) -> DataFrame:
        place = F.struct(*[F.col(k) if k in keys else F.col(f"first.{k}") for k in order])
        return parts.groupBy(*keys).agg(F.min_by("first", place).alias("first"), F.sum("n").alias("n"))

    log = DeltaLog(spark, "first-rows", schema, fold, state_path)

    def handle(df: DataFrame, batch: int) -> None:
        log.add(batch, fold(df.select(*keys, F.struct(*[f.name for f in rest]).alias("first"), F.lit(1).cast("bigint").alias("n"))))

    run_batches(rows, "dedupe", handle, checkpoint)
    return log.upto().select(*keys, "first.*", (F.col("n") - 1).alias("dropped"))


def stream_endpoint_cooldown(log: DataFrame, after: int = rules.COOLDOWN_AFTER_FAILURES, state_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Failure count and cooldown end per endpoint, carried across micro-batches.

    A micro-batch is folded to one row per endpoint by the chunked scan before it meets
    the state, so a busy endpoint is never one task's work.
    """
    spark = log.sparkSession
    schema = "endpoint string, failures long, cooldown_until_us long, last_us long, success_count long"
    state = StateTable(spark, "cooldown-state", schema, state_path)

    def handle(df: DataFrame, batch: int) -> None:
        counted = scans.streak(df.select("endpoint", "request_id", "ts_us", "ok"), ["endpoint"], ["ts_us", "request_id"], scans.time_chunk(), F.col("ok"), "failures")
        folded = counted.groupBy("endpoint").agg(
            F.max_by("failures", F.struct("ts_us", "request_id")).alias("tail"), F.max("ok").alias("any_ok"), F.max("ts_us").alias("new_us"), F.count_if("ok").alias("new_ok")
        )
        joined = state.before(batch).join(folded, "endpoint", "full")
        before = F.coalesce(F.col("failures"), F.lit(0))
        failures = F.when(F.col("tail").isNull(), before).when(F.col("any_ok"), F.col("tail")).otherwise(before + F.col("tail"))
        wait = F.least(rules.COOLDOWN_BASE_SECONDS * F.pow(F.lit(2), F.least(failures - after, F.lit(30))), F.lit(rules.COOLDOWN_MAX_SECONDS))
        # failures after a success restart the wait, so the last failure decides it
        until = F.when(F.col("tail").isNull(), F.col("cooldown_until_us")).when(failures >= after, F.col("new_us") + (wait * 1000000).cast("bigint")).otherwise(0)
        state.after(
            batch,
            joined.select(
                "endpoint", failures.cast("bigint").alias("failures"), until.cast("bigint").alias("cooldown_until_us"), F.greatest("last_us", "new_us").alias("last_us"),
                (F.coalesce("success_count", F.lit(0)) + F.coalesce("new_ok", F.lit(0))).alias("success_count"),
            ),
        )

    run_batches(log, "cooldown", handle, checkpoint)
    return state.latest()


def stream_supervisor(batches: DataFrame, state_path: str | None = None, out_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Advice per work batch, with the zero-yield streak carried across micro-batches."""
    spark = batches.sparkSession
    out = out_path or fresh_path(spark, "decisions")
    state = StateTable(spark, "supervisor-state", "run_id string, carried long", state_path)
    kinds = {c: batches.schema[c].dataType.simpleString() for c in ("run_id", "batch_id")}
    schema = f"run_id {kinds['run_id']}, batch_id {kinds['batch_id']}, zero_streak long, action string, severity string"

    def handle(df: DataFrame, batch: int) -> None:
        held = state.before(batch)
        fruitful = (F.col("records_saved") > 0) | (F.col("discovered_urls") > 0)
        marked = scans.running(df, ["run_id"], ["batch_id"], oplog.batch_chunk(), maxes={"broken": fruitful.cast("int")})
        rows = oplog.supervise_batch(df).join(marked.select("run_id", "batch_id", "broken"), ["run_id", "batch_id"]).join(held, "run_id", "left")
        streak = F.col("zero_streak") + F.when(F.col("broken") == 0, F.coalesce("carried", F.lit(0))).otherwise(0)
        lifted = rows.withColumn("zero_streak", streak)
        pause = (F.col("action") == "repair_after_run") & (F.col("zero_streak") >= 2)
        done = lifted.select(
            "run_id", "batch_id", F.col("zero_streak").cast("long").alias("zero_streak"), F.when(pause, "pause").otherwise(F.col("action")).alias("action"), F.when(pause, "critical").otherwise(F.col("severity")).alias("severity")
        )
        done.write.mode("overwrite").parquet(f"{out}/micro_batch={batch}")
        last = spark.read.parquet(f"{out}/micro_batch={batch}").groupBy("run_id").agg(F.max_by("zero_streak", "batch_id").alias("now"))
        state.after(batch, held.join(last, "run_id", "full").select("run_id", F.coalesce("now", "carried").alias("carried")))

    run_batches(batches, "supervisor", handle, checkpoint)
    return read_or_empty(spark, out, f"{schema}, micro_batch int")


def stream_pressure(batches: DataFrame, state_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Pressure signals of each run after the newest work batches.

    A micro-batch is folded to sums and the slow streak at its end, over chunks of a run, before it meets the state,
    which is eight numbers a run; so a busy run is never one task's work.  Work batches arrive in the order of their numbers.
    """
    spark = batches.sparkSession
    sums = {"n": F.count("*"), "latency": F.sum("latency_ms"), "claimed": F.sum("claimed"), "failed": F.sum("failed"), "retried": F.sum("retried"), "errors": F.sum("checkpoint_errors")}
    kinds = {name: "double" if name == "latency" else "long" for name in sums}
    schema = ", ".join([f"run_id {batches.schema['run_id'].dataType.simpleString()}", *[f"{c} {k}" for c, k in kinds.items()], "slow long"])
    state = StateTable(spark, "pressure-state", schema, state_path)

    def handle(df: DataFrame, batch: int) -> None:
        new = oplog.slow_streak(df).groupBy("run_id").agg(*[v.cast(kinds[c]).alias(f"new_{c}") for c, v in sums.items()], F.max_by("slow_streak", "batch_id").alias("tail"))
        joined = state.before(batch).join(new, "run_id", "full")
        # a micro-batch that is slow throughout continues the streak before it
        slow = F.coalesce("tail", F.lit(0)) + F.when(F.coalesce(F.col("tail") < F.col("new_n"), F.lit(False)), 0).otherwise(F.coalesce("slow", F.lit(0)))
        total = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"new_{c}", F.lit(0))).cast(kinds[c]).alias(c) for c in sums]
        state.after(batch, joined.select("run_id", *total, slow.cast("bigint").alias("slow")))

    run_batches(batches, "pressure", handle, checkpoint)
    return oplog._signals(state.latest(), "run_id")


def stream_quality_gate(
    records: DataFrame, policy: quality.GatePolicy, normalize: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame], DataFrame],
    state_path: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Gate verdict per run after each micro-batch, over all that the run has brought so far.

    Carried are one row of counts per run and, for what counts distinct things, the keys and failed addresses
    met so far.  A micro-batch adds its own counts and reads only the buckets that its keys fall into.
    """
    spark = records.sparkSession
    at = state_path or fresh_path(spark, "gate")
    kind = records.schema["run_id"].dataType.simpleString() if "run_id" in records.columns else "string"
    counts = ["total_records", "keyed", "distinct_keys", "failed_url_count", *[f"c_{f}" for f in quality.COMPLETENESS_FIELDS]]
    totals = StateTable(spark, "totals", ", ".join([f"run_id {kind}", *[f"{c} long" for c in counts]]), f"{at}/totals")
    keys = SeenKeys(spark, "keys", f"run_id {kind}, dedupe_key string", f"{at}/keys")
    urls = SeenKeys(spark, "urls", f"run_id {kind}, url string", f"{at}/urls")

    def handle(df: DataFrame, batch: int) -> None:
        rows = normalize(df)
        has_key = F.coalesce(F.col("dedupe_key"), F.lit("")) != ""
        filled = quality._filled(rows)
        parts = [
            totals.before(batch),
            rows.groupBy("run_id").agg(F.count("*").alias("total_records"), F.count_if(has_key).alias("keyed"), *[F.count_if(v).alias(f"c_{f}") for f, v in filled.items()]),
            keys.fresh(batch, rows.where(has_key)).groupBy("run_id").agg(F.count("*").alias("distinct_keys")),
            urls.fresh(batch, failed(rows).where("url IS NOT NULL")).groupBy("run_id").agg(F.count("*").alias("failed_url_count")),
        ]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        totals.after(batch, every.groupBy("run_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts]))
        now = totals.before(batch + 1).withColumn("duplicate_count", F.col("keyed") - F.col("distinct_keys"))
        quality.quality_summary_gate(quality.rates(now), policy).write.mode("overwrite").parquet(f"{at}/report/micro_batch={batch}")

    run_batches(records, "gate", handle, checkpoint)
    report = "run_id string, passed boolean, failed_checks long, severity string, should_fail boolean, micro_batch long"
    return read_or_empty(spark, f"{at}/report", report.replace("run_id string", f"run_id {kind}"))


def resume_counts(table: DataFrame, key: Column) -> DataFrame:
    """Rows, distinct keys and duplicates after a restart."""
    per_key = table.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("duplicates"))
