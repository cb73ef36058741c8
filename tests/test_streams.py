"""Streams over several micro-batches give what the batch operators give."""

import random

from pyspark.sql import functions as F

from harvestlake.operators import oplog as O
from harvestlake.operators import quality as Q
from harvestlake.operators import records as R
from harvestlake.session import fresh_path
from harvestlake.streaming import streams as ST


def growing(spark, df, order, parts=3):
    """The rows as files of a folder, read one file per micro-batch in row order."""
    path = fresh_path(spark, "growing")
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def log(spark, n=600):
    r = random.Random(4)
    rows = [(i, "hot" if r.random() < 0.6 else f"e{r.randrange(4)}", i * 30_000_000 + r.randrange(1000), r.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, endpoint string, ts_us long, ok boolean")


def test_cooldown_carries_state(spark):
    df = log(spark)
    got = {r["endpoint"]: (r["failures"], r["cooldown_until_us"], r["success_count"]) for r in ST.stream_endpoint_cooldown(growing(spark, df, "ts_us")).collect()}
    want = {r["endpoint"]: (r["failure_count"], r["cooldown_until_us"], r["success_count"]) for r in O.endpoint_state(df).collect()}
    # an endpoint without a failure after the last success keeps no cooldown in either form
    assert got == want


def test_cooldown_restart_without_new_files(spark):
    source, state, mark = growing(spark, log(spark, 90), "ts_us"), fresh_path(spark, "state"), fresh_path(spark, "mark")
    rows = lambda: sorted(ST.stream_endpoint_cooldown(source, state_path=state, checkpoint=mark).collect())
    first = rows()
    assert first and rows() == first


def test_state_before_any_batch(spark):
    state = ST.StateTable(spark, "none", "k string, n long")
    assert state.latest().count() == state.before(0).count() == 0
    state.after(0, spark.createDataFrame([("a", 1)], state.schema))
    state.after(10, spark.createDataFrame([("a", 2)], state.schema))
    assert [tuple(r) for r in state.latest().collect()] == [tuple(r) for r in state.before(11).collect()] == [("a", 2)]


def work(spark):
    r = random.Random(6)
    rows = [("r%d" % (i % 2), i, r.choice([100.0, 9000.0]), 10, 10 - i % 4, i % 4, i % 3, i % 2, r.choice([0, 0, 3]), r.choice([0, 0, 0, 2])) for i in range(90)]
    return spark.createDataFrame(rows, "run_id string, batch_id long, latency_ms double, claimed long, succeeded long, failed long, retried long, checkpoint_errors long, records_saved long, discovered_urls long")


def test_supervisor_carries_streak(spark):
    df = work(spark)
    key = lambda rows: sorted((r["run_id"], r["batch_id"], r["zero_streak"], r["action"], r["severity"]) for r in rows)
    assert key(ST.stream_supervisor(growing(spark, df, "batch_id")).collect()) == key(O.supervise_batch(df).collect())


def test_supervisor_restart_without_new_files(spark):
    source, paths = growing(spark, work(spark), "batch_id"), {p: fresh_path(spark, p) for p in ("state_path", "out_path", "checkpoint")}
    first = sorted(ST.stream_supervisor(source, **paths).collect())
    assert first and sorted(ST.stream_supervisor(source, **paths).collect()) == first


def test_pressure_state(spark):
    df = work(spark)
    got = {r["run_id"]: r for r in ST.stream_pressure(growing(spark, df, "batch_id")).collect()}
    for want in O.batch_pressure(df).collect():
        row = got[want["run_id"]]
        assert all(row[c] == want[c] for c in ("total_batches", "avg_latency_ms", "failure_rate", "consecutive_slow", "recommendation"))


def test_dedupe_equals_first_seen(spark):
    """Over restarts, bases and copies that come late but are first, as over the whole table."""
    r = random.Random(5)
    rows = [(i, f"k{r.randrange(9)}" if r.random() < 0.9 else None, r.randrange(1000)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, at long")
    want = sorted(map(str, R.first_seen_dedupe(df, ("k",), ("at", "id")).select("k", "id", "at", "dropped").collect()))
    path, mark, state = (fresh_path(spark, x) for x in ("source", "mark", "state"))
    for part in range(6):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], df.schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = ST.stream_dedupe_records(stream, ["k"], ["at", "id"], state, mark)
    assert sorted(map(str, got.select("k", "id", "at", "dropped").collect())) == want


def test_deltas_fold_into_bases(spark):
    log = ST.DeltaLog(spark, "deltas", "k string, n long", lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), every=3)
    assert log.upto().count() == 0
    for b in range(8):
        for _ in range(2):  # a repeated batch rewrites its own part
            log.add(b, spark.createDataFrame([("a", 1), ("b", b)], "k string, n long"))
        assert {r["k"]: r["n"] for r in log.upto().collect()} == {"a": b + 1, "b": b * (b + 1) // 2}
    assert {r["k"]: r["n"] for r in log.upto(4).collect()} == {"a": 5, "b": 10}


def gate_rows(spark):
    r = random.Random(7)
    rows = [("r%d" % (i % 2), r.choice(["", None, f"k{r.randrange(25)}"]), "t" if r.random() < 0.7 else "", "c", "d", ["i"], 1.0, r.choice(["ok", "failed"]), f"u{r.randrange(12)}") for i in range(90)]
    schema = "run_id string, dedupe_key string, title string, category string, description string, image_urls array<string>, highest_price double, status string, source_url string"
    return spark.createDataFrame(rows, schema)


def test_gate_judges_all_so_far(spark):
    df = gate_rows(spark)
    failed = lambda d: d.where("status = 'failed'").select("run_id", F.col("source_url").alias("url"))
    policy = Q.GatePolicy(mode="fail", min_items=40, max_duplicate_rate=0.2, max_failed_urls=9, thresholds={"title": 0.65})
    paths = {p: fresh_path(spark, p) for p in ("state_path", "checkpoint")}
    source = growing(spark, df, "source_url", parts=4)
    report = ST.stream_quality_gate(source, policy, lambda d: d, failed, **paths)
    cols = ["run_id", "passed", "failed_checks", "severity", "should_fail"]
    rows = df.orderBy("source_url").collect()
    step = -(-len(rows) // 4)
    for batch in range(4):
        part = spark.createDataFrame(rows[: (batch + 1) * step], df.schema)
        want = Q.quality_summary_gate(Q.run_quality(part, failed(part)), policy)
        assert sorted(report.where(F.col("micro_batch") == batch).select(*cols).collect()) == sorted(want.select(*cols).collect()), batch
    again = ST.stream_quality_gate(source, policy, lambda d: d, failed, **paths)
    assert sorted(again.collect()) == sorted(report.collect())


def test_pressure_restart_without_new_files(spark):
    source, paths = growing(spark, work(spark), "batch_id"), {p: fresh_path(spark, p) for p in ("state_path", "checkpoint")}
    first = sorted(ST.stream_pressure(source, **paths).collect())
    assert first and sorted(ST.stream_pressure(source, **paths).collect()) == first


def test_pressure_of_slow_runs(spark):
    """A streak goes on over micro-batches that are slow throughout and ends with a quick work batch."""
    times = {"slow": [9000.0] * 12, "late": [1.0] * 3 + [9000.0] * 9, "quick": [9000.0] * 11 + [1.0], "short": [9000.0] * 2}
    rows = [(run, i, ms, 10, 10, 0, 0, 0, 1, 1) for run, all_ms in times.items() for i, ms in enumerate(all_ms)]
    df = spark.createDataFrame(rows, work(spark).schema)
    got = {r["run_id"]: (r["total_batches"], r["consecutive_slow"]) for r in ST.stream_pressure(growing(spark, df, "batch_id", 5)).collect()}
    assert got == {"slow": (12, 12), "late": (12, 9), "quick": (12, 0), "short": (2, 2)}
