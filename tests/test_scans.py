"""Chunked running values against plain Python, with one group holding most rows."""

import random

from pyspark.sql import functions as F

from harvestlake.operators import frontier, oplog, scans


def log_rows(n=1500, seed=3):
    """Two thirds of the rows belong to one endpoint."""
    r = random.Random(seed)
    rows, ts = [], 0
    for i in range(n):
        ts += r.choice([1_000_000, 40_000_000, 900_000_000])
        key = "hot" if r.random() < 0.66 else f"e{r.randrange(5)}"
        ok = r.random() < 0.4
        rows.append((key, i, ts, ok, r.choice(["navigation_timeout", "challenge_like", "http_blocked", "server_error"]) if not ok else "", r.randrange(9)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "endpoint string, request_id long, ts_us long, ok boolean, failure_category string, v int")


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[2], x[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_streak_and_index(spark):
    rows = log_rows()
    got = scans.streak(frame(spark, rows), ["endpoint"], ["ts_us", "request_id"], scans.time_chunk(), F.col("ok"), "s", index="i").collect()
    got = {r["request_id"]: (r["s"], r["i"]) for r in got}
    for rs in groups(rows).values():
        n = 0
        for i, row in enumerate(rs, 1):
            n = 0 if row[3] else n + 1
            assert got[row[1]] == (n, i)


def test_running_sum_max_lag(spark):
    rows = log_rows()
    got = scans.running(
        frame(spark, rows), ["endpoint"], ["ts_us", "request_id"], scans.time_chunk(), sums={"total": F.col("v")}, maxes={"top": F.col("v")}, lags={"prev": F.col("v")}
    ).collect()
    got = {r["request_id"]: (r["total"], r["top"], r["prev"]) for r in got}
    for rs in groups(rows).values():
        total, top, prev = 0, -1, None
        for row in rs:
            total, top = total + row[5], max(top, row[5])
            assert got[row[1]] == (total, top, prev)
            prev = row[5]


def test_cooldown_loop(spark):
    rows = log_rows()
    got = {r["request_id"]: (r["failures"], r["cooldown_until_us"]) for r in oplog.endpoint_cooldown(frame(spark, rows)).collect()}
    for rs in groups(rows).values():
        failures = until = 0
        for row in rs:
            if row[3]:
                failures = until = 0
            else:
                failures += 1
                if failures >= 3:
                    until = max(until, row[2] + min(30 * 2 ** (failures - 3), 600) * 1_000_000)
            assert got[row[1]] == (failures, until)


def test_politeness_loop(spark):
    rows = [(r[0], r[1], r[2]) for r in log_rows()]
    df = spark.createDataFrame(rows, "domain string, request_id long, ts_us long")
    delay = 300_000_000
    got = {r["request_id"]: r["start_us"] for r in frontier.politeness_schedule(df, F.lit(delay).cast("bigint")).collect()}
    last = {}
    for key, i, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        start = max(ts, last[key] + delay) if key in last else ts
        last[key] = start
        assert got[i] == start


def test_sliding_health(spark):
    rows = log_rows()
    got = {r["request_id"]: (r["window_requests"], r["health_score"]) for r in oplog.profile_health_score(frame(spark, rows), 600).collect()}
    for rs in groups(rows).values():
        for row in rs:
            seen = [x for x in rs if row[2] - 600_000_000 <= x[2] <= row[2]]
            n = lambda *c: sum(x[4] in c for x in seen)
            score = sum(x[3] for x in seen) / len(seen) - min(n("navigation_timeout") * 0.1, 0.3) - min(n("challenge_like") * 0.15, 0.3) - min(n("http_blocked") * 0.05, 0.15)
            assert got[row[1]][0] == len(seen)
            assert abs(got[row[1]][1] - max(0.0, score)) < 1e-6


def test_value_at_rank(spark):
    r = random.Random(5)
    rows = [(k, float(r.randrange(100000)) / 7) for k in ("a", "b") for _ in range(20 if k == "a" else 333)]
    df = spark.createDataFrame(rows, "run_id string, latency_ms double")
    got = {x["run_id"]: x["p95_latency_ms"] for x in oplog.p95_latency(df).collect()}
    for k in ("a", "b"):
        values = sorted(v for key, v in rows if key == k)
        assert got[k] == values[min(int(len(values) * 0.95), len(values) - 1)]


def test_no_window_over_a_whole_group(spark):
    """The only window over a bare group runs on the one-row-per-chunk table."""
    plan = oplog.endpoint_cooldown(frame(spark, log_rows(200)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    whole = [w for w in windows if "_chunk" not in w.split("],", 1)[1]]
    assert windows and all("sum(_n" in w or "max(" in w for w in whole)


def test_rows_without_a_key_are_a_group(spark):
    df = spark.createDataFrame([("a", 1, True), (None, 1, False), (None, 2, False)], "k string, t bigint, b boolean")
    got = scans.streak(df, ["k"], ["t"], scans.F.lit(0), scans.F.col("b"), "n").orderBy("k", "t").collect()
    assert [(r.k, r.t, r.n) for r in got] == [(None, 1, 1), (None, 2, 2), ("a", 1, 0)]
