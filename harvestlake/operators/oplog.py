"""Fetch logs and work batches: pressure, bottlenecks, diagnosis, health, cooldown, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harvestlake import rules
from harvestlake.functions import urls
from harvestlake.operators import scans

BATCH_CHUNK = 1024  # batches of a run per chunk


def _kept(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def _pct(c: Column, digits: int) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(c * 100, digits)), F.lit("%"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def batch_chunk(order: str = "batch_id") -> Column:
    return F.floor(F.col(order) / F.lit(BATCH_CHUNK)).cast("bigint")


# ---------------------------------------------------------------- pressure
def slow_streak(batches: DataFrame, threshold: float = rules.PRESSURE["latency_warn_ms"]) -> DataFrame:
    """Consecutive slow batches of a run up to each batch."""
    return scans.streak(batches, ["run_id"], ["batch_id"], batch_chunk(), F.col("latency_ms") < threshold, "slow_streak")


def zero_yield_streak(batches: DataFrame) -> DataFrame:
    """Consecutive batches of a run without records and without new urls."""
    fruitful = (F.col("records_saved") > 0) | (F.col("discovered_urls") > 0)
    return scans.streak(batches, ["run_id"], ["batch_id"], batch_chunk(), fruitful, "zero_streak")


def _ladder(avg: Column, failure: Column, retry: Column, loss: Column, slow: Column) -> tuple[Column, Column]:
    """Throttle recommendation and its reason."""
    p = rules.PRESSURE
    steps = [
        (failure >= p["failure_rate_pause"], "abort", F.concat(F.lit("failure_rate "), _pct(failure, 1), F.lit(" >= 40%"))),
        (avg >= p["latency_pause_ms"], "pause", F.concat(F.lit("avg_latency "), F.format_string("%.0f", F.round(avg, 0)), F.lit("ms >= 15000ms"))),
        (slow >= p["slow_batches"], "pause", F.concat(F.lit("consecutive_slow_batches "), slow, F.lit(" >= 3"))),
        (failure >= p["failure_rate_warn"], "slow_down", F.concat(F.lit("failure_rate "), _pct(failure, 1), F.lit(" >= 15%"))),
        (retry >= p["retry_rate_warn"], "slow_down", F.concat(F.lit("retry_rate "), _pct(retry, 1), F.lit(" >= 25%"))),
        (avg >= p["latency_warn_ms"], "slow_down", F.concat(F.lit("avg_latency "), F.format_string("%.0f", F.round(avg, 0)), F.lit("ms >= 5000ms"))),
        (loss >= p["quality_loss_warn"], "slow_down", F.concat(F.lit("quality_loss_rate "), _pct(loss, 1), F.lit(" >= 10%"))),
    ]
    action = reason = None
    for test, name, why in steps:
        action = F.when(test, name) if action is None else action.when(test, name)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return action.otherwise("proceed"), reason.otherwise("")


def _signals(df: DataFrame, *keep: str) -> DataFrame:
    """Rates and recommendation from n, latency, claimed, failed, retried, errors, slow."""
    claimed = F.col("claimed")
    staged = df.withColumns(
        {
            "avg_latency_ms": F.col("latency") / F.col("n"),
            "failure_rate": _rate(F.col("failed"), claimed),
            "retry_rate": _rate(F.col("retried"), claimed),
            "quality_loss_rate": _rate(F.col("errors"), claimed),
        }
    )
    action, reason = _ladder(F.col("avg_latency_ms"), F.col("failure_rate"), F.col("retry_rate"), F.col("quality_loss_rate"), F.col("slow"))
    return staged.select(
        *keep,
        F.col("n").alias("total_batches"),
        F.round("avg_latency_ms", 1).alias("avg_latency_ms"),
        *[F.round(c, 4).alias(c) for c in ("failure_rate", "retry_rate", "quality_loss_rate")],
        F.col("slow").alias("consecutive_slow"),
        action.alias("recommendation"),
        reason.alias("reason"),
    )


def batch_totals(batches: DataFrame) -> DataFrame:
    """Sums per run with the slow streak at its last batch."""
    return slow_streak(batches).groupBy("run_id").agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency"), F.sum("claimed").alias("claimed"), F.sum("failed").alias("failed"),
        F.sum("retried").alias("retried"), F.sum("checkpoint_errors").alias("errors"), F.max_by("slow_streak", "batch_id").alias("slow"),
        F.sum("records_saved").alias("records_saved"), F.sum("succeeded").alias("succeeded"),
    )


def p95_latency(batches: DataFrame, band_ms: float = 250.0) -> DataFrame:
    """Value at index min(int(n * 0.95), n - 1) of the sorted latencies of each run."""
    rank = F.least(F.floor(F.col("n") * 0.95).cast("bigint"), F.col("n") - 1)
    return scans.value_at_rank(batches, ["run_id"], "latency_ms", rank, band_ms, "p95_latency_ms")


def batch_pressure(batches: DataFrame) -> DataFrame:
    """Pressure signals and throttle recommendation per run."""
    p95 = p95_latency(batches).select("run_id", F.round("p95_latency_ms", 1).alias("p95_latency_ms"))
    return _signals(batch_totals(batches), "run_id").join(p95, "run_id")


def running_pressure(batches: DataFrame) -> DataFrame:
    """Pressure signals after every batch."""
    sums = {
        "n": F.lit(1).cast("bigint"), "latency": F.col("latency_ms"), "claimed_sum": F.col("claimed"), "failed_sum": F.col("failed"),
        "retried_sum": F.col("retried"), "errors_sum": F.col("checkpoint_errors"),
    }
    cols = ["run_id", "batch_id", "latency_ms", "claimed", "failed", "retried", "checkpoint_errors"]
    with_streak = slow_streak(batches.select(*cols))
    run = scans.running(with_streak, ["run_id"], ["batch_id"], batch_chunk(), sums=sums)
    shaped = run.select(
        "run_id", "batch_id", "n", "latency", F.col("claimed_sum").alias("claimed"), F.col("failed_sum").alias("failed"),
        F.col("retried_sum").alias("retried"), F.col("errors_sum").alias("errors"), F.col("slow_streak").alias("slow"),
    )
    return _signals(shaped, "run_id", "batch_id")


def _word_hits(words) -> Column:
    """How many of the words occur in any error text of the group."""
    low = F.lower("error")
    return sum((F.max(F.contains(low, F.lit(w)).cast("int")) for w in words), F.lit(0))


def run_errors(log: DataFrame) -> DataFrame:
    """Keyword hits over all error texts of a run."""
    return log.groupBy("run_id").agg(
        _word_hits(rules.BLOCKING_WORDS).alias("blocking_hits"), _word_hits(rules.SELECTOR_WORDS).alias("selector_hits")
    )


def classify_bottlenecks(batches: DataFrame, log: DataFrame, frontier: DataFrame) -> DataFrame:
    """Bottleneck rows per run; ``frontier`` has run_id, done, queued."""
    totals = batch_totals(batches).join(run_errors(log), "run_id", "left").join(frontier, "run_id", "left")
    totals = totals.fillna(0, ["blocking_hits", "selector_hits", "done", "queued"]).withColumns(
        {
            "avg": F.col("latency") / F.col("n"), "failure": _rate(F.col("failed"), F.col("claimed")),
            "retry": _rate(F.col("retried"), F.col("claimed")), "loss": _rate(F.col("errors"), F.col("claimed")),
        }
    )
    avg, failure, retry, loss, hits = (F.col(c) for c in ("avg", "failure", "retry", "loss", "blocking_hits"))

    def row(test: Column, key: str, severity: Column, evidence: Column) -> Column:
        return F.when(test, F.struct(F.lit(key).alias("bottleneck"), severity.alias("severity"), F.round(evidence.cast("double"), 4).alias("evidence")))

    two = lambda test: F.when(test, "critical").otherwise("warn")
    found = _kept(
        row((hits >= 2) | ((failure >= 0.30) & (hits >= 1)), "access_blocking", two(failure >= 0.40), hits),
        row(F.col("selector_hits") >= 1, "selector_loss", F.lit("warn"), F.col("selector_hits")),
        row((F.col("done") > 0) & (F.col("queued") == 0) & (F.col("n") > 0) & (1 - failure < 0.5), "pagination_gap", F.lit("warn"), 1 - failure),
        row(avg >= 10000, "transport_pressure", two(avg >= 15000), F.round(avg, 1)),
        row(retry >= 0.20, "retry_pressure", two(retry >= 0.40), retry),
        row(loss >= 0.05, "quality_loss", two(loss >= 0.15), loss),
    )
    return totals.select("run_id", F.inline(found))


def repeated_page_gaps(batches: DataFrame, frontier: DataFrame) -> DataFrame:
    """Runs that ran dry early or whose batches stopped yielding records."""
    totals = batch_totals(batches).join(frontier, "run_id", "left").fillna(0, ["done", "queued"])
    failure = _rate(F.col("failed"), F.col("claimed"))
    return totals.select(
        "run_id",
        ((F.col("done") > 0) & (F.col("queued") == 0) & (1 - failure < 0.5)).alias("early_exhaustion"),
        ((F.col("n") > 2) & (F.col("records_saved") < 5)).alias("pagination_stuck"),
    )


def supervise_batch(batches: DataFrame) -> DataFrame:
    """Advice per batch: abort, pause, repair, slow down or proceed."""
    b = zero_yield_streak(batches)
    total = F.col("succeeded") + F.col("failed")
    failure, success = _rate(F.col("failed"), total), _rate(F.col("succeeded"), total)
    zero = F.col("zero_streak")
    dry = (F.col("claimed") > 0) & (F.col("records_saved") == 0) & (F.col("discovered_urls") == 0)
    low = (F.col("claimed") > 0) & (_rate(F.col("records_saved"), F.col("claimed")) < 0.05) & (F.col("discovered_urls") == 0)
    steps = [
        ((total > 0) & (failure >= 0.85), "abort", "critical"),
        (dry & (zero >= 2), "pause", "critical"),
        (dry, "repair_after_run", "warning"),
        ((total > 0) & (success < 0.6), "slow_down", "warning"),
        (low, "repair_after_run", "warning"),
    ]
    action = severity = None
    for test, name, level in steps:
        action = F.when(test, name) if action is None else action.when(test, name)
        severity = F.when(test, level) if severity is None else severity.when(test, level)
    return b.select("run_id", "batch_id", "zero_streak", action.otherwise("proceed").alias("action"), severity.otherwise("info").alias("severity"))


def supervision_summary(decisions: DataFrame) -> DataFrame:
    """Decisions of a run: counts, worst severity, last action and what to do next."""
    out = decisions.groupBy("run_id").agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("abort", "pause", "repair_after_run", "slow_down", "proceed")],
        F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)).alias("_worst"),
        F.max_by("action", "batch_id").alias("last_action"),
    )
    last = F.col("last_action")
    return out.select(
        "run_id", "events", *[f"n_{a}" for a in ("abort", "pause", "repair_after_run", "slow_down", "proceed")],
        F.when(F.col("_worst") == 2, "critical").when(F.col("_worst") == 1, "warning").otherwise("info").alias("highest_severity"),
        "last_action",
        F.when(last.isin("pause", "abort", "repair_after_run"), "ai_rerun").when(last == "slow_down", "reduce_concurrency").otherwise("").alias("next_action"),
    )


# ---------------------------------------------------------------- diagnosis
def failure_counters(log: DataFrame) -> DataFrame:
    """Counters a diagnosis needs, per run, from the fetch log."""
    low, cat = F.lower("error"), F.col("failure_category")
    named = {}
    for name in rules.REPAIR_STEPS:
        buckets, words = rules.DIAGNOSIS_BUCKETS.get(name, ()), rules.DIAGNOSIS_WORDS.get(name, ())
        if buckets or words:
            per_row = F.lit(0)
            if buckets:
                per_row = per_row + cat.isin(*buckets).cast("int")
            if words:
                per_row = per_row + urls.has_token(low, words).cast("int")
            named[name] = F.sum(per_row)
    return log.groupBy("run_id").agg(
        *[v.alias(f"c_{k}") for k, v in named.items()], F.sum("records").alias("records_saved"), F.count_if("ok").alias("succeeded"), F.count("*").alias("claimed")
    )


def diagnose_failures(counters: DataFrame) -> DataFrame:
    """One row per failure category found in a run, worst first.

    Expects the counter columns of ``failure_counters`` plus status, batches, coverage,
    indicator, short_pages, no_html, selectors and selector_misses.
    """
    saved, ind = F.col("records_saved"), F.col("indicator")
    n = lambda name: F.col(f"c_{name}")

    def row(test: Column, name: str, severity: Column | str, confidence: Column | float, signals: Column) -> Column:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        conf = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.when(
            test,
            F.struct(
                F.lit(list(rules.REPAIR_STEPS).index(name)).alias("ord"), F.lit(name).alias("category"), sev.alias("severity"),
                F.round(conf, 4).alias("confidence"), signals.cast("bigint").alias("signals"),
            ),
        )

    one = F.lit(1)
    done = F.col("status").isin("completed", "failed")
    misses, tried = F.col("selector_misses"), F.col("selectors")
    found = _kept(
        row(n("access_blocked") > 0, "access_blocked", "critical", F.least(F.lit(0.9), 0.5 + n("access_blocked") * 0.1), n("access_blocked")),
        row(n("access_challenge") > 0, "access_challenge", "critical", F.least(F.lit(0.95), 0.6 + n("access_challenge") * 0.1), n("access_challenge")),
        row(n("browser_crash") > 0, "browser_crash", "critical", 0.7, n("browser_crash")),
        row(n("proxy_error") > 0, "proxy_error", "warning", 0.6, n("proxy_error")),
        row(n("timeout") > 0, "timeout", "warning", 0.6, n("timeout")),
        row(F.col("no_html") | (F.col("short_pages") > 0), "empty_html", F.when(F.col("no_html"), "critical").otherwise("warning"), F.when(F.col("no_html"), 0.8).otherwise(0.6), F.col("short_pages")),
        row(n("api_replay_failed") > 0, "api_replay_failed", "warning", 0.6, n("api_replay_failed")),
        row((saved == 0) & (done | (F.col("status") == "executed")), "no_records", F.when(done, "critical").otherwise("warning"), F.when(done, 0.9).otherwise(0.7), one),
        row((F.col("batches") > 2) & (saved < 5), "pagination_stuck", "warning", 0.5, F.col("batches")),
        row((misses > 0) & (misses >= F.greatest(one, F.floor(tried / 2))), "selector_miss", "warning", 0.7, misses),
        row((F.col("coverage") < 0.5) & ind.isin("fail", "warn"), "low_coverage", "warning", 0.6, one),
        row(ind == "fail", "quality_fail", "warning", 0.7, one),
    )
    return counters.select("run_id", "records_saved", F.inline(found))


def run_health(diagnoses: DataFrame, runs: DataFrame) -> DataFrame:
    """Overall health, focus list and manual flag of each run; at most twelve rows per run are folded."""
    sev = F.col("severity")
    order = F.struct(F.when(sev == "critical", 0).otherwise(1).alias("s"), (-F.col("confidence")).alias("c"), F.col("ord"))
    focus = None
    for cat, name in rules.DIAGNOSIS_FOCUS.items():
        focus = F.when(F.col("category") == cat, name) if focus is None else focus.when(F.col("category") == cat, name)
    agg = diagnoses.withColumn("_f", F.struct(order.alias("o"), focus.alias("f"))).groupBy("run_id").agg(
        F.count_if(sev == "critical").alias("critical"),
        F.count_if(sev == "warning").alias("warnings"),
        F.array_sort(F.collect_list("_f")).alias("_fs"),
        F.max((F.col("category") == "browser_crash") & (sev == "critical") | ((F.col("category") == "proxy_error") & (F.col("confidence") > 0.8))).alias("manual"),
    )
    joined = runs.select("run_id", "records_saved").join(agg, "run_id", "left").fillna(0, ["critical", "warnings"])
    saved, crit, warn = F.col("records_saved"), F.col("critical"), F.col("warnings")
    fallback = F.when(saved > 0, "healthy").otherwise("unknown")
    health = (
        F.when(crit > 0, "critical").when(warn > 1, "degraded").when(warn == 1, F.when(saved == 0, "degraded").otherwise("healthy")).otherwise(fallback)
    )
    names = F.array_distinct(F.filter(F.transform("_fs", lambda x: x["f"]), lambda f: f.isNotNull()))
    return joined.select(
        "run_id", "records_saved", health.alias("health"), F.array_join(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, 5), ",").alias("focus"),
        F.coalesce("manual", F.lit(False)).alias("manual"),
    )


def repair_plan(diagnoses: DataFrame) -> DataFrame:
    """Repair steps per run, cheapest first, capped by the worst severity, closed by a rerun."""
    steps = F.create_map(*[x for k, v in rules.REPAIR_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    cost = F.create_map(*[x for k, v in rules.REPAIR_COST.items() for x in (F.lit(k), F.lit(v))])
    sev = F.when(F.col("severity") == "critical", 0).otherwise(1)
    rows = diagnoses.select("run_id", "category", "severity", sev.alias("sev"), (-F.col("confidence")).alias("neg"), "ord", F.posexplode(F.element_at(steps, F.col("category"))).alias("pos", "step"))
    # the first diagnosis (worst, surest, earliest checked) that names a step keeps it
    first = rows.groupBy("run_id", "step").agg(
        F.min(F.struct("sev", "neg", "ord", "pos", "category", "severity")).alias("d"), F.min("sev").alias("_s")
    )
    worst = diagnoses.groupBy("run_id").agg(F.min(sev).alias("worst"))
    limits = first.join(worst, "run_id").withColumn("cost", F.element_at(cost, F.col("step")))
    (most_c, limit_c), (most_w, limit_w) = rules.REPAIR_CAP["critical"], rules.REPAIR_CAP["warning"]
    allowed = limits.where(F.col("cost") <= F.when(F.col("worst") == 0, limit_c).otherwise(limit_w))
    w = W.partitionBy("run_id").orderBy("cost", "d.sev", "d.neg", "d.ord", "d.pos")
    most = F.when(F.col("worst") == 0, most_c).otherwise(most_w)
    kept = allowed.withColumn("step_no", F.row_number().over(w)).where(F.col("step_no") <= most)
    plan = kept.select("run_id", "step_no", "step", "cost", F.col("d.category").alias("category"))
    rerun = plan.groupBy("run_id").agg((F.max("step_no") + 1).alias("step_no")).select(
        "run_id", "step_no", F.lit("prepare_rerun").alias("step"), F.lit(0).alias("cost"), F.lit("").alias("category")
    )
    return plan.unionByName(rerun)


def repair_delta(before: DataFrame, after: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """What a repair changed: records, coverage, health, and how many findings it settled."""
    level = F.create_map(*[x for k, v in rules.HEALTH_ORDER.items() for x in (F.lit(k), F.lit(v))])
    pick = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("records_saved", "coverage", "health")]
    joined = before.select("run_id", *pick("b")).join(after.select("run_id", *pick("a")), "run_id")
    counts = diagnoses.groupBy("run_id").agg(
        F.count_if(F.col("category").isin("no_records", "low_coverage")).alias("_by_records"),
        F.count_if(F.col("category").isin("access_blocked", "access_challenge")).alias("_by_health"),
    )
    full = joined.join(counts, "run_id", "left").fillna(0, ["_by_records", "_by_health"])
    records = F.col("a_records_saved") - F.col("b_records_saved")
    coverage = F.round(F.col("a_coverage") - F.col("b_coverage"), 4)
    health = F.element_at(level, F.col("a_health")) - F.element_at(level, F.col("b_health"))
    resolved = F.when(F.col("a_records_saved") > 0, F.col("_by_records")).otherwise(0) + F.when(F.col("a_health").isin("healthy", "degraded"), F.col("_by_health")).otherwise(0)
    return full.select(
        "run_id", records.alias("records_delta"), coverage.alias("coverage_delta"), health.alias("health_delta"),
        ((records > 0) | (coverage > 0.05) | (health > 0)).alias("improved"), resolved.alias("resolved"),
    )


# ---------------------------------------------------------------- endpoints
def endpoint_cooldown(log: DataFrame, after: int = rules.COOLDOWN_AFTER_FAILURES, chunk_us: int = scans.HOUR_US) -> DataFrame:
    """Failure count and cooldown end of an endpoint after each request.

    A success clears both; from the ``after``-th failure in a row the wait doubles up to its
    cap.  Time and wait only grow inside such a run, so the latest end is also the largest.
    ``chunk_us`` bounds what one task sees of a busy endpoint.
    """
    rows = log.select("endpoint", "request_id", "ts_us", "ok")
    counted = scans.streak(rows, ["endpoint"], ["ts_us", "request_id"], scans.time_chunk("ts_us", chunk_us), F.col("ok"), "failures")
    wait = F.least(rules.COOLDOWN_BASE_SECONDS * F.pow(F.lit(2), F.least(F.col("failures") - after, F.lit(30))), F.lit(rules.COOLDOWN_MAX_SECONDS))
    until = F.when(F.col("failures") >= after, F.col("ts_us") + (wait * 1000000).cast("bigint")).otherwise(0)
    return counted.withColumn("cooldown_until_us", until)


def endpoint_state(log: DataFrame, chunk_us: int = scans.HOUR_US) -> DataFrame:
    """Latest health record of each endpoint."""
    last = F.struct("ts_us", "request_id")
    ends = endpoint_cooldown(log, chunk_us=chunk_us).groupBy("endpoint").agg(
        F.max_by(F.struct("failures", "cooldown_until_us"), last).alias("_l"), F.max("ts_us").alias("last_used_us"), F.count_if("ok").alias("success_count")
    )
    return ends.select("endpoint", "success_count", F.col("_l.failures").alias("failure_count"), F.col("_l.cooldown_until_us").alias("cooldown_until_us"), "last_used_us")


def endpoint_health_summary(state: DataFrame, now_us: int) -> DataFrame:
    cooling = F.count_if(F.col("cooldown_until_us") > now_us)
    return state.agg(
        F.count("*").alias("tracked"), (F.count("*") - cooling).alias("healthy"), cooling.alias("in_cooldown"), F.coalesce(F.sum("failure_count"), F.lit(0)).alias("total_failures")
    )


def _health(ok: Column, total: Column, timeouts: Column, challenges: Column, blocked: Column) -> Column:
    """Success share less capped penalties, never below zero."""
    penalty = F.least(timeouts * 0.1, F.lit(0.3)) + F.least(challenges * 0.15, F.lit(0.3)) + F.least(blocked * 0.05, F.lit(0.15))
    return F.round(F.greatest(F.lit(0.0), ok / total - penalty), 6)


CHALLENGE_CATEGORIES = ("challenge_like", "managed_challenge", "captcha")


def _health_counts() -> dict[str, Column]:
    cat = F.col("failure_category")
    return {
        "w_total": F.count("*"),
        "w_ok": F.sum(F.col("ok").cast("int")),
        "w_timeouts": F.sum((cat == "navigation_timeout").cast("int")),
        "w_challenges": F.sum(cat.isin(*CHALLENGE_CATEGORIES).cast("int")),
        "w_blocked": F.sum((cat == "http_blocked").cast("int")),
    }


def profile_health_score(log: DataFrame, window_s: int = 300, bucket_us: int = scans.HOUR_US) -> DataFrame:
    """Health of an endpoint over the last seconds of event time, after each request."""
    rows = log.select("endpoint", "request_id", "ts_us", "ok", "failure_category")
    seen = scans.sliding(rows, ["endpoint"], "ts_us", window_s * 1_000_000, _health_counts(), bucket_us=bucket_us)
    score = _health(*[F.col(c) for c in ("w_ok", "w_total", "w_timeouts", "w_challenges", "w_blocked")])
    return seen.select("endpoint", "request_id", "ts_us", F.col("w_total").alias("window_requests"), score.alias("health_score"))


def cumulative_health(log: DataFrame) -> DataFrame:
    """All-time health of each endpoint, the fallback where no window holds records."""
    out = log.groupBy("endpoint").agg(*[v.alias(k) for k, v in _health_counts().items()])
    score = _health(*[F.col(c) for c in ("w_ok", "w_total", "w_timeouts", "w_challenges", "w_blocked")])
    return out.select("endpoint", F.col("w_total").alias("requests"), score.alias("health_score"))


def healthiest_profile(log: DataFrame, k: int = 1) -> DataFrame:
    """Endpoints with the best latest score; the first name wins ties."""
    latest = profile_health_score(log).groupBy("endpoint").agg(F.max_by("health_score", F.struct("ts_us", "request_id")).alias("health_score"))
    return latest.orderBy(F.desc("health_score"), "endpoint").limit(k)


# ---------------------------------------------------------------- metrics
def fetch_metrics(log: DataFrame) -> DataFrame:
    """Per run: totals, and counts per domain, status and event type, in one pass."""
    dims = ["domain", "status_code", "event_type"]
    sets = [["run_id"], *[["run_id", d] for d in dims]]
    grouped = log.groupingSets([[F.col(c) for c in s] for s in sets], "run_id", *dims).agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("ok_count"), F.count_if(~F.col("ok")).alias("fail_count"),
        F.count_if("retried").alias("retries"), F.max("k").alias("max_active"), *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    kind = F.when(F.col("_g_domain") == 0, "domain").when(F.col("_g_status_code") == 0, "status").when(F.col("_g_event_type") == 0, "event_type").otherwise("total")
    value = F.coalesce(F.col("domain"), F.col("status_code").cast("string"), F.col("event_type"), F.lit(""))
    return grouped.select("run_id", kind.alias("metric"), value.alias("key"), "requests", "ok_count", "fail_count", "retries", "max_active")


def fetch_errors(log: DataFrame, per_run: int | None = None, chunk_us: int = scans.HOUR_US) -> DataFrame:
    """Error texts of each run in order, numbered over time chunks; with ``per_run`` only the first ones, cut before the shuffle."""
    failed = log.where("NOT ok AND error <> ''").select("run_id", "ts_us", "request_id", "error")
    if per_run:
        w = W.partitionBy("run_id").orderBy("ts_us", "request_id")
        return failed.withColumn("error_no", F.row_number().over(w)).drop("ts_us").where(F.col("error_no") <= per_run)
    numbered = scans.running(failed, ["run_id"], ["ts_us", "request_id"], scans.time_chunk("ts_us", chunk_us), sums={"error_no": F.lit(1)})
    return numbered.select("run_id", "request_id", "error", F.col("error_no").cast("int").alias("error_no"))


def failure_histogram(*sources: DataFrame) -> DataFrame:
    """Failure buckets of several sources summed; sources have run_id, bucket, n."""
    out = None
    for s in sources:
        s = s.select("run_id", "bucket", "n")
        out = s if out is None else out.unionByName(s)
    return out.groupBy("run_id", "bucket").agg(F.sum("n").alias("failures"))


def domain_memory(log: DataFrame) -> DataFrame:
    """Per domain: success and failure counts, last mode that worked, last challenge seen."""
    at = F.struct("ts_us", "request_id")
    challenge = F.when(~F.col("ok") & F.col("failure_category").isin(*CHALLENGE_CATEGORIES, "http_blocked"), F.col("failure_category"))
    return log.groupBy(F.lower("domain").alias("domain")).agg(
        F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"),
        F.coalesce(F.max_by("mode", F.when(F.col("ok"), at)), F.lit("")).alias("preferred_mode"),
        F.coalesce(F.max_by(challenge, F.when(challenge.isNotNull(), at)), F.lit("")).alias("last_challenge"),
        F.max("ts_us").alias("updated_us"),
    )


SELECTOR_KEY = ("site_key", "name", "selector", "selector_type", "attribute")


def selector_memory(events: DataFrame) -> DataFrame:
    """Per selector: saves, recoveries, latest signature and last recovery score.

    ``events`` has the key columns, kind ('save' or 'recover'), signature, score, ts_us, event_id.
    """
    at = F.struct("ts_us", "event_id")
    save, recover = F.col("kind") == "save", F.col("kind") == "recover"
    return events.groupBy(*SELECTOR_KEY).agg(
        F.count_if(save).alias("success_count"), F.count_if(recover).alias("recover_count"),
        F.max_by("signature", F.when(save, at)).alias("signature"),
        F.coalesce(F.max_by("score", F.when(recover, at)), F.lit(0.0)).alias("last_score"),
        F.max("ts_us").alias("updated_us"),
    ).where("success_count > 0")


def selector_lookup(memory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Signature of each wanted selector: exact key, else the newest of the (site, name)."""
    newest = memory.groupBy("site_key", "name").agg(F.max_by("signature", F.struct("updated_us", "selector")).alias("_newest"))
    exact = memory.select(*SELECTOR_KEY, F.col("signature").alias("_exact"))
    joined = wanted.join(exact, list(SELECTOR_KEY), "left").join(newest, ["site_key", "name"], "left")
    return joined.select(
        *SELECTOR_KEY, F.coalesce("_exact", "_newest", F.lit("")).alias("signature"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_newest").isNotNull(), "newest").otherwise("none").alias("found_by"),
    )


def frame_summary(frames: DataFrame) -> DataFrame:
    """Per page: connections, directions, data types and bytes of its websocket frames."""
    sent, is_text = F.col("direction") == "sent", F.col("data_type") == "text"
    return frames.groupBy("page").agg(
        F.count_distinct("connection").alias("connections"), F.count("*").alias("total_frames"), F.count_if(sent).alias("sent_frames"),
        F.count_if(~sent).alias("received_frames"), F.count_if(is_text).alias("text_frames"), F.count_if(~is_text).alias("binary_frames"), F.sum("byte_length").alias("total_bytes"),
    )


def run_latest(log: DataFrame) -> DataFrame:
    """Latest checkpoint of each run with its item and failure counts."""
    return log.groupBy("run_id").agg(
        F.max_by(F.struct("request_id", "domain"), "request_id").alias("_l"), F.sum("records").cast("bigint").alias("item_count"), F.count_if(~F.col("ok")).alias("failure_count")
    ).select("run_id", F.col("_l.request_id").alias("checkpoint_id"), F.col("_l.domain").alias("domain"), "item_count", "failure_count")


def multi_site_summary(sites: DataFrame) -> DataFrame:
    """Records per site and, in the ``*`` row, all sites; ``sites`` has site, ok, records."""
    per_site = sites.groupBy("site").agg(F.every("ok").alias("ok"), F.sum(F.when(F.col("ok"), F.col("records")).otherwise(0)).alias("records"))
    total = per_site.rollup("site").agg(
        F.count("*").alias("sites"), F.count_if("ok").alias("ok_sites"), F.count_if(~F.col("ok")).alias("failed_sites"), F.sum("records").alias("records"), F.grouping("site").alias("_g")
    )
    return total.select(F.when(F.col("_g") == 1, "*").otherwise(F.col("site")).alias("site"), "sites", "ok_sites", "failed_sites", "records")


def append_failure_rows(log: DataFrame) -> DataFrame:
    """Failure log rows with default bucket and redacted error text."""
    from harvestlake.functions import text

    return log.where("NOT ok").select(
        "run_id", "request_id", F.coalesce(F.nullif(F.col("failure_category"), F.lit("")), F.lit("runtime_error")).alias("bucket"),
        text.redact_text(F.col("error")).alias("error"), "retried",
    )
