"""Queries over fetch logs, batches, the frontier and run coverage."""

from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.operators import frontier as FR
from harvestlake.operators import funnel as FU
from harvestlake.operators import oplog as O
from harvestlake.operators import quality as Q
from harvestlake.plans import records_plan as RP
from harvestlake.plans import sqlx as S
from harvestlake.plans.registry import query

FL, BA = ("fetch_log",), ("batches",)
NOW = 1_000_000_000

# ---------------------------------------------------------------- streaks and pressure


def _streak(cond: str, name: str) -> str:
    return f"""sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, island ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS {name}
  FROM (SELECT *, sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS island FROM batches) i"""


_SLOW = f"slow AS (SELECT * EXCLUDE (island), {_streak('latency_ms < 5000', 's')}), slow2 AS (SELECT *, s::bigint AS slow_streak FROM slow)"
query("slow_streak", f"WITH {_SLOW} SELECT run_id, batch_id, slow_streak FROM slow2", BA)(lambda t: O.slow_streak(t("batches")).select("run_id", "batch_id", "slow_streak"))
_ZERO = f"zero AS (SELECT * EXCLUDE (island), {_streak('records_saved > 0 OR discovered_urls > 0', 'z')}), zero2 AS (SELECT *, z::bigint AS zero_streak FROM zero)"
query("zero_yield_streak", f"WITH {_ZERO} SELECT run_id, batch_id, zero_streak FROM zero2", BA)(lambda t: O.zero_yield_streak(t("batches")).select("run_id", "batch_id", "zero_streak"))

_P = lambda x: f"printf('%.1f', round({x} * 100, 1)) || '%'"
_LADDER = f"""CASE WHEN failure_rate >= 0.4::double THEN 'abort' WHEN avg_l >= 15000 THEN 'pause' WHEN slow >= 3 THEN 'pause' WHEN failure_rate >= 0.15::double THEN 'slow_down' WHEN retry_rate >= 0.25::double THEN 'slow_down'
  WHEN avg_l >= 5000 THEN 'slow_down' WHEN loss >= 0.1::double THEN 'slow_down' ELSE 'proceed' END AS recommendation,
CASE WHEN failure_rate >= 0.4::double THEN 'failure_rate ' || {_P('failure_rate')} || ' >= 40%' WHEN avg_l >= 15000 THEN 'avg_latency ' || printf('%.0f', round(avg_l, 0)) || 'ms >= 15000ms' WHEN slow >= 3 THEN 'consecutive_slow_batches ' || slow || ' >= 3'
  WHEN failure_rate >= 0.15::double THEN 'failure_rate ' || {_P('failure_rate')} || ' >= 15%' WHEN retry_rate >= 0.25::double THEN 'retry_rate ' || {_P('retry_rate')} || ' >= 25%'
  WHEN avg_l >= 5000 THEN 'avg_latency ' || printf('%.0f', round(avg_l, 0)) || 'ms >= 5000ms' WHEN loss >= 0.1::double THEN 'quality_loss_rate ' || {_P('loss')} || ' >= 10%' ELSE '' END AS reason"""
_TOT = f"""{_SLOW}, tot AS (SELECT run_id, count(*) AS n, avg(latency_ms) AS avg_l, sum(failed)::double / sum(claimed) AS failure_rate, sum(retried)::double / sum(claimed) AS retry_rate, sum(checkpoint_errors)::double / sum(claimed) AS loss,
  arg_max(slow_streak, batch_id) AS slow, sum(records_saved) AS records_saved FROM slow2 GROUP BY run_id)"""
_SIG = f"n AS total_batches, round(avg_l, 1) AS avg_latency_ms, round(failure_rate, 4) AS failure_rate, round(retry_rate, 4) AS retry_rate, round(loss, 4) AS quality_loss_rate, slow AS consecutive_slow, {_LADDER}"
query(
    "batch_pressure",
    f"""WITH {_TOT}, p AS (SELECT run_id, latency_ms, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY run_id) AS c FROM batches)
SELECT tot.run_id, {_SIG}, round(p.latency_ms, 1) AS p95_latency_ms FROM tot JOIN p ON tot.run_id = p.run_id AND p.rn = least(floor(c * 0.95::double)::bigint, c - 1)""",
    BA,
)(lambda t: O.batch_pressure(t("batches")))
query(
    "running_pressure",
    f"""WITH {_SLOW}, r AS (SELECT run_id, batch_id, count(*) OVER w AS n, avg(latency_ms) OVER w AS avg_l, (sum(failed) OVER w)::double / (sum(claimed) OVER w) AS failure_rate, (sum(retried) OVER w)::double / (sum(claimed) OVER w) AS retry_rate,
  (sum(checkpoint_errors) OVER w)::double / (sum(claimed) OVER w) AS loss, slow_streak AS slow FROM slow2 WINDOW w AS (PARTITION BY run_id ORDER BY batch_id ROWS UNBOUNDED PRECEDING))
SELECT run_id, batch_id, {_SIG} FROM r""",
    BA,
)(lambda t: O.running_pressure(t("batches")))


def _frontier_of_runs(t):
    """done / queued per run of the fetch log."""
    return t("fetch_log").groupBy("run_id").agg(F.count_if("ok").alias("done"), F.count_if((F.col("k") == 99) & (F.dayofmonth("ts") % 2 == 0)).alias("queued"))


_FRS = "frs AS (SELECT run_id, count(*) FILTER (ok) AS done, count(*) FILTER (k = 99 AND day(ts) % 2 = 0) AS queued FROM fetch_log GROUP BY run_id)"
_HIT = lambda words: " + ".join(f"max(contains(lower(error), {S.lit(w)})::int)" for w in words)
query(
    "classify_bottlenecks",
    f"""WITH {_TOT}, {_FRS}, er AS (SELECT run_id, {_HIT(rules.BLOCKING_WORDS)} AS bh, {_HIT(rules.SELECTOR_WORDS)} AS sh FROM fetch_log GROUP BY run_id),
j AS (SELECT tot.*, bh, sh, done, queued FROM tot LEFT JOIN er ON tot.run_id = er.run_id LEFT JOIN frs ON tot.run_id = frs.run_id)
SELECT run_id, 'access_blocking' AS bottleneck, CASE WHEN failure_rate >= 0.4::double THEN 'critical' ELSE 'warn' END AS severity, round(bh::double, 4) AS evidence FROM j WHERE bh >= 2 OR (failure_rate >= 0.3::double AND bh >= 1)
UNION ALL SELECT run_id, 'selector_loss', 'warn', sh::double FROM j WHERE sh >= 1
UNION ALL SELECT run_id, 'pagination_gap', 'warn', round(1 - failure_rate, 4) FROM j WHERE done > 0 AND queued = 0 AND n > 0 AND 1 - failure_rate < 0.5::double
UNION ALL SELECT run_id, 'transport_pressure', CASE WHEN avg_l >= 15000 THEN 'critical' ELSE 'warn' END, round(avg_l, 1) FROM j WHERE avg_l >= 10000
UNION ALL SELECT run_id, 'retry_pressure', CASE WHEN retry_rate >= 0.4::double THEN 'critical' ELSE 'warn' END, round(retry_rate, 4) FROM j WHERE retry_rate >= 0.2::double
UNION ALL SELECT run_id, 'quality_loss', CASE WHEN loss >= 0.15::double THEN 'critical' ELSE 'warn' END, round(loss, 4) FROM j WHERE loss >= 0.05::double""",
    ("batches", "fetch_log"),
)(lambda t: O.classify_bottlenecks(t("batches"), t("fetch_log"), _frontier_of_runs(t)))
query(
    "repeated_page_gaps",
    f"WITH {_TOT}, {_FRS} SELECT tot.run_id, done > 0 AND queued = 0 AND 1 - failure_rate < 0.5::double AS early_exhaustion, n > 2 AND records_saved < 5 AS pagination_stuck FROM tot JOIN frs ON tot.run_id = frs.run_id",
    ("batches", "fetch_log"),
)(lambda t: O.repeated_page_gaps(t("batches"), _frontier_of_runs(t)))

_SUP = f"""{_ZERO}, sup AS (SELECT run_id, batch_id, zero_streak, CASE WHEN tt > 0 AND failed / tt >= 0.85::double THEN 'abort' WHEN dry AND zero_streak >= 2 THEN 'pause' WHEN dry THEN 'repair_after_run' WHEN tt > 0 AND succeeded / tt < 0.6::double THEN 'slow_down'
   WHEN claimed > 0 AND records_saved / claimed < 0.05::double AND discovered_urls = 0 THEN 'repair_after_run' ELSE 'proceed' END AS action
  FROM (SELECT *, succeeded + failed AS tt, claimed > 0 AND records_saved = 0 AND discovered_urls = 0 AS dry FROM zero2) x),
sup2 AS (SELECT *, CASE WHEN action IN ('abort', 'pause') THEN 'critical' WHEN action = 'proceed' THEN 'info' ELSE 'warning' END AS severity FROM sup)"""
query("supervise_batch", f"WITH {_SUP} SELECT * FROM sup2", BA)(lambda t: O.supervise_batch(t("batches")))
query(
    "supervision_summary",
    f"""WITH {_SUP} SELECT run_id, count(*) AS events, count(*) FILTER (action = 'abort') AS n_abort, count(*) FILTER (action = 'pause') AS n_pause, count(*) FILTER (action = 'repair_after_run') AS n_repair_after_run,
  count(*) FILTER (action = 'slow_down') AS n_slow_down, count(*) FILTER (action = 'proceed') AS n_proceed, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END AS highest_severity,
  arg_max(action, batch_id) AS last_action, CASE WHEN arg_max(action, batch_id) IN ('pause', 'abort', 'repair_after_run') THEN 'ai_rerun' WHEN arg_max(action, batch_id) = 'slow_down' THEN 'reduce_concurrency' ELSE '' END AS next_action FROM sup2 GROUP BY run_id""",
    BA,
)(lambda t: O.supervision_summary(O.supervise_batch(t("batches"))))


# ---------------------------------------------------------------- diagnosis
def _sites(t):
    """Fetch log keyed by site, so that runs differ in what goes wrong."""
    return t("fetch_log").withColumn("run_id", F.concat(F.lit("site-"), F.col("user_id") % 97))


def _counters(t):
    c = O.failure_counters(_sites(t))
    n = F.regexp_extract("run_id", "[0-9]+", 0).cast("int")
    return c.withColumns(
        {
            "records_saved": F.when(n % 6 == 0, 0).otherwise(F.col("records_saved")).cast("bigint"),
            "c_api_replay_failed": F.when(n % 8 == 0, 2).otherwise(0).cast("bigint"),
            "c_browser_crash": F.when(n % 10 == 0, 1).otherwise(0).cast("bigint"),
            "status": F.when(n % 4 == 0, "executed").when(n % 4 == 1, "completed").otherwise("failed"),
            "batches": n % 5,
            "coverage": (n % 10) / 10.0,
            "indicator": F.when(n % 3 == 0, "fail").when(n % 3 == 1, "warn").otherwise("pass"),
            "short_pages": F.when(n % 7 == 0, 3).otherwise(0),
            "no_html": n % 14 == 0,
            "selectors": n % 6 + 1,
            "selector_misses": n % 4,
        }
    )


def _cnt(name):
    b, w = rules.DIAGNOSIS_BUCKETS.get(name, ()), rules.DIAGNOSIS_WORDS.get(name, ())
    parts = ([f"(failure_category IN {S.inlist(b)})::int"] if b else []) + ([f"{S.has_any('lower(error)', w)}::int"] if w else [])
    return f"sum({' + '.join(parts)})::bigint AS c_{name}"


_DIAG = f"""
dc AS (SELECT 'site-' || (user_id % 97) AS run_id, user_id % 97 AS n, {', '.join(_cnt(x) for x in ('access_blocked', 'access_challenge', 'proxy_error', 'timeout'))}, sum(records)::bigint AS rec FROM fetch_log GROUP BY ALL),
dd AS (SELECT *, CASE WHEN n % 6 = 0 THEN 0 ELSE rec END AS records_saved, CASE WHEN n % 8 = 0 THEN 2 ELSE 0 END AS c_api, CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS c_crash, n % 4 IN (1, 2, 3) AS done, n % 5 AS batches, (n % 10) / 10.0::double AS coverage,
  CASE WHEN n % 3 = 0 THEN 'fail' WHEN n % 3 = 1 THEN 'warn' ELSE 'pass' END AS indicator, CASE WHEN n % 7 = 0 THEN 3 ELSE 0 END AS short_pages, n % 14 = 0 AS no_html, n % 6 + 1 AS selectors, n % 4 AS misses FROM dc),
diag AS (
  SELECT run_id, records_saved, 0 AS ord, 'access_blocked' AS category, 'critical' AS severity, round(least(0.9::double, 0.5::double + c_access_blocked * 0.1::double), 4) AS confidence, c_access_blocked AS signals FROM dd WHERE c_access_blocked > 0
  UNION ALL SELECT run_id, records_saved, 1, 'access_challenge', 'critical', round(least(0.95::double, 0.6::double + c_access_challenge * 0.1::double), 4), c_access_challenge FROM dd WHERE c_access_challenge > 0
  UNION ALL SELECT run_id, records_saved, 2, 'browser_crash', 'critical', 0.7::double, c_crash FROM dd WHERE c_crash > 0
  UNION ALL SELECT run_id, records_saved, 3, 'proxy_error', 'warning', 0.6::double, c_proxy_error FROM dd WHERE c_proxy_error > 0
  UNION ALL SELECT run_id, records_saved, 4, 'timeout', 'warning', 0.6::double, c_timeout FROM dd WHERE c_timeout > 0
  UNION ALL SELECT run_id, records_saved, 5, 'empty_html', CASE WHEN no_html THEN 'critical' ELSE 'warning' END, CASE WHEN no_html THEN 0.8::double ELSE 0.6::double END, short_pages FROM dd WHERE no_html OR short_pages > 0
  UNION ALL SELECT run_id, records_saved, 6, 'api_replay_failed', 'warning', 0.6::double, c_api FROM dd WHERE c_api > 0
  UNION ALL SELECT run_id, records_saved, 7, 'no_records', CASE WHEN done THEN 'critical' ELSE 'warning' END, CASE WHEN done THEN 0.9::double ELSE 0.7::double END, 1 FROM dd WHERE records_saved = 0
  UNION ALL SELECT run_id, records_saved, 8, 'pagination_stuck', 'warning', 0.5::double, batches FROM dd WHERE batches > 2 AND records_saved < 5
  UNION ALL SELECT run_id, records_saved, 9, 'selector_miss', 'warning', 0.7::double, misses FROM dd WHERE misses > 0 AND misses >= greatest(1, selectors // 2)
  UNION ALL SELECT run_id, records_saved, 10, 'low_coverage', 'warning', 0.6::double, 1 FROM dd WHERE coverage < 0.5::double AND indicator IN ('fail', 'warn')
  UNION ALL SELECT run_id, records_saved, 11, 'quality_fail', 'warning', 0.7::double, 1 FROM dd WHERE indicator = 'fail')"""
query("diagnose_failures", f"WITH {_DIAG} SELECT run_id, records_saved, ord, category, severity, confidence, signals::bigint AS signals FROM diag", FL)(lambda t: O.diagnose_failures(_counters(t)))
_FOCUS = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DIAGNOSIS_FOCUS.items()) + " END"
_HEALTH = f"""
hl_a AS (SELECT run_id, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'warning') AS warn, bool_or(category = 'browser_crash' OR (category = 'proxy_error' AND confidence > 0.8::double)) AS manual FROM diag GROUP BY run_id),
hl_f AS (SELECT run_id, f, min((CASE WHEN severity = 'critical' THEN 0 ELSE 1 END) * 1000000 - confidence * 10000 + ord * 0.001::double) AS o FROM (SELECT *, {_FOCUS} AS f FROM diag) x WHERE f IS NOT NULL GROUP BY ALL),
hl_g AS (SELECT run_id, string_agg(f, ',' ORDER BY o) AS focus FROM hl_f GROUP BY run_id),
health AS (SELECT d.run_id, d.records_saved, CASE WHEN coalesce(crit, 0) > 0 THEN 'critical' WHEN coalesce(warn, 0) > 1 THEN 'degraded' WHEN coalesce(warn, 0) = 1 THEN CASE WHEN d.records_saved = 0 THEN 'degraded' ELSE 'healthy' END
  WHEN d.records_saved > 0 THEN 'healthy' ELSE 'unknown' END AS health, coalesce(focus, '') AS focus, coalesce(manual, false) AS manual FROM dd d LEFT JOIN hl_a ON d.run_id = hl_a.run_id LEFT JOIN hl_g ON d.run_id = hl_g.run_id)"""
query("run_health", f"WITH {_DIAG}, {_HEALTH} SELECT * FROM health", FL)(lambda t: O.run_health(O.diagnose_failures(_counters(t)), _counters(t)))
_STEPS = "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in rules.REPAIR_STEPS.items()) + "}"
_COST = "CASE step " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.REPAIR_COST.items()) + " END"
query(
    "repair_plan",
    f"""WITH {_DIAG}, st AS (SELECT run_id, category, CASE WHEN severity = 'critical' THEN 0 ELSE 1 END AS sev, confidence, ord, generate_subscripts(l, 1) AS pos, unnest(l) AS step FROM (SELECT *, {_STEPS}[category] AS l FROM diag) a),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY sev, confidence DESC, ord, pos) AS rn, min(sev) OVER (PARTITION BY run_id) AS worst FROM st) b WHERE rn = 1),
co AS (SELECT *, {_COST} AS cost FROM fs),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cost, sev, confidence DESC, ord, pos) AS step_no FROM co WHERE cost <= CASE WHEN worst = 0 THEN 4 ELSE 2 END),
pl AS (SELECT run_id, step_no, step, cost, category FROM rk WHERE step_no <= CASE WHEN worst = 0 THEN 5 ELSE 3 END)
SELECT * FROM pl UNION ALL SELECT run_id, max(step_no) + 1, 'prepare_rerun', 0, '' FROM pl GROUP BY run_id""",
    FL,
)(lambda t: O.repair_plan(O.diagnose_failures(_counters(t))).withColumn("step_no", F.col("step_no").cast("bigint")))


def _delta(t):
    c = _counters(t)
    h = O.run_health(O.diagnose_failures(c), c)
    before = c.select("run_id", "records_saved", "coverage").join(h.select("run_id", "health"), "run_id")
    after = before.select(
        "run_id", (F.col("records_saved") + F.length("run_id") - 6).alias("records_saved"), F.least(F.col("coverage") + 0.04, F.lit(0.9)).alias("coverage"),
        F.when(F.col("health") == "critical", "degraded").otherwise(F.col("health")).alias("health"),
    )
    return O.repair_delta(before, after, O.diagnose_failures(c))


_LV = "CASE {} WHEN 'critical' THEN 0 WHEN 'degraded' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END"
query(
    "repair_delta",
    f"""WITH {_DIAG}, {_HEALTH}, ba AS (SELECT d.run_id, d.records_saved AS rb, d.records_saved + length(d.run_id) - 6 AS ra, d.coverage AS cb, least(d.coverage + 0.04::double, 0.9::double) AS ca, health AS hb, CASE WHEN health = 'critical' THEN 'degraded' ELSE health END AS ha FROM dd d JOIN health h ON d.run_id = h.run_id),
cn AS (SELECT run_id, count(*) FILTER (category IN ('no_records', 'low_coverage')) AS br, count(*) FILTER (category IN ('access_blocked', 'access_challenge')) AS bh FROM diag GROUP BY run_id),
x AS (SELECT ba.run_id, ra - rb AS records_delta, round(ca - cb, 4) AS coverage_delta, {_LV.format('ha')} - {_LV.format('hb')} AS health_delta, (CASE WHEN ra > 0 THEN coalesce(br, 0) ELSE 0 END) + (CASE WHEN ha IN ('healthy', 'degraded') THEN coalesce(bh, 0) ELSE 0 END) AS resolved FROM ba LEFT JOIN cn ON ba.run_id = cn.run_id)
SELECT run_id, records_delta, coverage_delta, health_delta, records_delta > 0 OR coverage_delta > 0.05::double OR health_delta > 0 AS improved, resolved FROM x""",
    FL,
)(_delta)

# ---------------------------------------------------------------- endpoints
_COOL = """
isl AS (SELECT endpoint, request_id, ts_us, ok, sum(ok::int) OVER (PARTITION BY endpoint ORDER BY ts_us, request_id ROWS UNBOUNDED PRECEDING) AS island FROM fetch_log),
fl AS (SELECT *, (sum((NOT ok)::int) OVER (PARTITION BY endpoint, island ORDER BY ts_us, request_id ROWS UNBOUNDED PRECEDING))::bigint AS failures FROM isl),
cool AS (SELECT endpoint, request_id, ts_us, ok, failures, CASE WHEN failures >= 3 THEN ts_us + (least(30 * pow(2, least(failures - 3, 30)), 600) * 1000000)::bigint ELSE 0 END AS cooldown_until_us FROM fl),
st AS (SELECT endpoint, count(*) FILTER (ok) AS success_count, arg_max(failures, ts_us) AS failure_count, arg_max(cooldown_until_us, ts_us) AS cooldown_until_us, max(ts_us) AS last_used_us FROM cool GROUP BY endpoint)"""
_END = 1706700000000000  # shortly before the log ends
query("endpoint_cooldown", f"WITH {_COOL} SELECT * FROM cool", FL)(lambda t: O.endpoint_cooldown(t("fetch_log")))
query("endpoint_state", f"WITH {_COOL} SELECT * FROM st", FL)(lambda t: O.endpoint_state(t("fetch_log")))
query("list_endpoints", f"WITH {_COOL} SELECT * FROM st ORDER BY failure_count DESC, endpoint LIMIT 20", FL)(
    lambda t: O.endpoint_state(t("fetch_log")).orderBy(F.desc("failure_count"), "endpoint").limit(20)
)
query(
    "endpoint_health_summary",
    f"WITH {_COOL} SELECT count(*) AS tracked, count(*) FILTER (cooldown_until_us <= {_END}) AS healthy, count(*) FILTER (cooldown_until_us > {_END}) AS in_cooldown, sum(failure_count)::bigint AS total_failures FROM st",
    FL,
)(lambda t: O.endpoint_health_summary(O.endpoint_state(t("fetch_log")), _END))
query("prune_endpoints", f"WITH {_COOL} SELECT * FROM st WHERE last_used_us >= {_END} - 7 * 86400000000 OR last_used_us = 0", FL)(
    lambda t: FR.prune_endpoints(O.endpoint_state(t("fetch_log")), _END)
)
_CNT = "count(*) OVER w AS w_total, sum(ok::int) OVER w AS w_ok, sum((failure_category = 'navigation_timeout')::int) OVER w AS wt, sum((failure_category IN ('challenge_like', 'managed_challenge', 'captcha'))::int) OVER w AS wc, sum((failure_category = 'http_blocked')::int) OVER w AS wb"
_SCORE = "round(greatest(0.0::double, w_ok / w_total - (least(wt * 0.1::double, 0.3::double) + least(wc * 0.15::double, 0.3::double) + least(wb * 0.05::double, 0.15::double))), 6)"
_HS = f"hs AS (SELECT endpoint, request_id, ts_us, w_total AS window_requests, {_SCORE} AS health_score FROM (SELECT *, {_CNT} FROM fetch_log WINDOW w AS (PARTITION BY endpoint ORDER BY ts_us RANGE BETWEEN {{span}} PRECEDING AND CURRENT ROW)) x)"
query("profile_health_score", f"WITH {_HS.format(span=300000000)} SELECT * FROM hs", FL)(lambda t: O.profile_health_score(t("fetch_log")))
query("profile_health_score_6h", f"WITH {_HS.format(span=21600000000)} SELECT * FROM hs", FL)(lambda t: O.profile_health_score(t("fetch_log"), 21600))
query(
    "cumulative_health",
    f"SELECT endpoint, w_total AS requests, {_SCORE} AS health_score FROM (SELECT endpoint, {_CNT.replace(' OVER w', '')} FROM fetch_log GROUP BY endpoint) x",
    FL,
)(lambda t: O.cumulative_health(t("fetch_log")))
query(
    "healthiest_profile",
    f"WITH {_HS.format(span=300000000)} SELECT endpoint, arg_max(health_score, ts_us) AS health_score FROM hs GROUP BY endpoint ORDER BY health_score DESC, endpoint LIMIT 5",
    FL,
)(lambda t: O.healthiest_profile(t("fetch_log"), 5))

# ---------------------------------------------------------------- metrics
query(
    "fetch_metrics",
    """SELECT run_id, CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(status_code) = 0 THEN 'status' WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'total' END AS metric, coalesce(domain, status_code::varchar, event_type, '') AS key,
  count(*) AS requests, count(*) FILTER (ok) AS ok_count, count(*) FILTER (NOT ok) AS fail_count, count(*) FILTER (retried) AS retries, max(k) AS max_active FROM fetch_log GROUP BY GROUPING SETS ((run_id), (run_id, domain), (run_id, status_code), (run_id, event_type))""",
    FL,
)(lambda t: O.fetch_metrics(t("fetch_log")))
query("fetch_errors", "SELECT run_id, request_id, error, error_no FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, request_id) AS error_no FROM fetch_log WHERE NOT ok AND error <> '') x", FL)(
    lambda t: O.fetch_errors(t("fetch_log"))
)


def _hist(t):
    log = t("fetch_log").where("NOT ok")
    a = log.groupBy("run_id", F.col("failure_category").alias("bucket")).agg(F.count("*").alias("n"))
    b = log.groupBy("run_id", F.when(F.col("status_code") >= 500, "server_error").otherwise("http_blocked").alias("bucket")).agg(F.count("*").alias("n"))
    return O.failure_histogram(a, b)


query(
    "failure_histogram",
    "SELECT run_id, bucket, count(*) AS failures FROM (SELECT run_id, failure_category AS bucket FROM fetch_log WHERE NOT ok UNION ALL SELECT run_id, CASE WHEN status_code >= 500 THEN 'server_error' ELSE 'http_blocked' END FROM fetch_log WHERE NOT ok) x GROUP BY ALL",
    FL,
)(_hist)
query(
    "domain_memory",
    """SELECT lower(domain) AS domain, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count, coalesce(arg_max(mode, ts_us) FILTER (ok), '') AS preferred_mode,
  coalesce(arg_max(failure_category, ts_us) FILTER (NOT ok AND failure_category IN ('challenge_like', 'http_blocked')), '') AS last_challenge, max(ts_us) AS updated_us FROM fetch_log GROUP BY 1""",
    FL,
)(lambda t: O.domain_memory(t("fetch_log")))


def _selector_events(t):
    k = F.col("k")
    return t("fetch_log").select(
        F.col("domain").alias("site_key"), F.element_at(F.array(*map(F.lit, ("title", "price", "image"))), (k % 3 + 1).cast("int")).alias("name"),
        F.concat(F.lit(".s"), k % 4).alias("selector"), F.lit("css").alias("selector_type"), F.when(k % 5 == 0, "href").otherwise("").alias("attribute"),
        F.when(F.col("event_type") == "error", "recover").otherwise("save").alias("kind"), F.concat(F.lit("sig-"), "request_id").alias("signature"),
        (k / 100.0).alias("score"), "ts_us", F.col("request_id").alias("event_id"),
    )


_SELM = """
sev AS (SELECT domain AS site_key, ['title', 'price', 'image'][k % 3 + 1] AS name, '.s' || (k % 4) AS selector, 'css' AS selector_type, CASE WHEN k % 5 = 0 THEN 'href' ELSE '' END AS attribute, event_type = 'error' AS rec, 'sig-' || request_id AS signature, k / 100.0::double AS score, ts_us FROM fetch_log),
sm AS (SELECT site_key, name, selector, selector_type, attribute, count(*) FILTER (NOT rec) AS success_count, count(*) FILTER (rec) AS recover_count, arg_max(signature, ts_us) FILTER (NOT rec) AS signature, coalesce(arg_max(score, ts_us) FILTER (rec), 0.0::double) AS last_score, max(ts_us) AS updated_us
  FROM sev GROUP BY ALL HAVING count(*) FILTER (NOT rec) > 0)"""
query("selector_memory", f"WITH {_SELM} SELECT * FROM sm", FL)(lambda t: O.selector_memory(_selector_events(t)))


def _selector_wanted(t):
    m = O.selector_memory(_selector_events(t))
    want = _selector_events(t).select(*O.SELECTOR_KEY).distinct()
    moved = want.withColumn("selector", F.concat("selector", F.lit("-moved")))
    lost = want.withColumn("site_key", F.concat("site_key", F.lit(".net")))
    return O.selector_lookup(m, want.unionByName(moved).unionByName(lost).distinct())


query(
    "selector_lookup",
    f"""WITH {_SELM}, w0 AS (SELECT DISTINCT site_key, name, selector, selector_type, attribute FROM sev), w AS (SELECT * FROM w0 UNION SELECT site_key, name, selector || '-moved', selector_type, attribute FROM w0 UNION SELECT site_key || '.net', name, selector, selector_type, attribute FROM w0),
nw AS (SELECT site_key, name, arg_max(signature, updated_us) AS s FROM sm GROUP BY ALL)
SELECT w.site_key, w.name, w.selector, w.selector_type, w.attribute, coalesce(sm.signature, nw.s, '') AS signature, CASE WHEN sm.signature IS NOT NULL THEN 'exact' WHEN nw.s IS NOT NULL THEN 'newest' ELSE 'none' END AS found_by
FROM w LEFT JOIN sm ON (w.site_key, w.name, w.selector, w.selector_type, w.attribute) = (sm.site_key, sm.name, sm.selector, sm.selector_type, sm.attribute) LEFT JOIN nw ON w.site_key = nw.site_key AND w.name = nw.name""",
    FL,
)(_selector_wanted)
query(
    "frame_summary",
    """SELECT page, count(DISTINCT connection) AS connections, count(*) AS total_frames, count(*) FILTER (direction = 'sent') AS sent_frames, count(*) FILTER (direction <> 'sent') AS received_frames, count(*) FILTER (data_type = 'text') AS text_frames,
  count(*) FILTER (data_type <> 'text') AS binary_frames, sum(byte_length)::bigint AS total_bytes FROM frames GROUP BY page""",
    ("frames",),
)(lambda t: O.frame_summary(t("frames")))
query("run_latest", "SELECT run_id, max(request_id) AS checkpoint_id, arg_max(domain, request_id) AS domain, sum(records)::bigint AS item_count, count(*) FILTER (NOT ok) AS failure_count FROM fetch_log GROUP BY run_id", FL)(
    lambda t: O.run_latest(t("fetch_log"))
)
query(
    "multi_site_summary",
    """WITH s AS (SELECT domain AS site, bool_and(status_code <> 503 OR k <> 99) AS ok, sum(CASE WHEN ok THEN records ELSE 0 END) AS r0, sum(records) AS r FROM fetch_log GROUP BY domain), p AS (SELECT site, ok, (SELECT coalesce(sum(records), 0) FROM fetch_log f WHERE f.domain = s.site AND (f.status_code <> 503 OR f.k <> 99))::bigint AS records FROM s)
SELECT CASE WHEN grouping(site) = 1 THEN '*' ELSE site END AS site, count(*) AS sites, count(*) FILTER (ok) AS ok_sites, count(*) FILTER (NOT ok) AS failed_sites, sum(records)::bigint AS records FROM p GROUP BY ROLLUP (site)""",
    FL,
)(lambda t: O.multi_site_summary(t("fetch_log").select(F.col("domain").alias("site"), ((F.col("status_code") != 503) | (F.col("k") != 99)).alias("ok"), F.col("records").cast("bigint").alias("records"))))

# ---------------------------------------------------------------- frontier
_FRU = f"(CASE WHEN {S.is_web('trim(url)')} THEN {S.scheme('url')} || '://' || {S.netloc('url')} || {S.path('url')} || {S.q(S.query('url'))} || (CASE WHEN {S.part('url', 5)} = '' THEN '' ELSE '#' || {S.part('url', 5)} END) END)"
_CAND = f"""
cand AS (SELECT url, kind, ord, {_FRU} AS fu FROM (SELECT url, 'page' AS kind, page_id AS ord FROM pages UNION ALL SELECT CASE WHEN k % 9 = 0 THEN 'ftp://' || site || '/x' ELSE url END, 'api', 1000000 + call_id FROM captured_calls) c0),
known AS (SELECT DISTINCT sha256({_FRU}) AS url_hash FROM (SELECT url FROM frontier WHERE status <> 'failed' UNION ALL SELECT url FROM captured_calls WHERE k % 6 = 1) k0)"""


def _cands(t):
    pages = t("pages").select("url", F.lit("page").alias("kind"), F.col("page_id").alias("ord"))
    calls = t("captured_calls").select(F.when(F.col("k") % 9 == 0, F.concat(F.lit("ftp://"), "site", F.lit("/x"))).otherwise(F.col("url")).alias("url"), F.lit("api").alias("kind"), (F.col("call_id") + 1000000).alias("ord"))
    known = FR.frontier_rows(t("frontier").where("status <> 'failed'").select("url").unionByName(t("captured_calls").where("k % 6 = 1").select("url"))).select("url_hash").distinct()
    return pages.unionByName(calls), known


FRV = ("frontier", "captured_calls")
query(
    "frontier_add",
    f"WITH {_CAND} SELECT sha256(fu) AS url_hash, fu AS frontier_url, kind, {S.domain('fu')} AS domain, 'queued' AS status FROM (SELECT *, row_number() OVER (PARTITION BY fu ORDER BY ord) AS rn FROM cand WHERE fu IS NOT NULL) x WHERE rn = 1 AND sha256(fu) NOT IN (SELECT url_hash FROM known)",
    FRV,
)(lambda t: FR.frontier_add(*_cands(t), order=("ord",)).select("url_hash", "frontier_url", "kind", "domain", "status"))
query(
    "frontier_add_counts",
    f"""WITH {_CAND}, h AS (SELECT fu, count(*) AS n, sha256(fu) IN (SELECT url_hash FROM known) AS seen FROM cand WHERE fu IS NOT NULL GROUP BY fu)
SELECT count(*) FILTER (NOT seen) AS added, sum(CASE WHEN seen THEN n ELSE n - 1 END)::bigint AS skipped, (SELECT count(*) FROM cand WHERE fu IS NULL) AS invalid FROM h""",
    FRV,
)(lambda t: FR.frontier_add_counts(*_cands(t)))
query(
    "resume_pending",
    f"""WITH s AS (SELECT DISTINCT {_FRU} AS frontier_url FROM (SELECT canonical_url AS url FROM offers) a), d AS (SELECT DISTINCT {_FRU} AS u FROM (SELECT canonical_url AS url FROM offers WHERE l_linenumber <= 4) b)
SELECT sha256(frontier_url) AS url_hash, frontier_url FROM s WHERE frontier_url IS NOT NULL AND frontier_url NOT IN (SELECT u FROM d WHERE u IS NOT NULL)""",
    ("offers",),
)(lambda t: FR.resume_pending(t("offers").select(F.col("canonical_url").alias("url")), t("offers").where("l_linenumber <= 4").select(F.col("canonical_url").alias("url"))))
query(
    "next_batch",
    f"SELECT page_id, url, priority, attempts + 1 AS attempts, 'running' AS status FROM frontier WHERE status = 'queued' OR (status = 'running' AND locked_us < {NOW} - 300000000) ORDER BY priority DESC, created_us, page_id LIMIT 25",
    ("frontier",),
)(lambda t: FR.next_batch(t("frontier"), 25, NOW).select("page_id", "url", "priority", "attempts", "status"))
query(
    "apply_outcomes",
    """SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN status WHEN page_id % 3 = 0 THEN 'done' WHEN page_id % 5 = 0 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN page_id % 4 = 1 AND page_id % 3 <> 0 THEN 'err ' || page_id ELSE '' END AS error FROM frontier""",
    ("frontier",),
)(
    lambda t: FR.apply_outcomes(
        t("frontier"),
        t("frontier").where("status = 'running'").select("page_id", (F.col("page_id") % 3 == 0).alias("ok"), (F.col("page_id") % 5 == 0).alias("retry"), F.concat(F.lit("err "), "page_id").alias("error")),
    ).select("page_id", "status", "error")
)
query("frontier_stats", "SELECT status, count(*) AS urls FROM frontier GROUP BY status", ("frontier",))(lambda t: FR.frontier_stats(t("frontier")))
_RST = """fs AS (SELECT run_id, count(*) FILTER (status IN ('queued', 'running')) AS open_urls, count(*) FILTER (status = 'failed') AS failed_urls, count(*) FILTER (status = 'done') AS done_urls FROM (SELECT 'site-' || (page_id % 60) AS run_id, status FROM frontier) a GROUP BY run_id),
rst AS (SELECT *, CASE WHEN open_urls > 0 THEN 'paused' WHEN failed_urls > 0 THEN 'partial' ELSE 'completed' END AS run_status, CASE WHEN open_urls > 0 THEN 'bounded_pass_paused' WHEN failed_urls > 0 THEN 'frontier_failed_items' ELSE 'frontier_exhausted' END AS stop_reason FROM fs)"""
query("run_status", f"WITH {_RST} SELECT * FROM rst", ("frontier",))(lambda t: FR.run_status(t("frontier").withColumn("run_id", F.concat(F.lit("site-"), F.col("page_id") % 60))))


def _progress(t):
    fr = t("frontier").withColumn("run_id", F.concat(F.lit("site-"), F.col("page_id") % 60))
    saved = _sites(t).groupBy("run_id").agg((F.sum("records") - 5).cast("bigint").alias("saved"))
    n = F.regexp_extract("run_id", "[0-9]+", 0).cast("int")
    return FR.run_progress(fr, saved, F.when(n % 4 == 0, "completed").when(n % 4 == 1, "failed").otherwise("running"))


query(
    "run_progress",
    """WITH f AS (SELECT page_id % 60 AS n, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM frontier GROUP BY 1),
r AS (SELECT user_id % 97 AS n, (sum(records) - 5)::bigint AS saved FROM fetch_log GROUP BY 1), j AS (SELECT 'site-' || f.n AS run_id, queued, done, failed, coalesce(saved, 0) AS saved, CASE WHEN f.n % 4 = 0 THEN 'completed' WHEN f.n % 4 = 1 THEN 'failed' ELSE 'running' END AS run_state FROM f LEFT JOIN r ON f.n = r.n)
SELECT *, coalesce(round(done / nullif(greatest(done + queued + failed, saved), 0), 4), 0.0::double) AS completion, CASE WHEN run_state = 'failed' THEN 'stopped' WHEN run_state = 'completed' THEN 'finished' WHEN queued > 0 THEN 'crawling' WHEN done > 0 THEN 'finishing' ELSE 'starting' END AS stage,
  CASE WHEN saved + failed = 0 THEN 'unknown' WHEN saved / (saved + failed) >= 0.9::double THEN 'pass' WHEN saved / (saved + failed) >= 0.6::double THEN 'warn' ELSE 'fail' END AS quality_indicator FROM j""",
    ("frontier", "fetch_log"),
)(_progress)

# ---------------------------------------------------------------- robots, rates, schedule


def _robot_links(t):
    o = t("offers")
    paths = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("/category/"), "l_linenumber")).otherwise(F.concat(F.lit("/products/"), "p_partkey"))
    return o.select("l_orderkey", "l_linenumber", "p_partkey", F.concat("source_site", F.lit(".example.com")).alias("host"), F.concat(F.lit("https://"), "source_site", F.lit(".example.com"), paths).alias("url"))


_ROB = """
rl AS (SELECT l_orderkey, l_linenumber, p_partkey, source_site || '.example.com' AS host, CASE WHEN l_orderkey % 3 = 0 THEN '/category/' || l_linenumber ELSE '/products/' || p_partkey END AS path FROM offers),
rt AS (SELECT host, CASE WHEN contains(body, 'harvester') THEN 1 WHEN contains(body, '# main') THEN 0 WHEN body = '' THEN 3 ELSE 2 END AS form, body FROM robots_files)"""
query(
    "robots_verdict",
    f"""WITH {_ROB}
SELECT l_orderkey, l_linenumber, p_partkey, rl.host, 'https://' || rl.host || path AS url,
  CASE form WHEN 0 THEN NOT (starts_with(path, '/products/1') OR starts_with(path, '/category')) WHEN 1 THEN NOT starts_with(path, '/products/2') WHEN 2 THEN starts_with(path, '/products/1') ELSE true END AS can_fetch,
  CASE WHEN form = 0 AND starts_with(path, '/products/1') THEN '/products/1' WHEN form = 0 AND starts_with(path, '/products') THEN '/products' WHEN form = 0 THEN '/category' WHEN form = 1 AND starts_with(path, '/products/2') THEN '/products/2'
       WHEN form = 2 AND starts_with(path, '/products/1') THEN '/products/1' WHEN form = 2 THEN '*' ELSE '' END AS matched_rule,
  CASE WHEN form = 0 THEN regexp_extract(body, 'Crawl-delay: (\\d+)', 1)::double END AS crawl_delay, CASE WHEN form = 1 THEN regexp_extract(body, 'Request-rate: (\\S+)', 1) ELSE '' END AS request_rate
FROM rl JOIN rt ON rl.host = rt.host""",
    ("offers", "robots_files"),
)(lambda t: FR.robots_verdict(_robot_links(t), FR.parse_robots(t("robots_files"), "harvester/1.0")))

_RULES = [("d1.example.com", 2.0, 5, 2.0), ("*.example.com", 1.5, 3, 1.5), ("*.shop.example.com", 3.0, 2, 2.0), ("default", 1.0, 3, 2.0)]
_RULES_SQL = "(VALUES " + ", ".join(f"('{p}', {d}::double, {m}, {b}::double)" for p, d, m, b in _RULES) + ") rr(pattern, delay_s, max_retries, backoff)"
_DOM = "CASE WHEN k % 5 = 0 THEN site || '.shop.example.com' WHEN k % 5 = 1 THEN site || '.other.org' ELSE domain END"


def _rated(t):
    rate = t.spark.createDataFrame(_RULES, "pattern string, delay_s double, max_retries int, backoff double")
    log = t("fetch_log").withColumn("domain", F.expr(_DOM))
    return log, FR.rate_rule_lookup(log.select("domain"), rate)


_RATE = f"""
rlog AS (SELECT * EXCLUDE (domain), {_DOM} AS domain FROM fetch_log),
rdom AS (SELECT DISTINCT domain FROM rlog),
rmatch AS (SELECT domain, pattern AS rule, delay_s, max_retries, backoff, CASE WHEN domain = pattern THEN 100000 WHEN pattern = 'default' THEN 0 ELSE length(pattern) END AS w FROM rdom JOIN {_RULES_SQL} ON domain = pattern OR pattern = 'default' OR (starts_with(pattern, '*.') AND ends_with(domain, substr(pattern, 2)))),
rate AS (SELECT domain, rule, delay_s, max_retries, backoff FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY w DESC) AS rn FROM rmatch) x WHERE rn = 1)"""
query("rate_rule_lookup", f"WITH {_RATE} SELECT * FROM rate", FL)(lambda t: _rated(t)[1])


def _retry(t):
    log, rate = _rated(t)
    rows = log.join(rate, "domain").withColumns(
        {"attempt": F.col("k") % 5, "crawl_delay": F.when(F.col("k") % 7 == 0, F.col("k") / 10.0), "error": F.when(F.col("k") % 3 == 0, F.col("error")).otherwise("")}
    )
    return FR.retry_decision(rows).select("request_id", "rule", "should_retry", "wait_s", "retry_reason")


query(
    "retry_decision",
    f"""WITH {_RATE}, a AS (SELECT request_id, rule, delay_s, max_retries, backoff, status_code, k % 5 AS attempt, CASE WHEN k % 7 = 0 THEN k / 10.0::double END AS cd, CASE WHEN k % 3 = 0 THEN error ELSE '' END AS err FROM rlog JOIN rate ON rlog.domain = rate.domain),
b AS (SELECT *, err <> '' OR status_code IN {S.inlist(rules.RETRY_STATUSES)} AS retryable, greatest(delay_s, coalesce(greatest(cd, 0), 0)) AS base FROM a)
SELECT request_id, rule, retryable AND attempt < max_retries AS should_retry, round(CASE WHEN retryable AND attempt < max_retries AND attempt > 0 THEN base * pow(backoff, attempt) ELSE base END, 3) AS wait_s,
  CASE WHEN status_code = 429 THEN 'rate_limited' WHEN err <> '' THEN 'transport_error' WHEN cd IS NOT NULL THEN 'robots_metadata' WHEN retryable THEN 'retryable_status:' || status_code ELSE 'standard' END AS retry_reason FROM b""",
    FL,
)(_retry)
query(
    "politeness_schedule",
    """WITH r AS (SELECT request_id, domain, ts_us, row_number() OVER (PARTITION BY domain ORDER BY ts_us, request_id) AS i FROM fetch_log),
s AS (SELECT *, max(ts_us - i * 900000000) OVER (PARTITION BY domain ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 900000000 AS start_us FROM r) SELECT request_id, domain, ts_us, start_us, start_us - ts_us AS wait_us FROM s""",
    FL,
)(lambda t: FR.politeness_schedule(t("fetch_log").select("request_id", "domain", "ts_us"), F.lit(900000000).cast("bigint")))

# ---------------------------------------------------------------- lineage


def _lineage(t):
    """Orders as pages: a page is discovered by its quarter and by its customer's page."""
    o = t("orders")
    url = F.concat(F.lit("u"), "o_orderkey")
    quarter = o.select(F.concat(F.lit("u"), F.floor(F.col("o_orderkey") / 4)).alias("parent"), url.alias("child"))
    customer = o.where("o_orderkey > o_custkey * 3").select(F.concat(F.lit("u"), "o_custkey").alias("parent"), url.alias("child"))
    edges = quarter.unionByName(customer)
    seeds = edges.where("parent = child").select(F.col("child").alias("url"))
    return FR.crawl_lineage(seeds, edges.where("parent <> child"))


query(
    "crawl_lineage",
    """WITH RECURSIVE e0 AS (SELECT 'u' || floor(o_orderkey / 4)::bigint AS parent, 'u' || o_orderkey AS child FROM orders UNION ALL SELECT 'u' || o_custkey, 'u' || o_orderkey FROM orders WHERE o_orderkey > o_custkey * 3),
e AS (SELECT DISTINCT * FROM e0 WHERE parent <> child), seeds AS (SELECT DISTINCT child AS url FROM e0 WHERE parent = child),
w AS (SELECT url, 0 AS depth FROM seeds UNION SELECT e.child, depth + 1 FROM w JOIN e ON e.parent = w.url WHERE depth < 14),
d AS (SELECT url, min(depth) AS depth FROM w GROUP BY url),
f AS (SELECT e.child, min(e.parent) AS parent FROM e JOIN d p ON p.url = e.parent JOIN d c ON c.url = e.child AND p.depth = c.depth - 1 GROUP BY e.child)
SELECT d.url, d.depth, coalesce(f.parent, '') AS parent_url FROM d LEFT JOIN f ON f.child = d.url""",
)(_lineage)

# ---------------------------------------------------------------- lists
JB = ("jobs",)
_JNOW = 915148800000000
query("list_jobs", "SELECT task_id, kind, status, created_us FROM jobs WHERE status = 'completed' AND kind = '1-URGENT'", JB)(
    lambda t: FR.list_jobs(t("jobs"), "completed", "1-URGENT").select("task_id", "kind", "status", "created_us")
)
query("list_tasks", "SELECT task_id, status, created_us FROM jobs ORDER BY created_us DESC, task_id LIMIT 20", JB)(lambda t: FR.list_jobs(t("jobs"), limit=20).select("task_id", "status", "created_us"))
query("list_items", "SELECT task_id, item_index, title, link FROM task_items ORDER BY seen_us, task_id, item_index, l_partkey, l_suppkey LIMIT 100", ("task_items",))(
    lambda t: t("task_items").orderBy("seen_us", "task_id", "item_index", "l_partkey", "l_suppkey").limit(100).select("task_id", "item_index", "title", "link")
)
query("prune_stale", f"SELECT task_id, status, created_us FROM jobs WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND created_us < {_JNOW} - 3600000000)", JB)(
    lambda t: FR.prune_stale(t("jobs"), _JNOW).select("task_id", "status", "created_us")
)
query("stuck_jobs", "SELECT task_id, created_us FROM jobs WHERE status = 'running'", JB)(lambda t: FR.list_jobs(t("jobs"), "running").select("task_id", "created_us"))
query("active_jobs", "SELECT count(*) FILTER (status = 'running') AS active, 4 AS capacity, count(*) FILTER (status = 'running') < 4 AS has_room FROM jobs", JB)(lambda t: FR.active_jobs(t("jobs"), 4))


# ---------------------------------------------------------------- coverage
def _cov_parts(t):
    run = F.concat(F.lit("run-"), F.col("user_id") % 9)
    log = t("fetch_log").withColumn("run_id", run)
    browser = F.col("mode") == "browser"
    work = log.groupBy("run_id").agg(
        F.count("*").alias("claimed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(browser).alias("rendered"), F.count_if(browser & F.col("ok")).alias("render_ok")
    )
    failures = log.where("NOT ok").select("run_id", F.col("failure_category").alias("bucket"))
    errors = RP.issues(t).where("severity = 'error'").select("run_id", "l_orderkey", "l_linenumber", "p_partkey").distinct()
    frontier = t("frontier").withColumn("run_id", F.concat(F.lit("run-"), F.col("page_id") % 9))
    return work, frontier, failures, RP.run_quality(t), errors


COVV = ("fetch_log", "frontier", "offers")


def _counters_df(t):
    return FU.coverage_counters(*_cov_parts(t), min_items=100, target_fields=("title", "price", "colors"))


_COV = f"""{RP.ISSUES}, {RP.QUALITY.replace(RP.LEAN + ', ', '')},
cw AS (SELECT 'run-' || (user_id % 9) AS run_id, count(*) AS claimed, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (mode = 'browser') AS rendered, count(*) FILTER (mode = 'browser' AND ok) AS render_ok,
  count(*) FILTER (NOT ok AND failure_category IN ('http_blocked', 'challenge_like')) AS blocked FROM fetch_log GROUP BY 1),
cf AS (SELECT 'run-' || (page_id % 9) AS run_id, count(*) AS disc, count(*) FILTER (status IN ('queued', 'running')) AS pending FROM frontier GROUP BY 1),
ce AS (SELECT run_id, count(DISTINCT (l_orderkey, l_linenumber, p_partkey)) AS bad FROM issues WHERE severity = 'error' GROUP BY 1),
cj AS (SELECT cw.*, coalesce(disc, 0) AS disc, coalesce(pending, 0) AS pending, coalesce(total_records, 0) AS parsed, coalesce(duplicate_count, 0) AS dup, coalesce(bad, 0) AS bad, coalesce(r_title, 0) AS rt, coalesce(r_price, 0) AS rp FROM cw LEFT JOIN cf ON cw.run_id = cf.run_id LEFT JOIN qual ON cw.run_id = qual.run_id LEFT JOIN ce ON cw.run_id = ce.run_id),
ck AS (SELECT *, greatest(parsed - bad, 0) AS passed, least(parsed - dup, greatest(parsed - bad, 0)) AS uniq FROM cj),
cov AS (SELECT run_id, greatest(100, disc, uniq)::bigint AS estimated_inventory, disc AS discovered_urls, claimed AS attempted_fetches, pending > 0 AS time_budget_exhausted, succeeded AS fetched_success, blocked AS blocked_or_challenged, failed AS fetch_failed, rendered AS render_attempted,
  render_ok AS render_success, parsed AS parsed_records, passed AS quality_passed, bad AS quality_failed, uniq AS exported_unique, dup AS duplicate_dropped, 0::bigint AS stale_or_invalid_pages, ((rt < 0.8::double)::int + (rp < 0.8::double)::int + 1)::bigint AS missing_required_fields, pending = 0 AS catalog_exhausted FROM ck)"""
query("coverage_counters", f"WITH {_COV} SELECT * FROM cov", COVV)(_counters_df)
_FLOW = (
    ("discovery", "estimated_inventory", "discovered_urls"), ("schedule", "discovered_urls", "attempted_fetches"), ("access", "attempted_fetches", "fetched_success"), ("render", "render_attempted", "render_success"),
    ("parse", "fetched_success", "parsed_records"), ("quality", "parsed_records", "quality_passed"), ("export", "quality_passed", "exported_unique"),
)
_LOSS = f"""{_COV}, loss AS ({' UNION ALL '.join(f"SELECT run_id, {i} AS o, '{s}' AS stage, {e} AS expected, {a} AS actual, greatest({e} - {a}, 0) AS lost, round({a} / {e}, 4) AS rate, '{dict(rules.COVERAGE_STAGES)[s]}' AS reason FROM cov WHERE {e} > 0" for i, (s, e, a) in enumerate(_FLOW))})"""
query("coverage_funnel", f"WITH {_LOSS} SELECT * EXCLUDE (o) FROM loss", COVV)(lambda t: FU.coverage_funnel(_counters_df(t)))


def _rt(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0::double ELSE round({a} / {b}, 4) END"


_TRIED = "(CASE WHEN attempted_fetches > 0 THEN attempted_fetches ELSE discovered_urls END)"
_REP = f"""{_LOSS}, mainl AS (SELECT run_id, arg_max(reason, lost * 100 - o) AS reason, max(lost) AS lost FROM loss GROUP BY run_id),
rep AS (SELECT cov.run_id, {_rt('discovered_urls', 'estimated_inventory')} AS discovery_rate, {_rt('fetched_success', _TRIED)} AS fetch_success_rate, {_rt('blocked_or_challenged', _TRIED)} AS block_rate, {_rt('render_success', 'render_attempted')} AS render_success_rate,
  {_rt('parsed_records', 'fetched_success')} AS parse_success_rate, {_rt('quality_passed', 'parsed_records')} AS quality_pass_rate, {_rt('exported_unique', 'quality_passed')} AS export_rate, {_rt('exported_unique', 'estimated_inventory')} AS overall_coverage_rate, 0.0::double AS target_completion_rate,
  CASE WHEN lost > 0 THEN reason ELSE 'no_major_loss' END AS main_loss_reason, {_rt('exported_unique', 'estimated_inventory')} >= 0.95::double OR (catalog_exhausted AND exported_unique >= estimated_inventory) AS accepted FROM cov LEFT JOIN mainl ON cov.run_id = mainl.run_id)"""
query("coverage_report", f"WITH {_REP} SELECT * FROM rep", COVV)(lambda t: FU.coverage_report(_counters_df(t)))
_LOSTOF = lambda st: f"coalesce((SELECT lost FROM loss l WHERE l.run_id = cov.run_id AND stage = '{st}'), 0) > 0"
_TESTS = {
    "expand_catalog_discovery": _LOSTOF("discovery"), "increase_throughput": f"time_budget_exhausted OR {_LOSTOF('schedule')}",
    "harden_access": "blocked_or_challenged > 0 OR coalesce((SELECT rate FROM loss l WHERE l.run_id = cov.run_id AND stage = 'access'), 0) < 0.95::double", "harden_rendering": f"render_attempted > 0 AND {_LOSTOF('render')}",
    "repair_parsing": _LOSTOF("parse"), "recover_quality": "quality_failed > 0 OR missing_required_fields > 0", "review_export_granularity": "duplicate_dropped > 0", "record_catalog_exhausted": "catalog_exhausted",
}
query(
    "recovery_actions",
    f"WITH {_LOSS}, acts AS ({' UNION ALL '.join(f'SELECT run_id, {i} AS o, {S.lit(k)} AS action, {S.lit(rules.RECOVERY_ADVICE[k])} AS advice FROM cov WHERE {c}' for i, (k, c) in enumerate(_TESTS.items()))}) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS action_no, action, advice FROM acts",
    COVV,
)(lambda t: FU.recovery_actions(_counters_df(t)).withColumn("action_no", F.col("action_no").cast("bigint")))
_ADV = """CASE WHEN "check" = 'min_items' THEN 'Too few items: go through more pages or start from more addresses.' WHEN "check" = 'duplicate_rate' THEN 'Too many duplicates: check how addresses are normalised and keys are built.'
 WHEN "check" = 'failed_url_count' THEN 'Too many failures: look at the failed addresses before asking for more.' ELSE 'Often empty, check its mapping: `' || substr("check", 7) || '`.' END"""
query("next_actions", f"""WITH {RP._CHECKS} SELECT run_id, "check", {_ADV} AS advice FROM checks WHERE NOT passed""", ("offers",))(lambda t: FU.next_actions(Q.quality_checks(RP.run_quality(t), RP.POLICY)))


def _report(t):
    q = RP.run_quality(t)
    fr = t("frontier").withColumn("run_id", F.concat(F.lit("run-"), F.col("page_id") % 9))
    return FU.run_report(q, Q.quality_summary_gate(q, Q.GatePolicy(mode="fail", min_items=100, max_duplicate_rate=0.5, max_failed_urls=10**9)), FR.run_status(fr), FU.coverage_report(_counters_df(t)))


query(
    "run_report",
    f"""WITH {_REP}, fst AS (SELECT 'run-' || (page_id % 9) AS run_id, count(*) FILTER (status IN ('queued', 'running')) AS o, count(*) FILTER (status = 'failed') AS f FROM frontier GROUP BY 1)
SELECT q.run_id, total_records, duplicate_count, duplicate_rate, failed_url_count, CASE WHEN total_records >= 100 AND duplicate_rate <= 0.5::double THEN 'pass' ELSE 'fail' END AS gate,
  CASE WHEN o > 0 THEN 'paused' WHEN f > 0 THEN 'partial' WHEN o IS NOT NULL THEN 'completed' END AS run_status, CASE WHEN o > 0 THEN 'bounded_pass_paused' WHEN f > 0 THEN 'frontier_failed_items' WHEN o IS NOT NULL THEN 'frontier_exhausted' END AS stop_reason,
  overall_coverage_rate, main_loss_reason, total_records > 0 AND total_records >= 100 AND duplicate_rate <= 0.5::double AS accepted
FROM qual q LEFT JOIN fst ON q.run_id = fst.run_id LEFT JOIN rep ON q.run_id = rep.run_id""",
    COVV,
)(_report)
