"""The crawl frontier as set operations: add, claim, outcomes, resume, robots, rates, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harvestlake import rules
from harvestlake.functions import urls
from harvestlake.operators import scans
from harvestlake.session import fresh_path, materialize


def frontier_rows(candidates: DataFrame, url: str = "url") -> DataFrame:
    """Candidates with canonical url and hash; null where the address is not a web address."""
    split, u = urls.with_parts(candidates, F.trim(F.col(url)), "_u")
    shaped = split.withColumn("frontier_url", urls.frontier_form(u)).withColumn("domain", urls.domain_of(u))
    return urls.without_parts(shaped, "_u").withColumn("url_hash", urls.url_hash(F.col("frontier_url")))


def frontier_add(candidates: DataFrame, known: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """New frontier rows: first candidate of each hash that is not known yet."""
    valid = frontier_rows(candidates.where(urls.is_web(F.trim(F.col("url")))))
    rest = [c for c in valid.columns if c != "url_hash"]
    first = valid.groupBy("url_hash").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    fresh = first.join(known.select("url_hash"), "url_hash", "left_anti")
    return fresh.select("url_hash", *[F.col(f"_f.{c}").alias(c) for c in rest], F.lit("queued").alias("status"))


def frontier_add_counts(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """added / skipped / invalid counters of one insert."""
    rows = frontier_rows(candidates)
    per_hash = rows.groupBy("url_hash").agg(F.count("*").alias("n"))
    marked = per_hash.join(known.select("url_hash", F.lit(True).alias("known")).distinct(), "url_hash", "left")
    invalid, seen = F.col("url_hash").isNull(), F.coalesce(F.col("known"), F.lit(False))
    return marked.agg(
        F.count_if(~invalid & ~seen).alias("added"),
        F.coalesce(F.sum(F.when(~invalid, F.col("n") - F.when(seen, 0).otherwise(1))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.when(invalid, F.col("n"))), F.lit(0)).alias("invalid"),
    )


def resume_pending(seeds: DataFrame, done: DataFrame) -> DataFrame:
    """Seeds still to be fetched after a pause."""
    first = frontier_rows(seeds.where(urls.is_web(F.trim(F.col("url"))))).select("url_hash", "frontier_url").distinct()
    return first.join(frontier_rows(done).select("url_hash"), "url_hash", "left_anti")


def next_batch(frontier: DataFrame, limit: int, now_us: int, lease_s: int = 300, tie: str = "page_id") -> DataFrame:
    """Rows to work on next: queued or with an expired lease, by priority and age."""
    ready = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("locked_us") < now_us - lease_s * 1_000_000))
    return (
        frontier.where(ready)
        .orderBy(F.desc("priority"), "created_us", tie)
        .limit(max(1, int(limit)))
        .withColumns({"status": F.lit("running"), "locked_us": F.lit(now_us), "attempts": F.col("attempts") + 1})
    )


def apply_outcomes(frontier: DataFrame, outcomes: DataFrame, key: str = "page_id") -> DataFrame:
    """Frontier after results came in: done, queued again or failed; other rows unchanged."""
    o = outcomes.select(key, F.col("ok").alias("_ok"), F.col("retry").alias("_retry"), F.col("error").alias("_error"))
    joined = frontier.join(o, key, "left")
    status = F.when(F.col("_ok"), "done").when(F.col("_retry"), "queued").when(F.col("_ok").isNotNull(), "failed").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "error": F.when(F.col("_ok") == False, F.col("_error")).otherwise("")}).drop("_ok", "_retry", "_error")  # noqa: E712


def frontier_stats(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count("*").alias("urls"))


def run_status(frontier: DataFrame) -> DataFrame:
    """Status and stop reason of each run from its frontier."""
    s = F.col("status")
    c = frontier.groupBy("run_id").agg(
        F.count_if(s.isin("queued", "running")).alias("open_urls"), F.count_if(s == "failed").alias("failed_urls"), F.count_if(s == "done").alias("done_urls")
    )
    return c.select(
        "*",
        F.when(F.col("open_urls") > 0, "paused").when(F.col("failed_urls") > 0, "partial").otherwise("completed").alias("run_status"),
        F.when(F.col("open_urls") > 0, "bounded_pass_paused").when(F.col("failed_urls") > 0, "frontier_failed_items").otherwise("frontier_exhausted").alias("stop_reason"),
    )


def run_progress(frontier: DataFrame, records: DataFrame, status: Column) -> DataFrame:
    """Done, queued, failed and saved per run with completion ratio, stage and indicator."""
    s = F.col("status")
    c = frontier.groupBy("run_id").agg(F.count_if(s == "queued").alias("queued"), F.count_if(s == "done").alias("done"), F.count_if(s == "failed").alias("failed"))
    joined = c.join(records, "run_id", "left").fillna(0, ["saved"]).withColumn("run_state", status)
    queued, done, failed, saved, state = (F.col(x) for x in ("queued", "done", "failed", "saved", "run_state"))
    known = F.greatest(done + queued + failed, saved)
    share = F.try_divide(saved, saved + failed)
    return joined.select(
        "run_id", "queued", "done", "failed", "saved", "run_state",
        F.coalesce(F.round(F.try_divide(done, known), 4), F.lit(0.0)).alias("completion"),
        F.when(state.isin("failed", "cancelled"), "stopped").when(state == "completed", "finished")
        .when((state == "running") & (queued > 0), "crawling").when((state == "running") & (done > 0), "finishing").when(state == "running", "starting").otherwise(state).alias("stage"),
        F.when(share.isNull(), "unknown").when(share >= 0.9, "pass").when(share >= 0.6, "warn").otherwise("fail").alias("quality_indicator"),
    )


# ---------------------------------------------------------------- robots
_LINE = "struct<grp:int,field:string,value:string>"


def parse_robots(files: DataFrame, agent: str = "*") -> DataFrame:
    """robots texts → one row per host with the rules that apply to an agent.

    A host is one file and stays one row; its rules are an ordered array, so no host is
    ever exploded against its urls.  A group that names the agent wins over ``*``.
    """
    # only a truly empty line ends a group; a comment line does not
    pairs = F.transform(
        F.split("body", r"\r?\n"),
        lambda x: F.struct(
            F.lower(F.trim(F.regexp_extract(x, "^([^:#]*):", 1))).alias("field"),
            F.trim(F.regexp_extract(x, "^[^:#]*:([^#]*)", 1)).alias("value"),
            (x == "").alias("blank"),
        ),
    )
    start = F.expr(f"named_struct('g', 0, 'state', 0, 'rows', cast(array() AS array<{_LINE}>))")

    def step(acc: Column, x: Column) -> Column:
        """state: 0 outside a group, 1 after an agent line, 2 after a rule."""
        is_agent = x["field"] == "user-agent"
        is_rule = x["field"].isin("disallow", "allow", "crawl-delay", "request-rate")
        opens = is_agent & (acc["state"] != 1)
        g = F.when(opens, acc["g"] + 1).otherwise(acc["g"])
        keep = is_agent | (is_rule & (acc["state"] != 0))
        state = F.when(x["blank"], 0).when(is_agent, 1).when(is_rule & (acc["state"] != 0), 2).otherwise(acc["state"])
        row = F.array(F.struct(g.cast("int").alias("grp"), x["field"].alias("field"), x["value"].alias("value")))
        return F.struct(g.alias("g"), state.alias("state"), F.when(keep, F.concat(acc["rows"], row)).otherwise(acc["rows"]).alias("rows"))

    rows = F.aggregate(pairs, start, step, lambda acc: acc["rows"])
    staged = files.select("host", rows.alias("_rows")).withColumn(
        "_ruled", F.transform(F.filter("_rows", lambda r: r["field"] != "user-agent"), lambda r: r["grp"])
    )
    # agent lines without any rule after them are no group
    agents = F.filter("_rows", lambda r: (r["field"] == "user-agent") & F.array_contains("_ruled", r["grp"]))
    named = F.get(F.filter(agents, lambda r: (r["value"] != "*") & F.contains(F.lit(agent.lower()), F.lower(r["value"]))), F.lit(0))["grp"]
    anyone = F.get(F.filter(agents, lambda r: r["value"] == "*"), F.lit(0))["grp"]
    staged = staged.withColumn("_g", F.coalesce(named, anyone))
    mine = F.filter("_rows", lambda r: r["grp"] == F.col("_g"))
    staged = staged.withColumn("_mine", mine)
    path_rules = F.transform(
        F.filter("_mine", lambda r: r["field"].isin("allow", "disallow")),
        # an empty disallow allows everything
        lambda r: F.struct(((r["field"] == "allow") | (r["value"] == "")).alias("allow"), r["value"].alias("prefix")),
    )
    value = lambda name: F.get(F.filter("_mine", lambda r: r["field"] == name), F.lit(0))["value"]
    return staged.select(
        "host", F.coalesce(path_rules, F.expr("cast(array() AS array<struct<allow:boolean,prefix:string>>)")).alias("rules"),
        F.when(value("crawl-delay").rlike(r"^\d+$"), value("crawl-delay").try_cast("double")).alias("crawl_delay"),
        F.when(value("request-rate").rlike(r"^\d+/\d+$"), value("request-rate")).alias("request_rate"),
    )


def _percent_decoded(x: Column) -> Column:
    """``%xx`` as characters; a plus stays a plus, and a percent sign without two digits stays as it is."""
    safe = F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(x, F.lit("%")), F.coalesce(F.try_url_decode(safe), x)).otherwise(x)


def robots_verdict(links: DataFrame, robots: DataFrame, mode: str = "respect") -> DataFrame:
    """Links with the first matching robots line of their host; no file allows all.

    Addresses and lines are compared percent-decoded, so ``%7E`` and ``~`` are one.
    """
    joined = links.join(robots, "host", "left")
    after_host = F.regexp_replace(F.col("url"), r"^[A-Za-z]+://[^/?#]*", "")
    path = _percent_decoded(F.when(after_host == "", "/").otherwise(after_host))
    hit = F.get(F.filter("rules", lambda r: (r["prefix"] == "*") | F.startswith(path, _percent_decoded(r["prefix"]))), F.lit(0))
    allowed = F.coalesce(hit["allow"], F.lit(True))
    return joined.select(
        *links.columns,
        (F.lit(True) if mode in ("record_only", "disabled") else allowed).alias("can_fetch"),
        F.coalesce(hit["prefix"], F.lit("")).alias("matched_rule"), "crawl_delay", F.coalesce("request_rate", F.lit("")).alias("request_rate"),
    )


# ---------------------------------------------------------------- rates and retries
def rate_rule_lookup(domains: DataFrame, rate_rules: DataFrame, domain: str = "domain") -> DataFrame:
    """Rule of each domain: exact name, then the longest ``*.suffix``, then ``default``.

    Each domain yields one row per dot, joined to the rule table and folded back.
    """
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    wild = F.transform(
        F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))),
        lambda i: F.struct(i.alias("rank"), F.concat(F.lit("*."), F.array_join(F.slice(parts, i, n), ".")).alias("pattern")),
    )
    options = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col(domain).alias("pattern"))),
        F.filter(wild, lambda w: w["rank"] <= n - 1),
        F.array(F.struct(F.lit(1000).alias("rank"), F.lit("default").alias("pattern"))),
    )
    tries = domains.select(domain).distinct().select(domain, F.inline(options))
    fields = [c for c in rate_rules.columns if c != "pattern"]
    found = tries.join(rate_rules, "pattern").groupBy(domain).agg(F.min_by(F.struct("pattern", *fields), "rank").alias("_r"))
    return found.select(domain, F.col("_r.pattern").alias("rule"), *[F.col(f"_r.{f}").alias(f) for f in fields])


def retry_decision(rows: DataFrame) -> DataFrame:
    """Retry or not, delay and reason.  Rows carry status_code, error, attempt, the rule and robots delay."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    retryable = failed | F.coalesce(F.col("status_code").isin(*rules.RETRY_STATUSES), F.lit(False))
    again = retryable & (F.col("attempt") < F.col("max_retries"))
    robots = F.col("crawl_delay")
    base = F.greatest(F.col("delay_s"), F.coalesce(F.greatest(robots, F.lit(0.0)), F.lit(0.0)))
    delay = F.when(again & (F.col("attempt") > 0), base * F.pow(F.col("backoff"), F.col("attempt"))).otherwise(base)
    reason = (
        F.when(F.col("status_code") == 429, "rate_limited").when(failed, "transport_error").when(robots.isNotNull(), "robots_metadata")
        .when(retryable, F.concat(F.lit("retryable_status:"), F.col("status_code"))).otherwise("standard")
    )
    return rows.withColumns({"should_retry": again, "wait_s": F.round(delay, 3), "retry_reason": reason})


def politeness_schedule(requests: DataFrame, delay_us: Column, key: str = "domain", chunk_us: int = scans.HOUR_US) -> DataFrame:
    """Start of each request when a domain is asked no faster than once per delay."""
    out = scans.spaced_starts(requests, [key], ["ts_us", "request_id"], scans.time_chunk("ts_us", chunk_us), "ts_us", delay_us, "start_us")
    return out.withColumn("wait_us", F.col("start_us") - F.col("ts_us"))


# ---------------------------------------------------------------- lineage
def crawl_lineage(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, buckets: int = 16) -> DataFrame:
    """Depth and first discoverer of every url reachable from the seeds.

    ``seeds`` has url; ``edges`` has parent, child.  Edges and visited urls lie in buckets of the url's hash in the
    shared folder, a folder per level, so every level's plan is the same two reads, and a narrow level only reads
    the buckets of its own urls.  Ends when a level finds nothing new; ``max_depth`` ends it earlier.
    """
    spark = seeds.sparkSession
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")
    by_parent, visited = fresh_path(spark, "lineage-edges"), fresh_path(spark, "lineage-visited")
    edges.select("parent", "child", bucket("parent")).write.partitionBy("bucket").parquet(by_parent)
    all_edges = spark.read.schema("parent string, child string, bucket int").parquet(by_parent)

    def keep(level: DataFrame, depth: int) -> DataFrame:
        at = f"{visited}/level={depth}"
        level.select("url", F.lit(depth).alias("depth"), "parent_url", bucket("url")).repartition("bucket").write.partitionBy("bucket").parquet(at)
        return spark.read.schema("url string, depth int, parent_url string, bucket int").parquet(at)

    def among(df: DataFrame, rows: DataFrame) -> DataFrame:
        """The buckets of a table that rows fall into; at most ``buckets`` numbers reach the driver."""
        return df.where(F.col("bucket").isin([r["bucket"] for r in rows.select("bucket").distinct().collect()]))

    level, depth = keep(seeds.select("url", F.lit("").alias("parent_url")).distinct(), 0), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = among(all_edges, level).join(level.select(F.col("url").alias("parent")), "parent").groupBy("child").agg(F.min("parent").alias("parent_url"))
        reached = materialize(reached.select(F.col("child").alias("url"), "parent_url", bucket("child")), "lineage")
        known = among(spark.read.schema("url string, bucket int").parquet(visited), reached)
        fresh = reached.drop("bucket").join(known.select("url"), "url", "left_anti")
        level = keep(fresh, depth)
        if level.isEmpty():
            break
    return spark.read.schema("url string, depth int, parent_url string").parquet(visited).select("url", "depth", "parent_url")


# ---------------------------------------------------------------- lists
def list_jobs(jobs: DataFrame, status: str = "", kind: str = "", limit: int | None = None) -> DataFrame:
    """Jobs, newest first, optionally of one status or kind; all of them unless a number is asked for."""
    rows = jobs.where(F.col("status") == status) if status else jobs
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.orderBy(F.desc("created_us"), "task_id")
    return rows.limit(limit) if limit else rows


def prune_stale(jobs: DataFrame, now_us: int, retention_s: int = 3600) -> DataFrame:
    """Jobs that stay after finished ones past the retention are removed."""
    old = F.col("status").isin("completed", "failed", "cancelled") & (F.col("created_us") < now_us - retention_s * 1_000_000)
    return jobs.where(~old)


def prune_endpoints(state: DataFrame, now_us: int, days: int = 7) -> DataFrame:
    """Endpoint records used within the last days."""
    return state.where((F.col("last_used_us") >= now_us - days * 86_400_000_000) | (F.col("last_used_us") == 0))


def active_jobs(jobs: DataFrame, capacity: int) -> DataFrame:
    running = F.count_if(F.col("status") == "running")
    return jobs.agg(running.alias("active"), F.lit(capacity).alias("capacity"), (running < capacity).alias("has_room"))


def top_per_key(rows: DataFrame, keys: list[str], order: list, k: int | None) -> DataFrame:
    """Top k rows per key, the limit is applied on the map side first; without ``k``, all rows with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k) if k else ranked
