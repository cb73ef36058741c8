"""Captured calls, evidence signals, strategy scorecards and risk reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import urls
from harvestlake.operators.frontier import top_per_key
from harvestlake.session import materialize

CANDIDATES = ("http", "api_intercept", "browser", "deeper_recon", "manual_handoff")
EXECUTABLE = ("http", "api_intercept", "browser")


def _kept(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


# ---------------------------------------------------------------- captured calls
def _is_graphql(url: Column, post: Column) -> Column:
    query = F.trim(F.try_variant_get(F.try_parse_json(F.nullif(post, F.lit(""))), "$.query", "string"))
    starts = r"^(query |mutation |subscription )"
    in_json = query.rlike(starts) | (F.startswith(query, F.lit("{")) & F.contains(query, F.lit("}")))
    return F.contains(url, F.lit("graphql")) | F.contains(post, F.lit("graphql")) | F.coalesce(in_json, F.lit(False)) | F.trim(post).rlike(starts)


def network_entry_score(calls: DataFrame) -> DataFrame:
    """Score, kind, reasons and keep rule of each captured call."""
    low, post, ctype = F.lower("url"), F.lower(F.coalesce("post_data", F.lit(""))), F.lower("content_type")
    status, xhr = F.col("status_code"), F.col("resource_type").isin("xhr", "fetch")
    json_like = F.contains(ctype, F.lit("application/json")) | (F.coalesce(F.col("json_preview"), F.lit("")) != "")
    static = urls.any_endswith(F.substring_index(low, "?", 1), rules.STATIC_SUFFIXES) | urls.has_token(ctype, rules.STATIC_TYPES)
    flagged = calls.withColumns({"_gql": _is_graphql(low, post), "_json": json_like})
    parts = [
        (status.between(200, 299), 10, F.lit("status_ok")),
        (status.isin(401, 403, 429, 503), -10, F.concat(F.lit("blocked_or_limited:"), status)),
        (xhr, 18, F.lit("xhr_fetch")),
        (F.col("_json"), 20, F.lit("json")),
        (F.col("_gql"), 24, F.lit("graphql_signal")),
        (urls.has_token(low, rules.CALL_KEYWORDS), 12, F.lit("api_url_keywords")),
        (F.upper("method") == "POST", 4, F.lit("post")),
        (static, -30, F.lit("static_asset")),
    ]
    score = sum((F.when(t, p).otherwise(0) for t, p, _ in parts), F.lit(0))
    return (
        flagged.withColumns(
            {
                "score": score,
                "kind": F.when(F.col("_gql"), "graphql").when(F.col("_json"), "json").otherwise("other"),
                "reasons": F.array_join(_kept(*[F.when(t, r) for t, _, r in parts]), ","),
            }
        )
        .withColumn("keep", (F.col("score") >= 10) | xhr)
        .drop("_gql", "_json")
    )


def network_candidates(scored: DataFrame) -> DataFrame:
    """API candidates: score of 20 or more, no trackers, best call per (method, url)."""
    good = scored.where((F.col("score") >= 20) & ~urls.is_tracking_url(F.col("url")))
    best = good.groupBy(F.upper("method").alias("method"), "url").agg(
        F.max_by(F.struct("page", "kind", "score", "status_code", "call_id"), F.struct("score", -F.col("call_id"))).alias("_b"), F.count("*").alias("seen")
    )
    return best.select("method", "url", "_b.page", "_b.kind", "_b.score", "_b.status_code", "_b.call_id", "seen")


def body_call_score(calls: DataFrame, product_tokens=("product", "catalog", "item", "goods", "search")) -> DataFrame:
    """Score of a call that also reads its body: JSON, arrays, product fields, paging, noise."""
    low, body = F.lower("url"), F.try_parse_json(F.nullif(F.col("json_preview"), F.lit("")))
    array = F.coalesce(*[F.try_variant_get(body, p, "array<variant>") for p in ("$", *[f"$.{k}" for k in rules.ITEM_LIST_KEYS])])
    first = F.get(array, F.lit(0))
    has = lambda k: F.try_variant_get(first, f"$.{k}", "variant").isNotNull()
    fields = has("title") | has("name") | has("price") | has("sku")
    paged = F.exists(urls.query_pairs(urls.query_string(F.col("url"))), lambda p: F.lower(p["k"]).isin(*rules.PAGE_KEYS, *rules.OFFSET_KEYS, *rules.LIMIT_KEYS, *rules.CURSOR_KEYS))
    post_json = F.try_parse_json(F.nullif(F.col("post_data"), F.lit(""))).isNotNull()
    points = [
        (F.contains(F.lower("content_type"), F.lit("json")), 25), (body.isNotNull(), 22), (F.size(array) > 0, 25), ((F.size(array) > 0) & fields, 18),
        (urls.has_token(low, product_tokens), 12), (paged, 8), ((F.col("method") == "POST") & post_json, 8), (_is_graphql(low, F.lower("post_data")), 10),
        (urls.is_tracking_url(F.col("url")), -35), (~F.col("status_code").between(200, 299), -20),
    ]
    score = sum((F.when(F.coalesce(t, F.lit(False)), p).otherwise(0) for t, p in points), F.lit(0))
    return calls.withColumns({"body_score": F.greatest(F.lit(0), F.least(score, F.lit(100))), "item_count": F.coalesce(F.size(array), F.lit(0))})


_INNER = "array<struct<name:string,path:string,v:variant>>"


def _unfolded(value: Column, path: Column, depth: int) -> Column:
    """Leaves (name, path, value) down to some levels of a parsed JSON value, and the objects and lists below them (path, json)."""
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    inner = lambda v: as_map(v).isNotNull() | as_list(v).isNotNull()

    def below(v: Column, path: Column) -> Column:
        join = lambda k: F.concat_ws(".", F.nullif(path, F.lit("")), k)
        named = F.transform(F.map_entries(as_map(v)), lambda e: F.struct(e["key"].alias("name"), join(e["key"]).alias("path"), e["value"].alias("v")))
        listed = F.transform(as_list(v), lambda x, i: F.struct(i.cast("string").alias("name"), join(i.cast("string")).alias("path"), x.alias("v")))
        return F.coalesce(named, listed, F.expr(f"cast(array() AS {_INNER})"))

    level = below(value, path)
    out = []
    for _ in range(depth):
        out.append(F.transform(F.filter(level, lambda x: ~inner(x["v"])), lambda x: F.struct(x["name"].alias("name"), x["path"].alias("path"), F.coalesce(F.try_variant_get(x["v"], "$", "string"), F.lit("")).alias("value"))))
        level = F.flatten(F.transform(F.filter(level, lambda x: inner(x["v"])), lambda x: below(x["v"], x["path"])))
    # what is left are members of the last level, each a value of its own
    leaves = F.transform(F.filter(level, lambda x: ~inner(x["v"])), lambda x: F.struct(x["name"].alias("name"), x["path"].alias("path"), F.coalesce(F.try_variant_get(x["v"], "$", "string"), F.lit("")).alias("value")))
    rest = F.transform(F.filter(level, lambda x: inner(x["v"])), lambda x: F.struct(x["path"].alias("path"), F.to_json(x["v"]).alias("json")))
    return F.struct(F.concat(*out, leaves).alias("leaves"), rest.alias("rest"))


def json_leaves(rows: DataFrame, json: str, keep: list[str], depth: int = 4) -> DataFrame:
    """``keep`` columns, ``name``, ``path`` and ``value`` of the leaves of JSON texts, however deep.

    ``depth + 1`` levels are unfolded inside the row; only values with more are rows of another round, until none is left.
    """
    todo, out = rows.select(*keep, F.lit("").alias("path"), F.col(json).alias("json")), None
    while True:
        step = todo.select(*keep, _unfolded(F.try_parse_json(F.nullif(F.col("json"), F.lit(""))), F.col("path"), depth).alias("u")).select(*keep, "u.*")
        step = materialize(step, "json-leaves")
        leaves = step.select(*keep, F.inline("leaves"))
        out = leaves if out is None else out.unionByName(leaves)
        todo = step.where(F.size("rest") > 0).select(*keep, F.inline("rest"))
        if todo.isEmpty():
            return out


def _normal(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[_-]", "")


def request_params(calls: DataFrame, headers: str | None = None) -> DataFrame:
    """One row per query, header or body parameter that changes or guards a request."""
    pairs = urls.query_pairs(urls.query_string(F.col("url")))
    at = lambda place, arr: F.transform(arr, lambda x: F.struct(F.lit(place).alias("location"), x["name"].alias("name"), x["path"].alias("path"), x["value"].alias("value")))
    found = [at("query", F.transform(F.filter(pairs, lambda p: p["k"] != ""), lambda p: F.struct(p["k"].alias("name"), p["k"].alias("path"), p["v"].alias("value"))))]
    if headers:
        found.append(at("header", F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("name"), e["key"].alias("path"), e["value"].alias("value")))))
    rows = calls.select("call_id", "site", F.inline(F.concat(*found)))
    body = json_leaves(calls.where("post_data <> ''"), "post_data", ["call_id", "site"])
    rows = rows.unionByName(body.select("call_id", "site", F.lit("json").alias("location"), "name", "path", "value"))
    n = _normal(F.col("name"))
    stamp = n.isin(*rules.TIMESTAMP_NAMES) | F.col("value").rlike(r"^(\d{10}|\d{13})$")
    kinds = _kept(
        F.when(stamp, "timestamp").when(n.isin(*rules.NONCE_NAMES), "nonce"),
        F.when(n.isin(*rules.SIGNATURE_NAMES), "signature"),
        F.when((F.col("location") == "header") & n.isin(*rules.SESSION_HEADERS), "session"),
    )
    return rows.select("call_id", "site", "location", "name", "path", F.explode(kinds).alias("kind")).distinct()


def request_param_profile(calls: DataFrame, headers: str | None = None) -> DataFrame:
    """Fragility of each call: dynamic inputs, signed parts, session needs and the level they give."""
    counts = request_params(calls, headers).groupBy("call_id").agg(
        F.count_if(F.col("kind").isin("timestamp", "nonce")).alias("dynamic_inputs"), F.count_if(F.col("kind") == "signature").alias("signed_components"),
        F.count_if(F.col("kind") == "session").alias("session_requirements"),
    )
    d, s, r = F.col("dynamic_inputs"), F.col("signed_components"), F.col("session_requirements")
    joined = calls.select("call_id", "site").join(counts, "call_id", "left").fillna(0, ["dynamic_inputs", "signed_components", "session_requirements"])
    level = F.when((s > 0) & (r > 0), "high").when((s > 0) | (r > 0), "medium").when(d > 0, "low").otherwise("none")
    return joined.select("*", level.alias("risk_level"), ((d > 0) | (s > 0) | (r > 0)).alias("replay_required"))


def pagination_type_infer(calls: DataFrame) -> DataFrame:
    """Paging style of each site from the query parameters of its calls; first seen names win."""
    classes = {"page": rules.PAGE_KEYS, "offset": rules.OFFSET_KEYS, "limit": rules.LIMIT_KEYS, "cursor": rules.CURSOR_KEYS}
    k = F.lower("_p.k")
    cls = None
    for name, keys in classes.items():
        cls = F.when(k.isin(*keys), name) if cls is None else cls.when(k.isin(*keys), name)
    params = calls.select("site", "ts_us", "call_id", F.posexplode(urls.query_pairs(urls.query_string(F.col("url")))).alias("pos", "_p"))
    seen = params.where("_p.v <> ''").select("site", cls.alias("cls"), F.col("_p.k").alias("param"), F.col("_p.v").alias("value"), F.struct("ts_us", "call_id", "pos").alias("at")).where("cls IS NOT NULL")
    first = seen.groupBy("site", "cls").agg(F.min_by(F.struct("param", "value"), "at").alias("f"))
    pick = lambda name: F.max(F.when(F.col("cls") == name, F.col("f")))
    wide = first.groupBy("site").agg(*[pick(n).alias(n) for n in classes])
    style = F.when(F.col("page").isNotNull(), "page").when(F.col("offset").isNotNull(), "offset").when(F.col("cursor").isNotNull(), "cursor")
    chosen = F.coalesce("page", "offset", "cursor")
    start = F.when(style.isin("page", "offset"), F.coalesce(chosen["value"].try_cast("int"), F.when(style == "page", 1).otherwise(0)))
    return wide.where(style.isNotNull()).select(
        "site", style.alias("pagination_type"), chosen["param"].alias("param"), start.alias("start_value"),
        F.coalesce(F.col("limit.param"), F.lit("")).alias("size_param"), F.col("limit.value").try_cast("int").alias("page_size"),
        F.lit("high").alias("confidence"),
    )


# ---------------------------------------------------------------- transports
def transport_differences(attempts: DataFrame) -> DataFrame:
    """What differs between the fetch attempts of each url; optional columns may be absent."""
    have = set(attempts.columns)
    status, challenged = F.col("status_code"), F.col("challenge") != ""
    text_differs = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit(""))) > 1
    agg = {
        "attempts": F.count("*"),
        "statuses": F.count_distinct(F.when(status > 0, status)),
        "challenged": F.count_if(challenged),
        "challenges": F.count_distinct(F.when(challenged, F.col("challenge"))),
        "succeeded": F.count_if(status.between(200, 299)),
        "blocked": F.count_if(status.isin(403, 429, 503) | challenged),
        "spread": F.max("score") - F.min("score"),
    }
    for c in ("http_version", "transport_profile", "server"):
        agg[f"d_{c}"] = text_differs(c) if c in have else F.lit(False)
    for c in ("edge_header", "error"):
        agg[f"n_{c}"] = F.count_if(F.col(c) != "") if c in have else F.lit(0).cast("bigint")
    a = attempts.groupBy("url").agg(*[v.alias(k) for k, v in agg.items()])
    n, ch = F.col("attempts"), F.col("challenged")
    mixed = lambda c: (F.col(c) > 0) & (F.col(c) != n)
    consistent = (ch == n) & (F.col("challenges") <= 1)
    findings = _kept(
        F.when(F.col("statuses") > 1, "status_differs_by_transport"),
        F.when(ch > 0, F.when(consistent, "challenge_consistent_across_transports").otherwise("challenge_differs_by_transport")),
        F.when((F.col("succeeded") > 0) & (F.col("blocked") > 0), "some_transports_succeed_while_others_blocked"),
        F.when(F.col("spread") >= 40, "quality_score_differs_by_transport"),
        F.when(F.col("d_http_version"), "http_version_differs"),
        F.when(F.col("d_transport_profile"), "transport_profile_differs"),
        F.when(F.col("d_server"), "server_header_differs"),
        F.when(mixed("n_edge_header"), "edge_header_presence_differs"),
        F.when(mixed("n_error"), "transport_errors_are_mode_specific"),
    )
    return a.select("url", "attempts", F.array_join(findings, ",").alias("findings"))


# ---------------------------------------------------------------- evidence
def signal(page: Column, code: str | Column, source: str, confidence: str | Column, score: Column, variant: str | Column = "") -> list[Column]:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [page.alias("page"), as_col(code).alias("code"), F.lit(source).alias("source"), as_col(confidence).alias("confidence"), score.cast("int").alias("score"), as_col(variant).alias("variant")]


def dom_signals(dom: DataFrame) -> DataFrame:
    """dom: page, item_count, fields, has_title, has_selector."""
    n, f = F.col("item_count"), F.col("fields")
    many = n >= 2
    return dom.where(many | (f > 0) | F.col("has_selector")).select(
        *signal(
            F.col("page"), F.when(many, "dom_repeated_items").otherwise("dom_partial_selectors"), "dom",
            F.when(many & F.col("has_title"), "high").when(many, "medium").otherwise("low"), F.when(many, F.least(F.lit(85), 30 + n * 5 + f * 8)).otherwise(25),
        )
    )


def api_signals(candidates: DataFrame, per_page: int | None = None) -> DataFrame:
    """Candidate, signing, dynamic-input and GraphQL signals of a page's candidates: all, or the best ``per_page``.

    What follows from them folds by code and page, so a page may have any number.
    """
    top = top_per_key(candidates, ["page"], [F.desc("score"), "url", "method"], per_page) if per_page else candidates
    s, status = F.col("score"), F.col("status_code")
    blocked = status.isin(401, 403, 429, 503)
    base = top.select(
        *signal(
            F.col("page"), F.when(blocked, "blocked_api_candidate").otherwise("observed_api_candidate"), "api",
            F.when(blocked, "low").when(s >= 70, "high").when(s >= 40, "medium").otherwise("low"),
            F.greatest(s, F.when(F.col("kind").isin("json", "graphql"), 35).otherwise(20)),
        )
    )
    low = F.lower("url")
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    keys = F.transform(urls.query_pairs(urls.query_string(low)), lambda p: p["k"])
    counted = top.withColumns(
        {"_sig": hits(rules.SIGNING_WORDS), "_dyn": F.size(F.array_intersect(keys, F.array(*map(F.lit, rules.DYNAMIC_PARAMS)))), "_enc": hits(rules.ENCRYPTION_WORDS)}
    )
    signing = counted.where("_sig > 0").select(
        *signal(F.col("page"), "api_auth_token_hint", "api", F.when(F.col("_sig") >= 2, "high").otherwise("medium"), F.least(F.lit(80), 40 + F.col("_sig") * 12))
    )
    dynamic = counted.where("_dyn > 0").select(*signal(F.col("page"), "api_dynamic_input_hint", "api", "medium", F.least(F.lit(65), 30 + F.col("_dyn") * 10)))
    encrypted = counted.where("_enc > 0").select(*signal(F.col("page"), "api_encrypted_payload_hint", "api", "high", F.lit(70)))
    limited = top.where((F.col("kind") == "graphql") & (status == 429)).select(*signal(F.col("page"), "graphql_rate_limit", "graphql", "high", F.lit(75)))
    return base.unionByName(signing).unionByName(dynamic).unionByName(encrypted).unionByName(limited)


def _signal_struct(code: str, source: str, confidence: str, score: Column, variant: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), score.cast("int").alias("score"),
        (F.lit("") if variant is None else variant).alias("variant"),
    )


def script_signals(inventory: DataFrame) -> DataFrame:
    """Endpoint and keyword signals of a page's scripts; a group holds one page's scripts."""
    every = ["signature", "encryption", "token", "challenge", "anti_bot", "fingerprint", "verification", "bundler"]
    has = lambda *names: F.max(F.exists("categories", lambda c: c.isin(*names)))
    per_page = inventory.groupBy(F.concat(F.lit("p"), F.col("page_id")).alias("page")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("endpoints")))).alias("ends"),
        sum((F.max(F.array_contains("categories", c).cast("int")) for c in every), F.lit(0)).alias("n"), F.count_if(F.col("score") >= 50).alias("strong"),
        has("challenge", "fingerprint", "anti_bot").alias("guard"), has("token", "crypto", "encryption").alias("tok"),
    )
    ends, n = F.col("ends"), F.col("n")
    variant = F.concat_ws("+", F.when(F.col("guard"), "guard"), F.when(F.col("tok"), "token"))
    return per_page.select(
        "page",
        F.inline(
            _kept(
                F.when(ends > 0, _signal_struct("js_endpoint_strings", "js", "medium", F.least(F.lit(75), 30 + ends * 4))),
                F.when(n > 0, _signal_struct("js_keyword_categories", "js", "medium", F.least(F.lit(70), 20 + n * 8 + F.col("strong") * 10), variant)),
            )
        ),
    )


def access_signals(classified: DataFrame) -> DataFrame:
    return classified.select(
        F.concat(F.lit("p"), F.col("page_id")).alias("page"),
        F.inline(
            _kept(
                F.when(F.col("challenge") != "", _signal_struct("challenge_detected", "access", "high", F.lit(90))),
                F.when(F.col("js_shell"), _signal_struct("js_rendering_required", "access", "medium", F.lit(55))),
            )
        ),
    )


def frame_signals(summary: DataFrame) -> DataFrame:
    n = F.least(F.lit(75), 35 + F.col("connections") * 10 + F.col("total_frames"))
    return summary.select(*signal(F.col("page"), "websocket_activity", "websocket", "medium", n))


def transport_signals(differences: DataFrame) -> DataFrame:
    """differences: page, findings, selected_mode."""
    sensitive = F.contains("findings", F.lit("differs")) | F.contains("findings", F.lit("some_transports"))
    return differences.where("findings <> ''").select(
        *signal(
            F.col("page"), F.when(sensitive, "transport_sensitive").otherwise("transport_diagnostics"), "transport", F.when(sensitive, "high").otherwise("low"),
            F.when(sensitive, 75).otherwise(25), F.when(F.col("selected_mode") == "browser", "browser").otherwise("http"),
        )
    )


def evidence_signals(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


# ---------------------------------------------------------------- scorecard
def strategy_weights(spark) -> DataFrame:
    """The weight rules as a table; a fixed list of a few dozen rows, safe to broadcast."""
    return spark.createDataFrame(list(rules.STRATEGY_WEIGHTS), "rule string, candidate string, share int, plus int, at_least int")


def _rule_rows(signals: DataFrame) -> DataFrame:
    """Signals under each rule name they answer to: the code, and code:variant."""
    special = F.transform(F.filter(F.split("variant", r"\+"), lambda v: v != ""), lambda v: F.concat("code", F.lit(":"), v))
    return signals.select("page", "code", "score", F.explode(F.concat(F.array("code"), special)).alias("rule"))


def signal_weights_join(signals: DataFrame, weights: DataFrame, how: str = "inner") -> DataFrame:
    """Points each signal gives each candidate."""
    rows = _rule_rows(signals).join(F.broadcast(weights), "rule", how)
    amount = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score")))
    points = amount * F.col("share") + F.col("plus")
    return rows.select("page", "code", "score", "rule", "candidate", F.greatest(points, F.coalesce(F.col("at_least"), points)).alias("points"))


def strategy_scorecard(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Candidate scores of a page, the best and best executable one, confidence and guardrails.

    One aggregation over the weighted signals; page-wide adjustments are added to its row.
    """
    code, score = F.col("code"), F.col("score")
    rows = signal_weights_join(signals, weights, "left")
    per_page = rows.groupBy("page").agg(
        *[F.coalesce(F.sum(F.when(F.col("candidate") == c, F.col("points"))), F.lit(0)).alias(f"_{c}") for c in CANDIDATES],
        F.max(code.isin(*rules.SIGNING_RISK_CODES) & (score >= 50)).alias("signing_risk"), F.max(code == "challenge_detected").alias("challenge_seen"),
        F.max((code == "dom_repeated_items") & (score >= 55)).alias("strong_dom"), F.max(code == "blocked_api_candidate").alias("blocked"),
        F.max(code == "fingerprint_runtime_risk").alias("fingerprint"),
    )
    total = {c: F.col(f"_{c}") for c in CANDIDATES}
    for rule, candidate, _, plus, _ in rules.STRATEGY_WEIGHTS:
        if rule in ("signing_risk", "challenge_seen", "strong_dom"):
            total[candidate] = total[candidate] + F.when(F.col(rule), plus).otherwise(0)
    summed = per_page.withColumns({f"score_{c}": F.greatest(F.lit(0), v).cast("bigint") for c, v in total.items()})
    # a stable order of the names breaks ties
    ranked = lambda names: F.array_sort(F.array(*[F.struct((-F.col(f"score_{c}")).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(names)]))
    joined = summed.withColumns({"_all": ranked(CANDIDATES), "_exe": ranked(EXECUTABLE)})
    top, second = -F.col("_all")[0]["neg"], -F.col("_all")[1]["neg"]
    guards = _kept(
        F.lit("evidence_only_no_bypass"), F.when(F.col("blocked"), "blocked_api_candidate_penalty"), F.when(F.col("fingerprint"), "fingerprint_risk_requires_profile_review"),
        F.when(F.col("signing_risk"), "crypto_requires_runtime_inputs"), F.when(F.col("challenge_seen"), "challenge_blocks_api_replay"), F.when(F.col("strong_dom"), "good_dom_preserved"),
    )
    return joined.select(
        "page", *[f"score_{c}" for c in CANDIDATES],
        F.col("_all")[0]["name"].alias("recommended"), F.col("_exe")[0]["name"].alias("executable"),
        F.when((top >= 80) & (top - second >= 25), "high").when(top >= 50, "medium").otherwise("low").alias("confidence"), F.array_join(guards, ",").alias("guardrails"),
    )


# ---------------------------------------------------------------- risk
def page_findings(classified: DataFrame, signals: DataFrame) -> DataFrame:
    """Risk findings of pages from their classification and signals."""
    page = F.concat(F.lit("p"), F.col("page_id")).alias("page")
    row = lambda test, code, category, severity, source: F.when(test, F.struct(code.alias("code"), F.lit(category).alias("category"), severity.alias("severity"), F.lit(source).alias("source")))
    action = F.col("access_action")
    access = classified.select(
        page,
        F.inline(
            _kept(
                row(F.col("challenge") != "", F.concat(F.lit("access_"), F.col("challenge_kind")), "challenge", F.col("challenge_severity"), "access_diagnostics"),
                row(action.isin("backoff", "manual_handoff", "authorized_browser_review"), F.concat(F.lit("access_decision_"), action), "access_policy", F.when(action == "backoff", "medium").otherwise("high"), "access_policy"),
                row(F.col("status_code") == 429, F.lit("http_429_rate_limited"), "rate_limit", F.lit("medium"), "fetch"),
            )
        ),
    )
    code, variant = F.col("code"), F.col("variant")
    other = signals.select(
        "page",
        F.inline(
            _kept(
                row(code == "blocked_api_candidate", F.lit("blocked_api_candidates"), "api_block", F.lit("medium"), "api_candidates"),
                row(code.isin("transport_sensitive", "transport_diagnostics"), F.lit("transport_sensitive_access"), "transport", F.when(code == "transport_sensitive", "medium").otherwise("low"), "transport_diagnostics"),
                row((code == "js_keyword_categories") & F.contains(variant, F.lit("guard")), F.lit("js_anti_bot_clues"), "js_challenge", F.lit("medium"), "js_evidence"),
                row(code.isin(*rules.SIGNING_RISK_CODES), F.lit("js_signature_or_encryption_flow"), "crypto_signature", F.lit("high"), "js_crypto_evidence"),
                row(code == "websocket_activity", F.lit("websocket_runtime_dependency"), "runtime_protocol", F.lit("medium"), "websocket_summary"),
            )
        ),
    )
    return access.unionByName(other)


def page_risk_report(findings: DataFrame) -> DataFrame:
    """Risk score, level and action of each page from its distinct (code, source) findings."""
    weight = F.create_map(*[x for k, v in rules.SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    distinct = findings.groupBy("page", "code", "source").agg(F.max_by(F.struct("category", "severity"), F.coalesce(weight[F.col("severity")], F.lit(8))).alias("f")).select("page", "code", "source", "f.*")
    sev, cat, code = F.col("severity"), F.col("category"), F.col("code")
    any_of = lambda test: F.max(test)
    a = distinct.groupBy("page").agg(
        F.count("*").alias("findings"), F.least(F.lit(100), F.sum(F.coalesce(weight[sev], F.lit(8)))).cast("int").alias("risk_score"),
        any_of(sev == "critical").alias("c"), any_of(sev == "high").alias("h"), any_of(sev == "medium").alias("m"),
        any_of(F.contains(code, F.lit("captcha")) | (code == "access_managed_challenge")).alias("handoff"), any_of(code == "access_login_required").alias("login"),
        any_of((cat == "rate_limit") | (code == "http_429_rate_limited")).alias("limited"), any_of(cat == "crypto_signature").alias("signed"),
        any_of(cat.isin("fingerprint", "transport", "runtime_protocol")).alias("profile"),
        # a page has at most one row per finding code, a fixed short list
        F.array_sort(F.collect_list(F.struct((-F.coalesce(weight[sev], F.lit(8))).alias("w"), "code", "source"))).alias("_all"),
    )
    score = F.col("risk_score")
    leveled = a.withColumn("risk_level", F.when(F.col("c") | (score >= 90), "critical").when(F.col("h") | (score >= 55), "high").when(F.col("m") | (score >= 25), "medium").otherwise("low"))
    action = (
        F.when(F.col("handoff"), "manual_handoff").when(F.col("login"), "authorized_session_review").when(F.col("limited"), "backoff").when(F.col("signed"), "deeper_recon")
        .when(F.col("profile"), "browser_render_or_profile_review").when(F.col("risk_level").isin("high", "critical"), "manual_handoff").otherwise("standard_http")
    )
    tops = F.array_join(F.transform(F.slice("_all", 1, 3), lambda x: x["code"]), ",")
    return leveled.select("page", "findings", "risk_score", "risk_level", action.alias("action"), tops.alias("top_findings"))


# ---------------------------------------------------------------- selectors, rules, evidence
def selector_candidates(missing: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Selectors for missing fields of a site: same name, or one name inside the other at 80 %."""
    c = candidates.select("site", F.col("name").alias("candidate"), "selector", F.col("score").alias("raw"))
    low = F.lower("candidate")
    joined = missing.join(c, "site").where(F.contains(low, F.col("field")) | F.contains(F.col("field"), low))
    scored = joined.withColumn("score", F.round(F.when(F.col("candidate") == F.col("field"), F.col("raw")).otherwise(F.col("raw") * 0.8), 6)).drop("raw")
    return top_per_key(scored, ["site", "field"], [F.desc("score"), "candidate", "selector"], k)


def apply_site_rules(rows: DataFrame, site_rules: DataFrame, url: str = "url") -> DataFrame:
    """First matching rule of the row's site.

    A site's rules are a short ordered array joined one to one, so a busy site is not
    multiplied by its rules.  ``site_rules``: site, rules array<struct<pattern,kind,priority>>.
    """
    joined = rows.join(site_rules, "site", "left")
    hit = F.get(F.filter("rules", lambda r: F.regexp_like(F.col(url), r["pattern"])), F.lit(0))
    return joined.select(*rows.columns, F.coalesce(hit["kind"], F.lit("page")).alias("kind"), F.coalesce(hit["priority"], F.lit(0)).alias("priority"))


def merge_evidence(first: DataFrame, later: DataFrame, key: str = "site") -> DataFrame:
    """Evidence of two sources: later scalars win, lists are united, changed keys are noted.

    Both have the key, ``facts`` map<string,string> and ``lists`` map<string,array<string>>.
    """
    a = first.select(key, F.col("facts").alias("_fa"), F.col("lists").alias("_la"))
    b = later.select(key, F.col("facts").alias("_fb"), F.col("lists").alias("_lb"))
    none_s, none_l = F.expr("cast(map() AS map<string,string>)"), F.expr("cast(map() AS map<string,array<string>>)")
    j = a.join(b, key, "full").withColumns({"_fa": F.coalesce("_fa", none_s), "_fb": F.coalesce("_fb", none_s), "_la": F.coalesce("_la", none_l), "_lb": F.coalesce("_lb", none_l)})
    empty = F.array().cast("array<string>")
    return j.select(
        key,
        F.map_zip_with("_fa", "_fb", lambda k, x, y: F.coalesce(y, x)).alias("facts"),
        F.map_zip_with("_la", "_lb", lambda k, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty))).alias("lists"),
        F.array_sort(F.map_keys(F.map_filter(F.map_zip_with("_fa", "_fb", lambda k, x, y: x != y), lambda k, v: F.coalesce(v, F.lit(False))))).alias("conflicts"),
    )
