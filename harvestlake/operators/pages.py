"""Page classification: bad pages, challenges, access profile, framework, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import html as H
from harvestlake.functions import urls


def is_bad_page(html: Column, status: Column, min_length: int = rules.BAD_PAGE_MIN_LENGTH) -> Column:
    """Server error, too short or carrying a block marker."""
    body = F.coalesce(html, F.lit(""))
    return (
        (F.coalesce(status, F.lit(0)) >= 500)
        | (F.length(body) < min_length)
        | urls.any_contains(F.lower(body), rules.BAD_PAGE_MARKERS)
    )


def cache_key(value: Column, prefix: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(prefix), value))


def good_page_cache(pages: DataFrame, prefix: str = "") -> DataFrame:
    """Usable pages under their cache key."""
    return pages.where(~is_bad_page(F.col("html"), F.col("status_code"))).select(
        cache_key(F.col("url"), prefix).alias("cache_key"), *pages.columns
    )


def failure_bucket(category: Column, status: Column, error: Column) -> Column:
    return (
        F.when(category != "", category)
        .when(status.isin(401, 403, 407, 429), "http_blocked")
        .when(status >= 500, "server_error")
        .when(error != "", "runtime_error")
        .otherwise("unknown")
    )


def _array_of(*pairs: tuple[Column, Column]) -> Column:
    """Values whose test holds, in the given order."""
    return F.filter(F.array(*[F.when(test, value) for test, value in pairs]), lambda v: v.isNotNull())


def api_hints(html: Column) -> Column:
    """Distinct API-like strings of a page body."""
    found = F.regexp_extract_all(html, F.lit("(?i)" + rules.API_HINT), 1)
    return F.array_distinct(found)


def access_profile(pages: DataFrame, headers: str | None = None) -> DataFrame:
    """Size, structure and challenge signals of each page, next to its other columns."""
    h, status = F.coalesce(F.col("html"), F.lit("")), F.col("status_code")
    low = F.lower(h)
    if headers:
        entries = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
        low_all = F.concat_ws(" ", low, F.lower(F.array_join(entries, " ")))
    else:
        low_all = low
    is_json = H.looks_like_json(h)
    markers = F.array(
        *[F.struct(F.lit(m).alias("marker"), F.lit(k).alias("kind"), F.lit(v).alias("vendor")) for m, k, v in rules.CHALLENGE_MARKERS]
    )
    step = pages.withColumns({"_low": low_all, "is_json": is_json}).withColumn(
        "_hits", F.when(F.col("is_json"), F.slice(markers, 1, 0)).otherwise(F.filter(markers, lambda m: F.contains(F.col("_low"), m["marker"])))
    )
    first = F.get("_hits", F.lit(0))
    login = urls.any_contains(F.col("_low"), rules.LOGIN_MARKERS) | F.col("_low").rlike(rules.LOGIN_FORM)
    none_hit = F.size("_hits") == 0
    limited = ~F.col("is_json") & none_hit & (status == 429)
    gated = ~F.col("is_json") & none_hit & status.isin(401, 403) & login
    step = step.withColumns(
        {
            "challenge_kind": F.when(limited, "rate_limited").when(gated, "login_required").otherwise(F.coalesce(first["kind"], F.lit("none"))),
            "challenge_vendor": F.when(limited | gated, "unknown").otherwise(F.coalesce(first["vendor"], F.lit("none"))),
            "challenge": F.when(limited | gated, F.concat(F.lit("status:"), status)).otherwise(F.coalesce(first["marker"], F.lit(""))),
            "challenge_markers": F.when(limited, "status:429")
            .when(gated, F.concat(F.lit("status:"), status, F.lit(",login_marker")))
            .otherwise(F.array_join(F.col("_hits.marker"), ",")),
            "html_chars": F.length(h),
            "text_chars": F.length(H.visible_text(h)),
            "script_count": F.regexp_count(h, F.lit(r"(?i)<script\b")),
            "app_root_count": F.regexp_count(
                H.without_scripts(h), F.lit(r"(?is)<[a-z][^>]*\s(?:id\s*=\s*[\"']?(?:root|app)[\"'\s>]|data-reactroot|ng-version)")
            ),
            "json_ld_count": F.regexp_count(h, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"']")),
            "next_data": h.rlike(r"(?is)<script\b[^>]*id\s*=\s*[\"']__NEXT_DATA__[\"']"),
            "nuxt_data": F.contains(low, F.lit("__nuxt__")) | F.contains(low, F.lit("__nuxt_data__")),
            "api_hints": api_hints(h),
        }
    )
    kind = F.col("challenge_kind")
    shell = (F.col("challenge") == "") & (
        ((F.col("text_chars") < 500) & (F.col("script_count") >= 5))
        | ((F.col("app_root_count") > 0) & (F.col("text_chars") < 1200))
    )
    return step.withColumns(
        {
            "challenge_severity": F.when(kind == "none", "low")
            .when(kind.isin("managed_challenge", "captcha", "access_denied"), "high")
            .otherwise("medium"),
            "manual_handoff": kind.isin("managed_challenge", "captcha", "login_required"),
            "js_shell": shell,
            "structured_data": (F.col("json_ld_count") > 0) | F.col("next_data") | F.col("nuxt_data"),
        }
    ).drop("_low", "_hits")


def access_decision(profile: DataFrame, authorized: bool = False) -> DataFrame:
    """What may be done with the address next, from its access profile."""
    status = F.col("status_code")
    challenged = F.col("challenge") != ""
    restricted = status.isin(401, 403)
    action = (
        F.when(challenged, "authorized_browser_review" if authorized else "manual_handoff")
        .when(status == 429, "backoff")
        .when(restricted, "authorized_session_required")
        .when(F.col("js_shell"), "browser_render")
        .otherwise("standard_http")
    )
    blocked = challenged | ((status != 429) & restricted)
    return profile.withColumns(
        {
            "access_action": action,
            "risk_level": F.when(blocked, "high").when(status == 429, "medium").otherwise("low"),
            "access_allowed": F.when(blocked, F.lit(authorized)).otherwise(True),
            "access_reason": F.when(challenged, F.concat(F.col("challenge_kind"), F.lit(":"), F.col("challenge")))
            .when(status == 429, "rate_limited:status:429")
            .when(restricted, F.concat(F.lit("restricted_status:"), status))
            .when(F.col("js_shell"), "js_rendering_likely_required")
            .otherwise("no_access_block_detected"),
        }
    )


def framework(html: Column) -> Column:
    low = F.lower(html)
    out = None
    for name, marks in rules.FRAMEWORKS:
        hit = urls.any_contains(low, marks)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def rendering(html: Column, text_chars: Column, script_count: Column) -> Column:
    low = F.lower(html)
    root = urls.any_contains(low, ('id="root"', 'id="app"'))
    return (
        F.when(urls.any_contains(low, ("__next_data__", "__nuxt__")), "ssr")
        .when(root & ((text_chars < 80) | ((text_chars < 500) & (script_count >= 5))), "spa")
        .otherwise("static")
    )


_CANDIDATE = r"(?s)<(?i:article|li)[\s>/]|<[A-Za-z][^>]*\sclass\s*=\s*(?:\"[^\"]*(?:product|item|card|title)|'[^']*(?:product|item|card|title))"


def quality_score(profile: DataFrame) -> DataFrame:
    """Additive page score with reasons; ``good_enough`` is the accept rule."""
    status = F.col("status_code")
    dom = H.without_scripts(F.coalesce(F.col("html"), F.lit(""))).rlike(_CANDIDATE)
    chars, words = F.col("html_chars"), F.col("text_chars")
    has_hints = F.size("api_hints") > 0
    challenged = F.col("challenge") != ""
    parts = [  # test, points, reason
        (status.between(200, 299), 25, F.lit("status_ok")),
        (status.isin(403, 429, 503), -25, F.concat(F.lit("block_status:"), status)),
        (~status.between(200, 299) & ~status.isin(403, 429, 503) & (status > 0), -10, F.concat(F.lit("status:"), status)),
        (chars >= 1000, 15, F.lit("html_size_ok")),
        ((chars > 0) & (chars < 1000), 3, F.lit("html_size_small")),
        (chars == 0, -40, F.lit("empty_html")),
        (words >= 500, 20, F.lit("text_content_ok")),
        ((words >= 80) & (words < 500), 8, F.lit("some_text")),
        (words < 80, -8, F.lit("low_text")),
        (F.col("is_json"), 35, F.lit("json_payload")),
        (dom, 12, F.lit("dom_candidates")),
        (F.col("structured_data"), 10, F.lit("structured_data")),
        (has_hints, 4, F.lit("api_hints")),
        (challenged, -80, F.concat(F.lit("challenge:"), F.col("challenge"))),
        (F.col("js_shell"), -20, F.lit("js_shell")),
    ]
    score = F.lit(0)
    for test, points, _ in parts:
        score = score + F.when(test, points).otherwise(0)
    scored = profile.withColumns(
        {"quality_score": score, "quality_reasons": F.array_join(_array_of(*[(t, r) for t, _, r in parts]), ",")}
    )
    s = F.col("quality_score")
    return scored.withColumn("good_enough", (F.col("is_json") & (s >= 45)) | ((s >= 60) & ~F.col("js_shell")))


def classify_pages(pages: DataFrame) -> DataFrame:
    """Table job: every page predicate, class and score as a column; body dropped."""
    scored = quality_score(access_decision(access_profile(pages)))
    findings = _array_of(
        (F.col("challenge") != "", F.concat(F.lit("challenge_detected:"), F.col("challenge"))),
        (F.col("js_shell"), F.lit("js_rendering_likely_required")),
        (F.col("structured_data"), F.lit("embedded_structured_data_available")),
        (F.size("api_hints") > 0, F.lit("possible_api_endpoints_found")),
    )
    h, status = F.coalesce(F.col("html"), F.lit("")), F.col("status_code")
    return scored.withColumns(
        {
            "is_bad": is_bad_page(h, status),
            "framework": framework(h),
            "rendering": rendering(h, F.col("text_chars"), F.col("script_count")),
            "findings": F.array_join(findings, ","),
            "api_hint_count": F.size("api_hints"),
            "failure_bucket": failure_bucket(F.lit(""), status, F.lit("")),
        }
    ).drop("html", "api_hints")
