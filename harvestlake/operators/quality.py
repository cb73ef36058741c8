"""Record quality: issues, completeness, gates, task validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import urls


@dataclass(frozen=True)
class QualityProfile:
    """Thresholds of the record checks."""

    required: tuple[str, ...] = ("url", "title")
    allow_partial: bool = True
    allow_missing_price: bool = False
    price_required: bool = True
    image_required: bool = True
    min_description: int = 0
    key_required: bool = False
    invalid_title: tuple[str, ...] = ()


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def record_issues(products: DataFrame, keys: tuple[str, ...], profile: QualityProfile = QualityProfile()) -> DataFrame:
    """One row per quality issue (code, severity, field) of each record."""
    need = set(profile.required)
    status = F.coalesce(F.col("status"), F.lit(""))
    blocked = status == "blocked"
    lenient = (status == "partial") & F.lit(profile.allow_partial)

    def level(strict: bool, otherwise: str) -> Column:
        return F.lit("error" if strict else otherwise)

    url = F.coalesce(F.nullif(_text("canonical_url"), F.lit("")), F.nullif(_text("source_url"), F.lit("")), F.lit(""))
    title, notes, description = _text("title"), _text("notes"), _text("description")
    given = F.coalesce(F.col("price_text"), F.lit("")) != ""
    price, images = F.col("highest_price"), F.coalesce(F.col("image_urls"), F.array().cast("array<string>"))
    is_data = lambda i: F.startswith(i, F.lit("data:"))
    usable = F.filter(images, lambda i: ~is_data(i) & ~urls.has_token(F.lower(i), rules.QUALITY_IMAGE_NOISE))
    price_fields, image_fields = bool({"price", "highest_price"} & need), bool({"image", "images", "image_url", "image_urls"} & need)
    bad_title = F.lit(False)
    for pattern in profile.invalid_title:
        bad_title = bad_title | title.rlike("(?i)" + pattern)
    price_level = F.when(lenient, level(price_fields, "info")).otherwise(level(price_fields, "warning"))
    checks = [
        (F.lit("url" in need) & (url == ""), "missing_url", F.lit("error"), "url"),
        (F.lit("title" in need) & (title == ""), "missing_title", F.when(lenient, "warning").otherwise("error"), "title"),
        ((title != "") & bad_title, "invalid_title", F.lit("error"), "title"),
        (given & price.isNull(), "unparsable_price", price_level, "price"),
        (given & (price < 0), "negative_price", F.lit("error"), "price"),
        (~given & F.lit(profile.price_required and not profile.allow_missing_price) & ~lenient, "unparsable_price", level(price_fields, "warning"), "price"),
        (F.exists(images, is_data), "data_image_url", F.lit("info"), "image_urls"),
        ((F.size(images) > 0) & (F.size(usable) == 0) & F.lit(profile.image_required) & ~lenient, "noise_only_images", level(image_fields, "warning"), "image_urls"),
        ((F.size(images) == 0) & F.lit(profile.image_required) & ~lenient, "empty_images", level(image_fields, "warning"), "image_urls"),
        ((description == "") & ~lenient, "missing_body", level("description" in need, "info"), "description"),
        (
            ((description != "") | lenient) & F.lit(profile.min_description > 0) & (F.length(description) < profile.min_description),
            "short_body", F.lit("warning"), "description",
        ),
        (_text("handle") == "", "missing_handle", F.lit("info"), "handle"),
        (_text("category") == "", "missing_category", level("category" in need, "info"), "category"),
        (_text("dedupe_key") == "", "missing_dedupe_key", F.lit("warning" if profile.key_required else "info"), "dedupe_key"),
    ]

    def issue(code: str, severity: Column, name: str) -> Column:
        return F.struct(F.lit(code).alias("code"), severity.alias("severity"), F.lit(name).alias("field"))

    found = [F.when(~blocked & test, issue(code, sev, name)) for test, code, sev, name in checks]
    found.append(F.when(blocked & (notes == ""), issue("blocked_without_notes", F.lit("warning"), "notes")))
    return products.select(*keys, F.inline(F.filter(F.array(*found), lambda i: i.isNotNull())))


def issue_counts(issues: DataFrame, by: str = "run_id") -> DataFrame:
    """Issues per severity and code, with the run's error flag."""
    return issues.groupBy(by).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        (F.count_if(F.col("severity") == "error") > 0).alias("has_errors"),
    )


def issue_histogram(issues: DataFrame, by: str = "run_id") -> DataFrame:
    return issues.groupBy(by, "code", "severity").agg(F.count("*").alias("issues"))


# ---------------------------------------------------------------- completeness
COMPLETENESS_FIELDS = ("title", "price", "highest_price", "category", "description", "image_urls", "colors", "sizes")


def _filled(records: DataFrame) -> dict[str, Column]:
    def of(name: str) -> Column:
        if name not in records.columns:
            return F.lit(False)
        if dict(records.dtypes)[name].startswith("array"):
            return F.size(name) > 0
        return F.coalesce(F.col(name), F.lit("")) != ""

    price = F.col("highest_price").isNotNull()
    return {f: price if f in ("price", "highest_price") else of(f) for f in COMPLETENESS_FIELDS}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(0.0))


def run_quality(records: DataFrame, failed: DataFrame | None = None, by: str = "run_id") -> DataFrame:
    """Per run: record total, duplicates, failed urls and one completeness column per field.

    Duplicates are counted over per-key partial results, so a hot run is never gathered.
    """
    filled = _filled(records)
    per_key = records.groupBy(by, "dedupe_key").agg(
        F.count("*").alias("n"), *[F.count_if(v).alias(f"c_{f}") for f, v in filled.items()]
    )
    has_key = F.coalesce(F.col("dedupe_key"), F.lit("")) != ""
    out = per_key.groupBy(by).agg(
        F.sum("n").alias("total_records"),
        F.sum(F.when(has_key, F.col("n") - 1).otherwise(0)).alias("duplicate_count"),
        *[F.sum(f"c_{f}").alias(f"c_{f}") for f in filled],
    )
    if failed is not None:
        out = out.join(failed.groupBy(by).agg(F.count_distinct("url").alias("failed_url_count")), by, "left").fillna(0, ["failed_url_count"])
    else:
        out = out.withColumn("failed_url_count", F.lit(0).cast("bigint"))
    return rates(out, by)


def rates(counts: DataFrame, by: str = "run_id") -> DataFrame:
    """Totals with their duplicate rate and one completeness column per field, from the counts of each."""
    total = F.col("total_records")
    return counts.select(
        by, "total_records", "duplicate_count", "failed_url_count", _share(F.col("duplicate_count"), total).alias("duplicate_rate"),
        *[_share(F.col(f"c_{f}"), total).alias(f"r_{f}") for f in COMPLETENESS_FIELDS],
    )


def field_completeness(quality: DataFrame, by: str = "run_id") -> DataFrame:
    """Long form of the completeness columns."""
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("completeness")) for f in COMPLETENESS_FIELDS]
    return quality.select(by, F.inline(F.array(*rows)))


@dataclass(frozen=True)
class GatePolicy:
    mode: str = "warn"
    min_items: int = 0
    max_duplicate_rate: float = 0.0
    max_failed_urls: int = 0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def merged(cls, *layers: dict, required=()) -> "GatePolicy":
        """Later layers win; required fields count as threshold 1, thresholds are clamped to 0..1."""
        rename = {"highest_price": "price", "image": "image_urls", "images": "image_urls", "image_url": "image_urls"}
        out: dict = {"thresholds": {rename.get(f, f): 1.0 for f in required}}
        for layer in layers:
            for f in layer.get("required_fields", ()):
                out["thresholds"][rename.get(f, f)] = 1.0
            for f, t in layer.get("field_thresholds", {}).items():
                out["thresholds"][rename.get(f, f)] = min(max(float(t), 0.0), 1.0)
            for key in ("min_items", "max_duplicate_rate", "max_failed_urls"):
                if layer.get(key) is not None:
                    out[key] = layer[key]
            if layer.get("mode"):
                out["mode"] = "fail" if layer["mode"] in ("fail", "hard_fail", "enforce") else "warn"
        return cls(**out)


def quality_checks(quality: DataFrame, policy: GatePolicy, by: str = "run_id") -> DataFrame:
    """One row per gate check of a run."""

    def check(name: str, passed: Column, expected: float, actual: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), passed.alias("passed"), F.lit(float(expected)).alias("expected"),
            actual.cast("double").alias("actual"), F.when(passed, "pass").otherwise(policy.mode).alias("severity"),
        )

    n, dup, bad = F.col("total_records"), F.col("duplicate_rate"), F.col("failed_url_count")
    rows = [
        check("min_items", n >= policy.min_items, policy.min_items, n),
        check("duplicate_rate", dup <= policy.max_duplicate_rate, policy.max_duplicate_rate, dup),
        check("failed_url_count", bad <= policy.max_failed_urls, policy.max_failed_urls, bad),
    ]
    for f, t in sorted(policy.thresholds.items()):
        actual = F.col(f"r_{f}") if f in COMPLETENESS_FIELDS else F.lit(0.0)
        rows.append(check(f"field:{f}", actual >= t, t, actual))
    return quality.select(by, F.inline(F.array(*rows)))


def quality_summary_gate(quality: DataFrame, policy: GatePolicy, by: str = "run_id") -> DataFrame:
    """Checks of each run folded to one verdict."""
    return quality_checks(quality, policy, by).groupBy(by).agg(
        F.every("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.max(F.when(F.col("passed"), "pass").otherwise(policy.mode) != "pass").alias("any_failed"),
    ).select(
        by, "passed", "failed_checks",
        F.when(F.col("passed"), "pass").otherwise(policy.mode).alias("severity"),
        (~F.col("passed") & F.lit(policy.mode == "fail")).alias("should_fail"),
    )


def _percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def run_quality_gate(
    quality: DataFrame,
    checks: DataFrame,
    min_records: int = 1,
    min_coverage: float = 0.0,
    max_critical: int = 0,
    max_duplicate_rate: float = 1.0,
    required: tuple[str, ...] = (),
    thresholds: dict[str, float] | None = None,
    by: str = "run_id",
) -> DataFrame:
    """Second gate of a run: volume, mean coverage, critical checks, duplicates, fields → reasons."""
    critical = checks.groupBy(by).agg(F.count_if(~F.col("passed") & (F.col("severity") == "fail")).alias("critical"))
    mean = sum((F.col(f"r_{f}") for f in COMPLETENESS_FIELDS), F.lit(0.0)) / len(COMPLETENESS_FIELDS)
    joined = quality.join(critical, by, "left").withColumns({"field_coverage": F.round(mean, 4), "critical": F.coalesce("critical", F.lit(0))})
    n, cov, crit, dup = (F.col(c) for c in ("total_records", "field_coverage", "critical", "duplicate_rate"))
    absent = [f for f in required]
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(f"r_{f}") < 0.01, f) for f in absent]), lambda x: x.isNotNull()), ", ") if absent else F.lit("")
    reasons = [
        F.when(n < min_records, F.concat(F.lit("records="), n, F.lit(f" < min_records={min_records}"))),
        F.when(cov < min_coverage, F.concat(F.lit("field_coverage="), _percent(cov), F.lit(f" < min_coverage={min_coverage:.2%}"))),
        F.when(crit > max_critical, F.concat(F.lit("critical_failures="), crit, F.lit(f" > max={max_critical}"))),
        F.when(dup > max_duplicate_rate, F.concat(F.lit("duplicate_rate="), _percent(dup), F.lit(f" > max={max_duplicate_rate:.2%}"))),
        F.when(missing != "", F.concat(F.lit("required fields missing: "), missing)),
    ]
    for f, t in (thresholds or {}).items():
        actual = F.col(f"r_{f}")
        reasons.append(F.when(actual < t, F.concat(F.lit(f"field '{f}' coverage "), _percent(actual), F.lit(f" < threshold {t:.2%}"))))
    kept = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return joined.select(
        by, "total_records", "field_coverage", "critical", "duplicate_rate", (F.size(kept) == 0).alias("passed"), F.array_join(kept, "; ").alias("reasons")
    )


def required_field_check(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Legacy gate of an item: first required column that holds no data."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "None")
    problem = (
        F.when(blank("title"), "title").when(F.col("price").isNull() | (F.col("price") == 0), "price").when(blank("image_src"), "image_src").when(blank("handle"), "handle")
    )
    return items.select(*keys, problem.isNull().alias("ok"), F.coalesce(problem, F.lit("")).alias("problem"))


def item_validation(
    tasks: DataFrame, items: DataFrame, target: tuple[str, ...] = ("title", "price"), max_retries: int = 3
) -> DataFrame:
    """Verdict per task: completeness, anomalies, retry state and error code.

    Links are first counted per (task, link), so duplicates are found without
    collecting a task's links.
    """
    filled = {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) != 0) if f == "price" else (F.coalesce(F.col(f), F.lit("")) != "") for f in target}
    per_link = items.groupBy("task_id", "link").agg(F.count("*").alias("n"), *[F.count_if(v).alias(f"c_{f}") for f, v in filled.items()])
    per_task = per_link.groupBy("task_id").agg(
        F.sum("n").alias("items"),
        F.max(F.when(F.coalesce(F.col("link"), F.lit("")) != "", F.col("n")).otherwise(0)).alias("max_link"),
        *[F.sum(f"c_{f}").alias(f"c_{f}") for f in target],
    )
    joined = tasks.join(per_task, "task_id", "left").fillna(0, ["items", "max_link", *[f"c_{f}" for f in target]])
    n = F.col("items")
    total = sum((F.col(f"c_{f}") for f in target), F.lit(0))
    some = sum((F.when(F.col(f"c_{f}") > 0, 1).otherwise(0) for f in target), F.lit(0))
    staged = joined.withColumns(
        {"_comp": F.coalesce(F.try_divide(total, n * len(target)), F.lit(0.0)), "_conf": F.when(n > 0, some / len(target)).otherwise(0.0)}
    )
    comp, conf = F.col("_comp"), F.col("_conf")
    no_prices = (F.col("c_price") == 0) if "price" in target else F.lit(False)
    anomalies = F.filter(
        F.array(
            F.when(n == 0, "no_items"),
            F.when((n > 0) & (comp < 0.5), "low_completeness"),
            F.when((n > 0) & (conf < 0.3), "low_confidence"),
            F.when((n > 0) & no_prices, "no_prices"),
            F.when(F.col("max_link") > 1, "duplicate_links"),
        ),
        lambda a: a.isNotNull(),
    )
    valid = (F.size(anomalies) == 0) & (comp >= 0.5)
    retry = ~valid & (F.col("retries") < max_retries)
    failed = ~valid & ~retry
    return staged.select(
        "task_id",
        n.alias("items"),
        F.round(comp, 4).alias("completeness"),
        F.round(conf, 4).alias("confidence"),
        F.array_join(anomalies, ",").alias("anomalies"),
        F.when(valid, "completed").when(retry, "retrying").otherwise("failed").alias("status"),
        F.when(failed & (n == 0) & (F.col("challenge") != ""), "ANTI_BOT_BLOCKED")
        .when(failed & (n == 0), "EXTRACTION_EMPTY")
        .when(failed, "VALIDATION_FAILED")
        .otherwise("")
        .alias("error_code"),
    )


def run_stats(products: DataFrame) -> DataFrame:
    """Per run: all records, by status and by site in one pass, with price range and mean.

    ``*`` stands for "all" in the grouping columns.  Prices are summed in whole cents so
    that the mean does not depend on the order in which partitions arrive.
    """
    cents = F.round(F.col("highest_price") * 100).cast("bigint")
    sets = [["run_id"], ["run_id", "status"], ["run_id", "source_site"]]
    grouped = products.withColumn("_cents", cents).groupingSets([[F.col(c) for c in s] for s in sets], "run_id", "status", "source_site")
    return grouped.agg(
        F.count("*").alias("total"),
        F.min("highest_price").alias("price_min"),
        F.max("highest_price").alias("price_max"),
        F.round(F.sum("_cents") / F.count("_cents") / 100, 2).alias("price_avg"),
        F.grouping("status").alias("_gs"),
        F.grouping("source_site").alias("_gw"),
    ).select(
        "run_id",
        F.when(F.col("_gs") == 1, "*").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_gw") == 1, "*").otherwise(F.col("source_site")).alias("source_site"),
        "total", "price_min", "price_max", "price_avg",
    )


def field_gaps(quality: DataFrame, selected: tuple[str, ...], by: str = "run_id") -> DataFrame:
    """Selected fields that are under 80 % complete or not measured, and runs without records."""
    gaps = []
    for f in selected:
        if f in COMPLETENESS_FIELDS:
            rate = F.col(f"r_{f}")
            gaps.append(F.when(rate < 0.8, F.struct(F.lit(f).alias("field"), F.lit("field_coverage").alias("kind"), rate.alias("coverage"))))
        else:
            gaps.append(F.struct(F.lit(f).alias("field"), F.lit("missing_coverage_metric").alias("kind"), F.lit(None).cast("double").alias("coverage")))
    gaps.append(F.when(F.col("total_records") == 0, F.struct(F.lit("").alias("field"), F.lit("zero_records").alias("kind"), F.lit(0.0).alias("coverage"))))
    return quality.select(by, F.inline(F.filter(F.array(*gaps), lambda g: g.isNotNull())))
