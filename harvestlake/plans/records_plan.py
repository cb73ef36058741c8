"""Queries over product records, API payloads, menus and tasks."""

from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import urls
from harvestlake.operators import quality as Q
from harvestlake.operators import records as R
from harvestlake.plans import sqlx as S
from harvestlake.plans.registry import query

OF = ("offers",)

# ---------------------------------------------------------------- normalised offers
_SEP = "CASE WHEN contains(image_text, '|') THEN '|' ELSE ',' END"
_NOISE = S.has_any("lower(f)", rules.PRODUCT_IMAGE_NOISE)
_LV = "[trim(x) for x in regexp_split_to_array(category, '[>/|]') if trim(x) <> '']"
PROD = f"""
pr_a AS (SELECT *, [trim(x) for x in string_split(image_text, {_SEP}) if trim(x) <> ''] AS image_urls, {_LV} AS lv FROM offers),
pr_b AS (SELECT *, [f for f in [{S.product_abs('u', True)} for u in [{S.resolve('source_url', 'i')} for i in image_urls]] if f <> '' and not {_NOISE}] AS kept FROM pr_a),
pr_c AS (SELECT *, [{S.domain('f')} || lower({S.path('f')}) for f in kept] AS keys FROM pr_b),
prod AS (SELECT *, {S.price('price_text')} AS highest_price, {S.price('price_text', 'list_min')} AS lowest_price, {S.number_or_none('price_text')} AS number_price,
  {S.first_number('price_text')} AS first_price, try_cast(regexp_replace(replace(price_text, ',', '.'), '[^\\d.]', '', 'g') AS double) AS clean_price,
  try_cast(regexp_replace(price_text, '[^\\d.]', '', 'g') AS double) AS clean_score, {S.range_high('price_text')} AS range_high, {S.clean_text('description')} AS description_text,
  coalesce(lv[1], '') AS category_level_1, coalesce(lv[2], '') AS category_level_2, array_to_string(lv[3:], ' > ') AS category_level_3,
  [kept[i] for k, i in keys if list_position(keys, k) = i] AS images_clean,
  {S.dedupe_key('source_site', 'category', 'canonical_url', 'source_url', 'title')} AS dedupe_key FROM pr_c)"""
# the columns most queries need, without the image and text work
LEAN = f"""
prod AS (SELECT *, {S.price('price_text')} AS highest_price, [trim(x) for x in string_split(image_text, {_SEP}) if trim(x) <> ''] AS image_urls,
  {S.dedupe_key('source_site', 'category', 'canonical_url', 'source_url', 'title')} AS dedupe_key FROM offers)"""


def products(t):
    return R.normalize_products(t("offers"))


_NORM = ("dedupe_key", "highest_price", "lowest_price", "number_price", "first_price", "range_high", "clean_price", "clean_score", "description_text", "category_level_1", "category_level_2", "category_level_3")
query(
    "normalize_products",
    f"WITH {PROD} SELECT l_orderkey, l_linenumber, p_partkey, {', '.join(_NORM)}, array_to_string(image_urls, '|') AS image_urls, array_to_string(images_clean, '|') AS images_clean FROM prod",
    OF,
)(
    lambda t: products(t).select(
        "l_orderkey", "l_linenumber", "p_partkey", *_NORM, F.array_join("image_urls", "|").alias("image_urls"), F.array_join("images_clean", "|").alias("images_clean")
    )
)

_UP = ("run_id", "dedupe_key", "source_site", "canonical_url", "title", "status", "highest_price", "created_us", "updated_us", "writes")
_UPSERT = f"""{LEAN},
ups AS (SELECT * EXCLUDE (created_us), first_us AS created_us FROM (SELECT *, row_number() OVER (PARTITION BY run_id, dedupe_key ORDER BY created_us DESC, l_orderkey DESC, l_linenumber DESC) AS rn,
  min(created_us) OVER k AS first_us, max(created_us) OVER k AS updated_us, count(*) OVER k AS writes FROM prod WINDOW k AS (PARTITION BY run_id, dedupe_key)) x WHERE rn = 1)"""


def lean(t):
    keep = ("run_id", "dedupe_key", "source_site", "source_url", "canonical_url", "title", "category", "description", "currency", "status", "notes", "handle", "highest_price", "price_text", "image_urls", "created_us", "l_orderkey", "l_linenumber", "p_partkey")
    return products(t).select(*keep)


def upserted(t):
    slim = lean(t).select("run_id", "dedupe_key", "source_site", "canonical_url", "title", "status", "highest_price", "created_us", "l_orderkey", "l_linenumber")
    return R.upsert_latest(slim)


query("upsert_latest", f"WITH {_UPSERT} SELECT {', '.join(_UP)} FROM ups", OF)(lambda t: upserted(t).select(*_UP))
query(
    "upsert_counts",
    f"WITH {LEAN} SELECT run_id, count(DISTINCT dedupe_key) AS inserted, (count(*) - count(DISTINCT dedupe_key))::bigint AS updated, count(*) AS total FROM prod GROUP BY run_id",
    OF,
)(lambda t: R.upsert_counts(lean(t)))
query(
    "upsert_idempotent",
    f"WITH {_UPSERT} SELECT run_id, count(*) AS records, cast(sum(writes) * 2 AS bigint) AS writes FROM ups GROUP BY run_id",
    OF,
)(
    lambda t: R.upsert_into(lean(t).select("run_id", "dedupe_key", "title", *R.RECORD_ORDER), lean(t).select("run_id", "dedupe_key", "title", *R.RECORD_ORDER))
    .groupBy("run_id").agg(F.count("*").alias("records"), F.sum("writes").alias("writes"))
)
query(
    "first_seen_dedupe",
    """SELECT link, task_id, item_index, title, dropped FROM (
  SELECT *, count(*) OVER (PARTITION BY link) - 1 AS dropped, row_number() OVER (PARTITION BY link ORDER BY seen_us, task_id, item_index, l_suppkey, title) AS rn FROM task_items WHERE link <> '') x WHERE rn = 1""",
    ("task_items",),
)(
    lambda t: R.first_seen_dedupe(
        t("task_items").where("link <> ''").select("link", "task_id", "item_index", "title", "seen_us", "l_suppkey"), ("link",), ("seen_us", "task_id", "item_index", "l_suppkey", "title")
    ).select("link", "task_id", "item_index", "title", "dropped")
)
query(
    "lookup_record",
    f"WITH {_UPSERT} SELECT run_id, dedupe_key, title FROM ups WHERE (run_id, dedupe_key) IN (SELECT (run_id, dedupe_key) FROM prod WHERE status = 'blocked')",
    OF,
)(lambda t: R.lookup_record(upserted(t).select("run_id", "dedupe_key", "title"), lean(t).where("status = 'blocked'")))
query(
    "page_records",
    "SELECT run_id, source_url, created_us, l_orderkey, l_linenumber FROM offers ORDER BY created_us, l_orderkey, l_linenumber, p_partkey, run_id LIMIT 50 OFFSET 100",
    OF,
)(lambda t: R.page_records(t("offers"), 50, 100, (*R.RECORD_ORDER, "p_partkey", "run_id")).select("run_id", "source_url", "created_us", "l_orderkey", "l_linenumber"))

# ---------------------------------------------------------------- run quality
query(
    "run_stats",
    f"""WITH {LEAN} SELECT run_id, CASE WHEN grouping(status) = 1 THEN '*' ELSE status END AS status, CASE WHEN grouping(source_site) = 1 THEN '*' ELSE source_site END AS source_site,
  count(*) AS total, min(highest_price) AS price_min, max(highest_price) AS price_max, round(sum(cast(round(highest_price * 100) AS bigint))::double / count(highest_price) / 100, 2) AS price_avg
FROM prod GROUP BY GROUPING SETS ((run_id), (run_id, status), (run_id, source_site))""",
    OF,
)(lambda t: Q.run_stats(lean(t)))

FAILED = f"failed AS (SELECT run_id, count(DISTINCT source_url) AS failed_url_count FROM offers WHERE status = 'failed' GROUP BY run_id)"
_COMP = {
    "title": "title <> ''", "price": "highest_price IS NOT NULL", "highest_price": "highest_price IS NOT NULL", "category": "category <> ''",
    "description": "description <> ''", "image_urls": "len(image_urls) > 0", "colors": "false", "sizes": "false",
}
QUALITY = f"""{LEAN}, {FAILED},
qual AS (SELECT p.run_id, p.total_records, p.duplicate_count, coalesce(f.failed_url_count, 0) AS failed_url_count, round(p.duplicate_count / p.total_records, 4) AS duplicate_rate,
  {', '.join(f'r_{f}' for f in _COMP)} FROM (SELECT run_id, count(*) AS total_records, count(*) - count(DISTINCT dedupe_key) AS duplicate_count,
  {', '.join(f"round(count(*) FILTER ({c}) / count(*), 4) AS r_{f}" for f, c in _COMP.items())} FROM prod GROUP BY run_id) p LEFT JOIN failed f ON p.run_id = f.run_id)"""


def run_quality(t):
    rows = lean(t)
    return Q.run_quality(rows, rows.where("status = 'failed'").select("run_id", F.col("source_url").alias("url")))


query("run_quality", f"WITH {QUALITY} SELECT * FROM qual", OF)(run_quality)
query("duplicate_rate", f"WITH {QUALITY} SELECT run_id, duplicate_count, duplicate_rate FROM qual", OF)(
    lambda t: run_quality(t).select("run_id", "duplicate_count", "duplicate_rate")
)
query("field_completeness", f"WITH {QUALITY} " + " UNION ALL ".join(f"SELECT run_id, '{f}' AS field, r_{f} AS completeness FROM qual" for f in _COMP), OF)(
    lambda t: Q.field_completeness(run_quality(t))
)

POLICY = Q.GatePolicy.merged(
    {"min_items": 100, "max_duplicate_rate": 0.05}, {"mode": "enforce", "field_thresholds": {"highest_price": 0.6, "image": 0.9, "category": 0.9}}, required=("title",)
)
_CHECKS = f"""{QUALITY},
checks AS (SELECT run_id, 'min_items' AS "check", total_records >= 100 AS passed, 100.0::double AS expected, total_records::double AS actual FROM qual
  UNION ALL SELECT run_id, 'duplicate_rate', duplicate_rate <= 0.05::double, 0.05::double, duplicate_rate FROM qual
  UNION ALL SELECT run_id, 'failed_url_count', failed_url_count <= 0, 0.0::double, failed_url_count::double FROM qual
  {' '.join(f"UNION ALL SELECT run_id, 'field:{f}', r_{f} >= {th}::double, {th}::double, r_{f} FROM qual" for f, th in sorted(POLICY.thresholds.items()))})"""
query("quality_checks", f"""WITH {_CHECKS} SELECT *, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS severity FROM checks""", OF)(
    lambda t: Q.quality_checks(run_quality(t), POLICY)
)
query(
    "quality_summary_gate",
    f"""WITH {_CHECKS} SELECT run_id, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed_checks, CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS severity, NOT bool_and(passed) AS should_fail FROM checks GROUP BY run_id""",
    OF,
)(lambda t: Q.quality_summary_gate(run_quality(t), POLICY))


def _pct(x):
    return f"printf('%.2f%%', {x} * 100)"


_MEAN = "round((0.0::double + " + " + ".join(f"r_{f}" for f in _COMP) + ") / 8, 4)"
query(
    "run_quality_gate",
    f"""WITH {_CHECKS}, crit AS (SELECT run_id, count(*) FILTER (NOT passed) AS critical FROM checks GROUP BY run_id),
j AS (SELECT q.*, {_MEAN} AS field_coverage, coalesce(c.critical, 0) AS critical FROM qual q LEFT JOIN crit c ON q.run_id = c.run_id),
k AS (SELECT *, concat_ws('; ', CASE WHEN total_records < 100 THEN 'records=' || total_records || ' < min_records=100' END,
  CASE WHEN field_coverage < 0.9::double THEN 'field_coverage=' || {_pct('field_coverage')} || ' < min_coverage=90.00%' END,
  CASE WHEN critical > 1 THEN 'critical_failures=' || critical || ' > max=1' END,
  CASE WHEN duplicate_rate > 0.01::double THEN 'duplicate_rate=' || {_pct('duplicate_rate')} || ' > max=1.00%' END,
  CASE WHEN r_colors < 0.01::double THEN 'required fields missing: colors' END,
  CASE WHEN r_price < 0.95::double THEN 'field ''price'' coverage ' || {_pct('r_price')} || ' < threshold 95.00%' END) AS reasons FROM j)
SELECT run_id, total_records, field_coverage, critical, duplicate_rate, reasons = '' AS passed, reasons FROM k""",
    OF,
)(
    lambda t: Q.run_quality_gate(
        run_quality(t), Q.quality_checks(run_quality(t), POLICY), min_records=100, min_coverage=0.9, max_critical=1, max_duplicate_rate=0.01, required=("title", "colors"), thresholds={"price": 0.95}
    )
)
query(
    "field_gaps",
    f"""WITH {QUALITY} SELECT run_id, 'price' AS field, 'field_coverage' AS kind, r_price AS coverage FROM qual WHERE r_price < 0.8::double
UNION ALL SELECT run_id, 'image_urls', 'field_coverage', r_image_urls FROM qual WHERE r_image_urls < 0.8::double
UNION ALL SELECT run_id, 'colors', 'field_coverage', r_colors FROM qual WHERE r_colors < 0.8::double
UNION ALL SELECT run_id, 'material', 'missing_coverage_metric', NULL::double FROM qual""",
    OF,
)(lambda t: Q.field_gaps(run_quality(t), ("price", "image_urls", "colors", "material")))

# ---------------------------------------------------------------- issues
PROFILE = Q.QualityProfile(required=("url", "title", "price"), min_description=30, invalid_title=("404 not found",))
_USABLE = f"len([i for i in image_urls if not starts_with(i, 'data:') and not {S.has_any('lower(i)', rules.QUALITY_IMAGE_NOISE)}])"
ISSUES = f"""{LEAN},
iss_a AS (SELECT *, trim(description) AS d, status = 'partial' AS lenient, price_text <> '' AS given, {_USABLE} AS usable FROM prod),
issues AS (
  SELECT run_id, l_orderkey, l_linenumber, p_partkey, 'blocked_without_notes' AS code, 'warning' AS severity, 'notes' AS field FROM iss_a WHERE status = 'blocked' AND notes = ''
  {' '.join(f"UNION ALL SELECT run_id, l_orderkey, l_linenumber, p_partkey, '{code}', {sev}, '{fld}' FROM iss_a WHERE status <> 'blocked' AND ({cond})" for code, sev, fld, cond in (
      ('missing_url', "'error'", 'url', "canonical_url = '' AND source_url = ''"),
      ('missing_title', "CASE WHEN lenient THEN 'warning' ELSE 'error' END", 'title', "trim(title) = ''"),
      ('invalid_title', "'error'", 'title', "contains(lower(title), '404 not found')"),
      ('unparsable_price', "'error'", 'price', "given AND highest_price IS NULL"),
      ('negative_price', "'error'", 'price', "given AND highest_price < 0"),
      ('unparsable_price', "'error'", 'price', "NOT given AND NOT lenient"),
      ('data_image_url', "'info'", 'image_urls', "len([i for i in image_urls if starts_with(i, 'data:')]) > 0"),
      ('noise_only_images', "'warning'", 'image_urls', "len(image_urls) > 0 AND usable = 0 AND NOT lenient"),
      ('empty_images', "'warning'", 'image_urls', "len(image_urls) = 0 AND NOT lenient"),
      ('missing_body', "'info'", 'description', "d = '' AND NOT lenient"),
      ('short_body', "'warning'", 'description', "(d <> '' OR lenient) AND length(d) < 30"),
      ('missing_handle', "'info'", 'handle', "handle = ''"),
      ('missing_category', "'info'", 'category', "category = ''"),
  ))})"""


def issues(t):
    return Q.record_issues(lean(t), ("run_id", "l_orderkey", "l_linenumber", "p_partkey"), PROFILE)


query("record_issues", f"WITH {ISSUES} SELECT * FROM issues", OF)(issues)
query(
    "issue_counts",
    f"""WITH {ISSUES} SELECT run_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
  count(*) FILTER (severity = 'error') > 0 AS has_errors FROM issues GROUP BY run_id""",
    OF,
)(lambda t: Q.issue_counts(issues(t)))
query("issue_histogram", f"WITH {ISSUES} SELECT run_id, code, severity, count(*) AS issues FROM issues GROUP BY ALL", OF)(lambda t: Q.issue_histogram(issues(t)))
query(
    "required_field_check",
    """SELECT task_id, item_index, l_partkey, l_suppkey, problem = '' AS ok, problem FROM (SELECT *, CASE WHEN title IN ('', 'None') THEN 'title' WHEN price IS NULL OR price = 0 THEN 'price' WHEN image = '' THEN 'image_src' WHEN link = '' THEN 'handle' ELSE '' END AS problem FROM task_items) x""",
    ("task_items",),
)(
    lambda t: Q.required_field_check(
        t("task_items").withColumnsRenamed({"image": "image_src", "link": "handle"}), ("task_id", "item_index", "l_partkey", "l_suppkey")
    )
)
query(
    "item_validation",
    """
WITH tk AS (SELECT task_id, o_orderkey % 5 AS retries, CASE WHEN o_custkey % 3 = 0 THEN 'captcha' ELSE '' END AS challenge FROM jobs),
li AS (SELECT task_id, link, count(*) AS n FROM task_items WHERE link <> '' GROUP BY ALL),
ml AS (SELECT task_id, max(n) AS max_link FROM li GROUP BY task_id),
ag AS (SELECT task_id, count(*) AS n, count(*) FILTER (title <> '') AS ct, count(*) FILTER (price IS NOT NULL AND price <> 0) AS cp FROM task_items GROUP BY task_id),
j AS (SELECT tk.*, coalesce(n, 0) AS items, coalesce(ct, 0) AS ct, coalesce(cp, 0) AS cp, coalesce(max_link, 0) AS ml FROM tk LEFT JOIN ag ON tk.task_id = ag.task_id LEFT JOIN ml ON tk.task_id = ml.task_id),
k AS (SELECT *, CASE WHEN items > 0 THEN (ct + cp) / (items * 2) ELSE 0.0::double END AS comp, CASE WHEN items > 0 THEN ((ct > 0)::int + (cp > 0)::int) / 2 ELSE 0.0::double END AS conf FROM j),
l AS (SELECT *, concat_ws(',', CASE WHEN items = 0 THEN 'no_items' END, CASE WHEN items > 0 AND comp < 0.5::double THEN 'low_completeness' END, CASE WHEN items > 0 AND conf < 0.3::double THEN 'low_confidence' END,
  CASE WHEN items > 0 AND cp = 0 THEN 'no_prices' END, CASE WHEN ml > 1 THEN 'duplicate_links' END) AS anomalies FROM k),
m AS (SELECT *, CASE WHEN anomalies = '' AND comp >= 0.5::double THEN 'completed' WHEN retries < 3 THEN 'retrying' ELSE 'failed' END AS status FROM l)
SELECT task_id, items, round(comp, 4) AS completeness, round(conf, 4) AS confidence, anomalies, status,
  CASE WHEN status <> 'failed' THEN '' WHEN items = 0 AND challenge <> '' THEN 'ANTI_BOT_BLOCKED' WHEN items = 0 THEN 'EXTRACTION_EMPTY' ELSE 'VALIDATION_FAILED' END AS error_code FROM m""",
    ("jobs", "task_items"),
)(
    lambda t: Q.item_validation(
        t("jobs").select("task_id", (F.col("o_orderkey") % 5).alias("retries"), F.when(F.col("o_custkey") % 3 == 0, "captcha").otherwise("").alias("challenge")), t("task_items")
    )
)

# ---------------------------------------------------------------- fields and export
_MAP = {"name": "title", "price": "highest_price", "images": "image_urls", "l1": "category_level_1", "l2": "category_level_2", "l3": "category_level_3", "sizes": "sizes", "extra": "unknown_field"}
query(
    "export_rows",
    f"""WITH {LEAN}, lv AS (SELECT *, [x for x in string_split(category, '>') if trim(x) <> ''] AS parts FROM prod)
SELECT title AS name, highest_price AS price, array_to_string(image_urls, '; ') AS images, coalesce(parts[1], '') AS l1, coalesce(parts[2], '') AS l2, coalesce(parts[3], '') AS l3, '' AS sizes, '' AS extra FROM lv""",
    OF,
)(lambda t: R.export_rows(lean(t), {source: target for target, source in _MAP.items()}))
query("rename_fields", "SELECT p_partkey AS id, p_name AS title, p_retailprice AS highest_price, p_brand AS description, p_size AS sizes, p_type AS kind FROM part")(
    lambda t: R.rename_fields(
        t("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("Name"), F.col("p_retailprice").alias("价格"), F.col("p_brand").alias("desc"), F.col("p_size").alias("尺码"), F.col("p_type").alias("kind")
        )
    )
)

_ALIAS = "CASE " + " ".join(f"WHEN x IN {S.inlist(a)} THEN '{n}'" for n, a in rules.FIELD_ALIASES.items()) + " ELSE trim(regexp_replace(x, '[^a-z0-9_]+', '_', 'g'), '_') END"
_LABELS = "CASE p_partkey % 6 WHEN 0 THEN 'Price' WHEN 1 THEN '标题' WHEN 2 THEN ' Colour ' WHEN 3 THEN 'Brand Name!' WHEN 4 THEN 'link' ELSE 'p_type' END"
_REQ = f"req AS (SELECT DISTINCT task_id, field FROM (SELECT p_size AS task_id, {_ALIAS} AS field FROM (SELECT p_size, lower(trim({_LABELS})) AS x FROM part) a) b WHERE field <> '')"


def _requested(t):
    return t("part").selectExpr("p_size AS task_id", f"{_LABELS} AS label")


def _known(t):
    return t.spark.createDataFrame([("title",), ("highest_price",), ("canonical_url",)], "field string")


query(
    "resolve_fields",
    f"WITH {_REQ} SELECT task_id, field, CASE WHEN field IN ('title', 'highest_price', 'canonical_url') THEN 'resolved' ELSE 'missing' END AS state, CASE WHEN field IN ('title', 'highest_price', 'canonical_url') THEN 0.85::double ELSE 0.25::double END AS confidence FROM req",
)(lambda t: R.resolve_fields(_requested(t), _known(t)))
query(
    "field_diff",
    f"WITH {_REQ} SELECT DISTINCT p_size AS task_id, f.field FROM part, (VALUES ('title'), ('highest_price'), ('sizes')) f(field) WHERE (p_size, f.field) NOT IN (SELECT (task_id, field) FROM req)",
)(
    lambda t: R.field_diff(
        t("part").select(F.col("p_size").alias("task_id"), F.explode(F.array(F.lit("title"), F.lit("highest_price"), F.lit("sizes"))).alias("field")).distinct(),
        R.resolve_fields(_requested(t), _known(t)).select("task_id", "field"),
        ("task_id",),
    )
)

# ---------------------------------------------------------------- API payloads
AP = ("api_pages",)
API_ITEMS = """
api_a AS (SELECT job, page_key, fetched_us, url, cursor, payload, coalesce(nullif(json_extract(payload, '$.items[*]'), []), nullif(json_extract(payload, '$.data[*]'), []), json_extract(payload, '$.results[*]')) AS l FROM api_pages),
api_i AS (SELECT job, page_key, fetched_us, url, cursor, generate_subscripts(l, 1) - 1 AS item_no, unnest(l) AS item FROM api_a)"""


def api_items(t):
    return R.scan_api_payloads(t("api_pages"))


query("scan_api_payloads", f"WITH {API_ITEMS} SELECT job, page_key, item_no, coalesce(json_extract_string(item, '$.id'), '') AS item_id, coalesce(json_extract_string(item, '$.objectID'), '') AS object_id FROM api_i", AP)(
    lambda t: api_items(t).select(
        "job", "page_key", F.col("item_no").cast("bigint").alias("item_no"), F.coalesce(F.try_variant_get("item", "$.id", "string"), F.lit("")).alias("item_id"),
        F.coalesce(F.try_variant_get("item", "$.objectID", "string"), F.lit("")).alias("object_id"),
    )
)


def _jx(p):
    return f"nullif(json_extract_string(item, '$.{p}'), '')"


_ROW = f"""SELECT job, page_key, item_no, coalesce({_jx('title')}, {_jx('name')}, CASE WHEN json_extract(item, '$.title') IS NULL THEN {_jx('label')} END) AS title, coalesce({_jx('link')}, {_jx('url')}) AS link,
  json_extract_string(item, '$.image') AS image, coalesce(nullif({_jx('score')}, '0')) AS hot_score, NULL::varchar AS summary, coalesce(json_extract_string(item, '$.rank'), cast(item_no + 1 AS varchar)) AS rank,
  coalesce('url:' || {_jx('url')}, 'link:' || {_jx('link')}, 'objectID:' || {_jx('objectID')}, 'id:' || {_jx('id')}, 'title:' || coalesce({_jx('title')}, {_jx('label')}, '')) AS item_key FROM api_i"""
API_NORM = f"{API_ITEMS}, api_n AS (SELECT * FROM ({_ROW}) z WHERE coalesce(title, '') <> '')"
query("normalize_api_records", f"WITH {API_NORM} SELECT * FROM api_n", AP)(
    lambda t: R.normalize_api_records(api_items(t)).select("job", "page_key", F.col("item_no").cast("bigint").alias("item_no"), "title", "link", "image", "hot_score", "summary", "rank", "item_key")
)
_MAPPING = {"title": ["title", "name"], "highest_price": ["price", "cost.0.amount", "cost.1.amount"], "canonical_url": ["url", "link"], "image_urls": "image.src"}


def _jt(p):
    return f"nullif(trim(json_extract_string(item, '{p}')), '')"


query(
    "map_api_items",
    f"""WITH {API_ITEMS}, m AS (SELECT job, page_key, item_no, url, coalesce({_jt('$.title')}, {_jt('$.name')}) AS title, greatest({S.first_number("json_extract_string(item, '$.price')")}, {S.first_number("json_extract_string(item, '$.cost[0].amount')")}, {S.first_number("json_extract_string(item, '$.cost[1].amount')")}) AS highest_price,
  coalesce({_jt('$.url')}, {_jt('$.link')}) AS u, {_jt('$.image.src')} AS im FROM api_i)
SELECT job, page_key, item_no, title, highest_price, CASE WHEN u IS NOT NULL THEN {S.resolve('url', 'u')} ELSE url END AS canonical_url, CASE WHEN im IS NOT NULL THEN {S.resolve('url', 'im')} END AS image_url FROM m WHERE title IS NOT NULL""",
    AP,
)(lambda t: R.map_api_items(api_items(t), _MAPPING, "url").select("job", "page_key", F.col("item_no").cast("bigint").alias("item_no"), "title", "highest_price", "canonical_url", "image_url"))
_ALIAS_K = _ALIAS.replace("x IN", "lower(item_key) IN").replace("regexp_replace(x", "regexp_replace(lower(item_key)")
query(
    "infer_api_mapping",
    f"""WITH {API_ITEMS}, k AS (SELECT job, unnest(json_keys(item)) AS item_key FROM api_i), c AS (SELECT job, item_key, count(*) AS records, {_ALIAS_K} AS field FROM k GROUP BY ALL)
SELECT * FROM c WHERE field IN {S.inlist(rules.FIELD_ALIASES)}""",
    AP,
)(lambda t: R.infer_api_mapping(api_items(t), "job"))

# ---------------------------------------------------------------- menus
MENU = ("menus",)
MENU_NODES = """
m0 AS (SELECT menu_id, base_url, menu_json::json AS v FROM menus),
d1 AS (SELECT menu_id, base_url, unnest(json_keys(v)) AS k, v FROM m0 WHERE json_type(v) = 'OBJECT'),
d1v AS (SELECT menu_id, base_url, [k] AS path, k AS label, v -> ('$."' || k || '"') AS c FROM d1),
d2 AS (SELECT menu_id, base_url, list_append(path, k) AS path, k AS label, c -> ('$."' || k || '"') AS c FROM (SELECT menu_id, base_url, path, c, unnest(json_keys(c)) AS k FROM d1v WHERE json_type(c) = 'OBJECT') x),
d3 AS (SELECT menu_id, base_url, list_append(path, k) AS path, k AS label, c -> ('$."' || k || '"') AS c FROM (SELECT menu_id, base_url, path, c, unnest(json_keys(c)) AS k FROM d2 WHERE json_type(c) = 'OBJECT') x),
named AS (SELECT menu_id, base_url, path, label, CASE WHEN json_type(c) = 'OBJECT' THEN '' ELSE c ->> '$' END AS url FROM (SELECT * FROM d1v UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) y),
l1 AS (SELECT menu_id, base_url, []::varchar[] AS up, unnest(json_extract(v, '$[*]')) AS n FROM m0 WHERE json_type(v) = 'ARRAY'),
l1p AS (SELECT *, list_append(up, coalesce(n ->> '$.label', n ->> '$.name', n ->> '$.title')) AS path FROM l1),
l2p AS (SELECT *, list_append(up, coalesce(n ->> '$.label', n ->> '$.name', n ->> '$.title')) AS path FROM (SELECT menu_id, base_url, path AS up, unnest(json_extract(n, '$.children[*]')) AS n FROM l1p) x),
l3p AS (SELECT *, list_append(up, coalesce(n ->> '$.label', n ->> '$.name', n ->> '$.title')) AS path FROM (SELECT menu_id, base_url, path AS up, unnest(json_extract(n, '$.children[*]')) AS n FROM l2p) x),
listed AS (SELECT menu_id, base_url, path, path[-1] AS label, coalesce(n ->> '$.url', '') AS url FROM (SELECT * FROM l1p UNION ALL SELECT * FROM l2p UNION ALL SELECT * FROM l3p) y),
nodes AS (SELECT menu_id, base_url, label, url, array_to_string(path, ' > ') AS path, len(path)::int AS depth, path[1] AS level1, coalesce(path[2], '') AS level2, coalesce(path[3], '') AS level3,
  substr(sha1(array_to_string(path, ' > ') || '|' || url), 1, 16) AS node_id FROM (SELECT * FROM named UNION ALL SELECT * FROM listed) z)"""
query("scan_catalog_json", f"WITH {MENU_NODES} SELECT * FROM nodes", MENU)(lambda t: R.scan_catalog_json(t("menus")))
query("catalog_tree_stats", f"WITH {MENU_NODES} SELECT menu_id, count(*) AS nodes, count(*) FILTER (url <> '') AS leaves, max(depth) AS levels FROM nodes GROUP BY menu_id", MENU)(
    lambda t: R.catalog_tree_stats(R.scan_catalog_json(t("menus")))
)


def _enriched(t):
    nodes = R.scan_catalog_json(t("menus")).withColumn("full_url", F.when(F.col("url") != "", F.concat("base_url", "url")).otherwise(""))
    mine = nodes.select("menu_id", "path", "full_url", F.when(F.col("depth") == 1, "own").otherwise("").alias("uid"))
    found = nodes.where("menu_id % 2 = 1 OR depth > 1").select(
        F.upper("path").alias("path"), F.when(F.col("full_url") != "", F.concat("full_url", F.lit(".html"))).otherwise("").alias("full_url"),
        F.concat(F.lit("uid-"), "node_id").alias("uid"), F.col("menu_id").alias("ord"),
    )
    return R.enrich_catalog(mine, found)


def _uk(u):
    p = f"lower(trim({S.path(u)}, '/'))"
    return f"(CASE WHEN {S.netloc(u)} <> '' THEN rtrim({S.domain(u)} || '/' || regexp_replace({p}, '\\.html$', ''), '/') ELSE '' END)"


query(
    "enrich_catalog",
    f"""WITH {MENU_NODES}, n AS (SELECT menu_id, path, depth, node_id, CASE WHEN url <> '' THEN base_url || url ELSE '' END AS full_url, CASE WHEN depth = 1 THEN 'own' ELSE '' END AS uid FROM nodes),
f AS (SELECT lower(path) AS pk, CASE WHEN full_url <> '' THEN {_uk("(full_url || '.html')")} ELSE '' END AS uk, 'uid-' || node_id AS uid, menu_id AS ord FROM n WHERE menu_id % 2 = 1 OR depth > 1),
bu AS (SELECT uk, arg_min(uid, lpad(ord::varchar, 12, '0') || uid) AS uid FROM f WHERE uk <> '' GROUP BY uk), bp AS (SELECT pk, arg_min(uid, lpad(ord::varchar, 12, '0') || uid) AS uid FROM f GROUP BY pk)
SELECT n.menu_id, n.path, n.full_url, coalesce(nullif(n.uid, ''), bu.uid, bp.uid, '') AS uid FROM n LEFT JOIN bu ON {_uk('n.full_url')} = bu.uk LEFT JOIN bp ON lower(n.path) = bp.pk""",
    MENU,
)(_enriched)

# ---------------------------------------------------------------- tasks and logs
query(
    "task_with_items",
    "SELECT j.task_id, kind, status, item_index, title, link FROM jobs j JOIN task_items i ON j.task_id = i.task_id",
    ("jobs", "task_items"),
)(lambda t: R.task_with_items(t("jobs").select("task_id", "kind", "status"), t("task_items").select("task_id", "item_index", "title", "link")))


def _timeline(t):
    jobs, items = t("jobs"), t("task_items")
    created = jobs.select("task_id", F.col("created_us").alias("time_us"), F.lit("created").alias("type"), F.concat(F.lit("job created: "), "kind").alias("message"))
    status = jobs.where("status <> 'running'").select("task_id", (F.col("created_us") + 3600000000).alias("time_us"), F.lit("status").alias("type"), F.col("status").alias("message"))
    failures = items.where("price IS NULL").select("task_id", F.col("seen_us").alias("time_us"), F.lit("failure").alias("type"), F.concat(F.lit("no price: "), "title", F.lit(" #"), "l_partkey").alias("message"))
    return R.job_timeline((created, 0), (status, 0), (failures, 2))


query(
    "job_timeline",
    """SELECT task_id, created_us AS time_us, 'created' AS type, 'job created: ' || kind AS message FROM jobs
UNION ALL SELECT task_id, created_us + 3600000000, 'status', status FROM jobs WHERE status <> 'running'
UNION ALL SELECT task_id, seen_us, 'failure', message FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seen_us DESC, message) AS rn FROM
  (SELECT task_id, seen_us, 'no price: ' || title || ' #' || l_partkey AS message FROM task_items WHERE price IS NULL) a) b WHERE rn <= 2""",
    ("jobs", "task_items"),
)(_timeline)


def _red(x):
    return f"regexp_replace(regexp_replace({x}, {S.lit('(?i)' + rules.URL_SECRET)}, '[redacted_url]', 'g'), {S.lit('(?i)' + rules.KEY_VALUE_SECRET)}, '\\1=[redacted]', 'g')"


def _prev(x):
    for w in rules.PREVIEW_SECRETS:
        pattern = "(?i)(" + w + "[\"'\\s:=]+)[^\\n,;}\"]*"
        x = f"regexp_replace({x}, {S.lit(pattern)}, '\\1[REDACTED]', 'g')"
    return x


query(
    "redact_logs",
    f"""SELECT request_id AS id, error AS body, {_red('error')} AS body_safe, {_prev('error')} AS body_preview, error <> {_prev('error')} AS body_changed FROM fetch_log
UNION ALL SELECT -doc_id - 1, md5(text), md5({_red('text')}), md5({_prev('text')}), text <> {_prev('text')} FROM documents""",
    ("fetch_log",),
)(
    lambda t: R.redact_logs(t("fetch_log").select(F.col("request_id").alias("id"), F.col("error").alias("body")), ("body",)).unionByName(
        R.redact_logs(t("documents").select((-F.col("doc_id") - 1).alias("id"), F.col("text").alias("body")), ("body",)).withColumns(
            {c: F.md5(c) for c in ("body", "body_safe", "body_preview")}
        )
    )
)


def _header_rows(t):
    """Request headers of captured calls as maps, redacted, then exploded to rows."""
    from harvestlake.functions import text

    heads = F.create_map(F.lit("Cookie"), F.concat(F.lit("sid="), "k"), F.lit("Accept"), F.col("content_type"), F.lit("X-Api-Key"), F.lit("k1"))
    meta = F.create_map(F.lit("token"), F.col("page"), F.lit("proxy"), F.concat(F.lit("http://u:p@px"), "k", F.lit(":80/a")), F.lit("note"), F.concat(F.lit("see "), "url"), F.lit("storage_state_path"), F.lit("/a/b/state.json"))
    rows = t("captured_calls").select("call_id", text.redact_headers(heads).alias("h"), text.redact_map(meta).alias("m"))
    return rows.select("call_id", F.explode(F.map_concat("h", "m")).alias("name", "value"))


query(
    "redact_headers",
    """SELECT call_id, 'Cookie' AS name, '[redacted]' AS value FROM captured_calls UNION ALL SELECT call_id, 'Accept', content_type FROM captured_calls
UNION ALL SELECT call_id, 'X-Api-Key', '[redacted]' FROM captured_calls UNION ALL SELECT call_id, 'token', '[redacted]' FROM captured_calls
UNION ALL SELECT call_id, 'proxy', 'http://***:***@px' || k || ':80/a' FROM captured_calls UNION ALL SELECT call_id, 'note', 'see [redacted_url]' FROM captured_calls
UNION ALL SELECT call_id, 'storage_state_path', '[redacted-path]/state.json' FROM captured_calls""",
    ("captured_calls",),
)(_header_rows)


def _endpoints(t):
    from harvestlake.functions import text

    raw = F.concat(F.lit("http://user:pw@"), F.upper("domain"), F.lit(":80"), F.col("k") % 10, F.lit("/gate"))
    rows = t("fetch_log").select(raw.alias("proxy_url")).distinct()
    return rows.select("proxy_url", text.endpoint_id(F.col("proxy_url")).alias("endpoint_id"), text.redact_endpoint(F.col("proxy_url")).alias("label"))


query(
    "endpoint_id",
    """SELECT proxy_url, substr(sha256('http://' || host || '/gate'), 1, 16) AS endpoint_id, 'http://***:***@' || host || '/gate' AS label
FROM (SELECT DISTINCT 'http://user:pw@' || upper(domain) || ':80' || (k % 10) || '/gate' AS proxy_url, domain || ':80' || (k % 10) AS host FROM fetch_log) x""",
    ("fetch_log",),
)(_endpoints)


# ---------------------------------------------------------------- unions
def _discovered(t):
    from harvestlake.operators import links as L

    found = L.extract_links(t("product_pages")).select(F.col("link_url").alias("url"), "kind", (F.col("page_id") * 1000 + F.col("link_no")).alias("ord"))
    maps = L.scan_sitemap_xml(t("sitemaps")).select("url", "kind", (F.col("sitemap_id") * 1000 + F.col("loc_no")).alias("ord"))
    calls = t("captured_calls").where("k % 6 < 2").select("url", F.lit("api").alias("kind"), F.col("call_id").alias("ord"))
    return R.discovery_union(found, maps, calls).select("request_url", "kind", "source_no", "dropped")


def _discovered_sql():
    from harvestlake.plans import pages_plan as P

    links = P._links_sql("product_pages")
    maps = P._sitemap_sql
    return f"""
WITH lk AS ({links}), mp AS ({maps}),
every AS (SELECT link_url AS url, kind, 0 AS source_no, page_id * 1000 + link_no AS ord FROM lk UNION ALL SELECT url, kind, 1, sitemap_id * 1000 + loc_no FROM mp
  UNION ALL SELECT url, 'api', 2, call_id FROM captured_calls WHERE k % 6 < 2),
keyed AS (SELECT *, {S.request_form('url')} AS request_url FROM every)
SELECT request_url, kind, source_no, dropped FROM (SELECT *, count(*) OVER (PARTITION BY request_url) - 1 AS dropped, row_number() OVER (PARTITION BY request_url ORDER BY source_no, ord, url) AS rn FROM keyed) x WHERE rn = 1"""


query("discovery_union", _discovered_sql(), ("product_pages", "sitemaps", "captured_calls"))(_discovered)
