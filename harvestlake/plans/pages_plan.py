"""Queries over stored pages: scans, url forms, links, classification."""

from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import html as H
from harvestlake.functions import text, urls
from harvestlake.operators import links, pages
from harvestlake.plans import sqlx as S
from harvestlake.plans.registry import query

# ---------------------------------------------------------------- scans
query("scan_pages", "SELECT page_id, url, length(html) AS html_chars, md5(html) AS body_md5 FROM pages")(
    lambda t: t("pages").select("page_id", "url", F.length("html").alias("html_chars"), F.md5("html").alias("body_md5"))
)

_BAD = f"(status_code >= 500 OR length(html) < 600 OR {S.has_any('lower(html)', rules.BAD_PAGE_MARKERS)})"


query(
    "good_page_cache",
    f"SELECT md5('shop|' || url) AS cache_key, page_id, status_code, length(html) AS html_chars FROM product_pages WHERE NOT {_BAD}",
    ("product_pages",),
)(
    lambda t: pages.good_page_cache(t("product_pages"), "shop").select(
        "cache_key", "page_id", "status_code", F.length("html").alias("html_chars")
    )
)

_SITE_HOST = S.domain("sitemap_url")
_sitemap_sql = f"""
WITH locs AS (
  SELECT sitemap_id, sitemap_url, contains(xml, '<sitemapindex') AS idx, generate_subscripts(l, 1) AS pos, unnest(l) AS raw
  FROM (SELECT *, regexp_extract_all(xml, '<loc>\\s*([^<]+?)\\s*</loc>', 1) AS l FROM sitemaps) a),
res AS (SELECT sitemap_id, sitemap_url, idx, pos, {S.resolve('sitemap_url', 'raw')} AS u FROM locs),
kept AS (SELECT sitemap_id, sitemap_url, idx, min(pos) AS pos, d AS url
  FROM (SELECT *, {S.discovered_abs('u')} AS d FROM res) x
  WHERE d <> '' AND {S.domain('d')} = {_SITE_HOST} GROUP BY ALL)
SELECT sitemap_id, CASE WHEN idx THEN 'sitemap' ELSE 'page' END AS kind,
       row_number() OVER (PARTITION BY sitemap_id ORDER BY pos) - 1 AS loc_no, url
FROM (SELECT sitemap_id, idx, url, min(pos) AS pos FROM kept GROUP BY ALL) k"""
query(
    "scan_sitemap_xml",
    _sitemap_sql,
    ("sitemaps",),
)(lambda t: links.scan_sitemap_xml(t("sitemaps")).select("sitemap_id", "kind", F.col("loc_no").cast("bigint").alias("loc_no"), "url"))

# ---------------------------------------------------------------- url forms
_U = "url"
_FF = f"(CASE WHEN {S.is_web('trim(url)')} THEN {S.scheme(_U)} || '://' || {S.netloc(_U)} || {S.path(_U)} || {S.q(S.query(_U))} || (CASE WHEN {S.part(_U, 5)} = '' THEN '' ELSE '#' || {S.part(_U, 5)} END) ELSE '' END)"
_LAST = f"(list_filter(string_split({S.path(_U)}, '/'), lambda s: s <> '' AND NOT starts_with(s, ':')))"
_LABEL = f"(CASE WHEN len({_LAST}) > 0 THEN {_LAST}[-1] ELSE {S.netloc(_U)} END)"
_PAGENO = f"coalesce(try_cast([z.v for z in {S.pairs(S.query(_U))} if z.k = 'page' and z.v <> ''][1] AS integer), 1)"


def _urls_sql(source: str) -> str:
    label = S.squash(f"replace(regexp_replace(regexp_replace({_LABEL}, '[-_]+', ' ', 'g'), '(?i)\\.(html?|php|aspx?)$', ''), '%20', ' ')")
    nxt = (
        f"({S.scheme(_U)} || '://' || {S.netloc(_U)} || {S.nz(S.bare_path(_U))} || '?' || "
        + S.encode(
            f"(CASE WHEN list_contains([z.k for z in {S.pairs(S.query(_U))}], 'page') "
            f"THEN [{{'k': z.k, 'v': CASE WHEN z.k = 'page' THEN cast(page_no + 1 AS varchar) ELSE z.v END}} for z in {S.pairs(S.query(_U))}] "
            f"ELSE list_append({S.pairs(S.query(_U))}, {{'k': 'page', 'v': cast(page_no + 1 AS varchar)}}) END)"
        )
        + f" || (CASE WHEN {S.part(_U, 5)} = '' THEN '' ELSE '#' || {S.part(_U, 5)} END))"
    )
    return f"""
SELECT *, CASE WHEN frontier_form <> '' THEN sha256(frontier_form) END AS url_hash,
       substr(sha256('{{"data":null,"json":null,"method":"GET","url":"' || request_form || '"}}'), 1, 16) AS request_id,
       {nxt} AS next_page_url
FROM (SELECT {source.split()[0]} AS id, url, {_FF} AS frontier_form, {S.discovered_abs(_U)} AS discovered_form,
             {S.request_form(_U)} AS request_form, {S.product_abs(_U)} AS product_form,
             {S.product_abs(_U, True)} AS product_form_query, {S.domain(_U)} AS domain, {S.url_kind(_U)} AS url_kind,
             {_PAGENO} AS page_no, {label} AS label, {S.product_link(_U)} AS is_product,
             {S.catalog_url(_U)} AS is_catalog, {S.has_any('lower(url)', rules.TRACKING_PATTERNS)} AS is_tracking,
             ({S.ends_any(f'lower({S.path(_U)})', rules.ASSET_SUFFIXES)} OR {S.has_any(f'lower({S.path(_U)})', rules.ASSET_TOKENS)}) AS is_asset
      FROM {source.split()[1]}) x"""


query("canonicalize_urls", _urls_sql("page_id pages"))(
    lambda t: urls.canonicalize(t("pages").select(F.col("page_id").alias("id"), "url"))
)
query("canonicalize_call_urls", _urls_sql("call_id captured_calls"), ("captured_calls",))(
    lambda t: urls.canonicalize(t("captured_calls").select(F.col("call_id").alias("id"), "url"))
)

# ---------------------------------------------------------------- links
_HREFS = f"""
hrefs AS (SELECT page_id, url, generate_subscripts(l, 1) AS pos, unnest(l) AS tag
  FROM (SELECT page_id, url, {S.tags(S.without_scripts('html'), 'a')} AS l FROM {{src}}) a),
res AS (SELECT page_id, url, pos, {S.resolve('url', 'href')} AS u
  FROM (SELECT *, trim({S.unescape(S.attr('tag', 'href'))}) AS href FROM hrefs) h WHERE href <> ''),
disc AS (SELECT page_id, url, {S.domain('url')} AS host, pos, {S.discovered_abs('u')} AS d FROM res),
judged AS (SELECT *, CASE WHEN d = '' THEN 'invalid'
    WHEN NOT ({S.domain('d')} = host OR ends_with({S.domain('d')}, '.' || host)) THEN 'offsite'
    WHEN {S.ends_any(f"lower({S.path('d')})", rules.DENY_EXTENSIONS)} THEN 'ignored_extension' ELSE '' END AS reason FROM disc)"""


def _links_sql(src: str) -> str:
    return f"""
WITH {_HREFS.format(src=src)},
firsts AS (SELECT page_id, url AS parent_url, host, d AS link_url, min(pos) AS pos FROM judged WHERE reason = '' GROUP BY ALL)
SELECT page_id, parent_url, host, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS link_no, link_url,
       {S.url_kind('link_url')} AS kind, 1 AS depth FROM firsts"""


def _drops_sql(src: str) -> str:
    return f"""
WITH {_HREFS.format(src=src)},
outcome AS (SELECT host, CASE WHEN reason <> '' THEN reason
     WHEN row_number() OVER (PARTITION BY page_id, d ORDER BY pos) = 1 THEN 'kept' ELSE 'duplicate' END AS reason FROM judged)
SELECT host, reason, count(*) AS links FROM outcome GROUP BY ALL"""


def _links(t, src):
    out = links.extract_links(t(src))
    return out.drop("priority").withColumn("link_no", F.col("link_no").cast("bigint"))


query("extract_links", _links_sql("pages"))(lambda t: _links(t, "pages"))
query("extract_links_shop", _links_sql("product_pages"), ("product_pages",))(lambda t: _links(t, "product_pages"))
query("link_drop_stats", _drops_sql("pages"))(lambda t: links.link_drop_stats(t("pages")))
query("link_drop_stats_shop", _drops_sql("product_pages"), ("product_pages",))(lambda t: links.link_drop_stats(t("product_pages")))

_RULE = links.LinkRule(deny=(r"/sort", r"[?&]ref="), allow=(r"/products/", r"/api/", r"\.json"), deny_domains=("google-analytics.com",), classify={"special": r"/products/\d*7$"})


@query(
    "filter_links",
    f"""SELECT id, url, base_domain,
  CASE WHEN NOT {S.is_web('url')} THEN 'invalid'
       WHEN NOT ({S.domain('url')} = base_domain OR ends_with({S.domain('url')}, '.' || base_domain)) THEN 'offsite'
       WHEN {S.domain('url')} = 'google-analytics.com' OR ends_with({S.domain('url')}, '.google-analytics.com') THEN 'denied_domain'
       WHEN {S.ends_any(f"lower({S.path('url')})", rules.DENY_EXTENSIONS)} THEN 'ignored_extension'
       WHEN regexp_matches(url, '/sort') OR regexp_matches(url, '[?&]ref=') THEN 'denied_pattern'
       WHEN NOT (contains(url, '/products/') OR contains(url, '/api/') OR contains(url, '.json')) THEN 'not_allowed_pattern'
       ELSE '' END AS drop_reason,
  CASE WHEN regexp_matches(url, '/products/\\d*7$') THEN 'special' ELSE {S.url_kind('url')} END AS kind
FROM (SELECT call_id AS id, url, CASE WHEN k % 6 = 5 AND k % 4 = 1 THEN 'www.google-analytics.com' ELSE site || '.example.com' END AS base_domain FROM captured_calls
      UNION ALL SELECT l_orderkey * 10 + l_linenumber, source_url, source_site FROM offers) x""",
    ("captured_calls", "offers"),
)
def _filter_links(t):
    base = F.when((F.col("k") % 6 == 5) & (F.col("k") % 4 == 1), "www.google-analytics.com").otherwise(F.concat("site", F.lit(".example.com")))
    calls = t("captured_calls").select(F.col("call_id").alias("id"), "url", base.alias("base_domain"))
    offers = t("offers").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("source_url").alias("url"), F.col("source_site").alias("base_domain"))
    return links.filter_links(calls.unionByName(offers), _RULE)


# ---------------------------------------------------------------- classification
_LOW = "lower(html)"
_HITS = "[m for m in " + "[" + ", ".join("{'m': %s, 'k': %s, 'v': %s}" % (S.lit(m), S.lit(k), S.lit(v)) for m, k, v in rules.CHALLENGE_MARKERS) + "] if contains(low, m.m)]"
_DOM = r"(?s)<(?i:article|li)[\s>/]|<[A-Za-z][^>]*\sclass\s*=\s*(?:\"[^\"]*(?:product|item|card|title)|'[^']*(?:product|item|card|title))"
_FRAME = "CASE " + " ".join(f"WHEN {S.has_any('low', marks)} THEN '{n}'" for n, marks in rules.FRAMEWORKS) + " ELSE 'unknown' END"


def _classify_sql(src: str) -> str:
    return f"""
WITH a AS (SELECT *, lower(html) AS low, regexp_matches(html, '^\\s*[{{\\[]') AS is_json FROM {src}),
b AS (SELECT *, CASE WHEN is_json THEN [] ELSE {_HITS} END AS hits,
   {S.has_any('low', rules.LOGIN_MARKERS)} OR regexp_matches(low, {S.lit(rules.LOGIN_FORM)}) AS login FROM a),
c AS (SELECT *, NOT is_json AND len(hits) = 0 AND status_code = 429 AS limited, NOT is_json AND len(hits) = 0 AND status_code IN (401, 403) AND login AS gated FROM b),
d AS (SELECT *, CASE WHEN limited THEN 'rate_limited' WHEN gated THEN 'login_required' ELSE coalesce(hits[1].k, 'none') END AS challenge_kind,
   CASE WHEN limited OR gated THEN 'unknown' ELSE coalesce(hits[1].v, 'none') END AS challenge_vendor,
   CASE WHEN limited OR gated THEN 'status:' || status_code ELSE coalesce(hits[1].m, '') END AS challenge,
   CASE WHEN limited THEN 'status:429' WHEN gated THEN 'status:' || status_code || ',login_marker' ELSE array_to_string([h.m for h in hits], ',') END AS challenge_markers,
   length(html) AS html_chars, length({S.visible('html')}) AS text_chars, len(regexp_extract_all(html, '(?i)<script\\b')) AS script_count,
   len(regexp_extract_all({S.without_scripts('html')}, '(?is)<[a-z][^>]*\\s(?:id\\s*=\\s*["'']?(?:root|app)["''\\s>]|data-reactroot|ng-version)')) AS app_root_count,
   len(regexp_extract_all(html, '(?is)<script\\b[^>]*type\\s*=\\s*["'']application/ld\\+json["'']')) AS json_ld_count,
   regexp_matches(html, '(?is)<script\\b[^>]*id\\s*=\\s*["'']__NEXT_DATA__["'']') AS next_data,
   contains(low, '__nuxt__') OR contains(low, '__nuxt_data__') AS nuxt_data,
   len(list_distinct([u for u in regexp_extract_all(html, {S.lit('(?i)' + rules.API_HINT)}, 1)])) AS api_hint_count,
   regexp_matches({S.without_scripts('html')}, {S.lit(_DOM)}) AS dom FROM c),
e AS (SELECT *, challenge = '' AND ((text_chars < 500 AND script_count >= 5) OR (app_root_count > 0 AND text_chars < 1200)) AS js_shell,
   json_ld_count > 0 OR next_data OR nuxt_data AS structured_data, status_code IN (401, 403) AS restricted FROM d),
f AS (SELECT *, (CASE WHEN status_code BETWEEN 200 AND 299 THEN 25 WHEN status_code IN (403, 429, 503) THEN -25 ELSE -10 END)
   + (CASE WHEN html_chars >= 1000 THEN 15 WHEN html_chars > 0 THEN 3 ELSE -40 END)
   + (CASE WHEN text_chars >= 500 THEN 20 WHEN text_chars >= 80 THEN 8 ELSE -8 END)
   + (CASE WHEN is_json THEN 35 ELSE 0 END) + (CASE WHEN dom THEN 12 ELSE 0 END) + (CASE WHEN structured_data THEN 10 ELSE 0 END)
   + (CASE WHEN api_hint_count > 0 THEN 4 ELSE 0 END) - (CASE WHEN challenge <> '' THEN 80 ELSE 0 END) - (CASE WHEN js_shell THEN 20 ELSE 0 END) AS quality_score FROM e)
SELECT page_id, url, status_code, is_json, challenge_kind, challenge_vendor, challenge, challenge_markers, html_chars, text_chars, script_count,
  app_root_count, json_ld_count, next_data, nuxt_data, js_shell, structured_data, api_hint_count, quality_score,
  CASE WHEN challenge_kind = 'none' THEN 'low' WHEN challenge_kind IN ('managed_challenge', 'captcha', 'access_denied') THEN 'high' ELSE 'medium' END AS challenge_severity,
  challenge_kind IN ('managed_challenge', 'captcha', 'login_required') AS manual_handoff,
  CASE WHEN challenge <> '' THEN 'manual_handoff' WHEN status_code = 429 THEN 'backoff' WHEN restricted THEN 'authorized_session_required' WHEN js_shell THEN 'browser_render' ELSE 'standard_http' END AS access_action,
  CASE WHEN challenge <> '' OR restricted THEN 'high' WHEN status_code = 429 THEN 'medium' ELSE 'low' END AS risk_level,
  NOT (challenge <> '' OR restricted) AS access_allowed,
  CASE WHEN challenge <> '' THEN challenge_kind || ':' || challenge WHEN status_code = 429 THEN 'rate_limited:status:429' WHEN restricted THEN 'restricted_status:' || status_code WHEN js_shell THEN 'js_rendering_likely_required' ELSE 'no_access_block_detected' END AS access_reason,
  concat_ws(',', CASE WHEN status_code BETWEEN 200 AND 299 THEN 'status_ok' WHEN status_code IN (403, 429, 503) THEN 'block_status:' || status_code ELSE 'status:' || status_code END,
    CASE WHEN html_chars >= 1000 THEN 'html_size_ok' WHEN html_chars > 0 THEN 'html_size_small' ELSE 'empty_html' END,
    CASE WHEN text_chars >= 500 THEN 'text_content_ok' WHEN text_chars >= 80 THEN 'some_text' ELSE 'low_text' END,
    CASE WHEN is_json THEN 'json_payload' END, CASE WHEN dom THEN 'dom_candidates' END, CASE WHEN structured_data THEN 'structured_data' END,
    CASE WHEN api_hint_count > 0 THEN 'api_hints' END, CASE WHEN challenge <> '' THEN 'challenge:' || challenge END, CASE WHEN js_shell THEN 'js_shell' END) AS quality_reasons,
  (is_json AND quality_score >= 45) OR (quality_score >= 60 AND NOT js_shell) AS good_enough, {_BAD} AS is_bad, {_FRAME} AS framework,
  CASE WHEN contains(low, '__next_data__') OR contains(low, '__nuxt__') THEN 'ssr' WHEN (contains(low, 'id="root"') OR contains(low, 'id="app"')) AND (text_chars < 80 OR (text_chars < 500 AND script_count >= 5)) THEN 'spa' ELSE 'static' END AS rendering,
  concat_ws(',', CASE WHEN challenge <> '' THEN 'challenge_detected:' || challenge END, CASE WHEN js_shell THEN 'js_rendering_likely_required' END,
    CASE WHEN structured_data THEN 'embedded_structured_data_available' END, CASE WHEN api_hint_count > 0 THEN 'possible_api_endpoints_found' END) AS findings,
  CASE WHEN status_code IN (401, 403, 407, 429) THEN 'http_blocked' WHEN status_code >= 500 THEN 'server_error' ELSE 'unknown' END AS failure_bucket
FROM f"""


query("classify_pages", _classify_sql("product_pages"), ("product_pages",))(
    lambda t: pages.classify_pages(t("product_pages").drop("fetch_mode"))
)
query("classify_stored_pages", _classify_sql("(SELECT *, 200 AS status_code FROM pages)"))(
    lambda t: pages.classify_pages(t("pages").withColumn("status_code", F.lit(200)))
)

# ---------------------------------------------------------------- catalogue and paging
_ANCH = "regexp_extract_all({}, '(?is)(<a\\b[^>]*\\bhref\\b[^>]*>.*?</a\\s*>)', 1)"
_NAVS = "array_to_string(regexp_extract_all({}, '(?is)(<nav\\b[^>]*>.*?</nav\\s*>|<header\\b[^>]*>.*?</header\\s*>)', 1), ' ')"


def _catalog_sql(src: str) -> str:
    return f"""
WITH a AS (SELECT page_id, url, {S.without_scripts('html')} AS body FROM {src}),
b AS (SELECT page_id, url, {_ANCH.format('body')} AS all_links, {_ANCH.format(_NAVS.format('body'))} AS nav_links FROM a),
c AS (SELECT page_id, url, generate_subscripts(l, 1) AS pos, unnest(l) AS blk FROM (SELECT page_id, url, CASE WHEN len(nav_links) > 0 THEN nav_links ELSE all_links END AS l FROM b) x),
d AS (SELECT page_id, url, pos, {S.clean_text('blk')} AS label, trim({S.unescape(S.attr("regexp_extract(blk, '(?s)^<[^>]*>', 0)", 'href'))}) AS href FROM c),
e AS (SELECT page_id, pos, label, regexp_extract({S.resolve('url', 'href')}, '^[^#]*', 0) AS node_url FROM d WHERE label <> '' AND href <> ''),
f AS (SELECT page_id, node_url, min(pos) AS pos, arg_min(label, pos) AS label FROM e WHERE {S.catalog_url('node_url', 'label')} GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS node_no FROM f)
SELECT page_id, node_no, label, node_url, substr(sha1(label || '|' || node_url), 1, 16) AS node_id FROM g"""


def _catalog(t, src):
    return links.catalog_nodes(t(src)).withColumn("node_no", F.col("node_no").cast("bigint"))


query("catalog_nodes", _catalog_sql("product_pages"), ("product_pages",))(lambda t: _catalog(t, "product_pages"))
query("catalog_nodes_stored", _catalog_sql("pages"))(lambda t: _catalog(t, "pages"))

_P = "coalesce(try_cast([z.v for z in {} if z.k = 'page' and z.v <> ''][1] AS integer), NULL)"


def _set_page(u: str, n: str) -> str:
    ps = S.pairs(S.query(u))
    return (
        f"({S.scheme(u)} || '://' || {S.netloc(u)} || {S.nz(S.bare_path(u))} || '?' || "
        + S.encode(f"[{{'k': z.k, 'v': CASE WHEN z.k = 'page' THEN cast({n} AS varchar) ELSE z.v END}} for z in {ps}]")
        + f" || (CASE WHEN {S.part(u, 5)} = '' THEN '' ELSE '#' || {S.part(u, 5)} END))"
    )


def _next_sql(src: str) -> str:
    pager = (
        "array_to_string(regexp_extract_all(body, '(?is)<(?:nav|div|ul)\\b[^>]*\\bclass\\s*=\\s*[\"''][^\"'']*(?:pagination|pager|page-numbers)"
        "[^\"'']*[\"''][^>]*>.*?</(?:nav|div|ul)\\s*>'), ' ')"
    )
    rel = "(?is)<{}\\b[^>]*\\brel\\s*=\\s*[\"'']?next[\"''\\s>][^>]*>?"
    a_next = S.unescape(S.attr(f"regexp_extract(pager, '{rel.format('a')}', 0)", "href"))
    b_next = S.unescape(S.attr(f"regexp_extract(body, '{rel.format('a')}', 0)", "href"))
    l_next = S.unescape(S.attr(f"regexp_extract(body, '{rel.format('link')}', 0)", "href"))
    words = "(?i)^(next|>|>>|»|下一页.*|next\\s*page.*|suivant|volgende|weiter|siguiente)$"
    blocks = _ANCH.format("{}")

    def by_text(x):
        href = S.unescape(S.attr("regexp_extract(z, '(?s)^<[^>]*>', 0)", "href"))
        return f"[trim({href}) for z in {blocks.format(x)} if regexp_matches({S.clean_text('z')}, '{words}') and trim({href}) <> ''][1]"

    href_b = S.unescape(S.attr("regexp_extract(blk, '(?s)^<[^>]*>', 0)", "href"))
    here, there = _P.format(S.pairs(S.query("url"))), _P.format(S.pairs(S.query("nxt")))
    return f"""
WITH a AS (SELECT page_id, url, {S.without_scripts('html')} AS body FROM {src}),
b AS (SELECT *, {pager} AS pager FROM a),
c AS (SELECT *, coalesce(nullif({a_next}, ''), {by_text('pager')}, nullif({b_next}, ''), nullif({l_next}, ''), {by_text('body')}) AS href FROM b),
d AS (SELECT page_id, url, pager, CASE WHEN href IS NOT NULL THEN {S.resolve('url', 'href')} END AS nxt FROM c),
e AS (SELECT *, {here} AS here, {there} AS there FROM d),
steps AS (SELECT unnest(range(1, 10)) AS i),
nums AS (SELECT page_id, url, n, pos, {S.resolve('url', 'href')} AS u FROM (
   SELECT page_id, url, pos, try_cast(CASE WHEN regexp_matches({S.clean_text('blk')}, '^\\d{{1,9}}$') THEN {S.clean_text('blk')} END AS integer) AS n, trim({href_b}) AS href
   FROM (SELECT page_id, url, generate_subscripts(l, 1) AS pos, unnest(l) AS blk FROM (SELECT page_id, url, {blocks.format('pager')} AS l FROM e WHERE nxt IS NULL) q) w) v WHERE n IS NOT NULL AND href <> ''),
numbered AS (SELECT page_id, url, u, row_number() OVER (PARTITION BY page_id ORDER BY n, pos) AS o FROM nums WHERE n > 1),
found AS (
  SELECT page_id, url, 0 AS o, nxt AS next_url FROM e WHERE nxt IS NOT NULL
  UNION ALL SELECT page_id, url, i, {_set_page('nxt', 'there + i * (there - here)')} FROM e, steps WHERE nxt IS NOT NULL AND there > here
  UNION ALL SELECT page_id, url, o, u FROM numbered
  UNION ALL SELECT page_id, url, i, {_set_page('url', 'here + i')} FROM e, steps WHERE nxt IS NULL AND here IS NOT NULL AND page_id NOT IN (SELECT page_id FROM numbered))
SELECT page_id, url, next_url, row_number() OVER (PARTITION BY page_id ORDER BY min(o)) - 1 AS order_no FROM found GROUP BY page_id, url, next_url"""


def _next(t, src):
    return links.detect_next_pages(t(src)).withColumn("order_no", F.col("order_no").cast("bigint"))


query("detect_next_pages", _next_sql("product_pages"), ("product_pages",))(lambda t: _next(t, "product_pages"))
query("detect_next_pages_stored", _next_sql("pages"))(lambda t: _next(t, "pages"))
