"""Queries over captured calls, evidence, scorecards and paged jobs."""

from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import urls
from harvestlake.operators import extract as X
from harvestlake.operators import oplog as O
from harvestlake.operators import pages as P
from harvestlake.operators import paging as PG
from harvestlake.operators import records as R
from harvestlake.operators import scoring as SC
from harvestlake.plans import extract_plan as EP
from harvestlake.plans import oplog_plan as OP
from harvestlake.plans import pages_plan as PP
from harvestlake.plans import records_plan as RP
from harvestlake.plans import sqlx as S
from harvestlake.plans.registry import query
from harvestlake.session import materialize

CC = ("captured_calls",)

# ---------------------------------------------------------------- captured calls
_GQL = "(contains(lower(url), 'graphql') OR contains(lower(post_data), 'graphql') OR coalesce(regexp_matches(trim(try_cast(nullif(post_data, '') AS json) ->> '$.query'), '^(query |mutation |subscription )'), false) OR coalesce(starts_with(trim(try_cast(nullif(post_data, '') AS json) ->> '$.query'), '{'), false) OR regexp_matches(trim(lower(post_data)), '^(query |mutation |subscription )'))"
_NET = f"""
net_a AS (SELECT *, {_GQL} AS gql, contains(content_type, 'application/json') OR json_preview <> '' AS js, resource_type IN ('xhr', 'fetch') AS xhr, {S.has_any('lower(url)', rules.CALL_KEYWORDS)} AS kw,
  {S.ends_any("split_part(lower(url), '?', 1)", rules.STATIC_SUFFIXES)} OR {S.has_any('content_type', rules.STATIC_TYPES)} AS static FROM captured_calls),
net AS (SELECT *, (CASE WHEN status_code BETWEEN 200 AND 299 THEN 10 WHEN status_code IN (401, 403, 429, 503) THEN -10 ELSE 0 END) + (CASE WHEN xhr THEN 18 ELSE 0 END) + (CASE WHEN js THEN 20 ELSE 0 END) + (CASE WHEN gql THEN 24 ELSE 0 END)
  + (CASE WHEN kw THEN 12 ELSE 0 END) + (CASE WHEN method = 'POST' THEN 4 ELSE 0 END) - (CASE WHEN static THEN 30 ELSE 0 END) AS score, CASE WHEN gql THEN 'graphql' WHEN js THEN 'json' ELSE 'other' END AS kind,
  concat_ws(',', CASE WHEN status_code BETWEEN 200 AND 299 THEN 'status_ok' WHEN status_code IN (401, 403, 429, 503) THEN 'blocked_or_limited:' || status_code END, CASE WHEN xhr THEN 'xhr_fetch' END, CASE WHEN js THEN 'json' END, CASE WHEN gql THEN 'graphql_signal' END,
  CASE WHEN kw THEN 'api_url_keywords' END, CASE WHEN method = 'POST' THEN 'post' END, CASE WHEN static THEN 'static_asset' END) AS reasons FROM net_a),
cand AS (SELECT * FROM (SELECT method, url, page, kind, score, status_code, call_id, count(*) OVER k AS seen, row_number() OVER (PARTITION BY method, url ORDER BY score DESC, call_id) AS rn FROM net WHERE score >= 20 AND NOT {S.has_any('lower(url)', rules.TRACKING_PATTERNS)} WINDOW k AS (PARTITION BY method, url)) x WHERE rn = 1)"""
query("network_entry_score", f"WITH {_NET} SELECT call_id, score, kind, reasons, score >= 10 OR xhr AS keep FROM net", CC)(lambda t: SC.network_entry_score(t("captured_calls")).select("call_id", "score", "kind", "reasons", "keep"))


def _candidates(t):
    return SC.network_candidates(SC.network_entry_score(t("captured_calls")))


query("network_candidates", f"WITH {_NET} SELECT method, url, page, kind, score, status_code, call_id, seen FROM cand", CC)(_candidates)
_ITEMS = "coalesce(" + ", ".join(f"nullif(json_extract(b, '$.{k}[*]'), [])" for k in rules.ITEM_LIST_KEYS) + ", [])"
query(
    "body_call_score",
    f"""WITH {_NET}, z AS (SELECT *, try_cast(nullif(json_preview, '') AS json) AS b FROM net), y AS (SELECT *, {_ITEMS} AS items, try_cast(nullif(post_data, '') AS json) IS NOT NULL AS pj, len([p for p in {S.pairs(S.query('url'))} if lower(p.k) IN {S.inlist((*rules.PAGE_KEYS, *rules.OFFSET_KEYS, *rules.LIMIT_KEYS, *rules.CURSOR_KEYS))}]) > 0 AS paged FROM z)
SELECT call_id, len(items)::int AS item_count, greatest(0, least(100, (CASE WHEN contains(content_type, 'json') THEN 25 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 22 ELSE 0 END) + (CASE WHEN len(items) > 0 THEN 25 ELSE 0 END)
 + (CASE WHEN len(items) > 0 AND (json_extract(items[1], '$.title') IS NOT NULL OR json_extract(items[1], '$.name') IS NOT NULL) THEN 18 ELSE 0 END) + (CASE WHEN {S.has_any('lower(url)', ('product', 'catalog', 'item', 'goods', 'search'))} THEN 12 ELSE 0 END)
 + (CASE WHEN paged THEN 8 ELSE 0 END) + (CASE WHEN method = 'POST' AND pj THEN 8 ELSE 0 END) + (CASE WHEN gql THEN 10 ELSE 0 END) - (CASE WHEN {S.has_any('lower(url)', rules.TRACKING_PATTERNS)} THEN 35 ELSE 0 END) - (CASE WHEN status_code NOT BETWEEN 200 AND 299 THEN 20 ELSE 0 END))) AS body_score FROM y""",
    CC,
)(lambda t: SC.body_call_score(t("captured_calls")).select("call_id", "item_count", "body_score"))

# the bodies of the table hold query, variables.timestamp and variables.sessionId, or no JSON
_NRM = "regexp_replace(lower(name), '[_-]', '', 'g')"
_PAR = f"""
par_q AS (SELECT call_id, site, 'query' AS location, p.k AS name, p.k AS path, p.v AS value FROM (SELECT call_id, site, unnest({S.pairs(S.query('url'))}) AS p FROM captured_calls) a WHERE p.k <> ''),
par_h AS (SELECT call_id, site, 'header', h.n, h.n, h.v FROM captured_calls, (VALUES ('Cookie', 'a=1'), ('X-Request-Id', 'r'), ('Accept', 'x')) h(n, v) WHERE k % 4 = 0 OR h.n = 'Accept'),
par_b AS (SELECT call_id, site, post_data::json AS b FROM captured_calls WHERE starts_with(post_data, '{{')),
par_j AS (SELECT call_id, site, 'json', 'query', 'query', b ->> '$.query' FROM par_b UNION ALL SELECT call_id, site, 'json', 'timestamp', 'variables.timestamp', b ->> '$.variables.timestamp' FROM par_b UNION ALL SELECT call_id, site, 'json', 'sessionId', 'variables.sessionId', b ->> '$.variables.sessionId' FROM par_b),
par_all AS (SELECT *, {_NRM} AS n FROM (SELECT * FROM par_q UNION ALL SELECT * FROM par_h UNION ALL SELECT * FROM par_j) z),
par AS (SELECT DISTINCT call_id, site, location, name, path, kind FROM (
  SELECT *, CASE WHEN n IN {S.inlist(rules.TIMESTAMP_NAMES)} OR regexp_matches(value, '^(\\d{{10}}|\\d{{13}})$') THEN 'timestamp' WHEN n IN {S.inlist(rules.NONCE_NAMES)} THEN 'nonce' END AS kind FROM par_all
  UNION ALL SELECT *, CASE WHEN n IN {S.inlist(rules.SIGNATURE_NAMES)} THEN 'signature' END FROM par_all UNION ALL SELECT *, CASE WHEN location = 'header' AND n IN {S.inlist(rules.SESSION_HEADERS)} THEN 'session' END FROM par_all) y WHERE kind IS NOT NULL)"""


def _with_headers(t):
    heads = F.when(F.col("k") % 4 == 0, F.create_map(F.lit("Cookie"), F.lit("a=1"), F.lit("X-Request-Id"), F.lit("r"), F.lit("Accept"), F.lit("x"))).otherwise(F.create_map(F.lit("Accept"), F.lit("x")))
    return t("captured_calls").withColumn("headers", heads)


query("request_params", f"WITH {_PAR} SELECT * FROM par", CC)(lambda t: SC.request_params(_with_headers(t), "headers"))
query(
    "request_param_profile",
    f"""WITH {_PAR}, c AS (SELECT call_id, count(*) FILTER (kind IN ('timestamp', 'nonce')) AS d, count(*) FILTER (kind = 'signature') AS s, count(*) FILTER (kind = 'session') AS r FROM par GROUP BY call_id),
j AS (SELECT cc.call_id, cc.site, coalesce(d, 0) AS dynamic_inputs, coalesce(s, 0) AS signed_components, coalesce(r, 0) AS session_requirements FROM captured_calls cc LEFT JOIN c ON cc.call_id = c.call_id)
SELECT *, CASE WHEN signed_components > 0 AND session_requirements > 0 THEN 'high' WHEN signed_components > 0 OR session_requirements > 0 THEN 'medium' WHEN dynamic_inputs > 0 THEN 'low' ELSE 'none' END AS risk_level, dynamic_inputs + signed_components + session_requirements > 0 AS replay_required FROM j""",
    CC,
)(lambda t: SC.request_param_profile(_with_headers(t), "headers"))


def _paging_calls(t):
    """Calls by page, so that pages differ in the paging style they show."""
    return t("captured_calls").withColumn("site", F.when(F.col("k") % 6 == 1, F.concat("page", F.lit("-o"))).when(F.col("k") % 6 == 2, F.concat("page", F.lit("-c"))).otherwise(F.col("page")))


_CLS = "CASE " + " ".join(f"WHEN lower(p.k) IN {S.inlist(k)} THEN '{n}'" for n, k in (("page", rules.PAGE_KEYS), ("offset", rules.OFFSET_KEYS), ("limit", rules.LIMIT_KEYS), ("cursor", rules.CURSOR_KEYS))) + " END"
query(
    "pagination_type_infer",
    f"""WITH a AS (SELECT CASE WHEN k % 6 = 1 THEN page || '-o' WHEN k % 6 = 2 THEN page || '-c' ELSE page END AS site, ts_us, call_id, {S.pairs(S.query('url'))} AS l FROM captured_calls),
b AS (SELECT site, ts_us, call_id, generate_subscripts(l, 1) AS pos, unnest(l) AS p FROM a), c AS (SELECT site, {_CLS} AS cls, p.k AS param, p.v AS value, row_number() OVER (PARTITION BY site, {_CLS} ORDER BY ts_us, call_id, pos) AS rn FROM b WHERE p.v <> ''),
f AS (SELECT site, max(param) FILTER (cls = 'page') AS pp, max(value) FILTER (cls = 'page') AS pv, max(param) FILTER (cls = 'offset') AS op, max(value) FILTER (cls = 'offset') AS ov, max(param) FILTER (cls = 'cursor') AS cp, max(param) FILTER (cls = 'limit') AS lp, max(value) FILTER (cls = 'limit') AS lv FROM c WHERE rn = 1 AND cls IS NOT NULL GROUP BY site)
SELECT site, CASE WHEN pp IS NOT NULL THEN 'page' WHEN op IS NOT NULL THEN 'offset' ELSE 'cursor' END AS pagination_type, coalesce(pp, op, cp) AS param, CASE WHEN pp IS NOT NULL THEN coalesce(try_cast(pv AS int), 1) WHEN op IS NOT NULL THEN coalesce(try_cast(ov AS int), 0) END AS start_value,
  coalesce(lp, '') AS size_param, try_cast(lv AS int) AS page_size, 'high' AS confidence FROM f WHERE coalesce(pp, op, cp) IS NOT NULL""",
    CC,
)(lambda t: SC.pagination_type_infer(_paging_calls(t)))


def _merged(t):
    observed = _candidates(t).withColumn("origin", F.lit("observed"))
    hints = t("captured_calls").where("resource_type <> 'image'").select(F.col("method"), "url", (F.col("k") % 90).alias("score"), F.lit("hint").alias("origin")).distinct()
    return R.merge_candidates(hints, observed)


query(
    "merge_candidates",
    f"""WITH {_NET}, u AS (SELECT DISTINCT method, url, k % 90 AS score, 'hint' AS origin, 0 AS src FROM captured_calls WHERE resource_type <> 'image' UNION ALL SELECT method, url, score, 'observed', 1 FROM cand)
SELECT method, url, score, origin FROM (SELECT *, row_number() OVER (PARTITION BY method, url ORDER BY score DESC, src) AS rn FROM u) x WHERE rn = 1""",
    CC,
)(lambda t: _merged(t).withColumn("score", F.col("score").cast("bigint")))

# ---------------------------------------------------------------- transports
_TR = f"""{PP._classify_sql('product_pages').strip()[4:].rsplit('SELECT page_id', 1)[0]},
att AS (SELECT url, fetch_mode, page_id, status_code, challenge, quality_score AS score, CASE WHEN fetch_mode = 'http' THEN '1.1' ELSE '2' END AS http_version, CASE WHEN page_id % 40 < 10 THEN 'nginx' ELSE 'Nginx-x' END AS server, CASE WHEN page_id % 50 = 7 THEN 'ray' ELSE '' END AS edge_header,
  CASE WHEN status_code = 503 THEN 'timeout' ELSE '' END AS error FROM f),
tr_a AS (SELECT url, count(*) AS attempts, count(DISTINCT status_code) AS st, count(*) FILTER (challenge <> '') AS ch, count(DISTINCT challenge) FILTER (challenge <> '') AS cd, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok, count(*) FILTER (status_code IN (403, 429, 503) OR challenge <> '') AS bl, max(score) - min(score) AS spread,
  count(DISTINCT http_version) AS hv, count(DISTINCT server) AS sv, count(*) FILTER (edge_header <> '') AS ed, count(*) FILTER (error <> '') AS er FROM att GROUP BY url),
tr AS (SELECT url, attempts, concat_ws(',', CASE WHEN st > 1 THEN 'status_differs_by_transport' END, CASE WHEN ch = 0 THEN NULL WHEN ch = attempts AND cd <= 1 THEN 'challenge_consistent_across_transports' ELSE 'challenge_differs_by_transport' END,
  CASE WHEN ok > 0 AND bl > 0 THEN 'some_transports_succeed_while_others_blocked' END, CASE WHEN spread >= 40 THEN 'quality_score_differs_by_transport' END, CASE WHEN hv > 1 THEN 'http_version_differs' END, CASE WHEN sv > 1 THEN 'server_header_differs' END,
  CASE WHEN ed > 0 AND ed <> attempts THEN 'edge_header_presence_differs' END, CASE WHEN er > 0 AND er <> attempts THEN 'transport_errors_are_mode_specific' END) AS findings FROM tr_a)"""


def classified(t):
    return P.classify_pages(t("product_pages"))


def seen(t):
    """The page classes that signals and findings read, classified once and written."""
    return materialize(classified(t).select("page_id", "url", "fetch_mode", "status_code", "challenge", "challenge_kind", "challenge_severity", "access_action", "js_shell", "quality_score"), "classified")


def _attempts(pages):
    n = F.col("page_id")
    return pages.select(
        "url", "fetch_mode", "page_id", "status_code", "challenge", F.col("quality_score").alias("score"), F.when(F.col("fetch_mode") == "http", "1.1").otherwise("2").alias("http_version"),
        F.when(n % 40 < 10, "nginx").otherwise("Nginx-x").alias("server"), F.when(n % 50 == 7, "ray").otherwise("").alias("edge_header"), F.when(F.col("status_code") == 503, "timeout").otherwise("").alias("error"),
    )


query("transport_differences", f"WITH {_TR} SELECT * FROM tr", ("product_pages",))(lambda t: SC.transport_differences(_attempts(classified(t))))

# ---------------------------------------------------------------- signals, scorecard, risk
EV = ("product_pages", "captured_calls", "frames")
_SIGW = " + ".join(f"contains(lower(url), {S.lit(w)})::int" for w in rules.SIGNING_WORDS)
_ENCW = " + ".join(f"contains(lower(url), {S.lit(w)})::int" for w in rules.ENCRYPTION_WORDS)
_CATL = ["signature", "encryption", "token", "challenge", "anti_bot", "fingerprint", "verification", "bundler"]
_SIGNALS = f"""{_TR}, {_NET.strip()}, {EP._SCRIPT_CTE.replace('{src}', 'product_pages').strip()},
topc AS (SELECT * FROM cand),
tc AS (SELECT *, {_SIGW} AS sg, len(list_distinct([p.k for p in {S.pairs(S.query('lower(url)'))} if p.k IN {S.inlist(rules.DYNAMIC_PARAMS)}])) AS dy, {_ENCW} AS en FROM topc),
sc_w AS (SELECT 'p' || page_id AS page, {' + '.join(f"max(list_contains([x.c for x in keywords], '{c}')::int)" for c in _CATL)} AS n, count(*) FILTER (score >= 50) AS strong,
  max(list_has_any([x.c for x in keywords], ['challenge', 'fingerprint', 'anti_bot'])) AS guard, max(list_has_any([x.c for x in keywords], ['token', 'crypto', 'encryption'])) AS tok FROM sc GROUP BY page_id),
fr AS (SELECT page, count(DISTINCT connection) AS c, count(*) AS n FROM frames GROUP BY page),
trp AS (SELECT 'p' || a.page_id AS page, findings, fetch_mode FROM att a JOIN tr ON a.url = tr.url),
dom AS (SELECT 'p' || page_id AS page, page_id % 4 AS n, page_id % 3 AS f FROM product_pages),
sig AS (
  SELECT page, CASE WHEN n >= 2 THEN 'dom_repeated_items' ELSE 'dom_partial_selectors' END AS code, 'dom' AS source, CASE WHEN n >= 2 AND f = 2 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN n >= 2 THEN least(85, 30 + n * 5 + f * 8) ELSE 25 END AS score, '' AS variant FROM dom WHERE n >= 2 OR f > 0
  UNION ALL SELECT page, CASE WHEN status_code IN (401, 403, 429, 503) THEN 'blocked_api_candidate' ELSE 'observed_api_candidate' END, 'api', CASE WHEN status_code IN (401, 403, 429, 503) THEN 'low' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END, greatest(score, CASE WHEN kind IN ('json', 'graphql') THEN 35 ELSE 20 END), '' FROM topc
  UNION ALL SELECT page, 'api_auth_token_hint', 'api', CASE WHEN sg >= 2 THEN 'high' ELSE 'medium' END, least(80, 40 + sg * 12), '' FROM tc WHERE sg > 0
  UNION ALL SELECT page, 'api_dynamic_input_hint', 'api', 'medium', least(65, 30 + dy * 10), '' FROM tc WHERE dy > 0
  UNION ALL SELECT page, 'api_encrypted_payload_hint', 'api', 'high', 70, '' FROM tc WHERE en > 0
  UNION ALL SELECT page, 'graphql_rate_limit', 'graphql', 'high', 75, '' FROM topc WHERE kind = 'graphql' AND status_code = 429
  UNION ALL SELECT 'p' || page_id, 'js_endpoint_strings', 'js', 'medium', least(75, 30 + count(DISTINCT e) * 4), '' FROM (SELECT page_id, unnest(endpoints) AS e FROM sc) q GROUP BY page_id
  UNION ALL SELECT page, 'js_keyword_categories', 'js', 'medium', least(70, 20 + n * 8 + strong * 10), concat_ws('+', CASE WHEN guard THEN 'guard' END, CASE WHEN tok THEN 'token' END) FROM sc_w WHERE n > 0
  UNION ALL SELECT 'p' || page_id, 'challenge_detected', 'access', 'high', 90, '' FROM f WHERE challenge <> ''
  UNION ALL SELECT 'p' || page_id, 'js_rendering_required', 'access', 'medium', 55, '' FROM f WHERE js_shell
  UNION ALL SELECT page, 'websocket_activity', 'websocket', 'medium', least(75, 35 + c * 10 + n), '' FROM fr
  UNION ALL SELECT page, CASE WHEN contains(findings, 'differs') OR contains(findings, 'some_transports') THEN 'transport_sensitive' ELSE 'transport_diagnostics' END, 'transport', CASE WHEN contains(findings, 'differs') OR contains(findings, 'some_transports') THEN 'high' ELSE 'low' END,
    CASE WHEN contains(findings, 'differs') OR contains(findings, 'some_transports') THEN 75 ELSE 25 END, CASE WHEN fetch_mode = 'browser' THEN 'browser' ELSE 'http' END FROM trp WHERE findings <> '')"""


def signals(t, pages=None):
    pages = seen(t) if pages is None else pages
    n = F.col("page_id")
    dom = t("product_pages").select(F.concat(F.lit("p"), n).alias("page"), (n % 4).alias("item_count"), (n % 3).alias("fields"), (n % 3 == 2).alias("has_title"), F.lit(False).alias("has_selector"))
    attempts = _attempts(pages)
    per_page = attempts.select(F.concat(F.lit("p"), n).alias("page"), "url", F.col("fetch_mode").alias("selected_mode")).join(SC.transport_differences(attempts), "url")
    return SC.evidence_signals(
        SC.dom_signals(dom), SC.api_signals(_candidates(t)), SC.script_signals(X.script_inventory(t("product_pages"))), SC.access_signals(pages),
        SC.frame_signals(O.frame_summary(t("frames"))), SC.transport_signals(per_page),
    )


query("evidence_signals", f"WITH {_SIGNALS} SELECT * FROM sig", EV)(signals)
_WV = "(VALUES " + ", ".join(f"('{r}', '{c}', {s}, {p}, {'NULL' if m is None else m})" for r, c, s, p, m in rules.STRATEGY_WEIGHTS) + ") w(rule, candidate, share, plus, at_least)"
_RISK = S.inlist(rules.SIGNING_RISK_CODES)
_WJ = f"""{_SIGNALS},
ru AS (SELECT page, code AS rule, score FROM sig UNION ALL SELECT page, code || ':' || unnest(string_split(variant, '+')), score FROM sig WHERE variant <> ''
  UNION ALL SELECT page, 'signing_risk', 0 FROM sig WHERE code IN {_RISK} AND score >= 50 GROUP BY page UNION ALL SELECT page, 'challenge_seen', 0 FROM sig WHERE code = 'challenge_detected' GROUP BY page UNION ALL SELECT page, 'strong_dom', 0 FROM sig WHERE code = 'dom_repeated_items' AND score >= 55 GROUP BY page),
wj AS (SELECT page, ru.rule, candidate, greatest(score * share + plus, coalesce(at_least, score * share + plus))::bigint AS points FROM ru JOIN {_WV} ON ru.rule = w.rule)"""
query("signal_weights_join", f"WITH {_WJ} SELECT * FROM wj WHERE rule NOT IN ('signing_risk', 'challenge_seen', 'strong_dom')", EV)(
    lambda t: SC.signal_weights_join(signals(t), SC.strategy_weights(t.spark)).select("page", "rule", "candidate", F.col("points").cast("bigint").alias("points"))
)
_ORD = "CASE candidate " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(SC.CANDIDATES)) + " END"
_CARD = f"""{_WJ},
pg AS (SELECT DISTINCT page FROM sig), cl AS (SELECT page, candidate FROM pg, (VALUES {', '.join(f"('{c}')" for c in SC.CANDIDATES)}) v(candidate)),
ca AS (SELECT cl.page, cl.candidate, greatest(0, coalesce(sum(points), 0))::bigint AS score FROM cl LEFT JOIN wj ON cl.page = wj.page AND cl.candidate = wj.candidate GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, {_ORD}) AS r, row_number() OVER (PARTITION BY page, candidate IN ('http', 'api_intercept', 'browser') ORDER BY score DESC, {_ORD}) AS re FROM ca),
gd AS (SELECT page, bool_or(code = 'blocked_api_candidate') AS g1, bool_or(code = 'fingerprint_runtime_risk') AS g2, bool_or(code IN {_RISK} AND score >= 50) AS g3, bool_or(code = 'challenge_detected') AS g4, bool_or(code = 'dom_repeated_items' AND score >= 55) AS g5 FROM sig GROUP BY page),
wide AS (SELECT page, {', '.join(f"max(score) FILTER (candidate = '{c}') AS score_{c}" for c in SC.CANDIDATES)}, max(candidate) FILTER (r = 1) AS recommended, max(candidate) FILTER (re = 1 AND candidate IN ('http', 'api_intercept', 'browser')) AS executable, max(score) FILTER (r = 1) AS t1, max(score) FILTER (r = 2) AS t2 FROM rk GROUP BY page),
card AS (SELECT wide.* EXCLUDE (t1, t2), CASE WHEN t1 >= 80 AND t1 - t2 >= 25 THEN 'high' WHEN t1 >= 50 THEN 'medium' ELSE 'low' END AS confidence, concat_ws(',', 'evidence_only_no_bypass', CASE WHEN g1 THEN 'blocked_api_candidate_penalty' END, CASE WHEN g2 THEN 'fingerprint_risk_requires_profile_review' END,
  CASE WHEN g3 THEN 'crypto_requires_runtime_inputs' END, CASE WHEN g4 THEN 'challenge_blocks_api_replay' END, CASE WHEN g5 THEN 'good_dom_preserved' END) AS guardrails FROM wide JOIN gd ON wide.page = gd.page)"""
query("strategy_scorecard", f"WITH {_CARD} SELECT * FROM card", EV)(lambda t: SC.strategy_scorecard(signals(t), SC.strategy_weights(t.spark)))
_ACT = PP._classify_sql("product_pages").strip()[4:]
_SEVW = "CASE severity WHEN 'critical' THEN 65 WHEN 'high' THEN 42 WHEN 'medium' THEN 24 ELSE 8 END"
_FIND = f"""{_SIGNALS},
fin AS (
  SELECT 'p' || page_id AS page, 'access_' || challenge_kind AS code, 'challenge' AS category, CASE WHEN challenge_kind IN ('managed_challenge', 'captcha', 'access_denied') THEN 'high' ELSE 'medium' END AS severity, 'access_diagnostics' AS source FROM f WHERE challenge <> ''
  UNION ALL SELECT 'p' || page_id, 'access_decision_' || CASE WHEN challenge <> '' THEN 'manual_handoff' ELSE 'backoff' END, 'access_policy', CASE WHEN challenge <> '' THEN 'high' ELSE 'medium' END, 'access_policy' FROM f WHERE challenge <> '' OR status_code = 429
  UNION ALL SELECT 'p' || page_id, 'http_429_rate_limited', 'rate_limit', 'medium', 'fetch' FROM f WHERE status_code = 429
  UNION ALL SELECT page, 'blocked_api_candidates', 'api_block', 'medium', 'api_candidates' FROM sig WHERE code = 'blocked_api_candidate'
  UNION ALL SELECT page, 'transport_sensitive_access', 'transport', CASE WHEN code = 'transport_sensitive' THEN 'medium' ELSE 'low' END, 'transport_diagnostics' FROM sig WHERE code IN ('transport_sensitive', 'transport_diagnostics')
  UNION ALL SELECT page, 'js_anti_bot_clues', 'js_challenge', 'medium', 'js_evidence' FROM sig WHERE code = 'js_keyword_categories' AND contains(variant, 'guard')
  UNION ALL SELECT page, 'js_signature_or_encryption_flow', 'crypto_signature', 'high', 'js_crypto_evidence' FROM sig WHERE code IN {_RISK}
  UNION ALL SELECT page, 'websocket_runtime_dependency', 'runtime_protocol', 'medium', 'websocket_summary' FROM sig WHERE code = 'websocket_activity'),
fd AS (SELECT page, code, source, arg_max(category, w) AS category, arg_max(severity, w) AS severity, max(w) AS w FROM (SELECT *, {_SEVW} AS w FROM fin) x GROUP BY page, code, source)"""


def _findings(t):
    pages = seen(t)
    return SC.page_findings(pages, signals(t, pages))


query("page_findings", f"WITH {_FIND} SELECT page, code, category, severity, source FROM fin", EV)(_findings)
query(
    "page_risk_report",
    f"""WITH {_FIND}, ag AS (SELECT page, count(*) AS findings, least(100, sum(w))::int AS risk_score, bool_or(severity = 'critical') AS c, bool_or(severity = 'high') AS h, bool_or(severity = 'medium') AS m, bool_or(contains(code, 'captcha') OR code = 'access_managed_challenge') AS ho, bool_or(code = 'access_login_required') AS lo,
  bool_or(category = 'rate_limit') AS li, bool_or(category = 'crypto_signature') AS sg, bool_or(category IN ('fingerprint', 'transport', 'runtime_protocol')) AS pr FROM fd GROUP BY page),
lv AS (SELECT *, CASE WHEN c OR risk_score >= 90 THEN 'critical' WHEN h OR risk_score >= 55 THEN 'high' WHEN m OR risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_level FROM ag),
tp AS (SELECT page, string_agg(code, ',' ORDER BY rn) AS top_findings FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w DESC, code, source) AS rn FROM fd) z WHERE rn <= 3 GROUP BY page)
SELECT lv.page, findings, risk_score, risk_level, CASE WHEN ho THEN 'manual_handoff' WHEN lo THEN 'authorized_session_review' WHEN li THEN 'backoff' WHEN sg THEN 'deeper_recon' WHEN pr THEN 'browser_render_or_profile_review' WHEN risk_level IN ('high', 'critical') THEN 'manual_handoff' ELSE 'standard_http' END AS action, top_findings FROM lv JOIN tp ON lv.page = tp.page""",
    EV,
)(lambda t: SC.page_risk_report(_findings(t)))


# ---------------------------------------------------------------- selectors, rules, evidence
def _selectors(t):
    m = O.selector_memory(OP._selector_events(t))
    cands = m.select(F.col("site_key").alias("site"), "name", F.concat("selector", F.lit("@"), "attribute").alias("selector"), F.col("last_score").alias("score"))
    gaps = m.select(F.col("site_key").alias("site")).distinct().select("site", F.explode(F.array(*map(F.lit, ("title", "highest_price", "image_urls", "sizes")))).alias("field"))
    return SC.selector_candidates(gaps, cands)


query(
    "selector_candidates",
    f"""WITH {OP._SELM}, c AS (SELECT site_key AS site, name AS candidate, selector || '@' || attribute AS selector, last_score AS raw FROM sm), g AS (SELECT DISTINCT site_key AS site, f.field FROM sm, (VALUES ('title'), ('highest_price'), ('image_urls'), ('sizes')) f(field)),
j AS (SELECT g.site, g.field, candidate, selector, round(CASE WHEN candidate = g.field THEN raw ELSE raw * 0.8::double END, 6) AS score FROM g JOIN c ON g.site = c.site WHERE contains(candidate, g.field) OR contains(g.field, candidate))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, field ORDER BY score DESC, candidate, selector) AS rank FROM j) x WHERE rank <= 5""",
    ("fetch_log",),
)(lambda t: _selectors(t).withColumn("rank", F.col("rank").cast("bigint")))


def _ruled(t):
    sup = t("supplier").select(F.expr("replace(lower(s_name), '#', '')").alias("site"), "s_nationkey")
    rule = lambda p, k, n: F.struct(p.alias("pattern"), F.lit(k).alias("kind"), F.lit(n).alias("priority"))
    site_rules = sup.select("site", F.array(rule(F.concat(F.lit("/products/"), F.col("s_nationkey"), F.lit(r"\d*\?")), "own", 9), rule(F.lit(r"ref=[01]$"), "referred", 5)).alias("rules"))
    rows = t("offers").select("l_orderkey", "l_linenumber", "p_partkey", F.col("source_site").alias("site"), F.col("source_url").alias("url"))
    return SC.apply_site_rules(rows, site_rules)


query(
    "rules_broadcast",
    """SELECT l_orderkey, l_linenumber, p_partkey, source_site AS site, source_url AS url, CASE WHEN regexp_matches(source_url, '/products/' || s_nationkey || '\\d*\\?') THEN 'own' WHEN regexp_matches(source_url, 'ref=[01]$') THEN 'referred' ELSE 'page' END AS kind,
  CASE WHEN regexp_matches(source_url, '/products/' || s_nationkey || '\\d*\\?') THEN 9 WHEN regexp_matches(source_url, 'ref=[01]$') THEN 5 ELSE 0 END AS priority FROM offers JOIN supplier ON source_site = replace(lower(s_name), '#', '')""",
    ("offers",),
)(_ruled)


def _evidence(t):
    log = t("fetch_log")
    agg = lambda df, *extra: df.groupBy(F.col("domain").alias("site")).agg(F.max("mode").alias("mode"), F.max("status_code").alias("status"), F.min("run_id").alias("r0"), F.max("run_id").alias("r1"))
    shape = lambda df, tag: df.select(
        "site", F.create_map(F.lit("mode"), F.col("mode"), F.lit(f"only_{tag}"), F.lit("1"), F.lit("status"), F.col("status").cast("string")).alias("facts"),
        F.create_map(F.lit("runs"), F.array("r0", "r1"), F.lit(f"list_{tag}"), F.array("mode")).alias("lists"),
    )
    merged = SC.merge_evidence(shape(agg(log.where("ok")), "a"), shape(agg(log.where("NOT ok AND k < 50")), "b"))
    facts = merged.select("site", F.explode("facts").alias("key", "value"))
    lists = merged.select("site", F.explode("lists").alias("key", "l")).select("site", "key", F.array_join(F.array_sort("l"), ",").alias("value"))
    notes = merged.select("site", F.lit("conflicts").alias("key"), F.array_join("conflicts", ",").alias("value"))
    return facts.unionByName(lists).unionByName(notes)


query(
    "merge_evidence",
    """WITH a AS (SELECT domain AS site, max(mode) AS mode, max(status_code)::varchar AS status, min(run_id) AS r0, max(run_id) AS r1 FROM fetch_log WHERE ok GROUP BY domain), b AS (SELECT domain AS site, max(mode) AS mode, max(status_code)::varchar AS status, min(run_id) AS r0, max(run_id) AS r1 FROM fetch_log WHERE NOT ok AND k < 50 GROUP BY domain),
j AS (SELECT coalesce(a.site, b.site) AS site, a.mode AS am, b.mode AS bm, a.status AS st, b.status AS bs, a.r0, a.r1, b.r0 AS b0, b.r1 AS b1, a.site IS NOT NULL AS ia, b.site IS NOT NULL AS ib FROM a FULL JOIN b ON a.site = b.site)
SELECT site, 'mode' AS key, coalesce(bm, am) AS value FROM j UNION ALL SELECT site, 'status', coalesce(bs, st) FROM j UNION ALL SELECT site, 'only_a', '1' FROM j WHERE ia UNION ALL SELECT site, 'only_b', '1' FROM j WHERE ib
UNION ALL SELECT site, 'list_a', am FROM j WHERE ia UNION ALL SELECT site, 'list_b', bm FROM j WHERE ib UNION ALL SELECT site, 'runs', array_to_string(list_sort(list_distinct([x for x in [r0, r1, b0, b1] if x IS NOT NULL])), ',') FROM j
UNION ALL SELECT site, 'conflicts', concat_ws(',', CASE WHEN am <> bm THEN 'mode' END, CASE WHEN st <> bs THEN 'status' END) FROM j""",
    ("fetch_log",),
)(_evidence)

# ---------------------------------------------------------------- paged jobs
_PAGED = f"""{RP.API_NORM},
po AS (SELECT job, page_key, fetched_us, url, cursor, len(l) AS found, row_number() OVER w AS pos, lag(cursor) OVER w AS asked FROM api_a WINDOW w AS (PARTITION BY job ORDER BY fetched_us, page_key)),
pe AS (SELECT *, sum(CASE WHEN found > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM po),
pf AS (SELECT *, sum(CASE WHEN found > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY job, isl ORDER BY pos ROWS UNBOUNDED PRECEDING) AS empties, min(pos) OVER (PARTITION BY job, url) AS first_pos FROM pe),
it AS (SELECT n.*, pf.pos FROM api_n n JOIN pf ON n.job = pf.job AND n.page_key = pf.page_key),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, item_key ORDER BY pos, item_no) AS rn FROM it) x WHERE rn = 1),
nw AS (SELECT job, pos, count(*) AS c FROM fi GROUP BY ALL),
pc AS (SELECT pf.*, coalesce(c, 0) AS c, coalesce(sum(coalesce(c, 0)) OVER (PARTITION BY pf.job ORDER BY pf.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pf LEFT JOIN nw ON pf.job = nw.job AND pf.pos = nw.pos),
ev AS (SELECT job, pos * 2 AS stop_at, 0 AS rank, 'max_items' AS reason, pos - 1 AS last_pos FROM pc WHERE {{limit}} > 0 AND before >= {{limit}} UNION ALL SELECT job, pos * 2, 1, 'repeated_url', pos - 1 FROM pc WHERE first_pos < pos
  UNION ALL SELECT job, pos * 2 + 1, 2, 'empty_pages', pos FROM pc WHERE empties >= 2 UNION ALL SELECT job, pos * 2 + 1, 3, 'cursor_stuck', pos FROM pc WHERE cursor <> '' AND cursor = asked UNION ALL SELECT job, pos * 2 + 1, 4, 'no_next_hint', pos FROM pc WHERE cursor = ''),
e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY stop_at, rank) AS rn FROM ev) x WHERE rn = 1),
stp AS (SELECT a.job, coalesce(reason, '') AS stop_reason, coalesce(last_pos, n) AS pages_read FROM (SELECT job, max(pos) AS n FROM pf GROUP BY job) a LEFT JOIN e1 ON a.job = e1.job),
kp AS (SELECT fi.job, fi.pos, item_no, item_key, title, link FROM fi JOIN stp ON fi.job = stp.job AND fi.pos <= pages_read),
kl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos, item_no) AS rn FROM kp) x WHERE {{limit}} = 0 OR rn <= {{limit}}),
sto AS (SELECT stp.*, coalesce(n, 0) AS items FROM stp LEFT JOIN (SELECT job, count(*) AS n FROM kl GROUP BY job) z ON stp.job = z.job)"""
AP = ("api_pages",)
for _name, _limit in (("paged_assembly", 0), ("paged_assembly_max", 7)):
    query(_name, f"WITH {_PAGED.replace('{limit}', str(_limit))} SELECT * FROM sto", AP)(lambda t, n=_limit: PG.paged_assembly(t("api_pages"), n)[0])
    query(f"{_name}_items", f"WITH {_PAGED.replace('{limit}', str(_limit))} SELECT * FROM kl", AP)(
        lambda t, n=_limit: PG.paged_assembly(t("api_pages"), n)[1].withColumn("item_no", F.col("item_no").cast("bigint"))
    )
query("extract_rank", f"WITH {RP.API_NORM} SELECT job, page_key, item_no, item_key, rank FROM api_n", AP)(
    lambda t: R.normalize_api_records(RP.api_items(t)).select("job", "page_key", F.col("item_no").cast("bigint").alias("item_no"), "item_key", "rank")
)
