"""Queries over structured data in page bodies."""

from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.operators import extract as X
from harvestlake.plans import sqlx as S
from harvestlake.plans.registry import query

PP = ("product_pages",)
_FIELDS = ("title", "currency", "color", "size", "description", "image_url", "product_url", "category_level_1", "category_level_2", "brand", "sku")


def js(v: str, path: str) -> str:
    return f"coalesce(trim(json_extract_string({v}, {S.lit(path)})), '')"


def firstof(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def item_select(evidence: str, price: str, **fields: str) -> str:
    cols = []
    for f in _FIELDS:
        v = fields.get(f, "NULL::varchar")
        keep = f in ("title", "currency", "brand", "sku")
        cols.append(f"{f'coalesce({v}, {S.lit('')})' if keep else f'nullif({v}, {S.lit('')})'} AS {f}")
    return ", ".join(cols) + f", {price} AS highest_price, {evidence} AS evidence"


def ordered(body: str, order: str) -> str:
    return f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY {order}) - 1 AS item_no, * EXCLUDE (page_id, {order}) FROM ({body}) z"


# ---------------------------------------------------------------- one CTE chain per extractor
_LD = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"
_JSONLD_CTE = f"""
ld_s AS (SELECT page_id, url, generate_subscripts(l, 1) AS si, unnest(l) AS body FROM (SELECT page_id, url, regexp_extract_all(html, {S.lit(_LD)}, 1) AS l FROM product_pages) a),
ld_o AS (SELECT page_id, url, si, generate_subscripts(a, 1) AS oi, unnest(a) AS o FROM (SELECT page_id, url, si, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS a
  FROM (SELECT *, try_cast(trim({S.unescape('body')}) AS json) AS j FROM ld_s) b WHERE j IS NOT NULL) c),
ld_p AS (SELECT page_id, url, si * 1000000 + oi * 1000 + generate_subscripts(x, 1) AS ord, unnest(x) AS p FROM (SELECT *, CASE WHEN {js('o', '$."@type"')} = 'ItemList'
  THEN [z for z in json_extract(o, '$.itemListElement[*].item') if {js('z', '$."@type"')} = 'Product'] WHEN {js('o', '$."@type"')} = 'Product' THEN [o] ELSE [] END AS x FROM ld_o) d),
jsonld AS (SELECT page_id, ord, """ + item_select(
    "'jsonld'",
    S.number_or_none(firstof(js("p", "$.offers.price"), js("p", "$.offers.lowPrice"), js("p", "$.offers[0].price"), js("p", "$.offers[0].lowPrice"))),
    title=js("p", "$.name"), currency=firstof(js("p", "$.offers.priceCurrency"), js("p", "$.offers[0].priceCurrency")), description=js("p", "$.description"),
    image_url="CASE WHEN json_type(json_extract(p, '$.image')) = 'ARRAY' THEN json_extract_string(p, '$.image[0]') ELSE json_extract_string(p, '$.image') END",
    product_url=firstof(js("p", "$.url"), "url"), category_level_1=js("p", "$.category"),
    brand="coalesce(json_extract_string(p, '$.brand.name'), json_extract_string(p, '$.brand'))", sku=js("p", "$.sku"),
) + " FROM ld_p)"

_TILE_CUT = r"""(?i)(<[a-z][^>]*\sclass\s*=\s*["'](?:[^"']*\s)?product-tile(?:\s[^"']*)?["'])"""
_CHUNKS = f"string_split(regexp_replace(html, {S.lit(_TILE_CUT)}, chr(1) || '\\1', 'g'), chr(1))"


def tag_cls(x, tag, cls):
    return f"regexp_extract({x}, {S.lit(f'''(?is)<{tag}\\b[^>]*\\sclass\\s*=\\s*["'](?:[^"']*\\s)?{cls}(?:\\s[^"']*)?["'][^>]*>''')}, 0)"


_OPEN = "regexp_extract(c, '(?s)^<[^>]*>', 0)"
_A_HREF = "regexp_extract(c, '(?is)<a\\b[^>]*\\shref\\s*=[^>]*>', 0)"


def gtm_fields(g, image, url_expr):
    return item_select(
        "ev", S.number_or_none(js(g, "$.price")), title=js(g, "$.item_name"), currency=firstof(js(g, "$.currency"), "'GBP'"), color=js(g, "$.item_colour"),
        image_url=image, product_url=url_expr, category_level_1=js(g, "$.item_category"), category_level_2=js(g, "$.item_category2"), brand=js(g, "$.item_brand"), sku=js(g, "$.item_sku"),
    )


_SRCSET = (
    "(list_sort([{'s': -greatest(coalesce(try_cast(regexp_extract(lower(e), ' (.*)w$', 1) AS double), try_cast(regexp_extract(lower(e), ' (.*)x$', 1) AS double) * 1000, 1.0), "
    "coalesce(try_cast(regexp_extract(split_part(e, ' ', 1), '[?&]width=(\\d+)', 1) AS double), -1.0)), 'o': i, 'u': split_part(e, ' ', 1)} "
    "for e, i in [trim(w) for w in string_split(srcset, ',')] if e <> ''])[1]).u"
)
_GTM_CTE = f"""
gtm_c AS (SELECT page_id, url, generate_subscripts(l, 1) AS ci, unnest(l) AS c FROM (SELECT page_id, url, {_CHUNKS}[2:] AS l FROM product_pages) a),
gtm_t AS (SELECT *, json_extract(try_cast(trim({S.unescape(S.attr(_OPEN, 'data-gtm'))}) AS json), '$.ecommerce.items[0]') AS g, {S.attr(tag_cls('c', 'img', 'tile-image'), 'srcset')} AS srcset,
  {firstof(S.attr(tag_cls('c', '[a-z]+', 'tile-image-wrapper-link'), 'href'), S.attr(_A_HREF, 'href'))} AS href FROM gtm_c WHERE {S.attr(_OPEN, 'data-gtm')} <> ''),
gtm_tiles AS (SELECT page_id, ord, """ + gtm_fields("g", _SRCSET, f"CASE WHEN href <> '' THEN {S.resolve('url', 'href')} END") + " FROM (SELECT *, ci AS ord, 'gtm_tile' AS ev FROM gtm_t WHERE g IS NOT NULL) x)"
# every payload of the tables sits on a tile, so the text fallback adds no rows here

_PRICE_VALUE = r"""(?is)\bprice\b[^>]*>.*?\bsales["'\s][^>]*>.*?(<[a-z][^>]*\sclass\s*=\s*["'](?:[^"']*\s)?value(?:\s[^"']*)?["'][^>]*>)"""
_TILES_CTE = f"""
til_c AS (SELECT page_id, url, generate_subscripts(l, 1) AS ci, unnest(l) AS c FROM (SELECT page_id, url, {_CHUNKS}[2:] AS l FROM product_pages) a),
til_t AS (SELECT * FROM til_c WHERE {S.attr(_OPEN, 'data-pid')} <> ''),
til_a AS (SELECT page_id, ci AS ord, """ + item_select(
    "'tile'", S.number_or_none(S.attr(f"regexp_extract(c, {S.lit(_PRICE_VALUE)}, 1)", "content")),
    title=S.clean_text("""regexp_extract(c, '(?is)<[a-z][^>]*\\sclass\\s*=\\s*["''](?:[^"'']*\\s)?product-tile__name(?:\\s[^"'']*)?["''][^>]*>(.*?)</', 1)"""),
    currency="'USD'", image_url=S.attr(tag_cls("c", "img", "tile-image"), "src"),
    product_url=f"CASE WHEN {S.attr(_A_HREF, 'href')} <> '' THEN {S.resolve('url', S.attr(_A_HREF, 'href'))} END", sku=S.attr(_OPEN, "data-pid"),
) + f""" FROM til_t),
til_j AS (SELECT page_id, generate_subscripts(a, 1) AS ord, unnest(a) AS v FROM (SELECT page_id, json_extract(try_cast({S.unescape("regexp_extract(html, '(?s)productImpressions\\s*=\\s*(\\[.*?\\]);', 1)")} AS json), '$[*]') AS a
  FROM product_pages WHERE contains(html, 'productImpressions') AND page_id NOT IN (SELECT page_id FROM til_t)) b),
til_b AS (SELECT page_id, ord, """ + item_select(
    "'tile_script'", S.number_or_none(firstof(js("v", "$.price"), js("v", "$.product_price"))), title=firstof(js("v", "$.name"), js("v", "$.product_name")),
    currency=firstof(js("v", "$.currency"), "'USD'"), image_url=firstof(js("v", "$.image"), js("v", "$.product_image")), product_url=firstof(js("v", "$.url"), js("v", "$.product_url")),
    category_level_1=firstof(js("v", "$.category"), js("v", "$.product_category")), sku=firstof(js("v", "$.id"), js("v", "$.product_id")),
) + """ FROM til_j),
tiles AS (SELECT * FROM til_a UNION ALL SELECT * FROM til_b)"""

_NEXT = """(?is)<script\\b[^>]*\\bid\\s*=\\s*["']__NEXT_DATA__["'][^>]*>(.*?)</script"""
_HYD = f"coalesce(try_cast(nullif(regexp_extract(html, {S.lit(_NEXT)}, 1), '') AS json), CASE WHEN regexp_matches(html, '^\\s*[{{\\[]') THEN try_cast(html AS json) END)"
_HYD_CTE = f"hyd AS (SELECT page_id, url, {_HYD} AS j FROM product_pages)"
_WALL_CTE = """
wall_p AS (SELECT page_id, url, generate_subscripts(a, 1) AS ord, unnest(a) AS p FROM (SELECT page_id, url, coalesce(nullif(json_extract(j, '$.props.pageProps.initialState.Wall.productGroupings[*].products[*]'), []),
  json_extract(j, '$.Wall.productGroupings[*].products[*]')) AS a FROM hyd) b),
hydration_wall AS (SELECT page_id, ord, """ + item_select(
    "'hydration_wall'", S.number_or_none(js("p", "$.prices.currentPrice")), title=f"concat_ws(' - ', nullif({js('p', '$.copy.title')}, ''), nullif({js('p', '$.copy.subTitle')}, ''))",
    currency=js("p", "$.prices.currency"), color=js("p", "$.displayColors.colorDescription"), image_url=js("p", "$.colorwayImages.portraitURL"), product_url=js("p", "$.pdpUrl.url"),
    category_level_1=js("p", "$.productType"), sku=js("p", "$.productCode"),
) + " FROM wall_p)"
_RES = "$.props.pageProps.serverSideGqlResponseFed.productPageData.search.results.products[*]"
_GQL_CTE = f"""
gql_p AS (SELECT page_id, url, generate_subscripts(a, 1) AS ord, unnest(a) AS p FROM (SELECT page_id, url, coalesce(nullif(json_extract(j, '$.products[*]'), []), json_extract(j, '{_RES}')) AS a FROM hyd) b),
hydration_graphql AS (SELECT page_id, ord, """ + item_select(
    "'hydration_graphql'", S.number_or_none(js("p", "$.price.listPrice.amount")), title=js("p", "$.title"), currency=js("p", "$.price.currency"),
    color=f"[z.v for z in {S.pairs(S.query(js('p', '$.seoPath')))} if z.k = 'color'][1]", size=js("p", "$.variants[0].size"), description=js("p", "$.description"),
    image_url=js("p", "$.variants[0].mediaAssets[0].assetId"), product_url=f"CASE WHEN {js('p', '$.seoPath')} <> '' THEN {S.resolve('url', js('p', '$.seoPath'))} END",
    category_level_1=js("p", "$.productDefinition"), brand=js("p", "$.brand"), sku=js("p", "$.variants[0].skuId"),
) + " FROM gql_p)"
_GRID_CTE = f"""
grid_p AS (SELECT page_id, url, generate_subscripts(a, 1) AS ord, unnest(a) AS p FROM (SELECT page_id, url, CASE WHEN regexp_matches(html, '^\\s*[{{\\[]') THEN json_extract(try_cast(html AS json), '$.products[*]')
  ELSE json_extract(try_cast({S.unescape("regexp_extract(html, '(?s)\"products\"\\s*:\\s*(\\[.*?\\])\\s*[,}]', 1)")} AS json), '$[*]') END AS a FROM product_pages) b),
grid_v AS (SELECT *, {S.number_or_none(js('p', '$.variants[0].compare_at_price'))} AS was, {S.number_or_none(js('p', '$.variants[0].price'))} AS now_price FROM grid_p),
shop_grid AS (SELECT page_id, ord, """ + item_select(
    "'shop_grid'", "CASE WHEN was > coalesce(now_price, 0) THEN was ELSE now_price END", title=js("p", "$.title"), currency="'USD'",
    color=f"[{js('z', '$.values[0]')} for z in json_extract(p, '$.options[*]') if lower({js('z', '$.name')}) = 'color'][1]",
    size=f"[{js('z', '$.values[0]')} for z in json_extract(p, '$.options[*]') if lower({js('z', '$.name')}) = 'size'][1]",
    description=js('p', '$.body_html'), image_url=firstof(js("p", "$.image.src"), js("p", "$.images[0].src")),
    product_url=f"CASE WHEN {js('p', '$.handle')} <> '' THEN 'https://' || {S.netloc('url')} || '/products/' || {js('p', '$.handle')} END",
    category_level_1=js("p", "$.product_type"), brand=js("p", "$.vendor"), sku=js("p", "$.variants[0].sku"),
) + " FROM grid_v)"


def _register(name: str, strategy: str, cte: str, table: str) -> None:
    def run(t):
        return X.extract_items(t("product_pages"), strategy).withColumn("item_no", F.col("item_no").cast("bigint"))

    query(name, f"WITH {cte} " + ordered(f"SELECT * FROM {table}", "ord"), PP)(run)


_register("jsonld_products", "jsonld_product", _JSONLD_CTE, "jsonld")
_register("gtm_products", "gtm_tiles", _GTM_CTE, "gtm_tiles")
_register("hydration_wall_products", "hydration_wall", _HYD_CTE + "," + _WALL_CTE, "hydration_wall")
_register("hydration_graphql_products", "hydration_graphql", _HYD_CTE + "," + _GQL_CTE, "hydration_graphql")
_register("shop_grid_products", "shop_grid", _GRID_CTE, "shop_grid")
_register("tile_products", "tiles", _TILES_CTE, "tiles")

query(
    "script_json",
    f"""SELECT page_id, {_HYD.split(', CASE')[0].replace('coalesce(', '')} IS NOT NULL AS has_data,
  coalesce(json_extract_string(try_cast(nullif(regexp_extract(html, {S.lit(_NEXT)}, 1), '') AS json), '$.props.pageProps.initialState.Wall.productGroupings[0].products[0].copy.title'), '') AS wall_title,
  coalesce(json_extract_string(try_cast(nullif(regexp_extract(html, '(?s)var productImpressions = (.*?);\\s*</script>', 1), '') AS json), '$[0].name'), '') AS first_impression FROM product_pages""",
    PP,
)(
    lambda t: t("product_pages").select(
        "page_id",
        X.script_json(F.col("html"), "__NEXT_DATA__").isNotNull().alias("has_data"),
        X._get(X.script_json(F.col("html"), "__NEXT_DATA__"), "$.props.pageProps.initialState.Wall.productGroupings[0].products[0].copy.title").alias("wall_title"),
        X._get(X.script_json(F.col("html"), marker="var productImpressions"), "$[0].name").alias("first_impression"),
    )
)

# ---------------------------------------------------------------- contracts
_GRAPH = "json_extract(o, '$.\"@graph\"[*]')"
_ALL_CTE = ",".join([_JSONLD_CTE, _GTM_CTE, _TILES_CTE, _HYD_CTE, _WALL_CTE, _GQL_CTE, _GRID_CTE])
_DETECT_CTE = f"""{_ALL_CTE},
flags AS (
  SELECT page_id, 'gtm_tiles' AS strategy, 0.74::double AS prior, 0 AS ord FROM product_pages WHERE NOT regexp_matches(html, '^\\s*[{{\\[]') AND regexp_matches(html, '(?is)<[a-z][^>]*\\sdata-gtm\\s*=')
  UNION ALL SELECT DISTINCT page_id, 'jsonld_product', 0.68::double, 1 FROM ld_o WHERE {js('o', '$."@type"')} = 'Product' OR len([z for z in {_GRAPH} if {js('z', '$."@type"')} = 'Product']) > 0
  UNION ALL SELECT DISTINCT page_id, 'jsonld_itemlist', 0.7::double, 2 FROM ld_o WHERE {js('o', '$."@type"')} = 'ItemList' OR len([z for z in {_GRAPH} if {js('z', '$."@type"')} = 'ItemList']) > 0
  UNION ALL SELECT DISTINCT page_id, 'hydration_wall', 0.78::double, 3 FROM wall_p
  UNION ALL SELECT page_id, 'hydration_graphql', 0.8::double, 4 FROM hyd WHERE json_type(json_extract(j, '{_RES[:-3]}')) = 'ARRAY'
  UNION ALL SELECT page_id, 'tiles', 0.62::double, 5 FROM product_pages WHERE NOT regexp_matches(html, '^\\s*[{{\\[]') AND (contains(html, 'productImpressions') OR page_id IN (SELECT page_id FROM til_t))
  UNION ALL SELECT page_id, 'shop_grid_text', 0.6::double, 6 FROM product_pages WHERE NOT regexp_matches(html, '^\\s*[{{\\[]') AND regexp_matches(html, '"products"\\s*:\\s*\\[')
  UNION ALL SELECT DISTINCT page_id, 'shop_grid', 0.7::double, 7 FROM grid_p WHERE page_id IN (SELECT page_id FROM product_pages WHERE regexp_matches(html, '^\\s*[{{\\[]'))
     AND (json_extract(p, '$.handle') IS NOT NULL OR (json_extract(p, '$.variants') IS NOT NULL AND (json_extract(p, '$.vendor') IS NOT NULL OR json_extract(p, '$.product_type') IS NOT NULL)))),
every_item AS (SELECT 'gtm_tiles' AS strategy, * FROM gtm_tiles UNION ALL SELECT 'jsonld_product', * FROM jsonld UNION ALL SELECT 'jsonld_itemlist', * FROM jsonld
  UNION ALL SELECT 'hydration_wall', * FROM hydration_wall UNION ALL SELECT 'hydration_graphql', * FROM hydration_graphql UNION ALL SELECT 'tiles', * FROM tiles
  UNION ALL SELECT 'shop_grid_text', * FROM shop_grid UNION ALL SELECT 'shop_grid', * FROM shop_grid),
counts AS (SELECT page_id, strategy, count(*) AS n FROM every_item GROUP BY ALL),
cand AS (SELECT f.page_id, f.strategy, f.ord, coalesce(n, 0) AS items, round(CASE WHEN coalesce(n, 0) > 0 THEN least(0.98::double, prior + least(0.18::double, n * 0.03::double)) ELSE greatest(0.05::double, prior - 0.25::double) END, 4) AS confidence
  FROM flags f LEFT JOIN counts c ON f.page_id = c.page_id AND f.strategy = c.strategy),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (items > 0) DESC, confidence DESC, ord) AS rank FROM cand)"""

query("detect_contracts", f"WITH {_DETECT_CTE} SELECT page_id, rank, strategy, confidence, items FROM ranked", PP)(
    lambda t: X.detect_contracts(t("product_pages")).withColumns({"rank": F.col("rank").cast("bigint"), "items": F.col("items").cast("bigint")})
)

_BEST = "SELECT e.* FROM every_item e JOIN ranked r ON e.page_id = r.page_id AND e.strategy = r.strategy AND r.rank = 1"
_CONTRACT_SQL = f"WITH {_DETECT_CTE}, chosen AS ({_BEST}) " + ordered("SELECT * EXCLUDE (strategy) FROM chosen", "ord")
query("extract_by_contract", _CONTRACT_SQL, PP)(
    lambda t: X.extract_best(t("product_pages")).withColumn("item_no", F.col("item_no").cast("bigint"))
)

_FAMILY = {"gtm_tile": "gtm_tiles", "gtm_text": "gtm_tiles", "tile": "tiles", "tile_script": "tiles_script"}


def _reason(field: str) -> str:
    cases = "".join(
        f" WHEN evidence = '{k}' THEN {S.lit(rules.MISSING_BY_STRATEGY[_FAMILY.get(k, k)][field])}"
        for k in ("gtm_tile", "gtm_text", "hydration_wall", "hydration_graphql", "jsonld", "shop_grid", "tile", "tile_script")
        if field in rules.MISSING_BY_STRATEGY[_FAMILY.get(k, k)]
    )
    return f"CASE{cases} ELSE {S.lit(rules.MISSING_DEFAULT)} END" if cases else S.lit(rules.MISSING_DEFAULT)


query(
    "missing_reasons",
    f"WITH {_DETECT_CTE}, chosen AS ({_BEST}), items AS ({ordered('SELECT * EXCLUDE (strategy) FROM chosen', 'ord')}) "
    + " UNION ALL ".join(
        f"SELECT page_id, item_no, '{f}' AS field, {_reason(f)} AS reason FROM items WHERE coalesce(cast({f} AS varchar), '') = ''" for f in rules.ITEM_FIELDS
    ),
    PP,
)(lambda t: X.missing_reasons(X.extract_best(t("product_pages"))).withColumn("item_no", F.col("item_no").cast("bigint")))


# ---------------------------------------------------------------- meta fields
def meta(key):
    return S.squash(S.unescape(S.attr(f"regexp_extract(html, {S.lit(f'''(?is)<meta\\b[^>]*(?:property|name)\\s*=\\s*[\"']{key}[\"'][^>]*>''')}, 0)", "content")))


def inner(h, tag):
    return S.clean_text(f"regexp_extract({h}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)")


def _meta_sql(src, cte):
    body = S.without_scripts("html")
    price_tag = S.attr("""regexp_extract(html, '(?is)<[a-z][^>]*\\sitemprop\\s*=\\s*["'']price["''][^>]*>', 0)""", "content")
    price_text = S.clean_text(f"""regexp_extract({body}, '(?is)<[a-z][^>]*\\sclass\\s*=\\s*["''][^"'']*price[^"'']*["''][^>]*>(.*?)</', 1)""")
    img = firstof("CASE WHEN json_type(json_extract(p, '$.image')) = 'ARRAY' THEN json_extract_string(p, '$.image[0]') ELSE json_extract_string(p, '$.image') END", meta("og:image"), meta("twitter:image"))
    return f"""
WITH {cte}
meta AS (SELECT page_id, url, {firstof(js('p', '$.name'), meta('og:title'), meta('twitter:title'), inner(body, 'h1'), inner('html', 'title'))} AS title,
  {firstof(js('p', '$.description'), meta('description'), meta('og:description'))} AS description, {img} AS img,
  {firstof(js('p', '$.offers.highPrice'), js('p', '$.offers[0].highPrice'), js('p', '$.offers.price'), js('p', '$.offers[0].price'), meta('product:price:amount'), price_tag, price_text)} AS price_text,
  {firstof(js('p', '$.offers.priceCurrency'), js('p', '$.offers[0].priceCurrency'), meta('product:price:currency'))} AS currency FROM joined)
SELECT page_id, title, description, CASE WHEN img <> '' THEN {S.resolve('url', 'img')} END AS image_url, price_text, currency FROM meta"""


_META_LD = _JSONLD_CTE.split("ld_p AS")[0] + f"""
meta_w AS (SELECT page_id, si, oi, 0 AS lvl, o AS p FROM ld_o WHERE lower({js('o', '$."@type"')}) = 'product'),
meta_f AS (SELECT page_id, arg_min(p, si * 1000 + oi) AS p FROM meta_w WHERE {js('p', '$.name')} <> '' GROUP BY page_id),
joined AS (SELECT x.page_id, x.url, x.html, f.p FROM product_pages x LEFT JOIN meta_f f ON x.page_id = f.page_id),"""
query("page_meta_fields", _meta_sql("product_pages", _META_LD), PP)(lambda t: X.page_meta_fields(t("product_pages")))
query("page_meta_fields_stored", _meta_sql("pages", "joined AS (SELECT page_id, url, html, NULL::json AS p FROM pages),"))(lambda t: X.page_meta_fields(t("pages")))

# ---------------------------------------------------------------- hints and scripts
query(
    "page_api_candidates",
    f"""
WITH a AS (SELECT page_id, url, generate_subscripts(l, 1) AS pos, unnest(l) AS h FROM (SELECT page_id, url, regexp_extract_all(html, {S.lit('(?i)' + rules.API_HINT)}, 1) AS l FROM product_pages) x),
b AS (SELECT page_id, pos, {S.resolve('url', 'h')} AS u FROM a),
c AS (SELECT page_id, u, min(pos) AS pos FROM b WHERE NOT {S.has_any('lower(u)', rules.TRACKING_PATTERNS)} GROUP BY ALL),
d AS (SELECT *, (CASE WHEN contains(lower(u), 'api') THEN 20 ELSE 0 END) + (CASE WHEN contains(lower(u), 'graphql') THEN 18 ELSE 0 END)
  + (CASE WHEN {S.has_any('lower(u)', ('product', 'catalog', 'items', 'search'))} THEN 12 ELSE 0 END) + (CASE WHEN {S.has_any('lower(u)', ('page', 'offset', 'limit'))} THEN 4 ELSE 0 END) AS score FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM d)
SELECT page_id, rank, u AS api_url, score FROM e""",
    PP,
)(lambda t: X.page_api_candidates(t("product_pages")).withColumn("rank", F.col("rank").cast("bigint")))


def _hint_rows(t):
    from harvestlake.operators import pages as P

    return t("product_pages").select("page_id", F.posexplode(P.api_hints(F.col("html"))).alias("hint_no", "hint")).withColumn("hint_no", F.col("hint_no").cast("bigint"))


query(
    "api_hints",
    f"""
WITH a AS (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS hint FROM (SELECT page_id, regexp_extract_all(html, {S.lit('(?i)' + rules.API_HINT)}, 1) AS l FROM product_pages) x),
b AS (SELECT page_id, hint, min(pos) AS pos FROM a GROUP BY ALL),
c AS (SELECT page_id, hint, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS hint_no FROM b)
SELECT page_id, hint_no, hint FROM c""",
    PP,
)(_hint_rows)

_KW = "[{'w': k.w, 'c': k.c} for k in [" + ", ".join("{'w': %s, 'c': %s}" % (S.lit(w), S.lit(c)) for w, c in rules.SCRIPT_KEYWORDS) + "] if contains(lower(js), k.w)]"
_PW = [f"[{{'w': lower(m), 'c': {S.lit(c)}}} for m in regexp_extract_all(js, {S.lit(p)})]" for p, c in rules.SCRIPT_PATTERNS]
_KEYWORDS = "list_distinct(" + _KW + "".join(f" || {p}" for p in _PW) + ")"
_CATS = "[x.c for x in keywords]"
_SCRIPT_CTE = f"""
sc_a AS (SELECT page_id, url, generate_subscripts(l, 1) - 1 AS script_no, unnest(l) AS s FROM (SELECT page_id, url, {S.scripts('html')} AS l FROM {{src}}) x),
sc_b AS (SELECT page_id, url, script_no, s, regexp_extract(s, '(?is)^<script\\b[^>]*>', 0) AS tag FROM sc_a),
sc_c AS (SELECT *, trim({S.unescape(S.attr('tag', 'src'))}) AS src, {S.attr('tag', 'type')} AS type_attr FROM sc_b),
sc_d AS (SELECT page_id, script_no, type_attr, src = '' AS is_inline, CASE WHEN src <> '' THEN {S.resolve('url', 'src')} ELSE '' END AS script_url, CASE WHEN src = '' THEN trim({S.script_body('s')}) ELSE '' END AS js FROM sc_c),
sc_e AS (SELECT *, length(js) AS size, list_distinct([e for e in regexp_extract_all(js, {S.lit(rules.SCRIPT_ENDPOINT)}, 1) if not starts_with(e, 'data:')]) AS endpoints,
  {_KEYWORDS} AS keywords, list_distinct(regexp_extract_all(js, {S.lit(rules.SCRIPT_GRAPHQL[0])}, 1) || regexp_extract_all(js, {S.lit(rules.SCRIPT_GRAPHQL[1])}, 1)) AS graphql,
  list_distinct(regexp_extract_all(js, {S.lit(rules.SCRIPT_WEBSOCKET)}, 1)) AS websockets, list_distinct(regexp_extract_all(js, {S.lit(rules.SCRIPT_SOURCEMAP)}, 1)) AS sourcemaps FROM sc_d),
sc AS (SELECT *, {' + '.join(f"(CASE WHEN list_contains({_CATS}, '{c}') THEN {p} ELSE 0 END)" for c, p in rules.SCRIPT_CATEGORY_POINTS)}
  + least(len(endpoints) * 8, 40) + least(len(graphql) * 15, 45) + least(len(websockets) * 12, 36) + (CASE WHEN len(sourcemaps) > 0 THEN 15 ELSE 0 END)
  + (CASE WHEN type_attr = 'module' THEN 3 ELSE 0 END) + (CASE WHEN is_inline AND size > 100 THEN 2 ELSE 0 END) AS score FROM sc_e)"""


def _inventory_rows(t, src):
    inv = X.script_inventory(t(src))
    return inv.select(
        "page_id", F.col("script_no").cast("bigint").alias("script_no"), "script_url", "type_attr", "is_inline", F.col("size").cast("bigint").alias("size"),
        F.size("endpoints").alias("n_endpoints"), F.size("keywords").alias("n_keywords"), F.size("graphql").alias("n_graphql"), F.size("websockets").alias("n_websockets"),
        F.array_join("categories", ",").alias("categories"), F.col("score").cast("bigint").alias("score"),
    )


_INV_COLS = "page_id, script_no, script_url, type_attr, is_inline, size, len(endpoints)::int AS n_endpoints, len(keywords)::int AS n_keywords, len(graphql)::int AS n_graphql, len(websockets)::int AS n_websockets, array_to_string(list_sort(list_distinct([x.c for x in keywords])), ',') AS categories, score"
for _n, _src, _v in (("script_inventory", "product_pages", PP), ("script_inventory_stored", "pages", ())):
    query(_n, f"WITH {_SCRIPT_CTE.replace('{src}', _src)} SELECT {_INV_COLS} FROM sc", _v)(lambda t, s=_src: _inventory_rows(t, s))

query(
    "script_inventory_summary",
    f"""WITH {_SCRIPT_CTE.replace('{src}', 'product_pages')}
SELECT 'total_scripts' AS metric, count(*) AS value FROM sc UNION ALL SELECT 'scored_scripts', count(*) FROM sc WHERE score > 0
UNION ALL SELECT 'distinct_endpoints', count(DISTINCT v) FROM (SELECT unnest(endpoints) AS v FROM sc) a
UNION ALL SELECT 'distinct_keywords', count(DISTINCT v) FROM (SELECT unnest([k.w for k in keywords]) AS v FROM sc) a
UNION ALL SELECT 'distinct_websockets', count(DISTINCT v) FROM (SELECT unnest(websockets) AS v FROM sc) a""",
    PP,
)(lambda t: X.script_inventory_summary(X.script_inventory(t("product_pages"))))


def _top_scripts(t):
    inv = X.script_inventory(t("product_pages"))
    return inv.orderBy(F.desc("score"), "page_id", "script_no").limit(10).select("page_id", F.col("script_no").cast("bigint").alias("script_no"), F.col("score").cast("bigint").alias("score"))


query("top_candidates", f"WITH {_SCRIPT_CTE.replace('{src}', 'product_pages')} SELECT page_id, script_no, score FROM sc ORDER BY score DESC, page_id, script_no LIMIT 10", PP)(_top_scripts)


# ---------------------------------------------------------------- staged tasks
def _tasks(t):
    pages = t("product_pages")
    details = pages.withColumn("detail_url", F.concat(F.regexp_extract("url", r"^https://[^/]+", 0), F.lit("/products/"), F.col("page_id")))
    return X.list_detail_variant_tasks(pages, details)


query(
    "list_detail_variant_tasks",
    f"""
WITH a AS (SELECT page_id, url, regexp_extract(url, '^https://[^/]+', 0) || '/products/' || page_id AS detail_url, unnest({S.tags(S.without_scripts('html'), 'a')}) AS tag FROM product_pages),
b AS (SELECT *, {S.unescape(S.attr('tag', 'href'))} AS href, {S.attr('tag', 'class')} AS cls, {S.attr('tag', 'data-color')} AS color FROM a),
d AS (SELECT u AS url, min(url) AS parent_url FROM (SELECT url, regexp_extract({S.resolve('url', 'href')}, '^[^#]*', 0) AS u FROM b WHERE href <> '' AND NOT contains(cls, 'variant-link')) x WHERE {S.url_kind('u')} = 'detail' GROUP BY u),
v AS (SELECT {S.resolve('detail_url', 'href')} AS url, detail_url, color FROM b WHERE href <> '' AND contains(cls, 'variant-link') AND detail_url IN (SELECT url FROM d))
SELECT 'detail_page' AS kind, url, 1 AS depth, parent_url, '' AS color FROM d
UNION ALL SELECT 'variant_page', url, 2, min(detail_url), max(color) FROM v GROUP BY url""",
    PP,
)(_tasks)
