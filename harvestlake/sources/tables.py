"""Base tables and the adapter views that give them the shapes the operators read.

Each adapter is one SELECT in the dialect subset that Spark and DuckDB share, so
both sides of a check start from identical rows.  ``@name`` refers to a base table
or to another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

ADAPTERS: dict[str, str] = {}
BODIES = {"product_pages": "html", "api_pages": "payload", "menus": "menu_json", "sitemaps": "xml", "captured_calls": "url"}

# one request per event
ADAPTERS["fetch_log"] = """
SELECT request_id, ts, ts_us, run_id, site, concat(site, '.example.com') AS domain,
       concat('e', user_id) AS endpoint, user_id, k, event_type, event_type <> 'error' AS ok,
       cast(round(value * 100) AS bigint) AS latency_ms, value,
       CASE WHEN event_type <> 'error' THEN 200 WHEN k % 4 = 0 THEN 403 WHEN k % 4 = 1 THEN 429
            WHEN k % 4 = 2 THEN 500 ELSE 503 END AS status_code,
       CASE WHEN event_type <> 'error' THEN '' WHEN k % 4 = 0 THEN 'http_blocked'
            WHEN k % 4 = 1 THEN 'challenge_like' WHEN k % 4 = 2 THEN 'server_error'
            ELSE 'navigation_timeout' END AS failure_category,
       CASE WHEN event_type <> 'error' THEN '' WHEN k % 4 = 0 THEN 'HTTP 403 forbidden by captcha wall'
            WHEN k % 4 = 1 THEN 'HTTP 429 too many requests, token=abc123'
            WHEN k % 4 = 2 THEN 'parse error: selector returned no records'
            ELSE concat('timeout via http://user:pw@proxy', k, '.example.net:8080/x password: hunter2') END AS error,
       k % 10 = 0 AS retried, k % 25 = 7 AS checkpoint_error,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS records,
       CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS discovered,
       CASE WHEN k % 3 = 0 THEN 'browser' WHEN k % 3 = 1 THEN 'http' ELSE 'impersonate' END AS mode
FROM (SELECT event_id AS request_id, cast(ts AS timestamp) AS ts, unix_micros(cast(ts AS timestamp)) AS ts_us,
             concat('run-', cast(cast(ts AS date) AS string)) AS run_id, concat('d', user_id % 20) AS site,
             user_id, event_type, value, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k
      FROM @events) e
"""

# one work batch per run and hour; whole milliseconds, so sums do not depend on the order of rows
ADAPTERS["batches"] = """
SELECT run_id, cast(floor(ts_us / 3600000000) AS bigint) AS batch_id,
       cast(floor(cast(sum(latency_ms) AS double) / count(*)) AS double) AS latency_ms, count(*) AS claimed,
       cast(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS bigint) AS succeeded,
       cast(sum(CASE WHEN ok OR retried THEN 0 ELSE 1 END) AS bigint) AS failed,
       cast(sum(CASE WHEN retried AND NOT ok THEN 1 ELSE 0 END) AS bigint) AS retried,
       cast(sum(CASE WHEN checkpoint_error THEN 1 ELSE 0 END) AS bigint) AS checkpoint_errors,
       cast(sum(records) AS bigint) AS records_saved, cast(sum(discovered) AS bigint) AS discovered_urls
FROM @fetch_log GROUP BY run_id, cast(floor(ts_us / 3600000000) AS bigint)
"""

# one collected offer per line item
ADAPTERS["offers"] = """
SELECT concat('run-', l_linenumber) AS run_id, site AS source_site,
       concat('https://', site, '/products/', p_partkey, '?ref=', l_orderkey % 3) AS source_url,
       CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('https://', site, '/products/', p_partkey) END AS canonical_url,
       CASE WHEN l_orderkey % 23 = 0 THEN '' WHEN l_orderkey % 29 = 0 THEN '404 Not Found'
            ELSE concat(p_name, ' ', p_brand) END AS title,
       CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat(p_type, ' > ', p_brand, ' > ', p_name, ' / size ', p_size) END AS category,
       CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('<p>A  <b>', p_name, '</b> of size ', p_size, '</p>') END AS description,
       CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN concat('https://cdn.example.com/img/', p_partkey, '.jpg')
            WHEN p_partkey % 5 = 2 THEN 'https://cdn.example.com/logo.png'
            WHEN p_partkey % 5 = 3 THEN concat('data:image/png;base64,AAAA|/img/', p_partkey, '.jpg')
            ELSE concat('/img/', p_partkey, '.jpg?v=1 | /img/', p_partkey, '.jpg?v=2 | /img/b', p_partkey, '.jpg') END AS image_text,
       CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_returnflag = 'N' THEN 'partial'
            WHEN l_linenumber % 2 = 0 THEN 'blocked' ELSE 'failed' END AS status,
       CASE WHEN l_linenumber % 4 = 2 THEN 'challenge page' ELSE '' END AS notes,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('h-', p_partkey) END AS handle,
       CASE WHEN p_partkey % 6 = 0 THEN concat('EUR ', whole, ',', lpad(cast(frac AS string), 2, '0'))
            WHEN p_partkey % 6 = 1 THEN concat(whole, '.', lpad(cast(frac AS string), 2, '0'), ' USD')
            WHEN p_partkey % 6 = 2 THEN concat(whole + 1000, '.', lpad(cast(whole % 1000 AS string), 3, '0'), ',', lpad(cast(frac AS string), 2, '0'), ' kr')
            WHEN p_partkey % 6 = 3 THEN concat('$', whole, '.', lpad(cast(frac AS string), 2, '0'), ' - $', whole + 25, '.', lpad(cast(frac AS string), 2, '0'))
            WHEN p_partkey % 6 = 4 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Free' ELSE 'ask in store' END
            ELSE CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('-', whole % 100) END END AS price_text,
       'EUR' AS currency, l_shipdate AS created_at, unix_micros(cast(l_shipdate AS timestamp)) AS created_us,
       l_orderkey, l_linenumber, p_partkey, l_extendedprice
FROM (SELECT l.*, p.*, replace(lower(s.s_name), '#', '') AS site,
             cast(floor(cast(round(l_extendedprice * 100) AS bigint) / 100) AS bigint) AS whole,
             cast(round(l_extendedprice * 100) AS bigint) % 100 AS frac
      FROM @lineitem l JOIN @part p ON l_partkey = p_partkey JOIN @supplier s ON l_suppkey = s_suppkey) x
"""

# one fetched shop page per part; the page form cycles through eight shop layouts
ADAPTERS["product_pages"] = """
SELECT page_id, url, status_code, fetch_mode,
       CASE WHEN page_id % 11 = 3 THEN '<html><body>short</body></html>'
            WHEN page_id % 8 = 6 THEN body
            ELSE concat('<!DOCTYPE html><html><head><title>', name, ' | shop</title>',
              '<meta property="og:title" content="', name, ' &amp; more"><meta name="description" content="About ', name, '">',
              '<meta property="og:image" content="/img/', page_id, '.jpg">',
              CASE WHEN page_id % 4 = 1 THEN concat('<link rel="next" href="/list/', kind, '?page=', page_id % 5 + 2, '">') ELSE '' END,
              '<script src="/static/app.', page_id % 5, '.js"></script>',
              '<script type="module" src="https://cdn.example.com/vendor/react-dom.min.js"></script>',
              '<script>fetch("/api/v1/items/', page_id % 7, '?page=2");const u="https://api.example.com/graphql";',
              'var ws="wss://live.example.com/ws/', page_id % 3, '";function sign(a){return hmac(a,token)}',
              'var tracker="https://www.google-analytics.com/collect/ajax";</script></head><body>',
              '<nav><a href="/category/', kind, '">', kind, '</a><a href="/collections/sale">Sale</a>',
              '<a href="/cart">Cart</a><a href="https://other.example.org/c/x">Other</a><a href="/guide.pdf">Guide</a>',
              '<a href="/products/', page_id, '#top">Item</a><a href="/category/', kind, '">Again</a></nav>',
              CASE WHEN page_id % 6 = 0 THEN '<div id="app" data-v-1></div>' ELSE '' END,
              CASE WHEN page_id % 11 = 0 THEN '<div class="cf-challenge">Just a moment</div>'
                   WHEN page_id % 11 = 1 THEN '<div class="g-recaptcha"></div>'
                   WHEN page_id % 11 = 2 THEN '<h2>Access denied</h2>' ELSE '' END,
              CASE WHEN page_id % 13 = 0 THEN '<form action="/login">Sign in</form>' ELSE '' END,
              '<h1>', name, '</h1><a class="variant-link" data-color="red" href="/products/', page_id, '?v=', page_id % 3, '">red</a><a class="variant-link" href="/products/', page_id, '?v=x">plain</a><span class="price" itemprop="price" content="', price, '">', price, ' EUR</span>', body,
              CASE WHEN page_id % 3 = 0 THEN concat('<div class="pagination"><a href="?page=1">1</a><a href="?page=2">2</a><a rel="next" href="?page=', page_id % 5 + 2, '&amp;sort=new">Next</a></div>')
                   WHEN page_id % 3 = 1 THEN '<ul class="pager"><li><a href="?page=1">1</a></li><li><a href="?page=2">2</a></li><li><a href="?page=3">3</a></li></ul>'
                   ELSE '' END,
              '<ul class="related"><li class="card"><a class="card-title" href="/p/', page_id + 1, '">Next ', name, '</a><span class="amount">EUR 12,', page_id % 90 + 10, '</span><img src="/i/n.jpg"></li>',
              '<li class="card"><a class="card-title" href="/p/', page_id + 2, '">Also ', name, '<b>!</b></a><span class="amount">$', page_id % 50, '</span></li><li class="card selected">more</li></ul>',
              '<p>', repeat(concat(name, ' is a fine article of the ', kind, ' line. '), cast(2 + page_id % 30 AS int)), '</p></body></html>') END AS html
FROM (SELECT *, CASE WHEN page_id % 8 = 0 THEN concat('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"', name, '","sku":"S', page_id, '","image":"https://cdn.example.com/', page_id, '.jpg","description":"Fine ', name, '","category":"', kind, '","brand":{"@type":"Brand","name":"', brand, '"},"url":"https://', host, '/products/', page_id, '","offers":{"@type":"Offer","price":"', price, '","priceCurrency":"EUR"}}</script>')
       WHEN page_id % 8 = 1 THEN concat('<script type="application/ld+json">[{"@type":"WebSite","name":"x"},{"@type":"Product","name":"', name, '","sku":"S', page_id, '","image":["https://cdn.example.com/a', page_id, '.jpg","b.jpg"],"brand":"', brand, '","offers":[{"lowPrice":', price, ',"priceCurrency":"GBP"}]}]</script>')
       WHEN page_id % 8 = 2 THEN concat('<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"position":1,"item":{"@type":"Product","name":"', name, ' one","url":"/p/', page_id, '-1","offers":{"price":', price, ',"priceCurrency":"USD"}}},{"position":2,"item":{"@type":"Thing","name":"no"}},{"position":3,"item":{"@type":"Product","name":"', name, ' two","url":"/p/', page_id, '-2","offers":{"price":"$10 - $20"}}}]}</script>')
       WHEN page_id % 8 = 3 THEN concat('<div class="product-tile" data-gtm="{&quot;ecommerce&quot;:{&quot;items&quot;:[{&quot;item_name&quot;:&quot;', name, '&quot;,&quot;item_id&quot;:&quot;G', page_id, '&quot;,&quot;price&quot;:', price, ',&quot;item_colour&quot;:&quot;red&quot;,&quot;item_category&quot;:&quot;', kind, '&quot;,&quot;item_brand&quot;:&quot;', brand, '&quot;}]}}"><a class="tile-image-wrapper-link" href="/p/', page_id, '"><img class="tile-image" srcset="/i/', page_id, '-s.jpg 200w, /i/', page_id, '-l.jpg 800w, /i/', page_id, '-x.jpg 2x"></a></div><div class="product-tile" data-gtm="{&quot;ecommerce&quot;:{&quot;items&quot;:[]}}"></div>')
       WHEN page_id % 8 = 4 THEN concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"initialState":{"Wall":{"productGroupings":[{"products":[{"copy":{"title":"', name, '","subTitle":"Run"},"prices":{"currentPrice":', price, ',"currency":"USD"},"displayColors":{"colorDescription":"blue"},"colorwayImages":{"portraitURL":"https://img.example.com/', page_id, '.png"},"pdpUrl":{"url":"https://', host, '/t/', page_id, '"},"productCode":"N', page_id, '","productType":"', kind, '"}]},{"products":[{"copy":{"title":"Second ', name, '"},"prices":{},"productCode":"M', page_id, '"}]}]}}}}}</script>')
       WHEN page_id % 8 = 5 THEN concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"serverSideGqlResponseFed":{"productPageData":{"search":{"results":{"products":[{"id":"P', page_id, '","title":"', name, '","brand":"', brand, '","price":{"currency":"GBP","listPrice":{"amount":', price, '}},"seoPath":"/p/', page_id, '?color=NAVY&x=1","productDefinition":"', kind, '","variants":[{"size":"M","skuId":"K', page_id, '","mediaAssets":[{"assetId":"as', page_id, '"}]}]}]}}}}}}}</script>')
       WHEN page_id % 8 = 6 THEN concat('{"products":[{"id":', page_id, ',"title":"', name, '","handle":"h', page_id, '","vendor":"', brand, '","product_type":"', kind, '","body_html":"Nice ', name, '","options":[{"name":"Color","values":["green","red"]},{"name":"size","values":["L"]}],"variants":[{"price":"', price, '","compare_at_price":"', price, '0","sku":"V', page_id, '"},{"price":"1"}],"images":[{"src":"https://cdn.example.com/s', page_id, '.jpg"}]},{"id":"x', page_id, '","title":"Other ', name, '","variants":[{"price":"5.50","compare_at_price":"4.00"}],"image":{"src":"https://cdn.example.com/o.jpg"}}]}')
       WHEN page_id % 16 = 7 THEN concat('<div class="product-tile" data-pid="T', page_id, '"><span class="product-tile__name">', name, '</span><div class="price"><span class="sales"><span class="value" content="', price, '">x</span></span></div><img class="tile-image" src="/i/', page_id, '.jpg"><a class="link" href="/p/', page_id, '">go</a></div>')
       ELSE concat('<script>var productImpressions = [{"name":"', name, '","price":"', price, '","id":"J', page_id, '","category":"', kind, '","url":"/p/', page_id, '"},{"product_name":"Alt ', name, '","product_price":3,"product_id":"Q', page_id, '"}];</script>') END AS body
  FROM (SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, lower(p_type) AS kind, concat('shop', p_partkey % 20, '.example.com') AS host,
               concat('https://shop', p_partkey % 20, '.example.com/list/', lower(p_type), '?page=', p_partkey % 5 + 1, '&sort=new') AS url,
               concat(cast(floor(cast(round(p_retailprice * 100) AS bigint) / 100) AS bigint), '.', lpad(cast(cast(round(p_retailprice * 100) AS bigint) % 100 AS string), 2, '0')) AS price,
               CASE WHEN p_partkey % 13 = 0 THEN 403 WHEN p_partkey % 13 = 1 THEN 429 WHEN p_partkey % 13 = 2 THEN 503 ELSE 200 END AS status_code,
               CASE WHEN p_size % 3 = 0 THEN 'browser' WHEN p_size % 3 = 1 THEN 'http' ELSE 'impersonate' END AS fetch_mode
        FROM @part) a) b
"""

# one captured API page per order, ordered inside a job by (fetched_us, page_key)
ADAPTERS["api_pages"] = """
SELECT o_custkey AS job, o_orderkey AS page_key, unix_micros(cast(o_orderdate AS timestamp)) AS fetched_us,
       concat('https://api.example.com/v1/items?page=', o_orderkey % 400) AS url,
       CASE WHEN o_orderkey % 17 = 0 THEN 'stuck' WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('c', o_orderkey) END AS cursor,
       concat('{"', CASE WHEN o_orderkey % 3 = 0 THEN 'items' WHEN o_orderkey % 3 = 1 THEN 'data' ELSE 'results' END, '":[',
         CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE concat(
         '{"id":"i', o_orderkey % 40, '","title":"Item ', o_orderkey % 40, '","price":"', cast(floor(o_totalprice) AS bigint), '.50","url":"/p/', o_orderkey % 40, '","image":{"src":"/img/', o_orderkey % 40, '.jpg"},"views":', o_orderkey % 9, '},',
         '{"objectID":"', o_orderkey, '","name":"', o_orderpriority, '","cost":[{"amount":3},{"amount":', o_orderkey % 100, '}],"link":"https://x.example.com/', o_orderkey, '","score":', o_orderkey % 5, ',"rank":', o_orderkey % 3, '},',
         '{"label":"no title"}') END, '],"next_page":', o_orderkey % 50 + 1, '}') AS payload
FROM @orders
"""

# network calls seen while pages loaded
ADAPTERS["captured_calls"] = """
SELECT request_id AS call_id, concat('p', user_id) AS page, site, ts_us, k, status_code,
       CASE WHEN k % 6 = 3 OR k % 12 = 2 THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN k % 6 = 0 THEN concat('https://', domain, '/api/v1/items?page=', k, '&page_size=20')
            WHEN k % 6 = 1 THEN concat('https://', domain, '/api/items?offset=', k * 10, '&limit=10')
            WHEN k % 6 = 2 THEN concat('https://', domain, '/search/results.json?cursor=c', k, '&ts=17040', k, '&sign=ab', k)
            WHEN k % 6 = 3 THEN concat('https://', domain, '/graphql?nonce=', k)
            WHEN k % 6 = 4 THEN concat('https://', domain, '/static/app.js?v=', k)
            ELSE concat('https://www.google-analytics.com/collect?uid=', user_id) END AS url,
       CASE WHEN k % 6 = 4 THEN 'script' WHEN k % 6 = 5 THEN 'image' WHEN k % 2 = 0 THEN 'xhr' ELSE 'fetch' END AS resource_type,
       CASE WHEN k % 6 = 4 THEN 'text/javascript' WHEN k % 6 = 5 THEN 'image/gif' ELSE 'application/json' END AS content_type,
       CASE WHEN k % 6 < 3 THEN concat('{"items":[{"id":', k, ',"title":"t"}],"next":', k + 1, '}') ELSE '' END AS json_preview,
       CASE WHEN k % 6 = 3 THEN concat('{"query":"products","variables":{"timestamp":', k, ',"sessionId":"s1"}}')
            WHEN k % 12 = 2 THEN 'a=1&token=x' ELSE '' END AS post_data
FROM @fetch_log
"""

# websocket frames of a page
ADAPTERS["frames"] = """
SELECT request_id AS frame_id, concat('p', user_id) AS page, k % 3 AS connection,
       CASE WHEN event_type = 'click' THEN 'sent' ELSE 'received' END AS direction,
       CASE WHEN k % 2 = 0 THEN 'text' ELSE 'binary' END AS data_type,
       cast(floor(value) AS bigint) AS byte_length
FROM @fetch_log
"""

ADAPTERS["frontier"] = """
SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'queued' WHEN page_id % 4 = 1 THEN 'running'
                          WHEN page_id % 4 = 2 THEN 'done' ELSE 'failed' END AS status,
       page_id % 10 AS priority, page_id * 1000000 AS created_us, page_id % 3 AS attempts,
       CASE WHEN page_id % 8 = 1 THEN 400000000 WHEN page_id % 4 = 1 THEN 900000000 ELSE 0 END AS locked_us,
       concat('run-', page_id % 7) AS run_id
FROM @pages
"""

ADAPTERS["jobs"] = """
SELECT concat('task-', o_orderkey) AS task_id, o_orderkey, o_orderpriority AS kind,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
       unix_micros(cast(o_orderdate AS timestamp)) AS created_us, o_custkey, o_totalprice
FROM @orders
"""

ADAPTERS["task_items"] = """
SELECT concat('task-', l_orderkey) AS task_id, l_linenumber AS item_index, p.p_name AS title,
       CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('https://shop.example.com/p/', l_partkey) END AS link,
       CASE WHEN l_suppkey % 4 = 0 THEN cast(NULL AS double) ELSE l_extendedprice END AS price,
       CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('/img/', l_partkey, '.jpg') END AS image,
       unix_micros(cast(l_shipdate AS timestamp)) AS seen_us, l_suppkey, l_partkey
FROM @lineitem l JOIN @part p ON l_partkey = p_partkey
"""

ADAPTERS["sitemaps"] = """
SELECT s_suppkey AS sitemap_id, concat('https://', site, '/sitemap.xml') AS sitemap_url,
       CASE WHEN s_suppkey % 5 = 0 THEN concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://', site, '/sitemap-', s_nationkey, '.xml</loc></sitemap><sitemap><loc>/sitemap-b.xml</loc></sitemap></sitemapindex>')
            ELSE concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://', site, '/products/', s_suppkey, ' </loc></url><url><loc>https://', upper(site), '/category/n', s_nationkey, '#x</loc></url><url><loc>https://sub.', site, '/p/1</loc></url><url><loc>/products/', s_suppkey, '</loc></url><url><loc>mailto:x@y.z</loc></url></urlset>') END AS xml
FROM (SELECT *, concat(replace(lower(s_name), '#', ''), '.example.com') AS site FROM @supplier) s
"""

ADAPTERS["robots_files"] = """
SELECT concat(replace(lower(s_name), '#', ''), '.example.com') AS host,
       CASE WHEN s_suppkey % 4 = 0 THEN concat('# main', chr(10), 'User-agent: *', chr(10), 'Disallow: /products/1', chr(10), 'Allow: /products', chr(10), 'Disallow: /category', chr(10), 'Crawl-delay: ', s_nationkey % 5 + 1)
            WHEN s_suppkey % 4 = 1 THEN concat('User-agent: harvester', chr(10), 'Disallow: /products/2', chr(10), 'Request-rate: 1/', s_nationkey + 1, chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
            WHEN s_suppkey % 4 = 2 THEN concat('User-agent: a', chr(10), 'User-agent: *', chr(10), 'Allow: /products/1', chr(10), 'Disallow: *')
            ELSE '' END AS body
FROM @supplier
"""

ADAPTERS["menus"] = """
SELECT s_suppkey AS menu_id, concat('https://', replace(lower(s_name), '#', ''), '.example.com') AS base_url,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('{"', r_name, '":{"', n_name, '":"/c/', n_nationkey, '","More":{"Shoes":"/c/', n_nationkey, '/shoes","Bags":"/c/', n_nationkey, '/bags"}},"Sale":"/c/sale"}')
            ELSE concat('[{"label":"', r_name, '","url":"/r/', r_regionkey, '","children":[{"label":"', n_name, '","url":"/c/', n_nationkey, '","children":[{"name":"Shoes","url":"/c/', n_nationkey, '/shoes"}]}]},{"title":"Sale","href":"/c/sale"}]') END AS menu_json
FROM @supplier JOIN @nation ON s_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey
"""

_TOKEN = re.compile(r"(?<=(?:FROM|JOIN) )@(\w+)")


def duck_text(sql: str) -> str:
    """The checking engine's spelling of an adapter."""
    return _TOKEN.sub(r"\1", sql).replace("unix_micros(", "epoch_us(")


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in ADAPTERS and name not in order:
            for dep in _TOKEN.findall(ADAPTERS[name]):
                visit(dep)
            order.append(name)

    for n in names:
        visit(n)
    return order


def with_views(views: tuple[str, ...], sql: str) -> str:
    """Prefix checking SQL with the adapter views it reads."""
    parts = [f"{n} AS ({duck_text(ADAPTERS[n]).strip()})" for n in _closure(views)]
    if not parts:
        return sql
    body = sql.strip()
    recursive = bool(re.match(r"(?i)WITH\s+RECURSIVE\b", body))
    body = re.sub(r"(?i)^WITH(\s+RECURSIVE)?\b", ",", body, count=1) if re.match(r"(?i)WITH\b", body) else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + body


class Tables:
    """Hands out base tables and adapter views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _spread(self, df: DataFrame) -> DataFrame:
        """Use all cores on inputs with fewer splits than cores; large inputs stay as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            return self._spread(self.spark.read.parquet(self.path(name)))
        deps = set(_TOKEN.findall(ADAPTERS[name]))
        for dep in deps:
            self(dep).createOrReplaceTempView(f"hl_{dep}")
        view = self.spark.sql(_TOKEN.sub(r"hl_\1", ADAPTERS[name]))
        body = BODIES.get(name)
        if body:
            # a stored body is a column, not an expression: keep the optimizer from
            # copying the text that builds it into every predicate that reads it
            rest = [c for c in view.columns if c != body]
            view = view.select(*rest, F.explode(F.array(body)).alias(body)).select(*view.columns)
        return view

    def stream(self, name: str, streamed: str = "events") -> DataFrame:
        """A base table or adapter view with one base table read as a stream of files."""
        if name == streamed:
            schema = self.spark.read.parquet(self.path(name)).schema
            # a pattern matches a single file as well as a folder of files
            return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")
        if name not in ADAPTERS:
            return self(name)
        for dep in set(_TOKEN.findall(ADAPTERS[name])):
            self.stream(dep, streamed).createOrReplaceTempView(f"hl_{dep}")
        return self.spark.sql(_TOKEN.sub(r"hl_\1", ADAPTERS[name]))
