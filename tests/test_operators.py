"""Literal and brute-force cases for the table operators."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from harvestlake.operators import elements as E
from harvestlake.operators import extend
from harvestlake.operators import extract as X
from harvestlake.operators import frontier as FR
from harvestlake.operators import funnel as FU
from harvestlake.operators import links as L
from harvestlake.operators import oplog as O
from harvestlake.operators import pages as P
from harvestlake.operators import paging as PG
from harvestlake.operators import quality as Q
from harvestlake.operators import records as R
from harvestlake.operators import scoring as SC


def page(spark, html, url="https://shop.example/list?page=1", status=200):
    return spark.createDataFrame([(1, url, html, status)], "page_id long, url string, html string, status_code int")


# ---------------------------------------------------------------- links
LINK_PAGE = """<html><body><nav><a href="/products/1#x">One</a><a href="/products/1">One again</a><a href="/products/2?b=1">Two</a>
<a href="/api/items">Api</a><a href="/guide.PDF">Guide</a><a href="https://other.example/x">Other</a><a href="mailto:a@b.c">Mail</a><a>none</a>
<script>var s = '<a href="/hidden">no</a>';</script><!-- <a href="/comment">no</a> --></nav></body></html>"""


def test_extract_links(spark):
    got = L.extract_links(page(spark, LINK_PAGE)).orderBy("link_no").collect()
    assert [(r["link_url"], r["kind"]) for r in got] == [
        ("https://shop.example/products/1", "detail"), ("https://shop.example/products/2?b=1", "detail"), ("https://shop.example/api/items", "api")
    ]
    stats = {r["reason"]: r["links"] for r in L.link_drop_stats(page(spark, LINK_PAGE)).collect()}
    assert stats == {"kept": 3, "duplicate": 1, "ignored_extension": 1, "offsite": 1, "invalid": 1}


def test_link_rule(spark):
    rule = L.LinkRule(allow=(r"/products/", "/api/"), deny=(r"\?b=",), allow_domains=("shop.example",), classify={"special": "/1$"}, max_links=1, priority=7)
    got = L.extract_links(page(spark, LINK_PAGE), rule).collect()
    assert [(r["link_url"], r["kind"], r["priority"]) for r in got] == [("https://shop.example/products/1", "special", 7)]
    stats = {r["reason"]: r["links"] for r in L.link_drop_stats(page(spark, LINK_PAGE), rule).collect()}
    assert stats["denied_pattern"] == 1 and stats["offsite"] == 1


def test_subdomain_is_onsite_for_links_only(spark):
    html = '<a href="https://m.shop.example/x">m</a>'
    assert L.extract_links(page(spark, html)).count() == 1
    xml = "<urlset><url><loc>https://m.shop.example/x</loc></url><url><loc> https://shop.example/y </loc></url><url><loc>/y</loc></url></urlset>"
    files = spark.createDataFrame([(1, "https://shop.example/sitemap.xml", xml)], "sitemap_id long, sitemap_url string, xml string")
    assert [(r["url"], r["kind"]) for r in L.scan_sitemap_xml(files).collect()] == [("https://shop.example/y", "page")]
    index = "<s:sitemapindex xmlns:s='x'><s:sitemap><s:loc>/a.xml</s:loc></s:sitemap></s:sitemapindex>"
    files = spark.createDataFrame([(1, "https://shop.example/sitemap.xml", index)], "sitemap_id long, sitemap_url string, xml string")
    assert [(r["url"], r["kind"]) for r in L.scan_sitemap_xml(files).collect()] == [("https://shop.example/a.xml", "sitemap")]


@pytest.mark.parametrize(
    "html, url, want",
    [
        ('<a rel="next" href="?page=2">n</a>', "https://s.example/l?page=1", [f"https://s.example/l?page={i}" for i in (2, 3, 4, 5)]),
        ('<div class="pagination"><a href="/l/1">1</a><a href="/l/3">3</a><a href="/l/2">2</a></div>', "https://s.example/l", ["https://s.example/l/2", "https://s.example/l/3"]),
        ("<p>x</p>", "https://s.example/l?q=a&p=4", ["https://s.example/l?q=a&p=5", "https://s.example/l?q=a&p=6", "https://s.example/l?q=a&p=7"]),
        ('<a href="/next">Suivant</a>', "https://s.example/l", ["https://s.example/next"]),
        ("<p>x</p>", "https://s.example/l", []),
    ],
)
def test_next_pages(spark, html, url, want):
    got = L.detect_next_pages(page(spark, html, url), max_pages=4).orderBy("order_no").collect()
    assert [r["next_url"] for r in got] == want


# ---------------------------------------------------------------- pages
def test_bad_pages(spark):
    rows = [("x" * 700, 200, False), ("x" * 100, 200, True), ("x" * 700, 503, True), ("x" * 700 + "Just a Moment", 200, True), (None, 200, True)]
    df = spark.createDataFrame(rows, "html string, status int, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", P.is_bad_page(F.col("html"), F.col("status"))).collect())


@pytest.mark.parametrize(
    "html, status, kind, vendor, markers, action",
    [
        ("<p>hCaptcha</p>", 200, "captcha", "hcaptcha", "hcaptcha,captcha", "manual_handoff"),
        ("<p>Just a moment</p> access denied", 200, "managed_challenge", "cloudflare", "just a moment,access denied", "manual_handoff"),
        ('{"captcha": 1}', 200, "none", "none", "", "standard_http"),
        ("<p>slow</p>", 429, "rate_limited", "unknown", "status:429", "manual_handoff"),
        ("<form action='/login'>", 403, "login_required", "unknown", "status:403,login_marker", "manual_handoff"),
        ("<p>no</p>", 403, "none", "none", "", "authorized_session_required"),
        ("<div id='root'></div>", 200, "none", "none", "", "browser_render"),
    ],
)
def test_challenges(spark, html, status, kind, vendor, markers, action):
    r = P.classify_pages(page(spark, html, status=status)).first()
    assert (r["challenge_kind"], r["challenge_vendor"], r["challenge_markers"], r["access_action"]) == (kind, vendor, markers, action)


def test_marker_far_inside_a_page_counts(spark):
    r = P.classify_pages(page(spark, "<p>" + "word " * 60000 + "geetest</p>")).first()
    assert r["challenge_kind"] == "captcha"


def test_failure_bucket(spark):
    rows = [("x", 200, "", "x"), ("", 403, "", "http_blocked"), ("", 500, "", "server_error"), ("", 200, "e", "runtime_error"), ("", 200, "", "unknown")]
    df = spark.createDataFrame(rows, "c string, s int, e string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", P.failure_bucket(F.col("c"), F.col("s"), F.col("e"))).collect())


# ---------------------------------------------------------------- extraction
def test_jsonld_graph_offers_and_entities(spark):
    html = """<script type='application/ld+json'>{"@type":"Product","name":"A &amp; B","offers":[{"price":"199.99","priceCurrency":"GBP"}],"image":["i.jpg"],"brand":{"name":"Br"},"sku":7}</script>
    <script type="application/ld+json">not json</script><script type="application/ld+json">[{"@type":"Thing"}]</script>"""
    got = X.extract_items(page(spark, html), "jsonld_product").collect()
    assert [(r["title"], r["highest_price"], r["currency"], r["image_url"], r["brand"], r["sku"]) for r in got] == [("A & B", 199.99, "GBP", "i.jpg", "Br", "7")]
    fields = {r["field"] for r in X.missing_reasons(X.extract_items(page(spark, html), "jsonld_product")).collect()}
    assert fields == {"color", "size", "description", "category_level_1", "category_level_2"}


def test_gtm_text_fallback(spark):
    html = """<div class="product-tile" data-gtm='{"ecommerce":{"items":[{"item_name":"T","item_id":"1","price":"£13 - £26"}]}}'><a href="/p">x</a></div>
    <span data-gtm='{"ecommerce":{"items":[{"item_name":"U","item_id":"2"}]}}'></span><span data-gtm='{"ecommerce":{"items":[{"item_name":"T","item_id":"1"}]}}'></span>"""
    got = X.extract_items(page(spark, html), "gtm_tiles").orderBy("item_no").collect()
    assert [(r["title"], r["highest_price"], r["product_url"], r["evidence"]) for r in got] == [("T", 13.0, "https://shop.example/p", "gtm_tile"), ("U", None, None, "gtm_text")]


def test_unknown_contract_fails(spark):
    with pytest.raises(Exception, match="unsupported extraction strategy"):
        X.extract_by_contract(page(spark, "<p>x</p>").withColumn("strategy", F.lit("nope"))).collect()


def test_named_contract_routes(spark):
    html = '{"products":[{"title":"G","variants":[{"price":"5","compare_at_price":"9"}],"vendor":"v"}]}'
    got = X.extract_by_contract(page(spark, html).withColumn("strategy", F.lit("shop_grid"))).collect()
    assert [(r["title"], r["highest_price"], r["currency"]) for r in got] == [("G", 9.0, "USD")]
    best = X.detect_contracts(page(spark, html)).first()
    assert (best["strategy"], best["confidence"], best["items"]) == ("shop_grid", 0.73, 1)


# ---------------------------------------------------------------- records
def products(spark, n, keys):
    return spark.range(n).select(F.lit("r").alias("run_id"), F.concat(F.lit("k"), F.col("id") % keys).alias("dedupe_key"), F.col("id").alias("title_no"), F.col("id").alias("created_us"))


def test_upsert_counts(spark):
    df = products(spark, 100, 20)
    assert R.upsert_counts(df).first().asDict() == {"run_id": "r", "inserted": 20, "updated": 80, "total": 100}
    last = R.upsert_latest(df, order=("created_us",))
    rows = {r["dedupe_key"]: (r["title_no"], r["created_us"], r["updated_us"], r["writes"]) for r in last.collect()}
    assert rows["k3"] == (83, 3, 83, 5)
    again = R.upsert_into(last.select("run_id", "dedupe_key", "title_no", "created_us"), df.select("run_id", "dedupe_key", "title_no", "created_us"), order=("created_us", "title_no"))
    assert again.count() == 20


def test_upsert_thirty_thousand_twice(spark):
    df = products(spark, 30000, 30000)
    merged = R.upsert_into(df, df, order=("created_us",))
    assert merged.count() == 30000 and merged.agg(F.sum("writes")).first()[0] == 60000


def test_payload_shapes(spark):
    rows = [
        (1, '[{"a":1},2]', 1), (2, '{"children":[{"data":{"a":1}},{"b":2}]}', 2), (3, '{"data":{"items":[{"a":1}]}}', 1),
        (4, '{"x":{"y":[1,{"z":1}]}}', 1), (5, "broken", 0), (6, '{"items":[]}', 0), (7, '{"hits":[{"a":1},{"a":2}],"items":"no"}', 2),
    ]
    df = spark.createDataFrame(rows, "id int, payload string, want int")
    got = R.scan_api_payloads(df, deep=True).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {i: w for i, _, w in rows if w}


def test_deep_menu_fails_instead_of_losing_nodes(spark):
    menu = '{"a":' * 5 + '"/x"' + "}" * 5
    df = spark.createDataFrame([(1, "https://s.example", menu)], "menu_id long, base_url string, menu_json string")
    assert R.scan_catalog_json(df, 5).count() == 5
    with pytest.raises(Exception, match="deeper"):
        R.scan_catalog_json(df, 4).collect()


def test_issues_by_status(spark):
    cols = "run_id string, canonical_url string, source_url string, title string, status string, notes string, price_text string, highest_price double, image_urls array<string>, description string, handle string, category string, dedupe_key string"
    rows = [
        ("ok", "u", "", "t", "ok", "", "x", None, ["logo.png"], "", "", "", "k"),
        ("partial", "u", "", "", "partial", "", "", None, [], "", "h", "c", "k"),
        ("blocked", "", "", "", "blocked", "", "", None, [], "", "", "", ""),
        ("negative", "", "s", "t", "ok", "", "-5", -5.0, ["data:x", "a.jpg"], "d", "h", "c", ""),
    ]
    got = {}
    for r in Q.record_issues(spark.createDataFrame(rows, cols), ("run_id",)).collect():
        got.setdefault(r["run_id"], {})[r["code"]] = r["severity"]
    assert got["ok"] == {"unparsable_price": "warning", "noise_only_images": "warning", "missing_body": "info", "missing_handle": "info", "missing_category": "info"}
    assert got["partial"] == {"missing_title": "warning"}
    assert got["blocked"] == {"blocked_without_notes": "warning"}
    assert got["negative"] == {"negative_price": "error", "data_image_url": "info", "missing_dedupe_key": "info"}


# ---------------------------------------------------------------- coverage
COUNTERS = (
    "run_id string, estimated_inventory long, discovered_urls long, attempted_fetches long, time_budget_exhausted boolean, fetched_success long, blocked_or_challenged long, fetch_failed long, "
    "render_attempted long, render_success long, parsed_records long, quality_passed long, quality_failed long, exported_unique long, duplicate_dropped long, stale_or_invalid_pages long, missing_required_fields long, catalog_exhausted boolean"
)


def test_coverage_report(spark):
    rows = [
        ("a", 5000, 5000, 5000, False, 4300, 200, 500, 0, 0, 4290, 4285, 5, 4280, 5, 0, 0, False),
        ("b", 1000, 1000, 100, True, 100, 0, 0, 0, 0, 100, 100, 0, 100, 0, 0, 0, False),
        ("c", 919, 919, 919, False, 919, 0, 0, 0, 0, 919, 919, 0, 919, 0, 0, 0, True),
        ("d", 0, 0, 0, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, False),
    ]
    df = spark.createDataFrame(rows, COUNTERS)
    rep = {r["run_id"]: r for r in FU.coverage_report(df, target=1000).collect()}
    assert rep["a"]["overall_coverage_rate"] == 0.856 and rep["a"]["main_loss_reason"] == "access_or_transport_loss" and rep["a"]["accepted"]
    assert rep["b"]["main_loss_reason"] == "time_budget_or_frontier_pending" and not rep["b"]["accepted"]
    assert rep["c"]["accepted"] and rep["d"]["main_loss_reason"] == "missing_inventory_discovery"
    lost = {(r["run_id"], r["stage"]): r["lost"] for r in FU.coverage_funnel(df).collect()}
    assert lost[("b", "access")] == 0 and lost[("b", "schedule")] == 900 and ("d", "access") not in lost
    acts = {r["action"] for r in FU.recovery_actions(df).where("run_id = 'd'").collect()}
    assert acts == {"harden_access"}


# ---------------------------------------------------------------- pressure
def batches(spark, rows):
    return spark.createDataFrame(
        [("r", i, float(l), c, s, f, rt, e, rec, new) for i, (l, c, s, f, rt, e, rec, new) in enumerate(rows)],
        "run_id string, batch_id long, latency_ms double, claimed long, succeeded long, failed long, retried long, checkpoint_errors long, records_saved long, discovered_urls long",
    )


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(100, 10, 10, 0, 0, 0, 1, 0)], "proceed"),
        ([(100, 10, 6, 4, 0, 0, 1, 0)], "abort"),
        ([(16000, 10, 10, 0, 0, 0, 1, 0)], "pause"),
        ([(5000, 10, 10, 0, 0, 0, 1, 0)] * 3, "pause"),
        ([(100, 10, 8, 2, 0, 0, 1, 0)], "slow_down"),
        ([(100, 10, 10, 0, 3, 0, 1, 0)], "slow_down"),
        ([(100, 10, 10, 0, 0, 1, 1, 0)], "slow_down"),
    ],
)
def test_pressure_ladder(spark, rows, want):
    assert O.batch_pressure(batches(spark, rows)).first()["recommendation"] == want


def test_supervisor_ladder(spark):
    rows = [(1, 10, 1, 9, 0, 0, 1, 0), (1, 10, 10, 0, 0, 0, 0, 0), (1, 10, 10, 0, 0, 0, 0, 0), (1, 10, 5, 5, 0, 0, 3, 0), (1, 100, 100, 0, 0, 0, 4, 0), (1, 10, 10, 0, 0, 0, 9, 0)]
    got = [r["action"] for r in O.supervise_batch(batches(spark, rows)).orderBy("batch_id").collect()]
    assert got == ["abort", "repair_after_run", "pause", "slow_down", "repair_after_run", "proceed"]


# ---------------------------------------------------------------- frontier
def test_frontier_counts_and_resume(spark):
    cand = spark.createDataFrame([("https://a.example/1",), (" https://a.example/1 ",), ("https://a.example/2",), ("ftp://x/",), ("nope",)], "url string").withColumn("ord", F.monotonically_increasing_id())
    known = FR.frontier_rows(spark.createDataFrame([("https://a.example/2",)], "url string")).select("url_hash")
    assert FR.frontier_add_counts(cand, known).first().asDict() == {"added": 1, "skipped": 2, "invalid": 2}
    assert [r["frontier_url"] for r in FR.frontier_add(cand, known, ("ord",)).collect()] == ["https://a.example/1"]
    seeds = spark.range(30000).select(F.concat(F.lit("https://a.example/p/"), "id").alias("url"))
    done = seeds.limit(18000)
    pending = FR.resume_pending(seeds, done)
    assert pending.count() == 12000 and pending.select("url_hash").distinct().count() == 12000


def test_robots_groups(spark):
    body = "User-agent: lost\n\nUser-agent: a\nUser-agent: Bot\n# note\nDisallow: /private # x\nAllow: /\nCrawl-delay: 5\n\nUser-agent: *\nDisallow:\nRequest-rate: 1/9"
    files = spark.createDataFrame([("h", body), ("empty", "")], "host string, body string")
    links = spark.createDataFrame([("h", "https://h/private/x"), ("h", "https://h/p"), ("empty", "https://empty/private"), ("none", "https://none/x")], "host string, url string")
    verdict = lambda agent, mode="respect": [(r["can_fetch"], r["matched_rule"], r["crawl_delay"], r["request_rate"]) for r in FR.robots_verdict(links, FR.parse_robots(files, agent), mode).orderBy(F.desc("host"), F.desc("url")).collect()]
    assert verdict("bot/2.0") == [(True, "", None, ""), (False, "/private", 5.0, ""), (True, "/", 5.0, ""), (True, "", None, "")]
    assert verdict("other") == [(True, "", None, ""), (True, "", None, "1/9"), (True, "", None, "1/9"), (True, "", None, "")]
    assert verdict("lost")[1][3] == "1/9"
    assert all(v[0] for v in verdict("bot", "record_only"))


def test_robots_percent_forms(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a%7Eb\nDisallow: /x y\nDisallow: /p+q\nDisallow: /100%\nDisallow: /caf%C3%A9")], "host string, body string")
    paths = {"/a~b": False, "/a%7eb/c": False, "/x%20y": False, "/p+q": False, "/p%20q": True, "/100%25": False, "/100": True, "/café": False, "": True, "?q=/x%20y": True}
    links = spark.createDataFrame([("h", f"https://h{p}") for p in paths], "host string, url string")
    got = {r["url"].removeprefix("https://h"): r["can_fetch"] for r in FR.robots_verdict(links, FR.parse_robots(files)).collect()}
    assert got == paths


def test_lineage_against_search(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)]
    got = {x["url"]: (x["depth"], x["parent_url"]) for x in FR.crawl_lineage(spark.createDataFrame([("n1",), ("n2",)], "url string"), spark.createDataFrame(edges, "parent string, child string")).collect()}
    want = {"n1": (0, ""), "n2": (0, "")}
    level, depth = {"n1", "n2"}, 0
    while level:
        depth += 1
        found = {}
        for p, c in edges:
            if p in level and c not in want:
                found[c] = min(found.get(c, p), p)
        want.update({c: (depth, p) for c, p in found.items()})
        level = set(found)
    assert got == want


# ---------------------------------------------------------------- paged jobs
def brute_pages(pages, max_items):
    seen_urls, keys, order, empties, asked, last, reason = set(), set(), [], 0, None, 0, ""
    for pos, (url, cursor, items) in enumerate(pages, 1):
        if max_items and len(order) >= max_items:
            return "max_items", last, order
        if url in seen_urls:
            return "repeated_url", last, order
        seen_urls.add(url)
        last = pos
        if not items:
            empties += 1
            if empties >= 2:
                return "empty_pages", last, order
        else:
            empties = 0
            for i in items:
                if i not in keys:
                    keys.add(i)
                    order.append(i)
            if max_items:
                order = order[:max_items]
        if cursor == "":
            return "no_next_hint", last, order
        if cursor == asked:
            return "cursor_stuck", last, order
        asked = cursor
    return reason, last, order


@pytest.mark.parametrize("max_items", [0, 6])
def test_paged_assembly(spark, max_items):
    r = random.Random(9)
    jobs, rows, key = {}, [], 0
    for job in range(60):
        pages = []
        for i in range(r.randrange(1, 12)):
            pages.append((f"u{r.randrange(40)}", r.choice(["", "same", *(f"c{i}" for _ in range(12))]), [f"i{r.randrange(15)}" for _ in range(r.choice([0, 1, 3, 4]))]))
        jobs[job] = pages
        for i, (url, cursor, items) in enumerate(pages):
            key += 1
            body = ",".join(f'{{"id":"{x}","title":"t"}}' for x in items)
            rows.append((job, key, i * 40 * 86_400_000_000, url, cursor, f'{{"items":[{body}]}}'))
    df = spark.createDataFrame(rows, "job int, page_key long, fetched_us long, url string, cursor string, payload string")
    stops, kept = PG.paged_assembly(df, max_items)
    got = {x["job"]: (x["stop_reason"], x["pages_read"], x["items"]) for x in stops.collect()}
    items = {}
    for x in kept.orderBy("job", "pos", "item_no").collect():
        items.setdefault(x["job"], []).append(x["item_key"].split(":")[1])
    for job, pages in jobs.items():
        reason, last, order = brute_pages(pages, max_items)
        assert got[job] == (reason, last, len(order)), job
        assert items.get(job, []) == order


# ---------------------------------------------------------------- scoring
def test_scorecard(spark):
    rows = [("p", "dom_repeated_items", "dom", "high", 80, ""), ("q", "challenge_detected", "access", "high", 90, ""), ("q", "observed_api_candidate", "api", "high", 70, ""), ("z", "unweighted", "x", "low", 5, "")]
    df = spark.createDataFrame(rows, "page string, code string, source string, confidence string, score int, variant string")
    got = {r["page"]: r for r in SC.strategy_scorecard(df, SC.strategy_weights(spark)).collect()}
    assert (got["p"]["recommended"], got["p"]["score_http"], got["p"]["confidence"]) == ("http", 100, "high")
    assert (got["q"]["recommended"], got["q"]["score_manual_handoff"], got["q"]["score_api_intercept"], got["q"]["executable"]) == ("manual_handoff", 125, 10, "browser")
    assert (got["z"]["recommended"], got["z"]["confidence"]) == ("http", "low")


# ---------------------------------------------------------------- elements
TREE = """<html><body><ul class="list"><li class="card x"><a class="title" href="/1">One</a><span class="price">$ 5</span><li class="card"><h3>Two</h3><b>$ 6</b></ul>
<div id="d"><p>a<p>b<br>c</div><script>var x = "<i>no</i>";</script></body></html>"""


def test_tree(spark):
    rows = {r["elem_id"]: r for r in E.parse_elements(page(spark, TREE)).collect()}
    assert [rows[i]["tag"] for i in range(len(rows))] == ["html", "body", "ul", "li", "a", "span", "li", "h3", "b", "div", "p", "p", "br", "script"]
    assert rows[2]["children"] == ["li", "li"] and rows[3]["end_id"] == 5 and rows[6]["parent_id"] == 2
    assert rows[9]["full_text"] == "abc" and rows[4]["path"] == ["html", "body", "ul", "li", "a"]


@pytest.mark.parametrize("selector, want", [("li", 2), ("li.card.x", 1), ("ul > li", 2), ("body li a", 1), ("ul a", 1), ("ul > a", 0), ("div#d p", 2), ("a[href]", 1), ("a[href=/1]", 1), ("[class=price]", 1), ("div li", 0)])
def test_selectors(spark, selector, want):
    assert E.parse_elements(page(spark, TREE)).where(E.matches(selector)).count() == want


def test_containers(spark):
    e = E.parse_elements(page(spark, TREE))
    got = [(r["selector"], r["count"], r["score"]) for r in E.infer_containers(e).collect()]
    assert got == []  # ".card.x" and ".card" differ, so nothing repeats
    twice = TREE.replace("card x", "card")
    e = E.parse_elements(page(spark, twice))
    assert [(r["selector"], r["count"], r["score"]) for r in E.infer_containers(e).collect()] == [(".card", 2, 12)]
    fields = {r["field"]: r["field_selector"] for r in E.infer_field_selectors(e, E.container_groups(e)).collect()}
    assert fields == {"title": ".title", "price": ".price", "link": ".title@href"}


def test_similarity_against_difflib(spark):
    e = E.parse_elements(page(spark, TREE.replace("card x", "cards")))
    seeds = e.where("tag = 'li'").groupBy("page_id").agg(F.min("elem_id").alias("elem_id"))
    got = E.similar_elements(e, seeds).collect()
    assert [(r["elem_id"], r["score"]) for r in got] == [(6, round(SequenceMatcher(None, "cards", "card").ratio(), 4))]
    rows = E.with_parents(e).withColumn("site", F.lit("s"))
    saved = rows.where(E.matches("span.price")).groupBy("site").agg(F.min_by(E.signature(), "elem_id").alias("sig")).withColumn("name", F.lit("price"))
    best = E.relocate_elements(rows, saved).collect()
    assert [(r["elem_id"], r["score"]) for r in best] == [(5, 100.0)]
    moved = E.parse_elements(page(spark, TREE.replace('<span class="price">$ 5</span>', '<span class="cost">$ 7</span>')))
    found = E.relocate_elements(E.with_parents(moved).withColumn("site", F.lit("s")), saved).collect()
    assert [r["tag"] for r in found] == ["span"] and 40 <= found[0]["score"] < 100


def test_processor_failures_stay_with_their_item(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "later")], "page_id long, url string")

    def processor(row):
        if row["url"] == "boom":
            raise KeyError("x")
        return {"ok": row["url"] != "later", "retry": True, "records": [row["url"]]}

    out = extend.process_items(df, processor, "page_id")
    rows = {r["page_id"]: r for r in out.collect()}
    assert rows[1]["ok"] and rows[1]["records"] == ["a"] and rows[2]["error"] == "KeyError: 'x'" and not rows[2]["retry"] and rows[3]["retry"]
    frontier = df.select("page_id", F.lit("running").alias("status"))
    after = {r["page_id"]: r["status"] for r in FR.apply_outcomes(frontier, out).collect()}
    assert after == {1: "done", 2: "failed", 3: "queued"}


def test_hints_and_candidates_beyond_twenty(spark):
    from harvestlake.plans import extract_plan

    df = page(spark, "".join(f'<i data-u="/api/item/{k}"></i>' for k in range(45)))
    hints = extract_plan._hint_rows(lambda name: df).orderBy("hint_no").collect()
    assert [(r["hint_no"], r["hint"]) for r in hints] == [(k, f"/api/item/{k}") for k in range(45)]
    ranked = X.page_api_candidates(df).orderBy("rank").collect()
    assert [(r["rank"], r["api_url"]) for r in ranked] == [(k + 1, f"https://shop.example/api/item/{k}") for k in range(45)]
    assert X.page_api_candidates(df, limit=7).count() == 7


def test_containers_beyond_five(spark):
    html = "<body>" + "".join(f'<div class="kind-{c}"><a href="/x">t</a></div>' * 2 for c in "abcdefgh") + "</body>"
    e = E.parse_elements(page(spark, html)).cache()
    assert sorted(r["selector"] for r in E.infer_containers(e).collect()) == [f".kind-{c}" for c in "abcdefgh"]
    assert E.infer_containers(e, top=5).count() == 5
