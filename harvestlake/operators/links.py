"""Link discovery: anchors, drop reasons, sitemaps, menus, page numbering."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import html as H
from harvestlake.functions import text, urls


@dataclass(frozen=True)
class LinkRule:
    """Which links of a page are kept and how they are named."""

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    deny_extensions: tuple[str, ...] = rules.DENY_EXTENSIONS
    exact_domain: bool = False
    classify: dict[str, str] = field(default_factory=dict)
    default_kind: str = "page"
    priority: int = 0
    max_links: int = 0


def _in_domains(domain: Column, allowed: tuple[str, ...], exact: bool) -> Column:
    out = F.lit(False)
    for item in allowed:
        item = F.lit(item.lower())
        out = out | ((domain == item) if exact else urls.same_or_subdomain(domain, item))
    return out


def drop_reason(u: urls.Url, base_domain: Column, rule: LinkRule = LinkRule(), full: Column | None = None) -> Column:
    """First reason to drop a resolved link, '' to keep it."""
    full = u if full is None else full
    domain, path = urls.domain_of(u), F.lower(urls.path(u))
    if rule.allow_domains:
        offsite = ~_in_domains(domain, rule.allow_domains, rule.exact_domain)
    elif rule.exact_domain:
        offsite = (base_domain != "") & (domain != base_domain)
    else:
        offsite = (base_domain != "") & ~urls.same_or_subdomain(domain, base_domain)
    out = F.when(~urls.is_web(u), "invalid").when(offsite, "offsite")
    if rule.deny_domains:
        out = out.when(_in_domains(domain, rule.deny_domains, rule.exact_domain), "denied_domain")
    if rule.deny_extensions:
        out = out.when(urls.any_endswith(path, [e.lower() for e in rule.deny_extensions]), "ignored_extension")
    for pattern in rule.deny:
        out = out.when(full.rlike(pattern), "denied_pattern")
    if rule.allow:
        matched = F.lit(False)
        for pattern in rule.allow:
            matched = matched | full.rlike(pattern)
        out = out.when(~matched, "not_allowed_pattern")
    return out.otherwise("")


def filter_links(links: DataFrame, rule: LinkRule = LinkRule(), url: str = "url", base_domain: str = "base_domain") -> DataFrame:
    """Table job: drop reason and kind for a table of resolved links."""
    split, u = urls.with_parts(links, F.col(url), "_u")
    full = F.col(url)
    judged = split.withColumns(
        {
            "drop_reason": drop_reason(u, F.col(base_domain), rule, full),
            "kind": urls.url_kind(u, rule.classify, rule.default_kind, full),
        }
    )
    return urls.without_parts(judged, "_u")


def _page_links(pages: DataFrame, rule: LinkRule) -> DataFrame:
    """One row per page with its distinct links, the repeats per link and its host.

    Links of one page are one array in one row, so repeats are found without a shuffle.
    """
    body = H.without_scripts(F.col("html"))
    tags = F.concat(H.opening_tags(body, "a"), H.opening_tags(body, "area"))
    hrefs = F.filter(F.transform(tags, lambda t: F.trim(text.unescape(H.attribute(t, "href")))), lambda h: h != "")
    return (
        pages.withColumn("_hrefs", hrefs)
        .withColumn("_urls", urls.discovered_forms(F.col("_hrefs"), F.col("url")))
        .withColumn("host", urls.domain_of(F.col("url")))
        .drop("_hrefs", "html")
    )


def extract_links(pages: DataFrame, rule: LinkRule = LinkRule(), keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Kept links of each page: url, kind, priority, depth, parent and order on the page."""
    per_page = _page_links(pages.select(*keep, "html"), rule)
    kept = F.filter(F.array_distinct("_urls"), lambda u: drop_reason(u, F.col("host"), rule) == "")
    if rule.max_links:
        kept = F.slice(kept, 1, rule.max_links)
    rows = per_page.select(*keep, "host", F.posexplode(kept).alias("link_no", "link_url"))
    u = F.col("link_url")
    return rows.select(
        *[F.col(k) if k != "url" else F.col("url").alias("parent_url") for k in keep],
        "host",
        (F.col("link_no") + 1).alias("link_no"),
        "link_url",
        urls.url_kind(u, rule.classify, rule.default_kind).alias("kind"),
        F.lit(rule.priority).alias("priority"),
        F.lit(1).alias("depth"),
    )


def link_drop_stats(pages: DataFrame, rule: LinkRule = LinkRule()) -> DataFrame:
    """Links per page host and outcome; counts are combined before the shuffle."""
    per_page = _page_links(pages.select("url", "html"), rule)
    reasons = F.transform("_urls", lambda u: drop_reason(u, F.col("host"), rule))
    first = F.array_distinct("_urls")
    kept_once = F.size(F.filter(first, lambda u: drop_reason(u, F.col("host"), rule) == ""))
    kept_all = F.size(F.filter("_reasons", lambda r: r == ""))
    outcomes = F.concat(
        F.filter("_reasons", lambda r: r != ""),
        F.array_repeat(F.lit("kept"), kept_once),
        F.array_repeat(F.lit("duplicate"), kept_all - kept_once),
    )
    return (
        per_page.withColumn("_reasons", reasons)
        .select("host", F.explode(outcomes).alias("reason"))
        .groupBy("host", "reason")
        .agg(F.count("*").alias("links"))
    )


def scan_sitemap_xml(files: DataFrame, rule: LinkRule = LinkRule(exact_domain=True, deny_extensions=())) -> DataFrame:
    """Sitemap texts → kept page or nested sitemap urls, first mention of each."""
    xml, base = F.col("xml"), F.col("sitemap_url")
    root = F.lower(F.regexp_extract(xml, r"(?is)<(?:[\w.-]+:)?(urlset|sitemapindex)\b", 1))
    locs = F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?is)<(?:[\w.-]+:)?loc\b[^>]*>\s*(.*?)\s*</(?:[\w.-]+:)?loc\s*>"), 1),
        lambda x: text.unescape(F.trim(F.regexp_replace(x, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))),
    )
    found = files.select(
        "sitemap_id",
        "sitemap_url",
        root.alias("_root"),
        urls.discovered_forms(F.filter(locs, lambda x: x != ""), base).alias("_urls"),
    )
    kept = F.filter(F.array_distinct("_urls"), lambda u: drop_reason(u, urls.domain_of(F.col("sitemap_url")), rule) == "")
    return found.select(
        "sitemap_id",
        "sitemap_url",
        F.when(F.col("_root") == "sitemapindex", "sitemap").otherwise(rule.default_kind).alias("kind"),
        F.posexplode(kept).alias("loc_no", "url"),
    )


_NAV = r"(?is)(<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>)"
_ANCHOR = r"(?is)(<a\b[^>]*\bhref\b[^>]*>.*?</a\s*>)"


def _anchors(html: Column) -> Column:
    """(label, href) of each anchor."""
    blocks = F.regexp_extract_all(html, F.lit(_ANCHOR), 1)
    return F.transform(
        blocks,
        lambda b: F.struct(
            text.clean_text(b).alias("label"),
            F.trim(text.unescape(H.attribute(F.regexp_extract(b, r"(?s)^<[^>]*>", 0), "href"))).alias("href"),
        ),
    )


def catalog_nodes(pages: DataFrame) -> DataFrame:
    """Navigation anchors that look like categories, first label per url."""
    body = H.without_scripts(F.col("html"))
    nav = F.array_join(F.regexp_extract_all(body, F.lit(_NAV), 1), " ")
    anchors = (
        pages.select("page_id", "url", body.alias("_body"), nav.alias("_nav"))
        .withColumn("_in_nav", _anchors(F.col("_nav")))
        .withColumn("_links", F.when(F.size("_in_nav") > 0, F.col("_in_nav")).otherwise(_anchors(F.col("_body"))))
    )
    full = F.transform(
        F.filter("_links", lambda a: (a["label"] != "") & (a["href"] != "")),
        lambda a: F.struct(
            a["label"].alias("label"),
            F.regexp_extract(urls.resolve(F.col("url"), a["href"]), r"^[^#]*", 0).alias("node_url"),
        ),
    )
    wanted = F.filter(full, lambda n: urls.is_catalog_url(n["node_url"], n["label"]))
    keyed = anchors.select("page_id", wanted.alias("_nodes")).withColumn("_keys", F.col("_nodes.node_url"))
    first = F.transform(F.array_distinct("_keys"), lambda k: F.element_at(F.col("_nodes"), F.array_position("_keys", k).cast("int")))
    return keyed.select("page_id", F.posexplode(first).alias("node_no", "_n")).select(
        "page_id",
        (F.col("node_no") + 1).alias("node_no"),
        F.col("_n.label").alias("label"),
        F.col("_n.node_url").alias("node_url"),
        text.stable_node_id(F.array(F.col("_n.label")), F.col("_n.node_url")).alias("node_id"),
    )


_PAGE_PARAMS = ("page", "p", "pg", "pn", "pagina", "seite")
_NEXT_WORDS = r"(?i)^(next|>|>>|»|下一页.*|next\s*page.*|suivant|volgende|weiter|siguiente)$"
_PAGER = r"(?is)(<(nav|div|ul)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:pagination|pager|page-numbers)[^\"']*[\"'][^>]*>.*?</\2\s*>)"


def _named(name: str):
    return lambda p: (p["k"] == name) & (p["v"] != "")


def _expand(url: Column, param: Column, start: Column, step: Column, count: int) -> Column:
    """``count`` addresses after ``start``, ``step`` pages apart."""
    head = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    tail = F.when(F.contains(url, F.lit("#")), F.concat(F.lit("#"), urls.fragment(url))).otherwise("")
    pairs = urls.query_pairs(urls.query_string(url))

    def at(i: Column) -> Column:
        page = (start + i * step).cast("string")
        renumbered = F.transform(
            pairs, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == param, page).otherwise(p["v"]).alias("v"))
        )
        return F.concat(head, F.lit("?"), urls.encode_pairs(renumbered), tail)

    return F.transform(F.sequence(F.lit(1), F.lit(count)), at)


def detect_next_pages(pages: DataFrame, max_pages: int = 10) -> DataFrame:
    """Addresses of the following pages.

    A next link (pager block, then ``rel=next``, then link text) is continued by its
    page step; without one the numbered links count, without those the page number
    in the page's own address.
    """
    base = F.col("url")
    body = H.without_scripts(F.col("html"))
    pagers = F.array_join(F.regexp_extract_all(body, F.lit(_PAGER), 1), " ")
    staged = pages.select("page_id", "url", body.alias("_body"), pagers.alias("_pager"))
    rel_next = r"(?is)<{}\b[^>]*\brel\s*=\s*[\"']?next[\"'\s>][^>]*>?"

    def href_of(fragment: Column, pattern: str) -> Column:
        return text.unescape(H.attribute(F.regexp_extract(fragment, pattern, 0), "href"))

    def by_text(fragment: Column) -> Column:
        hits = F.filter(_anchors(fragment), lambda a: a["label"].rlike(_NEXT_WORDS) & (a["href"] != ""))
        return F.coalesce(F.get(hits, F.lit(0))["href"], F.lit(""))

    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    a_next, link_next = rel_next.format("a"), rel_next.format("link")
    href = F.coalesce(
        filled(href_of(F.col("_pager"), a_next)),
        filled(by_text(F.col("_pager"))),
        filled(href_of(F.col("_body"), a_next)),
        filled(href_of(F.col("_body"), link_next)),
        filled(by_text(F.col("_body"))),
    )
    numbered = F.filter(_anchors(F.col("_pager")), lambda a: a["label"].rlike(r"^\d{1,9}$") & (a["href"] != ""))
    numbers = F.array_sort(
        F.transform(numbered, lambda a, i: F.struct(a["label"].try_cast("int").alias("n"), i.alias("i"), urls.resolve(base, a["href"]).alias("u")))
    )
    staged = staged.withColumn("_href", href)
    href = F.col("_href")
    staged = staged.select(
        "page_id",
        "url",
        F.when(href.isNotNull(), urls.resolve(base, href)).alias("_next"),
        F.transform(F.filter(numbers, lambda x: x["n"] > 1), lambda x: x["u"]).alias("_numbered"),
    )

    def first_param(u: Column, names: tuple[str, ...]) -> Column:
        """(name, page) of the first listed parameter that holds a number."""
        pairs = urls.query_pairs(urls.query_string(u))
        tries = [
            F.struct(F.lit(n).alias("name"), F.get(F.filter(pairs, _named(n)), F.lit(0))["v"].try_cast("int").alias("page"))
            for n in names
        ]
        return F.get(F.filter(F.array(*tries), lambda x: x["page"].isNotNull()), F.lit(0))

    staged = staged.withColumns(
        {
            "_own": first_param(base, _PAGE_PARAMS),
            "_there": first_param(F.col("_next"), _PAGE_PARAMS[:4]),
        }
    )
    own, there = F.col("_own"), F.col("_there")
    step = F.when(own["name"] == there["name"], there["page"] - own["page"])
    nothing = F.array().cast("array<string>")
    found = (
        F.when(F.col("_next").isNotNull() & (step > 0), F.concat(F.array("_next"), _expand(F.col("_next"), there["name"], there["page"], step, max_pages - 1)))
        .when(F.col("_next").isNotNull(), F.array("_next"))
        .when(F.size("_numbered") > 0, F.col("_numbered"))
        .when(own.isNotNull(), _expand(base, own["name"], own["page"], F.lit(1), max_pages - 1))
        .otherwise(nothing)
    )
    return staged.select("page_id", "url", F.posexplode(F.array_distinct(found)).alias("order_no", "next_url"))
