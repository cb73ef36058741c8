"""Structured product extraction from page bodies.

Every extractor is a Column expression: body in, array of item structs out.  A page
is one row, so extracting, counting and choosing between extractors needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import html as H
from harvestlake.functions import text, urls
from harvestlake.session import materialize

_STRINGS = ("title", "currency", "color", "size", "description", "image_url", "product_url", "category_level_1", "category_level_2", "brand", "sku", "evidence")


def _none() -> Column:
    return F.expr("cast(array() AS array<variant>)")


def _get(v: Column, path: str) -> Column:
    """Trimmed text at a JSON path, '' if absent."""
    return F.coalesce(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _list(v: Column, path: str = "$") -> Column:
    """Elements of an array value, a lone value as one element, nothing for null."""
    at = F.try_variant_get(v, path, "variant")
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"), F.when(at.isNotNull() & ~F.is_variant_null(at), F.array(at)), _none()
    )


def _item(evidence: str, price: Column | None = None, **fields: Column) -> Column:
    """Raw item struct: texts as found, the price as text."""
    out = [fields.get(name, F.lit(None).cast("string")).cast("string").alias(name) for name in _STRINGS[:-1]]
    price = F.lit(None).cast("string") if price is None else price
    return F.struct(*out, price.alias("price"), F.lit(evidence).alias("evidence"))


def _finish(raw_items: Column) -> Column:
    """Typed items; empty text is null except for title, currency, brand and sku."""

    def one(x: Column) -> Column:
        out = []
        for name in _STRINGS[:-1]:
            if name in ("title", "currency", "brand", "sku"):
                out.append(F.coalesce(x[name], F.lit("")).alias(name))
            else:
                out.append(F.when(x[name] != "", x[name]).alias(name))
        return F.struct(*out, text.number_or_none(x["price"]).alias("highest_price"), x["evidence"].alias("evidence"))

    return F.transform(raw_items, one)


_ITEM_TYPE = "array<struct<" + ",".join(f"{n}:string" for n in _STRINGS[:-1]) + ",highest_price:double,evidence:string>>"


def no_items() -> Column:
    return F.expr(f"cast(array() AS {_ITEM_TYPE})")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed one time, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _or(*values: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[_once(v, lambda x: F.when(x != "", x)) for v in values], F.lit(""))


# ---------------------------------------------------------------- parsed parts of a page
class Page:
    """Columns of a page whose embedded JSON has been parsed once."""

    def __init__(self):
        self.html, self.url, self.ld, self.hyd, self.body = (F.col(c) for c in ("html", "url", "_ld", "_hyd", "_body"))
        self.is_json = F.col("_is_json")


def parse_pages(pages: DataFrame) -> DataFrame:
    """Add ld+json objects, hydration object and JSON body; unused ones are pruned away."""
    h = F.col("html")
    staged = pages.withColumn("_is_json", H.looks_like_json(h)).withColumns(
        {"_ld": jsonld_objects(h), "_body": F.when(F.col("_is_json"), F.try_parse_json(h))}
    )
    return staged.withColumn("_hyd", F.coalesce(script_json(h, "__NEXT_DATA__"), F.col("_body")))


# ---------------------------------------------------------------- JSON in pages
def script_json(html: Column, script_id: str = "", marker: str = "") -> Column:
    """JSON of a script found by id, else of the assignment after ``marker``; null if none parses."""
    found = []
    if script_id:
        body = F.regexp_extract(html, rf"(?is)<script\b[^>]*\bid\s*=\s*[\"']{script_id}[\"'][^>]*>(.*?)</script", 1)
        found.append(F.try_parse_json(F.when(body != "", F.trim(body))))
    if marker:
        rest = F.regexp_extract(html, rf"(?s)\Q{marker}\E(.*)$", 1)
        script = F.regexp_extract(rest, r"(?s)^(.*?)(?:</script>|$)", 1)
        expr = F.regexp_replace(F.trim(F.regexp_replace(script, r"(?s)^[^=]*=", "")), r";+\s*$", "")
        found.append(F.try_parse_json(F.when(expr != "", expr)))
    return F.coalesce(*found)


def jsonld_objects(html: Column) -> Column:
    """Top-level objects of all ld+json scripts as variants."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"), 1)
    parsed = F.transform(bodies, lambda b: F.try_parse_json(F.trim(text.unescape(b))))
    return F.flatten(F.transform(parsed, lambda v: _list(v)))


def _type(v: Column) -> Column:
    return _get(v, "$['@type']")


def _offer(v: Column, name: str) -> Column:
    return _or(_get(v, f"$.offers.{name}"), _get(v, f"$.offers[0].{name}"))


def _jsonld_item(page_url: Column):
    def build(p: Column) -> Column:
        price = _or(*[_get(p, path) for path in ("$.offers.price", "$.offers.lowPrice", "$.offers[0].price", "$.offers[0].lowPrice")])
        image = F.coalesce(F.try_variant_get(p, "$.image[0]", "string"), F.when(F.try_variant_get(p, "$.image", "array<variant>").isNull(), F.try_variant_get(p, "$.image", "string")))
        brand = F.coalesce(F.try_variant_get(p, "$.brand.name", "string"), F.try_variant_get(p, "$.brand", "string"))
        return _item(
            "jsonld",
            price,
            title=_get(p, "$.name"),
            currency=_offer(p, "priceCurrency"),
            description=_get(p, "$.description"),
            image_url=image,
            product_url=_or(_get(p, "$.url"), page_url),
            category_level_1=_get(p, "$.category"),
            brand=brand,
            sku=_get(p, "$.sku"),
        )

    return build


def jsonld_items(page: Page) -> Column:
    """Product objects and the products of item lists."""
    inner = lambda o: F.filter(F.transform(_list(o, "$.itemListElement"), lambda e: F.try_variant_get(e, "$.item", "variant")), lambda i: _type(i) == "Product")
    products = F.flatten(
        F.transform(page.ld, lambda o: F.when(_type(o) == "ItemList", inner(o)).when(_type(o) == "Product", F.array(o)).otherwise(_none()))
    )
    return _finish(F.transform(products, _jsonld_item(page.url)))


# ---------------------------------------------------------------- tiles
_TILE = r"(?i)(?=<[a-z][^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?product-tile(?:\s[^\"']*)?[\"'])"


def _tiles(html: Column, attribute: str) -> Column:
    """Page text cut at each product tile; chunks whose tile has the attribute."""
    # the leading blank keeps a tile at the very start apart from the text before it
    cut = F.split(F.concat(F.lit(" "), html), _TILE)
    chunks = F.when(~html.rlike("(?i)product-tile"), F.array().cast("array<string>")).otherwise(F.filter(cut, lambda c, i: i > 0))
    return F.filter(chunks, lambda c: H.attribute(F.regexp_extract(c, r"(?s)^<[^>]*>", 0), attribute) != "")


def _tag_with_class(chunk: Column, tag: str, cls: str) -> Column:
    return F.regexp_extract(chunk, rf"(?is)<{tag}\b[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?{cls}(?:\s[^\"']*)?[\"'][^>]*>", 0)


def _gtm_item(payload: Column, image: Column, product_url: Column, evidence: str) -> Column:
    return _item(
        evidence,
        _get(payload, "$.price"),
        title=_get(payload, "$.item_name"),
        currency=_or(_get(payload, "$.currency"), F.lit("GBP")),
        color=_get(payload, "$.item_colour"),
        image_url=image,
        product_url=product_url,
        category_level_1=_get(payload, "$.item_category"),
        category_level_2=_get(payload, "$.item_category2"),
        brand=_get(payload, "$.item_brand"),
        sku=_get(payload, "$.item_sku"),
    )


def _first_gtm(raw: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(F.trim(text.unescape(raw))), "$.ecommerce.items[0]", "variant")


def gtm_items(page: Page) -> Column:
    """First ecommerce item of each ``data-gtm`` tile; other payloads add unseen ids."""
    html, url = page.html, page.url
    tiles = F.transform(
        _tiles(html, "data-gtm"),
        lambda c: F.struct(
            _first_gtm(H.attribute(F.regexp_extract(c, r"(?s)^<[^>]*>", 0), "data-gtm")).alias("g"),
            H.attribute(_tag_with_class(c, "img", "tile-image"), "srcset").alias("srcset"),
            H.attribute(_tag_with_class(c, "img", "tile-image"), "src").alias("src"),
            _or(
                H.attribute(_tag_with_class(c, "[a-z]+", "tile-image-wrapper-link"), "href"),
                H.attribute(F.regexp_extract(c, r"(?is)<a\b[^>]*\shref\s*=[^>]*>", 0), "href"),
            ).alias("href"),
        ),
    )
    tiles = F.filter(tiles, lambda t: t["g"].isNotNull())

    def from_tile(t: Column) -> Column:
        return _gtm_item(
            t["g"],
            F.coalesce(F.when(t["srcset"] != "", text.best_srcset_url(t["srcset"])), text.unescape(t["src"])),
            F.when(t["href"] != "", _once(text.unescape(t["href"]), lambda ref: urls.resolve(url, ref))),
            "gtm_tile",
        )

    raw = F.regexp_extract_all(html, F.lit(r"(?s)data-gtm=(\"[^\"]*\"|'[^']*')"), 1)
    payloads = F.filter(F.transform(raw, lambda r: F.try_parse_json(F.trim(text.unescape(F.substr(r, F.lit(2), F.length(r) - 2))))), lambda v: v.isNotNull())

    def extra(tiles: Column, payloads: Column) -> Column:
        first = F.filter(F.transform(payloads, lambda v: F.try_variant_get(v, "$.ecommerce.items[0]", "variant")), lambda g: g.isNotNull())
        unseen = _once(
            F.transform(tiles, lambda t: _get(t["g"], "$.item_id")),
            lambda seen: F.filter(first, lambda g: _once(_get(g, "$.item_id"), lambda key: (key == "") | ~F.array_contains(seen, key))),
        )
        return F.transform(unseen, lambda g: _gtm_item(g, F.lit(None).cast("string"), F.lit(None).cast("string"), "gtm_text"))

    def items(tiles: Column, payloads: Column) -> Column:
        return _once(F.transform(tiles, from_tile), lambda own: F.when(F.size(tiles) < F.size(payloads), F.concat(own, extra(tiles, payloads))).otherwise(own))

    return _finish(_once(tiles, lambda t: _once(payloads, lambda p: items(t, p))))


def _tile_item(url: Column):
    def build(c: Column) -> Column:
        name = rf"(?is)<[a-z][^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?{{}}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</"
        in_link = r"(?is)\bpdp-link\b[^>]*>.*?(<a\b[^>]*>)(.*?)</a"
        a_link = r"(?is)<a\b[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?link(?:\s[^\"']*)?[\"'][^>]*>(.*?)</a"
        value = r"(?is)\bprice\b[^>]*>.*?\b{}[\"'\s][^>]*>.*?(<[a-z][^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?value(?:\s[^\"']*)?[\"'][^>]*>)"
        title = _or(
            text.clean_text(F.regexp_extract(c, name.format("product-tile__name"), 1)),
            text.clean_text(F.regexp_extract(c, in_link, 2)),
            text.clean_text(F.regexp_extract(c, a_link, 1)),
        )
        price = H.attribute(F.regexp_extract(c, value.format("sales"), 1), "content")
        in_image = r"(?is)\bproduct-tile__image\b[^>]*>.*?(<img\b[^>]*>)"
        image = _or(H.attribute(F.regexp_extract(c, in_image, 1), "src"), H.attribute(_tag_with_class(c, "img", "tile-image"), "src"))
        href = _or(
            H.attribute(F.regexp_extract(c, in_link, 1), "href"),
            H.attribute(F.regexp_extract(c, r"(?is)<a\b[^>]*\shref\s*=[^>]*>", 0), "href"),
        )
        return _item(
            "tile",
            price,
            title=title,
            currency=F.lit("USD"),
            image_url=image,
            product_url=_once(href, lambda ref: F.when(ref != "", urls.resolve(url, ref))),
            sku=H.attribute(F.regexp_extract(c, r"(?s)^<[^>]*>", 0), "data-pid"),
        )

    return build


def _impression(v: Column) -> Column:
    both = lambda name: _or(_get(v, f"$.{name}"), _get(v, f"$.product_{name}"))
    return _item(
        "tile_script",
        both("price"),
        title=both("name"),
        currency=_or(_get(v, "$.currency"), F.lit("USD")),
        image_url=both("image"),
        product_url=both("url"),
        category_level_1=both("category"),
        sku=both("id"),
    )


def tile_items(page: Page) -> Column:
    """Product tiles with a product id; without any, the impression arrays of scripts."""
    html, url = page.html, page.url
    tiles = F.transform(_tiles(html, "data-pid"), _tile_item(url))
    arrays = F.regexp_extract_all(html, F.lit(r"(?s)productImpressions\s*=\s*(\[.*?\]);"), 1)
    products = F.flatten(F.transform(arrays, lambda a: F.coalesce(F.try_variant_get(F.try_parse_json(text.unescape(a)), "$", "array<variant>"), _none())))
    return _finish(_once(tiles, lambda t: F.when(F.size(t) > 0, t).otherwise(F.transform(products, _impression))))


# ---------------------------------------------------------------- hydration data
_FED = "serverSideGqlResponseFed.productPageData.search.results.products"


def wall_products(v: Column) -> Column:
    groups = F.when(
        F.try_variant_get(v, "$.props.pageProps.initialState.Wall", "variant").isNotNull(),
        _list(v, "$.props.pageProps.initialState.Wall.productGroupings"),
    ).otherwise(_list(v, "$.Wall.productGroupings"))
    return F.flatten(F.transform(groups, lambda g: _list(g, "$.products")))


def wall_items(page: Page, brand: str = "") -> Column:
    def build(p: Column) -> Column:
        parts = F.filter(F.array(_get(p, "$.copy.title"), _get(p, "$.copy.subTitle")), lambda t: t != "")
        return _item(
            "hydration_wall",
            _get(p, "$.prices.currentPrice"),
            title=F.array_join(parts, " - "),
            currency=_get(p, "$.prices.currency"),
            color=_get(p, "$.displayColors.colorDescription"),
            image_url=_get(p, "$.colorwayImages.portraitURL"),
            product_url=_get(p, "$.pdpUrl.url"),
            category_level_1=_get(p, "$.productType"),
            brand=F.lit(brand),
            sku=_get(p, "$.productCode"),
        )

    return _finish(F.transform(wall_products(page.hyd), build))


def graphql_products(v: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(v, "$.products", "array<variant>"),
        F.try_variant_get(v, f"$.props.pageProps.{_FED}", "array<variant>"),
        F.try_variant_get(v, f"$.{_FED}", "array<variant>"),
        _none(),
    )


def graphql_items(page: Page, image_template: str = "{assetId}") -> Column:
    before, _, after = image_template.partition("{assetId}")

    def build(p: Column) -> Column:
        asset, seo = _get(p, "$.variants[0].mediaAssets[0].assetId"), _get(p, "$.seoPath")
        return _item(
            "hydration_graphql",
            _get(p, "$.price.listPrice.amount"),
            title=_get(p, "$.title"),
            currency=_get(p, "$.price.currency"),
            color=urls.query_value(seo, "color"),
            size=_get(p, "$.variants[0].size"),
            description=_get(p, "$.description"),
            image_url=F.when(asset != "", F.concat(F.lit(before), asset, F.lit(after))),
            product_url=F.when(seo != "", urls.resolve(page.url, seo)),
            category_level_1=_get(p, "$.productDefinition"),
            brand=_get(p, "$.brand"),
            sku=_get(p, "$.variants[0].skuId"),
        )

    return _finish(F.transform(graphql_products(page.hyd), build))


# ---------------------------------------------------------------- shop grid
def grid_products(page: Page) -> Column:
    """Products of a JSON body, else of the analytics object or array in the page text."""
    html, body = page.html, page.body
    meta = F.try_parse_json(text.unescape(F.nullif(F.regexp_extract(html, r"(?s)\.analytics\.meta\.product\s*=\s*(\{.*?\});", 1), F.lit(""))))
    in_text = F.try_parse_json(text.unescape(F.nullif(F.regexp_extract(html, r"(?s)\"products\"\s*:\s*(\[.*?\])\s*[,}]", 1), F.lit(""))))
    return F.coalesce(
        F.try_variant_get(body, "$.products", "array<variant>"),
        F.when(meta.isNotNull(), F.array(meta)),
        F.try_variant_get(in_text, "$", "array<variant>"),
        _none(),
    )


def grid_items(page: Page) -> Column:
    host = urls.netloc(page.url)

    def option(p: Column, name: str) -> Column:
        hits = F.filter(_list(p, "$.options"), lambda o: (F.lower(_get(o, "$.name")) == name) & (_get(o, "$.values[0]") != ""))
        return _get(F.get(hits, F.lit(0)), "$.values[0]")

    def build(p: Column) -> Column:
        was, now = _get(p, "$.variants[0].compare_at_price"), _get(p, "$.variants[0].price")
        higher = text.number_or_none(was) > F.coalesce(text.number_or_none(now), F.lit(0.0))
        handle = _get(p, "$.handle")
        return _item(
            "shop_grid",
            F.when(higher, was).otherwise(now),
            title=_get(p, "$.title"),
            currency=F.lit("USD"),
            color=option(p, "color"),
            size=option(p, "size"),
            description=_get(p, "$.body_html"),
            image_url=_or(_get(p, "$.image.src"), _get(p, "$.images[0].src")),
            product_url=F.when(handle != "", F.concat(F.lit("https://"), host, F.lit("/products/"), handle)),
            category_level_1=_get(p, "$.product_type"),
            brand=_get(p, "$.vendor"),
            sku=_get(p, "$.variants[0].sku"),
        )

    return _finish(F.transform(grid_products(page), build))


# ---------------------------------------------------------------- jobs
EXTRACTORS = {
    "gtm_tiles": gtm_items,
    "jsonld_product": jsonld_items,
    "jsonld_itemlist": jsonld_items,
    "hydration_wall": wall_items,
    "hydration_graphql": graphql_items,
    "tiles": tile_items,
    "shop_grid_text": grid_items,
    "shop_grid": grid_items,
}


def explode_items(pages: DataFrame, items: Column) -> DataFrame:
    return pages.select("page_id", F.posexplode(items).alias("item_no", "_i")).select(
        "page_id", "item_no", *[F.col(f"_i.{f}").alias(f) for f in (*_STRINGS[:-1], "highest_price", "evidence")]
    )


def extract_items(pages: DataFrame, strategy: str) -> DataFrame:
    """Items of one extractor over a page table."""
    return explode_items(parse_pages(pages), EXTRACTORS[strategy](Page()))


def _detected(page: Page) -> dict[str, Column]:
    """Which extractors have something to look at on a page."""
    html, markup = page.html, ~page.is_json
    walked = F.flatten(F.transform(page.ld, lambda o: F.concat(F.array(o), F.coalesce(F.try_variant_get(o, "$['@graph']", "array<variant>"), _none()))))
    has = lambda p, key: F.try_variant_get(p, f"$.{key}", "variant").isNotNull()
    grid_like = F.exists(
        F.coalesce(F.try_variant_get(page.body, "$.products", "array<variant>"), _none()),
        lambda p: has(p, "handle") | (has(p, "variants") & (has(p, "vendor") | has(p, "product_type"))),
    )
    fed = [F.try_variant_get(page.hyd, f"$.{prefix}{_FED}", "array<variant>") for prefix in ("props.pageProps.", "")]
    return {
        "gtm_tiles": markup & html.rlike(r"(?is)<[a-z][^>]*\sdata-gtm\s*="),
        "jsonld_product": F.exists(walked, lambda o: _type(o) == "Product"),
        "jsonld_itemlist": F.exists(walked, lambda o: _type(o) == "ItemList"),
        "hydration_wall": F.size(wall_products(page.hyd)) > 0,
        "hydration_graphql": F.coalesce(*fed).isNotNull(),
        "tiles": markup & ((F.size(_tiles(html, "data-pid")) > 0) | F.contains(html, F.lit("productImpressions"))),
        "shop_grid_text": markup & (F.contains(html, F.lit(".analytics.meta.product")) | html.rlike(r"\"products\"\s*:\s*\[")),
        "shop_grid": grid_like,
    }


_SHARED = {"jsonld_itemlist": "jsonld_product", "shop_grid_text": "shop_grid"}


def _trial_run(pages: DataFrame) -> DataFrame:
    """Flags, items of the flagged extractors and the ranked candidates of each page."""
    flagged = parse_pages(pages).withColumns({f"_f_{k}": v for k, v in _detected(Page()).items()})
    wanted: dict[str, Column] = {}
    for name, _ in rules.STRATEGY_PRIORS:
        owner = _SHARED.get(name, name)
        flag = F.coalesce(F.col(f"_f_{name}"), F.lit(False))
        wanted[owner] = wanted[owner] | flag if owner in wanted else flag
    ran = flagged.withColumns({f"_i_{k}": F.when(w, EXTRACTORS[k](Page())).otherwise(no_items()) for k, w in wanted.items()})
    rows = []
    for order, (name, prior) in enumerate(rules.STRATEGY_PRIORS):
        n = F.size(F.col(f"_i_{_SHARED.get(name, name)}"))
        sure = F.when(n > 0, F.least(F.lit(0.98), prior + F.least(F.lit(0.18), n * 0.03))).otherwise(max(0.05, prior - 0.25))
        row = F.struct(
            F.when(n > 0, 0).otherwise(1).alias("empty"),
            (-F.round(sure, 4)).alias("neg"),
            F.lit(order).alias("ord"),
            F.lit(name).alias("strategy"),
            n.alias("items"),
        )
        rows.append(F.when(F.col(f"_f_{name}"), row))
    return ran.withColumn("_ranked", F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def detect_contracts(pages: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Ranked extractor candidates per page with confidence after a trial run; all of them unless a number is asked for."""
    ranked = F.slice("_ranked", 1, max_candidates) if max_candidates else F.col("_ranked")
    return _trial_run(pages).select("page_id", F.posexplode(ranked).alias("rank", "_c")).select(
        "page_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("_c.strategy").alias("strategy"),
        (-F.col("_c.neg")).alias("confidence"),
        F.col("_c.items").alias("items"),
    )


def with_best_contract(pages: DataFrame) -> DataFrame:
    best = F.get("_ranked", F.lit(0))
    return _trial_run(pages).select(*pages.columns, best["strategy"].alias("strategy"))


def extract_by_contract(pages: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Items by the extractor named in each row; an unknown name fails the job."""
    name = F.col(strategy)
    chosen = F.when(name.isNull(), no_items())
    for key, extractor in EXTRACTORS.items():
        if key not in _SHARED:
            names = [key, *[n for n, owner in _SHARED.items() if owner == key]]
            chosen = chosen.when(name.isin(*names), extractor(Page()))
    chosen = chosen.otherwise(F.raise_error(F.concat(F.lit("unsupported extraction strategy: "), name)).cast(_ITEM_TYPE))
    return explode_items(parse_pages(pages), chosen)


def extract_best(pages: DataFrame) -> DataFrame:
    """Items by the best contract of each page; the trial run's items are used as they are."""
    ran = _trial_run(pages).withColumn("strategy", F.get("_ranked", F.lit(0))["strategy"])
    chosen = F.when(F.col("strategy").isNull(), no_items())
    for key in EXTRACTORS:
        chosen = chosen.when(F.col("strategy") == key, F.col(f"_i_{_SHARED.get(key, key)}"))
    return explode_items(ran, chosen)


def missing_reasons(items: DataFrame, keys: tuple[str, ...] = ("page_id", "item_no")) -> DataFrame:
    """One row per empty field of an item with the reason why it is empty."""
    family = {"gtm_tile": "gtm_tiles", "gtm_text": "gtm_tiles", "tile": "tiles", "tile_script": "tiles_script"}
    kinds = ("gtm_tile", "gtm_text", "hydration_wall", "hydration_graphql", "jsonld", "shop_grid", "tile", "tile_script")
    entries = []
    for name in rules.ITEM_FIELDS:
        reason = F.lit(rules.MISSING_DEFAULT)
        for kind in kinds:
            special = rules.MISSING_BY_STRATEGY[family.get(kind, kind)].get(name)
            if special:
                reason = F.when(F.col("evidence") == kind, special).otherwise(reason)
        empty = F.col(name).isNull() if name == "highest_price" else F.coalesce(F.col(name), F.lit("")) == ""
        entries.append(F.when(empty, F.struct(F.lit(name).alias("field"), reason.alias("reason"))))
    return items.select(*keys, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def page_meta_fields(pages: DataFrame) -> DataFrame:
    """Fallback product fields: ld+json first, then meta tags, headings and marked-up spans."""
    h, u = F.col("html"), F.col("url")

    def walk(v: Column) -> Column:
        """Product objects below graph and list keys, two levels down."""
        one = lambda x: F.flatten(F.array(*[_list(x, p) for p in ("$['@graph']", "$.graph", "$.itemListElement")]))
        level1 = F.flatten(F.transform(v, one))
        level2 = F.flatten(F.transform(level1, one))
        every = F.concat(v, level1, level2)
        return F.filter(every, lambda o: F.exists(F.concat(_list(o, "$['@type']"), _list(o, "$.type")), lambda t: F.lower(_get(t, "$")) == "product"))

    staged = pages.select("page_id", "url", "html", F.get(F.filter(walk(jsonld_objects(h)), lambda p: _get(p, "$.name") != ""), F.lit(0)).alias("_p"))
    p = F.col("_p")
    body = H.without_scripts(h)
    price_tag = F.regexp_extract(h, r"(?is)<[a-z][^>]*\sitemprop\s*=\s*[\"']price[\"'][^>]*>", 0)
    currency_tag = F.regexp_extract(h, r"(?is)<[a-z][^>]*\sitemprop\s*=\s*[\"']priceCurrency[\"'][^>]*>", 0)
    price_text = text.clean_text(F.regexp_extract(body, r"(?is)<[a-z][^>]*\sclass\s*=\s*[\"'][^\"']*price[^\"']*[\"'][^>]*>(.*?)</", 1))
    image = _or(F.coalesce(F.try_variant_get(p, "$.image[0]", "string"), F.when(F.try_variant_get(p, "$.image", "array<variant>").isNull(), _get(p, "$.image"))), text.unescape(H.meta_content(h, "og:image")), text.unescape(H.meta_content(h, "twitter:image")))
    return staged.select(
        "page_id",
        _or(_get(p, "$.name"), text.squash(text.unescape(H.meta_content(h, "og:title"))), text.squash(text.unescape(H.meta_content(h, "twitter:title"))), H.first_text(body, "h1"), H.first_text(h, "title")).alias("title"),
        _or(_get(p, "$.description"), text.squash(text.unescape(H.meta_content(h, "description"))), text.squash(text.unescape(H.meta_content(h, "og:description")))).alias("description"),
        F.when(image != "", urls.resolve(u, image)).alias("image_url"),
        _or(_offer(p, "highPrice"), _offer(p, "price"), H.meta_content(h, "product:price:amount"), H.attribute(price_tag, "content"), price_text).alias("price_text"),
        _or(_offer(p, "priceCurrency"), H.meta_content(h, "product:price:currency"), H.attribute(currency_tag, "content")).alias("currency"),
    )


# ---------------------------------------------------------------- API hints and scripts
def page_api_candidates(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """API-like strings of each page, resolved, without trackers, scored and ranked; ``limit`` keeps the best of a page."""
    found = F.regexp_extract_all(F.col("html"), F.lit("(?i)" + rules.API_HINT), 1)
    full = F.filter(
        F.array_distinct(F.transform(F.array_distinct(found), lambda x: urls.resolve(F.col("url"), x))),
        lambda x: ~urls.is_tracking_url(x),
    )

    def points(x: Column) -> Column:
        low = F.lower(x)
        return (
            F.when(F.contains(low, F.lit("api")), 20).otherwise(0)
            + F.when(F.contains(low, F.lit("graphql")), 18).otherwise(0)
            + F.when(urls.has_token(low, ("product", "catalog", "items", "search")), 12).otherwise(0)
            + F.when(urls.has_token(low, ("page", "offset", "limit")), 4).otherwise(0)
        )

    ranked = F.array_sort(F.transform(full, lambda x, i: F.struct((-points(x)).alias("neg"), i.alias("i"), x.alias("u"))))
    return pages.select("page_id", "url", F.posexplode(F.slice(ranked, 1, limit) if limit else ranked).alias("n", "_r")).select(
        "page_id", (F.col("n") + 1).alias("rank"), F.col("_r.u").alias("api_url"), (-F.col("_r.neg")).alias("score")
    )


def script_inventory(pages: DataFrame) -> DataFrame:
    """One row per script of a page: source, size, findings and score, ranked per page."""
    listed = pages.select("page_id", "url", F.posexplode(H.scripts(F.col("html"))).alias("script_no", "_s"))
    # tag, source and lower-cased body are named often below, so each is a column of its own step
    listed = listed.withColumn("_tag", H.script_tag(F.col("_s"))).withColumn("_src", F.trim(text.unescape(H.attribute(F.col("_tag"), "src"))))
    src = F.col("_src")
    staged = listed.select(
        "page_id",
        "script_no",
        F.when(src != "", urls.resolve(F.col("url"), src)).otherwise("").alias("script_url"),
        H.attribute(F.col("_tag"), "type").alias("type_attr"),
        (src == "").alias("is_inline"),
        F.when(src == "", F.trim(H.script_body(F.col("_s")))).otherwise("").alias("_js"),
    )
    js = F.col("_js")
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")) for w, c in rules.SCRIPT_KEYWORDS])
    listed_words = _once(F.lower(js), lambda low: F.filter(words, lambda k: F.contains(low, k["w"])))
    by_pattern = [
        F.transform(F.regexp_extract_all(js, F.lit(f"({p})"), 1), _word_in(c)) for p, c in rules.SCRIPT_PATTERNS
    ]
    graphql = F.concat(*[F.regexp_extract_all(js, F.lit(p), 1) for p in rules.SCRIPT_GRAPHQL])
    endpoints = F.filter(F.regexp_extract_all(js, F.lit(rules.SCRIPT_ENDPOINT), 1), lambda e: ~F.startswith(e, F.lit("data:")))
    found = staged.withColumns(
        {
            "endpoints": F.array_distinct(endpoints),
            "keywords": F.array_distinct(F.concat(listed_words, *by_pattern)),
            "graphql": F.array_distinct(graphql),
            "websockets": F.array_distinct(F.regexp_extract_all(js, F.lit(rules.SCRIPT_WEBSOCKET), 1)),
            "sourcemaps": F.array_distinct(F.regexp_extract_all(js, F.lit(rules.SCRIPT_SOURCEMAP), 1)),
            "size": F.length(js),
        }
    )
    cats = F.col("keywords.c")
    score = F.lit(0)
    for name, points in rules.SCRIPT_CATEGORY_POINTS:
        score = score + F.when(F.array_contains(cats, name), points).otherwise(0)
    has_map = F.size("sourcemaps") > 0
    score = (
        score
        + F.least(F.size("endpoints") * 8, F.lit(40))
        + F.least(F.size("graphql") * 15, F.lit(45))
        + F.least(F.size("websockets") * 12, F.lit(36))
        + F.when(has_map, 15).otherwise(0)
        + F.when(F.col("type_attr") == "module", 3).otherwise(0)
        + F.when(F.col("is_inline") & (F.col("size") > 100), 2).otherwise(0)
    )
    return found.withColumns({"score": score, "categories": F.array_sort(F.array_distinct(cats))}).drop("_js")


def _word_in(category: str):
    return lambda w: F.struct(F.lower(w).alias("w"), F.lit(category).alias("c"))


def script_inventory_summary(inventory: DataFrame) -> DataFrame:
    """Corpus totals; distinct values are counted after a partial, shuffled dedupe."""
    totals = inventory.agg(F.count("*").alias("total_scripts"), F.count_if(F.col("score") > 0).alias("scored_scripts"))
    values = inventory.select(
        F.inline(
            F.concat(
                F.transform("endpoints", lambda x: F.struct(F.lit("distinct_endpoints").alias("metric"), x.alias("v"))),
                F.transform("keywords", lambda x: F.struct(F.lit("distinct_keywords").alias("metric"), x["w"].alias("v"))),
                F.transform("graphql", lambda x: F.struct(F.lit("distinct_graphql").alias("metric"), x.alias("v"))),
                F.transform("websockets", lambda x: F.struct(F.lit("distinct_websockets").alias("metric"), x.alias("v"))),
                F.transform("sourcemaps", lambda x: F.struct(F.lit("distinct_sourcemaps").alias("metric"), x.alias("v"))),
            )
        )
    )
    distinct = values.groupBy("metric").agg(F.count_distinct("v").alias("value"))
    stacked = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns])))
    return stacked.unionByName(distinct)


# ---------------------------------------------------------------- staged tasks
def list_detail_variant_tasks(list_pages: DataFrame, detail_pages: DataFrame, variant_class: str = "variant-link") -> DataFrame:
    """Detail tasks found on list pages and variant tasks found on their detail pages.

    A task is kept once per (kind, url) with its smallest parent; both dedupes are
    aggregations, so repeated targets are combined before the shuffle.  Detail tasks are
    written once for both uses.
    """

    def anchors(html: Column, url: Column) -> Column:
        return F.transform(
            H.opening_tags(H.without_scripts(html), "a"),
            lambda t: F.struct(
                urls.resolve(url, text.unescape(H.attribute(t, "href"))).alias("url"),
                H.attribute(t, "class").alias("cls"),
                H.attribute(t, "data-color").alias("color"),
                H.attribute(t, "href").alias("href"),
            ),
        )

    listed = list_pages.select(F.col("url").alias("parent_url"), F.inline(anchors(F.col("html"), F.col("url"))))
    details = (
        listed.where((F.col("href") != "") & ~F.contains("cls", F.lit(variant_class)))
        .select("parent_url", F.regexp_extract("url", r"^[^#]*", 0).alias("url"))
        .where(urls.url_kind(F.col("url")) == "detail")
        .groupBy("url")
        .agg(F.min("parent_url").alias("parent_url"))
    )
    details = materialize(details, "details")
    bodies = detail_pages.select(F.col("detail_url").alias("url"), F.inline(anchors(F.col("html"), F.col("detail_url"))).alias("v_url", "v_cls", "v_color", "v_href"))
    variants = (
        bodies.where((F.col("v_href") != "") & F.contains("v_cls", F.lit(variant_class)))
        # estimates know neither the links of a page nor how well addresses compress, so no side is sent to the driver
        .join(details.select("url").hint("merge"), "url", "left_semi")
        .groupBy(F.col("v_url"))
        .agg(F.min("url").alias("parent_url"), F.max("v_color").alias("color"))
    )
    return details.select(F.lit("detail_page").alias("kind"), "url", F.lit(1).alias("depth"), "parent_url", F.lit("").alias("color")).unionByName(
        variants.select(F.lit("variant_page").alias("kind"), F.col("v_url").alias("url"), F.lit(2).alias("depth"), "parent_url", "color")
    )
