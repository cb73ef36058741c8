"""Literal cases for URL forms, prices, text, images and keys."""

import hashlib

import pytest
from pyspark.sql import functions as F

from harvestlake.functions import text, urls


def one(spark, expr, **values):
    """Value of an expression over one row of string columns."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("€64,95", 64.95), ("1.299,95", 1299.95), ("129,99 zł", 129.99), ("Free", 0.0), ("€49.99 - €99.99", 99.99), ("-5", -5.0),
        ("ask in store", None), ("", None), (None, None), ("1,299.95", 1299.95), ("1 299,95", 299.95), ("13–26", 26.0), ("GRATIS", 0.0),
    ],
)
def test_parse_price(spark, raw, want):
    assert one(spark, text.parse_price(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("13 - 26", 13.0), ("9,50", 9.5), ("none", None)])
def test_lowest_price(spark, raw, want):
    assert one(spark, text.parse_lowest_price(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("£13 - £26", 13.0), ("10 to 20", 10.0), ("abc 12,5", 12.5), ("x", None)])
def test_number_or_none(spark, raw, want):
    assert one(spark, text.number_or_none(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    "base, ref, want",
    [
        ("https://a.example/x/y", "../z?q=1#f", "https://a.example/z?q=1#f"),
        ("https://a.example/x/y", "z", "https://a.example/x/z"),
        ("https://a.example", "z", "https://a.example/z"),
        ("https://a.example/x?p=1", "?p=2", "https://a.example/x?p=2"),
        ("https://a.example/x/", "./k/../m", "https://a.example/x/m"),
        ("https://a.example/x", "//b.example/y", "https://b.example/y"),
        ("https://a.example/x", "mailto:a@b.c", "mailto:a@b.c"),
        ("https://a.example/a/b/", "..", "https://a.example/a/"),
    ],
)
def test_resolve(spark, base, ref, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("r")), b=base, r=ref) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTPS://A.Example/P;v=1?b=2&a=1#x", "https://a.example/P?a=1&b=2"),
        ("https://a.example", "https://a.example/"),
        ("https://a.example/?q=a b&c", "https://a.example/?c=&q=a+b"),
        ("https://a.example/?x=%zz", "https://a.example/?x=%25zz"),
        ("https://a.example/?t=~*", "https://a.example/?t=~%2A"),
    ],
)
def test_request_form(spark, raw, want):
    assert one(spark, urls.request_form(F.col("u")), u=raw) == want


def test_product_form(spark):
    assert one(spark, urls.product_form(F.col("u"), F.lit("https://s.example/x"), keep_query=True), u="/p/1?b=2&a=1") == "https://s.example/p/1?a=1&b=2"
    assert one(spark, urls.product_form(F.col("u"), F.lit("https://s.example/")), u="/p/1/?b=2") == "https://s.example/p/1"


@pytest.mark.parametrize("raw, want", [(" https://a.example/P?b=1#x ", "https://a.example/P?b=1#x"), ("ftp://a.example/", None), ("https:///x", None)])
def test_frontier_form(spark, raw, want):
    assert one(spark, urls.frontier_form(F.col("u")), u=raw) == want


def test_discovered_form(spark):
    assert one(spark, urls.discovered_form(F.col("r"), F.col("b")), r="/P/1?x=1#frag", b="https://Shop.Example/c") == "https://shop.example/P/1?x=1"
    assert one(spark, urls.discovered_form(F.col("r"), F.col("b")), r="javascript:void(0)", b="https://s.example/") == ""


def test_set_and_read_query_params(spark):
    u = "https://a.example/x?page=3&k=v"
    assert one(spark, urls.set_query_params(F.col("u"), {"page": F.lit(4), "z": F.lit("n")}), u=u) == "https://a.example/x?page=4&k=v&z=n"
    assert one(spark, urls.int_query_value(F.col("u"), "page", 1), u=u) == 3
    assert one(spark, urls.int_query_value(F.col("u"), "size", 9), u=u) == 9


def test_fingerprint_is_sha_of_compact_json(spark):
    raw = '{"data":null,"json":null,"method":"GET","url":"https://a.example/x?a=1"}'
    got = one(spark, urls.request_fingerprint(F.lit("get"), urls.request_form(F.col("u"))), u="https://A.example/x?a=1#f")
    assert got == hashlib.sha256(raw.encode()).hexdigest()


@pytest.mark.parametrize(
    "raw, want",
    [("https://a.b/api/x", "api"), ("https://a.b/x.json", "api"), ("https://a.b/products/1", "detail"), ("https://a.b/collections/s", "category"), ("https://a.b/search?q=1", "list"), ("https://a.b/about", "page")],
)
def test_url_kind(spark, raw, want):
    assert one(spark, urls.url_kind(F.col("u")), u=raw) == want


def test_predicates(spark):
    ok = "https://shop.example/produkt/rower-12.html"
    assert one(spark, urls.is_product_link(F.col("u"), F.lit("")), u=ok)
    assert not one(spark, urls.is_product_link(F.col("u"), F.lit("price")), u="https://shop.example/cart")
    assert one(spark, urls.is_catalog_url(F.col("u"), F.lit("Bikes")), u="https://shop.example/x")
    assert not one(spark, urls.is_catalog_url(F.col("u"), F.lit("Help")), u="https://shop.example/category/x")
    assert one(spark, urls.is_tracking_url(F.col("u")), u="https://stats.example/collect")
    assert one(spark, urls.is_asset_path(F.col("u")), u="/x/a.WOFF2")
    assert one(spark, urls.label_from_url(F.col("u")), u="https://s.example/a/mens-road_bikes.html") == "mens road bikes"


def test_categories_and_lists(spark):
    assert one(spark, text.category_levels(F.col("x")), x="A > B / C | D") == ["A", "B", "C > D"]
    assert one(spark, text.category_levels(F.col("x")), x="") == ["", "", ""]
    assert one(spark, text.image_list_split(F.col("x")), x='["a.jpg", " b.jpg "]') == ["a.jpg", "b.jpg"]
    assert one(spark, text.image_list_split(F.col("x")), x="a|b,c") == ["a", "b,c"]
    assert one(spark, text.image_list_split(F.col("x")), x="[broken") == ["[broken"]


def test_images(spark):
    images = F.array(*map(F.lit, ["/a.jpg?x=1", "/a.jpg?x=2", "data:abc", "/logo.png", "/media/catalog/product/1/2/a.jpg", "https://cdn.example/z/media/catalog/product/1/2/a.jpg"]))
    got = one(spark, text.clean_product_images(images, F.col("b")), b="https://s.example/p")
    assert got == ["https://s.example/a.jpg?x=1", "https://s.example/media/catalog/product/1/2/a.jpg"]


@pytest.mark.parametrize("raw, want", [("a.jpg 200w, b.jpg 800w, c.jpg 2x", "c.jpg"), ("a.jpg 1x, b.jpg 1x", "a.jpg"), ("a.jpg, b.jpg?width=900", "b.jpg?width=900")])
def test_srcset(spark, raw, want):
    assert one(spark, text.best_srcset_url(F.col("x")), x=raw) == want


def test_keys_and_names(spark):
    want = hashlib.sha256(b"s|c|https://u").hexdigest()[:32]
    key = text.product_dedupe_key(F.lit("s"), F.lit("c"), F.lit(""), F.col("u"), F.lit("t"))
    assert one(spark, key, u="https://u") == want
    assert one(spark, text.normalize_field_name(F.col("x")), x=" 价格 ") == "highest_price"
    assert one(spark, text.normalize_field_name(F.col("x")), x="Brand Name!") == "brand_name"
    assert one(spark, text.stable_node_id(F.array(F.lit("A"), F.lit("B")), F.col("u")), u="/x") == hashlib.sha1(b"A > B|/x").hexdigest()[:16]


def test_redaction(spark):
    got = one(spark, text.redact_text(F.col("x")), x="see http://u:p@h:80/x now, token=abc password: hunter2")
    assert got == "see [redacted_url] now, token=[redacted] password=[redacted]"
    assert one(spark, text.redact_preview(F.col("x")), x='{"token": "abc", "k": 1}').startswith('{"token": "[REDACTED]')
    assert one(spark, text.redact_endpoint(F.col("x")), x="http://u:p@H.example:80/a") == "http://***:***@h.example:80/a"
    assert one(spark, text.redact_endpoint(F.col("x")), x="http://h.example/a") == "http://h.example/a"
    want = hashlib.sha256(b"http://h.example:80/a").hexdigest()[:16]
    assert one(spark, text.endpoint_id(F.col("x")), x="http://u:p@H.example:80/a") == want


@pytest.mark.parametrize("raw, want", [("<p>A  <b>x</b></p>&amp; y", "A x & y"), ("", "")])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text(F.col("x")), x=raw) == want
