"""Prices, text, categories, images, keys and redaction as Column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestlake import rules
from harvestlake.functions import urls


# ---------------------------------------------------------------- prices
_NUMBER = r"(-?\d+(?:[.,]\d{3})*(?:[.,]\d{1,2})?|-?\d+)"
_DASHES = "-–—~"
_RANGE = r"(?s)^(.*?)(\d[\d.,]*)\s*[-–—~]\s*(\d[\d.,]*)"
# the look ahead passes over characters that begin no token
_TOKENS = f"(?iu)(?=[{''.join(sorted({re.escape(t[0].lower()) for t in rules.CURRENCY_TOKENS}))}])(?:{'|'.join(re.escape(t) for t in rules.CURRENCY_TOKENS)})"


def _as_number(x: Column) -> Column:
    """One match of ``_NUMBER`` as a double, whichever separators it uses.

    A match ends in a digit and only its last group may be shorter than three digits, so plain text functions tell the cases apart.
    """
    comma, dot = F.contains(x, F.lit(",")), F.contains(x, F.lit("."))
    no_dot = F.replace(x, F.lit("."), F.lit(""))
    no_comma = F.replace(x, F.lit(","), F.lit(""))
    tail = F.substring_index(x, ",", -1)
    head = F.substr(no_comma, F.lit(1), F.length(no_comma) - F.length(tail))
    text = (
        F.when(comma & dot, F.when(F.contains(tail, F.lit(".")), no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit("."))))
        .when(comma, F.when(F.length(tail) <= 2, F.concat(head, F.lit("."), tail)).otherwise(no_comma))
        .when(dot & ((F.length(no_dot) < F.length(x) - 1) | (F.substring(x, -4, 1) == ".")), no_dot)
        .otherwise(x)
    )
    return text.try_cast("double")


def _price_numbers(text: Column) -> Column:
    plain = F.regexp_replace(text, _TOKENS, " ")

    def split(t: Column) -> Column:
        dash = functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(d)) for d in _DASHES])
        return F.when(dash, F.regexp_replace(t, _RANGE, "$1$2 $3")).otherwise(t)

    # as the only element of an array the text is made once; without a dash there is no range to look for
    numbers = F.transform(F.regexp_extract_all(F.transform(F.array(plain), split)[0], F.lit(_NUMBER), 1), _as_number)
    return F.filter(numbers, lambda n: n.isNotNull())


def _price(raw: Column, pick) -> Column:
    text = F.trim(raw)
    free = F.lower(text).isin(*rules.FREE_WORDS)
    return F.when(free, F.lit(0.0)).otherwise(pick(_price_numbers(text)))


def parse_price(raw: Column) -> Column:
    """Largest number of a price text; words for free are 0, no number is null."""
    return _price(raw, F.array_max)


def parse_lowest_price(raw: Column) -> Column:
    return _price(raw, F.array_min)


_PRICE_RANGE = r"[£$€¥￥]?\s*(\d+(?:[.,]\d+)?)\s*(?:-|–|—|~|to)\s*[£$€¥￥]?\s*(\d+(?:[.,]\d+)?)"


def _comma_double(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_price_range(raw: Column) -> Column:
    """Struct (min, max) of the first range in the text, null if there is none."""
    a = _comma_double(F.regexp_extract(raw, _PRICE_RANGE, 1))
    b = _comma_double(F.regexp_extract(raw, _PRICE_RANGE, 2))
    return F.when(raw.rlike(_PRICE_RANGE), F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max")))


def number_or_none(raw: Column) -> Column:
    """Range minimum, else the first number of the text."""
    return F.coalesce(parse_price_range(raw)["min"], _comma_double(F.regexp_extract(raw, r"-?\d+(?:[.,]\d+)?", 0)))


def parse_price_first(raw: Column) -> Column:
    return _comma_double(F.regexp_extract(raw, r"\d+(?:[.,]\d+)?", 0))


def clean_price(raw: Column) -> Column:
    """Digits and points only; the text itself if that is no number."""
    return F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("double")


def clean_score(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^\d.]", "").try_cast("double")


# ---------------------------------------------------------------- text
def unescape(text: Column) -> Column:
    """The handful of entities that occur in attribute values; ampersand last."""
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(raw: Column) -> Column:
    """Markup removed, white space collapsed."""
    return squash(unescape(F.regexp_replace(raw, r"(?s)<[^>]*>", " ")))


def _parts(raw: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(raw, pattern), lambda p: F.trim(p)), lambda p: p != "")


def category_levels(raw: Column) -> Column:
    """Array of three levels; the third joins everything below the second."""
    parts = _parts(raw, r"[>/|]")
    rest = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), " > ")
    return F.array(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), rest)


def image_list_split(raw: Column) -> Column:
    """Image urls from a JSON array text or a ``|`` / ``,`` separated text."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    as_json = F.from_json(F.when(F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")), text), "array<string>")
    by_bar, by_comma = _parts(text, r"\|"), _parts(text, ",")
    tidy = F.filter(F.transform(as_json, lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(tidy, F.when(F.contains(text, F.lit("|")), by_bar).otherwise(by_comma))


def image_key(u: Column) -> Column:
    p = F.lower(urls.path(u))
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "/")
    media = F.contains(p, F.lit("media/catalog/product")) & (F.size(parts) >= 2)
    return F.when(media, tail).otherwise(F.concat(urls.domain_of(u), p))


def clean_product_images(images: Column, base: Column, required: tuple[str, ...] = ()) -> Column:
    """Resolved images without data urls and page furniture, first per media key."""

    def wanted(i: Column) -> Column:
        low = F.lower(i)
        ok = (i != "") & ~urls.has_token(low, rules.PRODUCT_IMAGE_NOISE)
        return ok & urls.has_token(low, [r.lower() for r in required]) if required else ok

    kept = F.filter(urls.product_forms(images, base), wanted)
    keyed = F.transform(kept, lambda i: F.struct(image_key(i).alias("k"), i.alias("u")))
    first = F.aggregate(
        keyed,
        F.expr("cast(array() AS array<struct<k:string,u:string>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda a: a["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(first, lambda x: x["u"])


def best_srcset_url(srcset: Column) -> Column:
    """Highest scored candidate of a srcset; the first one wins ties."""
    entries = F.filter(F.transform(F.split(srcset, ","), lambda p: squash(unescape(p))), lambda p: p != "")

    def score(entry: Column) -> Column:
        url = F.substring_index(entry, " ", 1)
        d = F.lower(F.regexp_extract(entry, r"^\S+ (\S+)", 1))
        by_w = F.regexp_extract(d, r"^(.*)w$", 1).try_cast("double")
        by_x = F.regexp_extract(d, r"^(.*)x$", 1).try_cast("double") * 1000
        width = F.regexp_extract(url, r"[?&]width=(\d+)", 1).try_cast("double")
        return F.greatest(F.coalesce(by_w, by_x, F.lit(1.0)), F.coalesce(width, F.lit(-1.0)))

    ranked = F.transform(
        entries, lambda e, i: F.struct(score(e).alias("s"), (-i).alias("o"), F.substring_index(e, " ", 1).alias("u"))
    )
    return F.array_max(ranked)["u"]


# ---------------------------------------------------------------- keys
def product_dedupe_key(site: Column, category: Column, canonical: Column, source: Column, title: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    ident = F.coalesce(filled(canonical), filled(source), filled(title), F.lit(""))
    raw = F.concat_ws("|", F.coalesce(site, F.lit("")), F.coalesce(category, F.lit("")), ident)
    return F.substring(F.sha2(raw, 256), 1, 32)


def stable_node_id(path_parts: Column, url: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.array_join(path_parts, " > "), F.lit("|"), url)), 1, 16)


def normalize_field_name(name: Column) -> Column:
    """Canonical field for a label in any of the known languages."""
    text = F.lower(F.trim(name))
    out = None
    for canonical, aliases in rules.FIELD_ALIASES.items():
        hit = text.isin(*aliases)
        out = F.when(hit, canonical) if out is None else out.when(hit, canonical)
    return out.otherwise(F.trim(F.regexp_replace(text, r"[^a-z0-9_]+", "_"), F.lit("_")))


# ---------------------------------------------------------------- redaction
def redact_text(text: Column) -> Column:
    """URLs and key=value secrets hidden."""
    no_urls = F.regexp_replace(text, "(?i)" + rules.URL_SECRET, "[redacted_url]")
    return F.regexp_replace(no_urls, "(?i)" + rules.KEY_VALUE_SECRET, "$1=[redacted]")


def redact_preview(text: Column) -> Column:
    for word in rules.PREVIEW_SECRETS:
        text = F.regexp_replace(text, f"(?i)({word}[\"'\\s:=]+)[^\\n,;}}\"]*", "$1[REDACTED]")
    return text


def redact_headers(headers: Column) -> Column:
    return F.transform_values(
        headers, lambda k, v: F.when(F.lower(k).isin(*rules.SENSITIVE_HEADERS), "[redacted]").otherwise(v)
    )


def redact_map(values: Column) -> Column:
    """Sensitive keys hidden, every other text value passed through ``redact_text``."""

    def safe(k: Column, v: Column) -> Column:
        low = F.lower(k)
        return (
            F.when(low.isin(*rules.SENSITIVE_KEYS), "[redacted]")
            .when(F.contains(low, F.lit("proxy")), redact_endpoint(v))
            .when(low == "storage_state_path", F.concat(F.lit("[redacted-path]/"), F.substring_index(v, "/", -1)))
            .otherwise(redact_text(v))
        )

    return F.transform_values(values, safe)


def _host_port(u: Column) -> Column:
    """Lower-case host with port, credentials removed."""
    bare = F.regexp_replace(urls.netloc(u), r"^.*@", "")
    return F.regexp_replace(F.lower(bare), r":$", "")


def endpoint_id(u: Column) -> Column:
    canonical = F.concat(urls.scheme(u), F.lit("://"), _host_port(u), urls.path(u))
    return F.when(u == "", "").otherwise(F.substring(F.sha2(canonical, 256), 1, 16))


def redact_endpoint(u: Column) -> Column:
    masked = F.concat(urls.scheme(u), F.lit("://***:***@"), _host_port(u), urls.path(u))
    return F.when(urls.netloc(u).rlike(r"^[^@]*[^@:][^@]*@|^:[^@]+@"), masked).otherwise(u)
