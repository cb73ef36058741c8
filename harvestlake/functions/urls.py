"""URL expressions.  All take and return Columns and stay inside the JVM.

URLs are split with small anchored patterns rather than ``parse_url``, which raises on
the malformed addresses that real pages contain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlake import rules

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/]*)"
_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?"


class Parts:
    """A URL whose parts are already columns, so that each is computed once per row."""

    def __init__(self, name: str):
        self.s, self.h, self.p, self.q, self.f = (F.col(f"{name}_{x}") for x in "shpqf")


Url = Column | Parts


def with_parts(df: DataFrame, u: Column, name: str) -> tuple[DataFrame, Parts]:
    """Add the parts of ``u`` as columns; drop them with ``without_parts``."""
    found = {"s": scheme(u), "h": netloc(u), "p": path(u), "q": query_string(u), "f": fragment(u)}
    return df.withColumns({f"{name}_{k}": v for k, v in found.items()}), Parts(name)


def without_parts(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[f"{n}_{x}" for n in names for x in "shpqf"])


def _no_fragment(u: Column) -> Column:
    return F.substring_index(u, "#", 1)


def _head(u: Column) -> Column:
    return F.substring_index(_no_fragment(u), "?", 1)


def scheme(u: Url) -> Column:
    return u.s if isinstance(u, Parts) else F.lower(F.regexp_extract(_head(u), _SCHEME, 1))


def netloc(u: Url) -> Column:
    return u.h if isinstance(u, Parts) else F.regexp_extract(_head(u), _NETLOC, 1)


def path(u: Url) -> Column:
    return u.p if isinstance(u, Parts) else F.regexp_replace(_head(u), _PREFIX, "")


def query_string(u: Url) -> Column:
    return u.q if isinstance(u, Parts) else F.substr(_no_fragment(u), F.length(_head(u)) + 2)


def fragment(u: Url) -> Column:
    return u.f if isinstance(u, Parts) else F.substr(u, F.length(_no_fragment(u)) + 2)


def domain_of(u: Column) -> Column:
    """Lower-case network location, port kept."""
    return F.lower(netloc(u))


def is_web(u: Column) -> Column:
    return scheme(u).isin("http", "https") & (netloc(u) != "")


def any_contains(text: Column, tokens) -> Column:
    """True if any token occurs; for long bodies, where substring search is fastest."""
    out = F.lit(False)
    for token in tokens:
        out = out | F.contains(text, F.lit(token))
    return out


def has_token(text: Column, tokens) -> Column:
    """``any_contains`` as one pattern, for short texts that are costly to derive."""
    return text.rlike("|".join(re.escape(t) for t in tokens))


def any_endswith(text: Column, suffixes) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(t) for t in suffixes) + ")$")


def _without_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments; only paths that have some pay for the fold."""
    segs = F.split(p, "/", -1)
    last_is_dot = F.element_at(segs, -1).isin(".", "..")
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    folded = F.when(last_is_dot, F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(folded, "/")).otherwise(p)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` as seen from ``base``."""
    ref = F.trim(ref)
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    base_path = path(base)
    parent = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    ref_path = F.regexp_extract(ref, r"^[^?#]*", 0)
    ref_tail = F.regexp_extract(ref, r"(?s)[?#].*$", 0)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme(base), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, _without_dots(ref_path), ref_tail))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, base_path, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(F.regexp_extract(base, r"^[^#]*", 0), ref))
        .otherwise(F.concat(root, _without_dots(F.concat(parent, ref_path)), ref_tail))
    )


def _decode(part: Column) -> Column:
    """Form-decode; a broken escape leaves the text as it was."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encode(part: Column) -> Column:
    enc = F.url_encode(part)
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(q: Column) -> Column:
    """Decoded (k, v) structs in order of appearance."""
    parts = F.filter(F.split(q, "&", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def sorted_query(q: Column) -> Column:
    return F.when(q == "", "").otherwise(encode_pairs(F.array_sort(query_pairs(q))))


def _with_query(q: Column) -> Column:
    return F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))


def _path_without_params(u: Column) -> Column:
    return F.regexp_replace(path(u), r";[^/]*$", "")


def _non_empty(p: Column) -> Column:
    return F.when(p == "", "/").otherwise(p)


def frontier_form(u: Column) -> Column:
    """Trimmed URL for the frontier, or null if it is not a web address."""
    u = u if isinstance(u, Parts) else F.trim(u)
    frag = F.when(fragment(u) == "", "").otherwise(F.concat(F.lit("#"), fragment(u)))
    full = F.concat(scheme(u), F.lit("://"), netloc(u), path(u), _with_query(query_string(u)), frag)
    return F.when(is_web(u), full)


def discovered_form(raw: Url, base: Column | None = None, keep_fragment: bool = False) -> Column:
    """Resolved link with lower-case host and without fragment; '' if not a web address."""
    u = raw if isinstance(raw, Parts) else resolve(base, raw)
    out = F.concat(
        scheme(u), F.lit("://"), domain_of(u), _non_empty(_path_without_params(u)), _with_query(query_string(u))
    )
    if keep_fragment:
        out = F.concat(out, F.when(fragment(u) == "", "").otherwise(F.concat(F.lit("#"), fragment(u))))
    return F.when(is_web(u), out).otherwise("")


def _split_all(refs: Column, base: Column) -> Column:
    """Resolved and split links of an array; staged so that each step runs once per link."""
    absolute = F.transform(refs, lambda r: resolve(base, r))
    return F.transform(
        absolute,
        lambda u: F.struct(
            scheme(u).alias("s"), domain_of(u).alias("h"), _path_without_params(u).alias("p"), query_string(u).alias("q")
        ),
    )


def discovered_forms(refs: Column, base: Column) -> Column:
    """``discovered_form`` over an array."""
    return F.transform(
        _split_all(refs, base),
        lambda x: F.when(
            x["s"].isin("http", "https") & (x["h"] != ""),
            F.concat(x["s"], F.lit("://"), x["h"], _non_empty(x["p"]), _with_query(x["q"])),
        ).otherwise(""),
    )


def product_forms(refs: Column, base: Column) -> Column:
    """``product_form`` with query over an array."""
    tidy = F.transform(
        _split_all(refs, base),
        lambda x: F.struct(
            x["s"].alias("s"),
            x["h"].alias("h"),
            F.when(x["p"].isin("", "/"), "/").otherwise(F.rtrim(x["p"], F.lit("/"))).alias("p"),
            sorted_query(x["q"]).alias("q"),
        ),
    )
    return F.transform(
        tidy,
        lambda x: F.when(
            x["s"].isin("http", "https"), F.concat(x["s"], F.lit("://"), x["h"], x["p"], _with_query(x["q"]))
        ).otherwise(""),
    )


def request_form(u: Column) -> Column:
    """Canonical request URL: sorted query, no fragment."""
    u = u if isinstance(u, Parts) else F.trim(u)
    prefix = F.when(scheme(u) == "", "").otherwise(F.concat(scheme(u), F.lit("://")))
    return F.concat(
        prefix, domain_of(u), _non_empty(_path_without_params(u)), _with_query(sorted_query(query_string(u)))
    )


def product_form(u: Column, base: Column | None = None, keep_query: bool = False) -> Column:
    """Product identity URL: query dropped unless kept, trailing slash dropped."""
    full = u if isinstance(u, Parts) else resolve(base, u) if base is not None else F.trim(u)
    p = _non_empty(_path_without_params(full))
    p = F.when(p == "/", p).otherwise(F.rtrim(p, F.lit("/")))
    out = F.concat(scheme(full), F.lit("://"), domain_of(full), p)
    if keep_query:
        out = F.concat(out, _with_query(sorted_query(query_string(full))))
    return F.when(scheme(full).isin("http", "https"), out).otherwise("")


def url_hash(u: Column) -> Column:
    return F.sha2(u, 256)


def query_value(u: Column, name: str) -> Column:
    """First non-blank value of a query parameter, null if absent."""
    hits = F.filter(query_pairs(query_string(u)), lambda p: (p["k"] == name) & (p["v"] != ""))
    return F.get(hits, F.lit(0))["v"]


def int_query_value(u: Column, name: str, default: int) -> Column:
    return F.coalesce(query_value(u, name).try_cast("int"), F.lit(default))


def _set_pair(pairs: Column, name: str, value: Column) -> Column:
    fresh = F.array(F.struct(F.lit(name).alias("k"), value.alias("v")))
    replaced = F.transform(
        pairs, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == name, value).otherwise(p["v"]).alias("v"))
    )
    present = F.exists(pairs, lambda p: p["k"] == name)
    usable = value.isNotNull() & (value != "")
    return F.when(usable, F.when(present, replaced).otherwise(F.concat(pairs, fresh))).otherwise(pairs)


def set_query_params(u: Column, params: dict[str, Column]) -> Column:
    """Replace parameters in place, append new ones; blank values are ignored."""
    pairs = query_pairs(query_string(u))
    for name, value in params.items():
        pairs = _set_pair(pairs, name, value.cast("string"))
    frag = F.when(fragment(u) == "", "").otherwise(F.concat(F.lit("#"), fragment(u)))
    return F.concat(
        scheme(u), F.lit("://"), netloc(u), _non_empty(_path_without_params(u)), _with_query(encode_pairs(pairs)), frag
    )


def request_fingerprint(method: Column, canonical: Column, data: Column | None = None, body: Column | None = None) -> Column:
    """sha256 of the compact JSON text of the request; null bodies print as ``null``."""

    def text(c: Column | None) -> Column:
        if c is None:
            return F.lit("null")
        quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.coalesce(F.concat(F.lit('"'), quoted, F.lit('"')), F.lit("null"))

    raw = F.concat(
        F.lit('{"data":'), text(data), F.lit(',"json":'), text(body), F.lit(',"method":"'), F.upper(method),
        F.lit('","url":'), text(canonical), F.lit("}"),
    )
    return F.sha2(raw, 256)


def url_kind(u: Url, classify: dict[str, str] | None = None, default: str = "page", full: Column | None = None) -> Column:
    """Kind of page a URL leads to: caller's patterns first, then path tokens."""
    full = u if full is None else full
    p = F.lower(path(u))
    tests = [(full.rlike(pattern), kind) for kind, pattern in (classify or {}).items()]
    tests += [
        (F.contains(p, F.lit("/api/")) | F.endswith(p, F.lit(".json")), "api"),
        (has_token(p, rules.DETAIL_TOKENS), "detail"),
        (has_token(p, rules.CATEGORY_TOKENS), "category"),
        (has_token(p, rules.LIST_TOKENS), "list"),
    ]
    out = None
    for test, kind in tests:
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(default)


def same_or_subdomain(domain: Column, parent: Column) -> Column:
    return (domain == parent) | F.endswith(domain, F.concat(F.lit("."), parent))


def is_product_link(u: Column, label: Column) -> Column:
    p = F.lower(path(u))
    numbered = F.endswith(p, F.lit(".html")) & p.rlike(r"/[^/]*[a-z][a-z0-9-]*-\d{2,}[^/]*\.html$")
    wanted = has_token(F.lower(label), rules.PRODUCT_LABELS) | has_token(p, rules.PRODUCT_PATHS) | numbered
    return is_web(u) & ~has_token(p, rules.NOT_PRODUCT_PATHS) & wanted


def is_catalog_url(u: Column, label: Column) -> Column:
    p = F.lower(path(u))
    words = F.split(F.lower(F.concat_ws(" ", path(u), label)), r"[^a-z0-9ąćęłńóśźż]+")
    everything = F.lower(F.concat_ws(" ", netloc(u), path(u), label))
    refused = F.arrays_overlap(words, F.array(*map(F.lit, rules.NOT_CATALOG_WORDS))) | has_token(
        everything, rules.NOT_CATALOG_PHRASES
    )
    wanted = F.arrays_overlap(words, F.array(*map(F.lit, rules.CATALOG_WORDS))) | has_token(p, rules.CATALOG_PATHS)
    return ~refused & wanted


def is_tracking_url(u: Column) -> Column:
    return has_token(F.lower(u), rules.TRACKING_PATTERNS)


def is_asset_path(p: Column) -> Column:
    p = F.lower(p)
    return any_endswith(p, rules.ASSET_SUFFIXES) | has_token(p, rules.ASSET_TOKENS)


def label_from_url(u: Column) -> Column:
    """Readable label from the last path part."""
    parts = F.filter(F.split(path(u), "/"), lambda s: (s != "") & ~F.startswith(s, F.lit(":")))
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(netloc(u))
    spaced = F.regexp_replace(last, r"[-_]+", " ")
    bare = F.regexp_replace(spaced, r"(?i)\.(html?|php|aspx?)$", "")
    tidy = F.trim(F.regexp_replace(F.replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit("%20"), F.lit(" ")), r"\s+", " "))
    return tidy


def canonicalize(df: DataFrame, url: str = "url") -> DataFrame:
    """Table job: every form, hash and predicate of an absolute URL as one column each."""
    split, u = with_parts(df, F.trim(F.col(url)), "_u")
    keep = [F.col(c) for c in df.columns]
    page = int_query_value(u, "page", 1)
    forms = split.select(
        "*",
        F.coalesce(frontier_form(u), F.lit("")).alias("frontier_form"),
        discovered_form(u).alias("discovered_form"),
        request_form(u).alias("request_form"),
        product_form(u).alias("product_form"),
        product_form(u, keep_query=True).alias("product_form_query"),
        domain_of(u).alias("domain"),
        url_kind(u, full=F.col(url)).alias("url_kind"),
        page.alias("page_no"),
        label_from_url(u).alias("label"),
        is_product_link(u, F.lit("")).alias("is_product"),
        is_catalog_url(u, F.lit("")).alias("is_catalog"),
        is_tracking_url(F.col(url)).alias("is_tracking"),
        is_asset_path(path(u)).alias("is_asset"),
    )
    return forms.select(
        *keep,
        *[F.col(c) for c in forms.columns if c not in split.columns],
        F.when(F.col("frontier_form") != "", url_hash(F.col("frontier_form"))).alias("url_hash"),
        F.substring(request_fingerprint(F.lit("GET"), F.col("request_form")), 1, 16).alias("request_id"),
        set_query_params(u, {"page": F.col("page_no") + 1}).alias("next_page_url"),
    )
