"""Text builders for the checking SQL (DuckDB dialect).

Written separately from the Spark expressions: same meaning, other engine.
"""

from __future__ import annotations

import re

from harvestlake import rules


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


def has_any(x: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in tokens) + ")"


def ends_any(x: str, tokens) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {lit(t)})" for t in tokens) + ")"


_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(u: str, i: int) -> str:
    return f"regexp_extract({u}, {lit(_SPLIT)}, {i})"


def scheme(u):
    return f"lower({part(u, 1)})"


def netloc(u):
    return part(u, 2)


def path(u):
    return part(u, 3)


def query(u):
    return part(u, 4)


def domain(u):
    return f"lower({netloc(u)})"


def is_web(u):
    return f"({scheme(u)} IN ('http', 'https') AND {netloc(u)} <> '')"


def q(text):
    return f"(CASE WHEN {text} = '' THEN '' ELSE '?' || {text} END)"


def pairs(qs):
    return (
        f"[{{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), "
        f"'v': url_decode(replace(regexp_replace(p, '^[^=]*(=|$)', ''), '+', ' '))}} "
        f"for p in string_split({qs}, '&') if p <> '']"
    )


def encode(ps):
    def e(x):
        return f"replace(url_encode({x}), '%20', '+')"

    return f"array_to_string([{e('z.k')} || '=' || {e('z.v')} for z in {ps}], '&')"


def sorted_query(qs):
    return f"(CASE WHEN {qs} = '' THEN '' ELSE {encode(f'list_sort({pairs(qs)})')} END)"


def nz(p):
    return f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def bare_path(u):
    return f"regexp_replace({path(u)}, ';[^/]*$', '')"


def resolve(base, ref):
    """Reference resolution without dot segments (the tables hold none)."""
    r = f"trim({ref})"
    root = f"{scheme(base)} || '://' || {netloc(base)}"
    return (
        f"(CASE WHEN {r} = '' THEN {base} WHEN regexp_matches({r}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {r} "
        f"WHEN starts_with({r}, '//') THEN {scheme(base)} || ':' || {r} "
        f"WHEN starts_with({r}, '/') THEN {root} || {r} "
        f"WHEN starts_with({r}, '?') THEN {root} || {path(base)} || {r} "
        f"WHEN starts_with({r}, '#') THEN regexp_extract({base}, '^[^#]*', 0) || {r} "
        f"ELSE {root} || (CASE WHEN {path(base)} = '' THEN '/' ELSE regexp_replace({path(base)}, '[^/]*$', '') END) || {r} END)"
    )


def discovered_abs(u):
    """Discovered form of an already absolute url."""
    return (
        f"(CASE WHEN {is_web(u)} THEN {scheme(u)} || '://' || {domain(u)} || {nz(bare_path(u))} || {q(query(u))} ELSE '' END)"
    )


def request_form(u):
    return f"({scheme(u)} || '://' || {domain(u)} || {nz(bare_path(u))} || {q(sorted_query(query(u)))})"


def product_abs(u, keep_query=False):
    p = nz(bare_path(u))
    tail = f" || {q(sorted_query(query(u)))}" if keep_query else ""
    return (
        f"(CASE WHEN {scheme(u)} IN ('http', 'https') THEN {scheme(u)} || '://' || {domain(u)} || "
        f"(CASE WHEN {p} = '/' THEN '/' ELSE rtrim({p}, '/') END){tail} ELSE '' END)"
    )


def url_kind(u, default="page"):
    p = f"lower({path(u)})"
    return (
        f"(CASE WHEN contains({p}, '/api/') OR ends_with({p}, '.json') THEN 'api' "
        f"WHEN {has_any(p, rules.DETAIL_TOKENS)} THEN 'detail' WHEN {has_any(p, rules.CATEGORY_TOKENS)} THEN 'category' "
        f"WHEN {has_any(p, rules.LIST_TOKENS)} THEN 'list' ELSE {lit(default)} END)"
    )


def catalog_url(u, label="''"):
    words = f"regexp_split_to_array(lower({path(u)} || ' ' || {label}), '[^a-z0-9ąćęłńóśźż]+')"
    every = f"lower({netloc(u)} || ' ' || {path(u)} || ' ' || {label})"
    p = f"lower({path(u)})"
    return (
        f"(NOT (list_has_any({words}, {list(rules.NOT_CATALOG_WORDS)}) OR {has_any(every, rules.NOT_CATALOG_PHRASES)}) "
        f"AND (list_has_any({words}, {list(rules.CATALOG_WORDS)}) OR {has_any(p, rules.CATALOG_PATHS)}))"
    )


def product_link(u):
    p = f"lower({path(u)})"
    return (
        f"({is_web(u)} AND NOT {has_any(p, rules.NOT_PRODUCT_PATHS)} AND ({has_any(p, rules.PRODUCT_PATHS)} OR "
        f"regexp_matches({p}, '/[^/]*[a-z][a-z0-9-]*-\\d{{2,}}[^/]*\\.html$')))"
    )


# ---------------------------------------------------------------- prices
def price_numbers(text):
    tokens = "|".join(re.escape(t) for t in rules.CURRENCY_TOKENS)
    plain = f"regexp_replace({text}, {lit('(?i)' + tokens)}, ' ', 'g')"
    split = f"regexp_replace({plain}, '(\\d[\\d.,]*)\\s*[-–—~]\\s*(\\d[\\d.,]*)', '\\1 \\2')"
    num = (
        "CASE WHEN contains(x, ',') AND contains(x, '.') THEN "
        "CASE WHEN regexp_matches(x, ',[^.,]*$') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END "
        "WHEN contains(x, ',') THEN CASE WHEN regexp_matches(x, ',\\d{1,2}$') "
        "THEN replace(regexp_extract(x, '^(.*),(\\d{1,2})$', 1), ',', '') || '.' || regexp_extract(x, '^(.*),(\\d{1,2})$', 2) "
        "ELSE replace(x, ',', '') END "
        "WHEN contains(x, '.') AND (len(string_split(x, '.')) > 2 OR regexp_matches(x, '\\.\\d{3}$')) THEN replace(x, '.', '') ELSE x END"
    )
    return (
        f"[try_cast({num} AS double) for x in regexp_extract_all({split}, "
        f"'(-?\\d+(?:[.,]\\d{{3}})*(?:[.,]\\d{{1,2}})?|-?\\d+)', 1)]"
    )


def price(raw, pick="list_max"):
    return f"(CASE WHEN lower(trim({raw})) IN {inlist(rules.FREE_WORDS)} THEN 0.0::double ELSE {pick}({price_numbers(f'trim({raw})')}) END)"


def first_number(raw):
    return f"try_cast(replace(regexp_extract({raw}, '\\d+(?:[.,]\\d+)?', 0), ',', '.') AS double)"


_RANGE = "[£$€¥￥]?\\s*(\\d+(?:[.,]\\d+)?)\\s*(?:-|–|—|~|to)\\s*[£$€¥￥]?\\s*(\\d+(?:[.,]\\d+)?)"


def _range_end(raw, i):
    return f"try_cast(replace(regexp_extract({raw}, {lit(_RANGE)}, {i}), ',', '.') AS double)"


def range_high(raw):
    return f"greatest({_range_end(raw, 1)}, {_range_end(raw, 2)})"


def number_or_none(raw):
    def num(i):
        return _range_end(raw, i)

    return f"coalesce(least({num(1)}, {num(2)}), try_cast(replace(regexp_extract({raw}, '-?\\d+(?:[.,]\\d+)?', 0), ',', '.') AS double))"


# ---------------------------------------------------------------- text and html
def squash(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def unescape(x):
    for entity, char in (
        ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def strip_tags(x):
    return f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"


def without_scripts(h):
    pat = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    return f"regexp_replace({h}, {lit(pat)}, ' ', 'g')"


def visible(h):
    return squash(unescape(strip_tags(without_scripts(h))))


def attr(tag, name):
    pat = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return "(" + " || ".join(f"regexp_extract({tag}, {lit(pat)}, {i})" for i in (1, 2, 3)) + ")"


def tags(h, names):
    return f"regexp_extract_all({h}, {lit(rf'(?is)(<(?:{names})\b[^>]*>)')}, 1)"


def scripts(h):
    return f"regexp_extract_all({h}, '(?is)(<script\\b[^>]*>.*?</script\\s*>)', 1)"


def script_body(s):
    return f"regexp_extract({s}, '(?is)^<script\\b[^>]*>(.*)</script\\s*>$', 1)"


def clean_text(x):
    return squash(unescape(strip_tags(x)))


def dedupe_key(site, category, canonical, source, title):
    ident = f"coalesce(nullif({canonical}, ''), nullif({source}, ''), nullif({title}, ''), '')"
    return f"substr(sha256({site} || '|' || {category} || '|' || {ident}), 1, 32)"
