"""Regular-expression views of stored page bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestlake.functions import text

_HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_SCRIPT = r"(?is)(<script\b[^>]*>.*?</script\s*>)"


def without_scripts(html: Column) -> Column:
    """Body without scripts, styles and comments, so that their text is not markup."""
    return F.regexp_replace(html, _HIDDEN, " ")


def visible_text(html: Column) -> Column:
    return text.clean_text(without_scripts(html))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, '' if absent."""
    # searched once; a bare value holds no quotes, so those at its ends are the ones around it
    pattern = rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"^[\"']|[\"']\z", "")


def opening_tags(html: Column, names: str) -> Column:
    """All opening tags with one of the ``a|b`` names, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<(?:{names})\b[^>]*>)"), 1)


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_SCRIPT), 1)


def script_body(script: Column) -> Column:
    return F.regexp_extract(script, r"(?is)^<script\b[^>]*>(.*)</script\s*>$", 1)


def script_tag(script: Column) -> Column:
    return F.regexp_extract(script, r"(?is)^<script\b[^>]*>", 0)


def looks_like_json(html: Column) -> Column:
    return F.ltrim(F.coalesce(html, F.lit(""))).rlike(r"^\s*[{\[]")


def meta_content(html: Column, key: str) -> Column:
    """Content of ``<meta property|name=key>``."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*(?:property|name)\s*=\s*[\"']{key}[\"'][^>]*>", 0)
    return attribute(tag, "content")


def first_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return text.clean_text(inner)
