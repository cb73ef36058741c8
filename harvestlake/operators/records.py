"""Product records: normalising, keys, upsert, first-seen dedupe, API mapping, export rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window as W

from harvestlake import rules
from harvestlake.functions import text, urls
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

RECORD_ORDER = ("created_us", "l_orderkey", "l_linenumber")


def normalize_products(offers: DataFrame) -> DataFrame:
    """Table job: prices, text, categories, images and key of collected offers."""
    price, cat = F.col("price_text"), F.col("category")
    split = offers.withColumns({"_images": text.image_list_split(F.col("image_text")), "_levels": text.category_levels(cat)})
    lv = F.col("_levels")
    return split.withColumns(
        {
            "highest_price": text.parse_price(price),
            "lowest_price": text.parse_lowest_price(price),
            "number_price": text.number_or_none(price),
            "first_price": text.parse_price_first(price),
            "range_high": text.parse_price_range(price)["max"],
            "clean_price": text.clean_price(price),
            "clean_score": text.clean_score(price),
            "description_text": text.clean_text(F.col("description")),
            "category_level_1": lv[0],
            "category_level_2": lv[1],
            "category_level_3": lv[2],
            "image_urls": F.col("_images"),
            "images_clean": text.clean_product_images(F.col("_images"), F.col("source_url")),
            "dedupe_key": text.product_dedupe_key(
                F.col("source_site"), cat, F.col("canonical_url"), F.col("source_url"), F.col("title")
            ),
        }
    ).drop("_images", "_levels")


def upsert_latest(
    records: DataFrame,
    keys: tuple[str, ...] = ("run_id", "dedupe_key"),
    order: tuple[str, ...] = RECORD_ORDER,
    created: str = "created_us",
) -> DataFrame:
    """Last write wins per key; first creation time kept; ``writes`` counts the merged rows.

    An aggregation rather than a window: rows of a hot key are folded where they are read,
    so no task ever holds a whole key.
    """
    rest = [c for c in records.columns if c not in keys]
    return (
        records.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"),
            F.min(created).alias("_first_created"),
            F.max(created).alias("updated_us"),
            F.count("*").alias("writes"),
        )
        .select(
            *keys,
            *[F.col(f"_last.{c}").alias(c) for c in rest if c != created],
            F.col("_first_created").alias(created),
            "updated_us",
            "writes",
        )
    )


def upsert_into(stored: DataFrame, batch: DataFrame, **options) -> DataFrame:
    """Merge a batch into a stored table; stored rows count as one earlier write."""
    return upsert_latest(stored.select(*batch.columns).unionByName(batch), **options)


def upsert_counts(records: DataFrame, keys: tuple[str, ...] = ("run_id", "dedupe_key")) -> DataFrame:
    """Inserted and updated rows per run."""
    per_key = records.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.groupBy(keys[0]).agg(
        F.count("*").alias("inserted"), F.sum(F.col("n") - 1).alias("updated"), F.sum("n").alias("total")
    )


def first_seen_dedupe(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """First row of each key, with the number of later copies as ``dropped``."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), (F.count("*") - 1).alias("dropped"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], "dropped")
    )


def discovery_union(*sources: DataFrame, url: str = "url") -> DataFrame:
    """Discovered requests of all sources, deduped on the request form; earlier sources win."""
    tagged = [s.select(url, "kind", F.lit(i).alias("source_no"), "ord") for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    split, u = urls.with_parts(every, F.trim(F.col(url)), "_u")
    keyed = urls.without_parts(split.withColumn("request_url", urls.request_form(u)), "_u")
    return first_seen_dedupe(keyed, ("request_url",), ("source_no", "ord", url))


def merge_candidates(*sources: DataFrame) -> DataFrame:
    """Best scored candidate per (method, url); the earlier source wins ties."""
    every = None
    for i, s in enumerate(sources):
        s = s.select("method", "url", "score", "origin", F.lit(-i).alias("_p"))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy("method", "url").agg(F.max(F.struct("score", "_p", "origin")).alias("_b"))
    return best.select("method", "url", F.col("_b.score").alias("score"), F.col("_b.origin").alias("origin"))


def lookup_record(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the wanted (run_id, dedupe_key) pairs."""
    return records.join(wanted.select("run_id", "dedupe_key").distinct(), ["run_id", "dedupe_key"], "left_semi")


def page_records(records: DataFrame, limit: int, offset: int = 0, order: tuple[str, ...] = RECORD_ORDER) -> DataFrame:
    """One page of records by creation time; other keys make the order total."""
    return records.orderBy(*order).offset(offset).limit(limit)


# ---------------------------------------------------------------- fields
def rename_fields(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rename columns to canonical fields; the first column of a field keeps the name."""
    known = {a.lower(): name for name, names in (aliases or rules.FIELD_ALIASES).items() for a in names}
    taken: set[str] = set()
    out = []
    for c in df.columns:
        target = known.get(c.strip().lower(), c)
        target = c if target in taken else target
        taken.add(target)
        out.append(F.col(f"`{c}`").alias(target))
    return df.select(*out)


def resolve_fields(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested labels against known fields: canonical name, resolved or missing."""
    wanted = requested.select("task_id", text.normalize_field_name(F.col("label")).alias("field")).where("field <> ''").distinct()
    have = known.select("field", F.lit(True).alias("known")).distinct()
    found = F.coalesce(F.col("known"), F.lit(False))
    return wanted.join(have, "field", "left").select(
        "task_id",
        "field",
        F.when(found, "resolved").otherwise("missing").alias("state"),
        F.when(found, 0.85).otherwise(0.25).alias("confidence"),
    )


def field_diff(required: DataFrame, present: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Required fields that are not present."""
    return required.join(present, [*keys, "field"], "left_anti")


def export_rows(records: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Flat export rows: lists joined with '; ', category cut into levels, fields renamed.

    A source field that does not exist exports as ''.
    """
    parts = F.filter(F.split("category", ">"), lambda p: F.trim(p) != "")

    def level(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    raw = {
        "title": F.col("title"),
        "highest_price": F.col("highest_price"),
        "currency": F.col("currency"),
        "image_urls": F.array_join("image_urls", "; "),
        "description": F.col("description"),
        "canonical_url": F.col("canonical_url"),
        "source_url": F.col("source_url"),
        "category": F.col("category"),
        "category_level_1": level(0),
        "category_level_2": level(1),
        "category_level_3": level(2),
    }
    for name in ("colors", "sizes"):
        raw[name] = F.array_join(name, "; ") if name in records.columns else F.lit("")
    chosen = mapping or {k: k for k in raw}
    return records.select(*[raw.get(source, F.lit("")).alias(target) for source, target in chosen.items()])


# ---------------------------------------------------------------- API payloads
def _first(v: Column, *paths: str, skip_zero: bool = False) -> Column:
    """First value that is neither missing nor empty (nor zero where numbers are tested by truth)."""
    tries = []
    for p in paths:
        value = F.try_variant_get(v, p, "string")
        bad = (value == "") | ((value == "0") if skip_zero else F.lit(False))
        tries.append(F.when(~bad, value))
    return F.coalesce(*tries)


def payload_items(v: Column) -> Column:
    """Records of a parsed response: a top list, children with data, then the listed keys."""
    none = F.expr("cast(array() AS array<variant>)")
    children = F.transform(
        F.try_variant_get(v, "$.children", "array<variant>"),
        lambda c: F.coalesce(F.when(F.try_variant_get(c, "$.data", "map<string,variant>").isNotNull(), F.try_variant_get(c, "$.data", "variant")), c),
    )
    tries = [F.try_variant_get(v, "$", "array<variant>"), F.when(F.size(children) > 0, children)]
    for key in rules.ITEM_LIST_KEYS:
        inner = [F.try_variant_get(v, f"$.{key}.{k}", "array<variant>") for k in rules.ITEM_LIST_KEYS]
        nested = F.coalesce(*[F.when(F.size(x) > 0, x) for x in inner])
        tries.append(F.try_variant_get(v, f"$.{key}", "array<variant>"))
        tries.append(F.when(F.try_variant_get(v, f"$.{key}", "map<string,variant>").isNotNull(), nested))
    return F.filter(F.coalesce(*tries, none), lambda i: F.try_variant_get(i, "$", "map<string,variant>").isNotNull())


def _first_records(value):
    """Depth-first search for the first list of objects below a parsed JSON value."""
    if isinstance(value, list):
        return [v for v in value if isinstance(v, dict)]
    if isinstance(value, dict):
        for inner in value.values():
            found = _first_records(inner)
            if found:
                return found
    return []


def _deep_items(payload: Column) -> Column:
    """Records of responses that carry them under no known key; Arrow batches."""

    @F.pandas_udf(ArrayType(StringType()))
    def search(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return []
            try:
                return [json.dumps(r, ensure_ascii=False) for r in _first_records(json.loads(t))]
            except ValueError:
                return []

        return texts.map(one)

    return F.transform(search(payload), lambda t: F.try_parse_json(t))


def with_payload_items(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the records of each response as ``_items``; the text is parsed once."""
    parsed = pages.withColumn("_parsed", F.try_parse_json(F.col(payload)))
    return parsed.withColumn("_items", payload_items(F.col("_parsed"))).drop("_parsed")


def scan_api_payloads(pages: DataFrame, payload: str = "payload", deep: bool = False) -> DataFrame:
    """One row per record of each response, in response order.

    ``deep`` also searches responses without any known key; only those reach Python.
    """
    rest = [c for c in pages.columns if c != payload]
    found = with_payload_items(pages, payload)
    if deep:
        tail = _deep_items(F.when(F.size("_items") == 0, F.col(payload)))
        found = found.withColumn("_deep", tail).withColumn("_items", F.when(F.size("_items") == 0, F.col("_deep")).otherwise(F.col("_items")))
    return found.select(*rest, F.posexplode("_items").alias("item_no", "item"))


def item_dedupe_key(v: Column, title: Column) -> Column:
    """``field:value`` of the first identifying field, else the title."""
    tries = []
    for name in rules.ITEM_KEY_FIELDS:
        value = F.try_variant_get(v, f"$.{name}", "string")
        tries.append(F.when(value != "", F.concat(F.lit(f"{name}:"), value)))
    return F.coalesce(*tries, F.concat(F.lit("title:"), F.coalesce(title, F.lit(""))))


def normalize_api_records(items: DataFrame) -> DataFrame:
    """Table job: common field names of API records coalesced; records without title dropped."""
    v = F.col("item")
    named = F.coalesce(
        F.when(F.try_variant_get(v, "$.title", "map<string,variant>").isNull(), F.nullif(F.try_variant_get(v, "$.title", "string"), F.lit(""))),
        _first(v, "$.title.english", "$.title.romaji", "$.title.native", "$.title.userPreferred"),
    )
    has_title = F.try_variant_get(v, "$.title", "variant").isNotNull()
    title = F.coalesce(named, F.when(~has_title, _first(v, "$.name", "$.label", "$.headline", "$.text")))
    rank = F.coalesce(
        F.try_variant_get(v, "$.rank", "string"),
        _first(v, "$.position", "$.stat.his_rank", "$.stat.now_rank", skip_zero=True),
        (F.col("item_no") + 1).cast("string"),
    )
    # as rows of a generator titles are made once; a filter on them would be pushed below and make them again
    titled = items.withColumn("title", F.explode(F.filter(F.array(title), lambda t: t != "")))
    return titled.withColumns(
        {
            "link": F.coalesce(F.try_variant_get(v, "$.link", "string"), _first(v, "$.html_url", "$.url", "$.href", "$.permalink", "$.siteUrl")),
            "image": F.coalesce(
                F.try_variant_get(v, "$.image", "string"), _first(v, "$.image_src", "$.thumbnail", "$.coverImage.medium", "$.pic")
            ),
            "hot_score": F.coalesce(
                F.try_variant_get(v, "$.hot_score", "string"),
                _first(
                    v, "$.score", "$.points", "$.num_comments", "$.comments", "$.rating", "$.ups", "$.heat", "$.popularity",
                    "$.averageScore", "$.stat.view", "$.stat.like", "$.stat.coin", skip_zero=True,
                ),
            ),
            "summary": F.coalesce(
                F.try_variant_get(v, "$.summary", "string"),
                _first(v, "$.description", "$.text", "$.body", "$.story_text", "$.author.name"),
            ),
            "rank": rank,
        }
    ).withColumn("item_key", item_dedupe_key(v, F.col("title"))).drop("item")


def _json_path(dotted: str) -> str:
    out = "$"
    for part in dotted.split("."):
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def map_api_items(items: DataFrame, mapping: dict[str, str | list[str]], base: str) -> DataFrame:
    """Payload records → product fields by dotted paths.

    A list of paths takes the first non-empty value, for prices the largest number.
    """
    v = F.col("item")

    def values(field: str) -> list[Column]:
        spec = mapping.get(field, field)
        return [F.try_variant_get(v, _json_path(p), "string") for p in (spec if isinstance(spec, list) else [spec])]

    def first(field: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in values(field)])

    numbers = [text.parse_price_first(x) for x in values("highest_price")]
    price = F.greatest(*numbers) if len(numbers) > 1 else numbers[0]
    link = first("canonical_url")
    return items.withColumns(
        {
            "title": first("title"),
            "highest_price": price,
            "canonical_url": F.when(link.isNotNull(), urls.resolve(F.col(base), link)).otherwise(F.col(base)),
            "image_url": F.when(first("image_urls").isNotNull(), urls.resolve(F.col(base), first("image_urls"))),
        }
    ).where(F.coalesce(F.col("title"), F.lit("")) != "").drop("item")


def infer_api_mapping(items: DataFrame, by: str) -> DataFrame:
    """Which payload keys feed which product field, by number of records that carry them."""
    keys = items.select(by, F.explode(F.map_keys(F.try_variant_get("item", "$", "map<string,variant>"))).alias("item_key"))
    counted = keys.groupBy(by, "item_key").agg(F.count("*").alias("records"))
    return counted.withColumn("field", text.normalize_field_name(F.col("item_key"))).where(F.col("field").isin(*rules.FIELD_ALIASES))


_NODE = "struct<path:array<string>,label:string,url:string,child:variant>"


def _menu_children(v: Column, path: Column) -> Column:
    """Nodes directly below a menu value: list entries, or label → url / child entries."""
    as_list = lambda x: F.try_variant_get(x, "$", "array<variant>")
    as_map = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    nested = lambda x: as_map(x).isNotNull() | as_list(x).isNotNull()

    def node(label: Column, url: Column, child: Column) -> Column:
        return F.struct(F.concat(path, F.array(label)).alias("path"), label.alias("label"), url.alias("url"), child.alias("child"))

    listed = F.transform(
        F.filter(as_list(v), lambda x: as_map(x).isNotNull()),
        lambda x: node(
            text.squash(F.coalesce(_first(x, "$.label", "$.name", "$.title", "$.url"), F.lit(""))),
            F.coalesce(F.try_variant_get(x, "$.url", "string"), F.lit("")),
            F.try_variant_get(x, "$.children", "variant"),
        ),
    )
    named = F.transform(
        F.map_entries(as_map(v)),
        lambda e: node(
            text.squash(e["key"]),
            F.when(nested(e["value"]), "").otherwise(F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit(""))),
            F.when(nested(e["value"]), e["value"]),
        ),
    )
    return F.coalesce(listed, named, F.expr(f"cast(array() AS array<{_NODE}>)"))


def scan_catalog_json(menus: DataFrame, max_depth: int = 8) -> DataFrame:
    """Nested menu JSON → flat nodes with path.

    Each menu is unfolded level by level inside its own row, so one pass over the table
    is enough; a menu deeper than ``max_depth`` fails the job instead of losing nodes.
    """
    level = menus.select("menu_id", "base_url", _menu_children(F.try_parse_json("menu_json"), F.array().cast("array<string>")).alias("_l1"))
    for i in range(2, max_depth + 1):
        below = F.flatten(
            F.transform(
                F.filter(f"_l{i - 1}", lambda n: n["child"].isNotNull()), lambda n: _menu_children(n["child"], n["path"])
            )
        )
        level = level.withColumn(f"_l{i}", below)
    too_deep = F.exists(f"_l{max_depth}", lambda n: n["child"].isNotNull())
    every = F.concat(*[F.col(f"_l{i}") for i in range(1, max_depth + 1)])
    nodes = F.when(too_deep, F.raise_error(F.lit("menu deeper than max_depth")).cast(f"array<{_NODE}>")).otherwise(every)
    rows = level.select("menu_id", "base_url", F.explode(nodes).alias("_n")).select("menu_id", "base_url", "_n.path", "_n.label", "_n.url")
    at = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))
    return rows.select(
        "menu_id", "base_url", "label", "url", F.array_join("path", " > ").alias("path"), F.size("path").alias("depth"),
        at(0).alias("level1"), at(1).alias("level2"), at(2).alias("level3"), text.stable_node_id(F.col("path"), F.col("url")).alias("node_id"),
    )


def catalog_tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("menu_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("url") != "").alias("leaves"), F.max("depth").alias("levels")
    )


def enrich_catalog(nodes: DataFrame, discovered: DataFrame) -> DataFrame:
    """Copy missing metadata from discovered nodes: by url key, else by path key, first wins."""

    def url_key(u: Column) -> Column:
        p = F.lower(F.trim(urls.path(u), F.lit("/")))
        key = F.concat(urls.domain_of(u), F.lit("/"), F.regexp_replace(p, r"\.html$", ""))
        return F.when(urls.netloc(u) != "", F.rtrim(key, F.lit("/"))).otherwise("")

    path_key = F.lower(F.regexp_replace(F.col("path"), r"\s*>\s*", " > "))
    left = nodes.withColumns({"_uk": url_key(F.col("full_url")), "_pk": path_key})
    right = discovered.withColumns({"_uk": url_key(F.col("full_url")), "_pk": path_key})
    by_url = right.where("_uk <> ''").groupBy("_uk").agg(F.min_by("uid", F.struct("ord", "uid")).alias("_u_uid"))
    by_path = right.where("_pk <> ''").groupBy("_pk").agg(F.min_by("uid", F.struct("ord", "uid")).alias("_p_uid"))
    joined = left.join(by_url, "_uk", "left").join(by_path, "_pk", "left")
    own = F.nullif(F.col("uid"), F.lit(""))
    return joined.select(
        *[c for c in nodes.columns if c != "uid"], F.coalesce(own, F.col("_u_uid"), F.col("_p_uid"), F.lit("")).alias("uid")
    )


# ---------------------------------------------------------------- tasks
def task_with_items(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Tasks with their items as rows; order by (task_id, item_index) to read them in sequence."""
    return tasks.join(items, "task_id")


def job_timeline(*sources: tuple[DataFrame, int]) -> DataFrame:
    """(task_id, time, type, message) rows of all sources; each source keeps its newest n per task."""
    out = None
    for df, n in sources:
        rows = df.select("task_id", "time_us", "type", "message")
        if n:
            w = W.partitionBy("task_id").orderBy(F.desc("time_us"), "message")
            rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
        out = rows if out is None else out.unionByName(rows)
    return out


def redact_logs(df: DataFrame, text_columns: tuple[str, ...], map_columns: tuple[str, ...] = ()) -> DataFrame:
    """Table job: secrets hidden in text and map columns, with a changed flag per text column."""
    out: dict[str, Column] = {}
    for c in text_columns:
        out[f"{c}_safe"] = text.redact_text(F.col(c))
        out[f"{c}_preview"] = text.redact_preview(F.col(c))
    for c in map_columns:
        out[f"{c}_safe"] = text.redact_map(F.col(c))
    safe = df.withColumns(out)
    return safe.withColumns({f"{c}_changed": F.col(c) != F.col(f"{c}_preview") for c in text_columns})
