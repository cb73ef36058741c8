"""Steps that were repeated over whole tables are done once, with the same results."""

from pyspark.sql import functions as F

from harvestlake.functions import html as H
from harvestlake.operators import elements as E
from harvestlake.operators import extract as X
from harvestlake.operators import records as R
from harvestlake.plans import scoring_plan
from harvestlake.plans import stream_plan
from harvestlake.sources.tables import Tables

PAGE = '<html><body><h1>One</h1><ul class="x"><li class="card a"><b id="k">t</b></li><li>u</li></ul></body></html>'


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (None, PAGE), (1, PAGE)], "page_id long, html string")


def test_asked_element_columns_are_those_of_the_whole_table(spark):
    """Columns nobody reads are not made."""
    whole = E.parse_elements(pages(spark))
    for names in (("tag",), ("elem_id", "depth", "path"), ("elem_id", "lineage", "ancestors"), ("text", "full_text", "siblings", "children", "parent_id", "end_id")):
        some = E.parse_elements(pages(spark), names)
        assert set(some.columns) == {"page_id", *names}
        rows = lambda df: sorted(map(str, df.select(some.columns).collect()))
        assert rows(some) == rows(whole)


def test_selected_fields_parse_pages_once(spark):
    """rules with one and with many values read the same parsed rows."""
    rules = [{"field": "t", "selector": "h1", "many": False}, {"field": "card", "selector": "ul > li.card b"}]
    got = E.select_fields(E.parse_elements(pages(spark), E.columns_for(rules)), rules)
    assert "MapInArrow" not in plan(got)
    assert sorted((r["page_id"] or 0, r["field"], r["value"]) for r in got.collect()) == sorted(
        [(1, "t", "One"), (0, "t", "One"), (1, "card", "t"), (1, "card", "t"), (0, "card", "t")]
    )


def test_attribute_is_searched_once(spark):
    """quoted, bare, empty and absent values; quotes inside a value stay."""
    tags = ["<a x='1' href=\"it's\">", "<a href='say \"hi\"'>", "<a href=bare/p>", '<a href="">', "<a>", "<a href=\"'q'\">", '<a HREF = "a\nb">', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t string").select("i", H.attribute(F.col("t"), "href").alias("v"))
    assert plan(df).count("regexp_extract") == 1
    assert [r["v"] for r in df.orderBy("i").collect()] == ["it's", 'say "hi"', "bare/p", "", "", "'q'", "a\nb", None]


def test_tiles_are_cut_once(spark):
    """the items of a page with tiles do not cut it again for their number."""
    html = '<div class="product-tile" data-pid="T1"><span class="product-tile__name">N</span><a class="link" href="/p/1">go</a></div>'
    df = spark.createDataFrame([(1, "https://s.example.com/", html), (2, "https://s.example.com/", "<p>none</p>")], "page_id long, url string, html string")
    out = X.extract_items(df, "tiles")
    assert plan(out).count(X._TILE) == 1
    assert [(r["page_id"], r["title"], r["sku"], r["product_url"]) for r in out.collect()] == [(1, "N", "T1", "https://s.example.com/p/1")]


def test_titles_are_made_once(spark):
    """The test for a title does not make it a second time."""
    texts = ['{"title":"a"}', '{"title":""}', '{"name":"b"}', '{"x":1}', '{"title":{"english":"c"}}', '{"label":""}']
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_no int, t string").select("item_no", F.parse_json("t").alias("item"))
    out = R.normalize_api_records(items)
    assert plan(out).count("$.title.english") == 2  # named twice where it is made, and nowhere else
    assert sorted((r["item_no"], r["title"], r["item_key"]) for r in out.collect()) == [(0, "a", "title:a"), (2, "b", "title:b"), (4, "c", "title:c")]


def tables(spark, folder):
    """Twelve parts, three requests, two orders of two lines each."""
    put = lambda name, *cols, n: spark.range(n).selectExpr(*cols).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    put("part", "id AS p_partkey", "'bolt' AS p_name", "'B1' AS p_brand", "'TIN' AS p_type", "int(id) AS p_size", "900.5 + id AS p_retailprice", n=12)
    put("events", "id AS event_id", "timestamp'2024-01-01' AS ts", "id AS user_id", "'click' AS event_type", "1.5D AS value", "concat('{\"k\": ', id, '}') AS props", n=3)
    put("orders", "id AS o_orderkey", "id AS o_custkey", "IF(id = 0, 'F', 'P') AS o_orderstatus", "5.0D AS o_totalprice", "timestamp'2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority", n=2)
    put("lineitem", "id % 2 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "int(id / 2) AS l_linenumber", "1.0D AS l_extendedprice", "timestamp'2024-01-01' AS l_shipdate", n=4)
    return Tables(spark, str(folder))


def test_pages_are_classified_once(spark, tmp_path):
    """signals and findings read stored page classes."""
    found = scoring_plan._findings(tables(spark, tmp_path))
    assert "text_chars" not in plan(found)
    assert {r["page"] for r in found.where("code = 'access_recaptcha' OR source = 'access_policy'").collect()} >= {"p1"}


def test_failed_tasks_are_read_from_the_saved_table(spark, tmp_path, monkeypatch):
    """the second save does not join the items anew."""
    plans = []
    save = stream_plan.sinks.save_task_result
    monkeypatch.setattr(stream_plan.sinks, "save_task_result", lambda s, p, rows: (plans.append(plan(rows)), save(s, p, rows)))
    rows = stream_plan._saved(tables(spark, tmp_path)).collect()
    assert "Join" in plans[0] and "Join" not in plans[1]
    assert sorted((r["task_id"], r["item_index"], r["title"], r["status"]) for r in rows) == [("task-0", 0, "bolt", "completed"), ("task-0", 1, "bolt", "completed"), ("task-1", 0, "BOLT", "retried"), ("task-1", 1, "BOLT", "retried")]
