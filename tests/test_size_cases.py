"""What a query sends, shuffles or keeps must not outgrow the driver or the disk; estimates of sizes are not trusted."""

import pytest
from pyspark.sql import functions as F

from harvestlake.operators import elements as E
from harvestlake.operators import extract as X
from harvestlake.plans import elements_plan
from harvestlake.sources.tables import Tables

PAGE = '<html><body><div class="a">t<b>u</b><i id="k"></i></div><p class="price">$ 5</p></body></html>'


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_detail_tasks_are_not_sent_to_the_driver(spark):
    """pages hold many links in few estimated bytes; variants meet their detail tasks in a shuffle."""
    links = '<a href="/products/1#top">1</a><a href="/products/2">2</a><a href="/products/1">1</a><a href="/cart">c</a><a class="variant-link" href="/products/9">9</a>'
    shop = spark.createDataFrame([("https://s.example.com/list/b", links), ("https://s.example.com/list/a", links), ("https://s.example.com/list/a", links), ("https://s.example.com/x", None), (None, links)], "url string, html string")
    red = '<a class="variant-link" data-color="red" href="?v=1">r</a><a class="variant-link" href="">e</a><a href="?v=2">o</a>'
    bodies = [("https://s.example.com/products/1", red), ("https://s.example.com/products/1", red.replace("red", "tan")), ("https://s.example.com/products/3", red), ("https://s.example.com/products/2", None), (None, red)]
    got = X.list_detail_variant_tasks(shop, spark.createDataFrame(bodies, "detail_url string, html string"))
    assert "Broadcast" not in physical(got)
    assert sorted(map(tuple, got.collect())) == [
        ("detail_page", "https://s.example.com/products/1", 1, "https://s.example.com/list/a", ""),
        ("detail_page", "https://s.example.com/products/2", 1, "https://s.example.com/list/a", ""),
        ("variant_page", "https://s.example.com/products/1?v=1", 2, "https://s.example.com/products/1", "tan"),
    ]
    assert "Broadcast" not in physical(got)  # nor in the plan that ran


def element_rows(spark):
    """Pages that come twice, without id, without some parents; elements without a number or a parent's number."""
    pages = [(1, PAGE), (2, PAGE.replace("$", "EUR")), (1, PAGE.replace('id="k"', 'id="m"')), (3, PAGE.replace("price", "cost")), (None, PAGE), (4, None), (5, PAGE)]
    e = E.materialize(E.parse_elements(spark.createDataFrame(pages, "page_id long, html string"), elements_plan.SIDES), "elements")
    e = e.where("page_id IS NULL OR NOT (page_id = 5 AND elem_id = 2)")
    odd = e.where("page_id = 2 AND elem_id = 3")
    return e.unionByName(odd.withColumn("elem_id", F.lit(None).cast("int"))).unionByName(odd.withColumn("parent_id", F.lit(None).cast("int")))


def test_parents_are_found_in_one_shuffle_of_the_elements(spark):
    """as the join on (page, id) finds them."""
    e = element_rows(spark)
    p = e.select("page_id", F.col("elem_id").alias("parent_id"), F.col("tag").alias("p_tag"), F.col("attrs").alias("p_attrs"), F.col("text").alias("p_text"))
    want, got = e.join(p, ["page_id", "parent_id"], "left"), E.with_parents(e)
    assert physical(got).count("Exchange") == 1 and "Join" not in physical(got)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sites_meet_the_elements_where_their_pages_are(spark):
    """neither are the elements shuffled again for their sites, nor are the sites sent to the driver."""
    got = physical(elements_plan._sited(Tables(spark, "/root/testdata/sf0.001")))
    assert got.count("Exchange hashpartitioning(page_id") == 2 and "(page_id#" in got and "Broadcast" not in got


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_pairs_are_not_shuffled_unless_signatures_are_many(spark, limit):
    """equal to the comparison of all pairs either way; a name that comes twice, one for two sites, and none."""
    rows = E.with_parents(element_rows(spark)).withColumn("site", F.when(F.col("page_id") == 3, "b").otherwise("a"))
    rows = E.materialize(rows, "sited")
    of = lambda cond, site, name: rows.where(cond).select(F.lit(site).alias("site"), F.lit(name).cast("string").alias("name"), E.signature().alias("sig"))
    saved = of("page_id = 2 AND tag = 'p'", "a", "price").unionByName(of("page_id = 3 AND tag = 'i'", "b", "price")).unionByName(of("page_id = 2 AND tag = 'b'", "a", "x"))
    saved = saved.unionByName(of("page_id = 3 AND tag = 'i'", "a", "x")).unionByName(of("page_id = 3 AND tag = 'p'", "a", None)).unionByName(of("page_id = 3 AND tag = 'p'", "c", "none"))
    saved = E.materialize(saved, "saved")
    top, every = {}, rows.join(saved, "site").withColumn("score", E._likeness_udf(F.col("sig"), E.signature())).where("page_id IS NOT NULL AND name IS NOT NULL").collect()
    for r in every:
        top[r["name"], r["page_id"]] = max(top.get((r["name"], r["page_id"]), 0), r["score"])
    plain = lambda rs: sorted((r["name"], r["page_id"], r["site"], str(r["elem_id"]), r["tag"], r["score"]) for r in rs)
    want = plain(r for r in every if r["score"] == top[r["name"], r["page_id"]] >= 40.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        found = E.relocate_elements(rows, saved)
        assert plain(found.collect()) == want and found.columns == ["name", "page_id", "site", "elem_id", "tag", "score"]
        assert ("Exchange hashpartitioning" in physical(E.relocation_pairs(rows, saved))) == (limit == "-1")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
