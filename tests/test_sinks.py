"""Append logs and task tables: what a reader sees after repeated and broken-off writes."""

import random

from pyspark.sql import functions as F

from harvestlake.operators import frontier
from harvestlake.session import create_once, fresh_path
from harvestlake.sources import sinks

LOG = "run_id string, id long, text string"


def test_repeated_append_leaves_one_copy(spark):
    path = fresh_path(spark, "log")
    df = spark.createDataFrame([("a b/ü", 1, "x"), ("r2", 2, None), (None, 3, "y")], LOG)
    assert sinks.read_log(spark, path, df.schema).count() == 0
    assert [sinks.append_log(df, path, batch=b) for b in (0, 0, 1, 0)] == [True, False, True, False]
    assert sorted(map(str, sinks.read_log(spark, path, df.schema).collect())) == sorted(map(str, df.unionByName(df).collect()))
    assert sinks.append_log(df, path) and sinks.append_log(df, path)
    assert sinks.read_log(spark, path, df.schema).count() == 12
    assert sinks.append_log(df.limit(0), path, batch="none") and sinks.read_log(spark, path, df.schema).count() == 12


def test_broken_off_append_is_not_read(spark):
    path = fresh_path(spark, "log")
    df = spark.createDataFrame([("r", i, "x") for i in range(9)], LOG)
    sinks._attempt(df, path, "run_id")  # files without a commit
    assert create_once(spark, f"{path}/commits/batch-7", '{"files": ["attem')  # a commit without its end
    assert sinks.read_log(spark, path, df.schema).count() == 0
    assert sinks.append_log(df, path, batch=7) and not sinks.append_log(df, path, batch=7)
    assert sinks.read_log(spark, path, df.schema).count() == 9


def test_saves_replace_whole_tasks(spark):
    path, r = fresh_path(spark, "tasks"), random.Random(3)
    table, versions = {}, []
    schema = "task_id string, item_index long, title string"
    for _ in range(5):
        tasks = {f"t{r.randrange(20)}": r.randrange(1, 5) for _ in range(6)}
        rows = [(t, i, f"v{r.random():.6f}") for t, n in tasks.items() for i in range(n)]
        versions.append(dict(table))
        for t in tasks:
            table[t] = sorted(x for x in rows if x[0] == t)
        df = spark.createDataFrame(rows, schema)
        assert sinks.save_task_result(spark, path, df, buckets=4) == len(versions) - 1
        got = sinks.read_tasks(spark, path, df.schema).collect()
        assert sorted(map(tuple, got)) == sorted(x for rows in table.values() for x in rows)
    old = sinks.read_tasks(spark, path, df.schema, version=2).collect()
    assert sorted(map(tuple, old)) == sorted(x for rows in versions[3].values() for x in rows)


def test_save_broken_off_leaves_the_old_version(spark):
    path = fresh_path(spark, "tasks")
    df = spark.createDataFrame([("t", 0, "old")], "task_id string, item_index long, title string")
    sinks.save_task_result(spark, path, df)
    sinks._attempt(df.withColumn("bucket", F.lit(0)), path, "bucket")
    assert create_once(spark, f"{path}/commits/1", '{"buckets"')
    assert [r["title"] for r in sinks.read_tasks(spark, path, df.schema).collect()] == ["old"]
    assert sinks.save_task_result(spark, path, df.withColumn("title", F.lit("new"))) == 1
    assert [r["title"] for r in sinks.read_tasks(spark, path, df.schema).collect()] == ["new"]


def test_lineage_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n)] + [(f"c{n}", "c0")], "parent string, child string")
    seeds = spark.createDataFrame([("c0",)], "url string")
    out = frontier.crawl_lineage(seeds, edges)
    assert {r["url"]: (r["depth"], r["parent_url"]) for r in out.collect()} == {f"c{i}": (i, f"c{i - 1}" if i else "") for i in range(n + 1)}
    assert len(out._jdf.queryExecution().toString()) < 5000
    assert frontier.crawl_lineage(seeds, edges, max_depth=3).count() == 4
