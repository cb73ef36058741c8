"""Values of any depth, pages with many candidates, null keys and the shuffles of running values."""

import json

from pyspark.sql import functions as F

from harvestlake.operators import oplog, scans, scoring


def leaves(value, path=""):
    items = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))
    for k, v in items:
        at = f"{path}.{k}" if path else k
        if isinstance(v, (dict, list)):
            yield from leaves(v, at)
        else:
            yield k, at, "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def test_json_leaves_of_any_depth(spark):
    deep = {"sign": "end"}
    for k in range(12):
        deep = {f"k{k}": deep, "n": k} if k % 3 else [deep, k]
    texts = [json.dumps(v) for v in ({"a": 1, "b": {"c": [1, {"d": None}]}}, deep, [deep, {"x": [[[[[["y"]]]]]]}], [], {"e": {}})] + ["", None, "not json", "5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "call_id long, body string")
    got = sorted((r["call_id"], r["name"], r["path"], r["value"]) for r in scoring.json_leaves(rows, "body", ["call_id"]).collect())
    assert got == sorted((i, *leaf) for i, t in enumerate(texts[:5]) for leaf in leaves(json.loads(t)))
    calls = spark.createDataFrame([(1, "s", "https://x/y", texts[1])], "call_id long, site string, url string, post_data string")
    assert [r["signed_components"] for r in scoring.request_param_profile(calls).collect()] == [1]


def test_all_candidates_of_a_page_count(spark):
    rows = [("p", f"https://h/api/{i}" + ("?token=1&sign=2" if i == 29 else ""), "GET", "json", 90 - i, 200) for i in range(30)]
    df = spark.createDataFrame(rows, "page string, url string, method string, kind string, score int, status_code int")
    codes = [r["code"] for r in scoring.api_signals(df).collect()]
    assert codes.count("observed_api_candidate") == 30 and "api_auth_token_hint" in codes
    few = [r["code"] for r in scoring.api_signals(df, per_page=10).collect()]
    assert few.count("observed_api_candidate") == 10 and "api_auth_token_hint" not in few


def shuffles_of(df, column):
    """Exchanges that move a column."""

    def below(node):
        children = node.children()
        yield node
        for i in range(children.size()):
            yield from below(children.apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    return sum(1 for n in below(plan) if n.nodeName() == "Exchange" and f"{column}#" in n.output().mkString(","))


def test_running_values_move_the_log_once(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        log = spark.range(100).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("at"), F.hex("id").alias("payload"))
        for out in (
            scans.streak(log, ["g"], ["at"], F.floor(F.col("at") / 10), F.col("at") % 4 == 0, "s", index="i"),
            scans.running(log, ["g"], ["at"], F.floor(F.col("at") / 10), sums={"n": F.lit(1)}, lags={"before": F.col("at")}),
        ):
            assert shuffles_of(out, "payload") == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rows_without_a_key_are_a_group(spark):
    rows = [(None if i % 3 == 0 else "a", "x" if i % 2 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, h string, at long")
    got = {r["at"]: (r["n"], r["before"]) for r in scans.running(df, ["g", "h"], ["at"], F.floor(F.col("at") / 7), sums={"n": F.lit(1)}, lags={"before": F.col("at")}).collect()}
    groups = {}
    for g, h, at in rows:
        seen = groups.setdefault((g, h), [])
        assert got[at] == (len(seen) + 1, seen[-1] if seen else None)
        seen.append(at)


def test_errors_are_numbered_over_chunks(spark):
    rows = [("r%d" % (i % 2), i * 700_000_000, i, i % 3 == 0, "" if i % 5 == 0 else f"e{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "run_id string, ts_us long, request_id long, ok boolean, error string")
    want = {}
    for run, _, i, ok, error in rows:
        if not ok and error:
            want[i] = sum(1 for r in want.values() if r[0] == run) + 1, error
            want[i] = (run, *want[i])
    got = {r["request_id"]: (r["run_id"], r["error_no"], r["error"]) for r in oplog.fetch_errors(df).collect()}
    assert got == want
    assert {r["request_id"] for r in oplog.fetch_errors(df, per_run=3).collect()} == {i for i, (_, n, _) in want.items() if n <= 3}
