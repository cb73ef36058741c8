"""Costly work of a query is done once: what its plan reads, and what the price patterns tell apart."""

import pytest
from pyspark.sql import functions as F

from harvestlake.functions import text
from harvestlake.plans import stream_plan
from harvestlake.sources import sinks
from harvestlake.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exports_share_one_pass_over_the_offers(spark, monkeypatch):
    plans, save = [], sinks.sink_export
    monkeypatch.setattr(sinks, "sink_export", lambda rows, *a: (plans.append(plan(rows)), save(rows, *a)))
    stream_plan._exported(Tables(spark, SF))
    assert len(plans) == 3 and not any("Join" in p for p in plans)


@pytest.mark.parametrize(
    "raw, low, high",
    [
        ("1.299,95 kr", 1299.95, 1299.95), ("1,299.95", 1299.95, 1299.95), ("1,234,567", 1234567.0, 1234567.0), ("1.234.567 EUR", 1234567.0, 1234567.0), ("12,5", 12.5, 12.5),
        ("12.345", 12345.0, 12345.0), ("12.34", 12.34, 12.34), ("1.234.5", 12345.0, 12345.0), ("-5,00", -5.0, -5.0), ("$3.10 – $28,75", 3.10, 28.75), ("a-b 7 ~ 9", 7.0, 9.0), ("ask", None, None),
    ],
)
def test_price_forms(spark, raw, low, high):
    df = spark.createDataFrame([(raw,)], "p string")
    assert tuple(df.select(text.parse_lowest_price(F.col("p")), text.parse_price(F.col("p"))).first()) == (low, high)
