"""Places where a user's own Python meets the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

OUTCOME = "ok boolean, retry boolean, records array<string>, discovered array<string>, error string"
_FIELDS = [
    ("ok", pa.bool_()), ("retry", pa.bool_()), ("records", pa.list_(pa.string())), ("discovered", pa.list_(pa.string())), ("error", pa.string()),
]


def _outcome(processor: Callable[[dict], dict], row: dict) -> dict:
    """What a processor makes of a row; what it raises is a failed outcome of that row."""
    try:
        got = processor(row) or {}
    except Exception as e:  # one bad item must not fail the batch
        got = {"ok": False, "error": f"{type(e).__name__}: {e}"}
    return {
        "ok": bool(got.get("ok", True)), "retry": bool(got.get("retry", False)), "records": list(got.get("records", ())),
        "discovered": list(got.get("discovered", ())), "error": got.get("error", ""),
    }


def process_items(items: DataFrame, processor: Callable[[dict], dict], key: str) -> DataFrame:
    """Outcome of a processor for each item, in Arrow batches.

    The processor gets a row as a dict and returns any of ok, retry, records, discovered and
    error; what it raises becomes a failed outcome of that row.  The result feeds
    ``frontier.apply_outcomes``.
    """
    key_type = dict(items.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(key, batch.schema.field(key).type), *_FIELDS])
            yield pa.RecordBatch.from_pylist([{key: row[key], **_outcome(processor, row)} for row in batch.to_pylist()], schema=schema)

    return items.mapInArrow(run, f"{key} {key_type}, {OUTCOME}")


def register_processor(spark: SparkSession, name: str, processor: Callable[[dict], dict], key: str) -> None:
    """Make a processor a table function for SQL: ``SELECT * FROM name(TABLE(items))``.

    Its columns follow from the table it is given: the key keeps its type.  Rows are taken where they lie.
    """
    outcome = StructType.fromDDL(OUTCOME)

    class Processor:
        @staticmethod
        def analyze(items: AnalyzeArgument) -> AnalyzeResult:
            if not items.isTable or key not in items.dataType.names:
                raise ValueError(f"{name} takes a table with the column {key}")
            return AnalyzeResult(schema=StructType([items.dataType[key], *outcome.fields]))

        def eval(self, row: Row):
            got = row.asDict(recursive=True)
            yield (got[key], *_outcome(processor, got).values())

    spark.udtf.register(name, udtf(Processor))
