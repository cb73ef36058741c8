"""All registered queries."""

from harvestlake.plans import elements_plan, extract_plan, oplog_plan, pages_plan, records_plan, scoring_plan, stream_plan  # noqa: F401
from harvestlake.plans.registry import ORACLES, QUERIES  # noqa: F401
