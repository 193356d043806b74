"""Relational operators on readings (all built-in column expressions)."""

from sensorlake.operators.errors import error_summary
from sensorlake.operators.keys import hash_range, token, token_range, token_splits, unexpired, with_expiry
from sensorlake.operators.quality import range_flags, step_flags, temperature_residual
from sensorlake.operators.readings import (
    presentation,
    report_columns,
    select_columns,
    type_readings,
    with_id,
)
from sensorlake.operators.report import (
    latest,
    lookup,
    newest_first,
    page,
    row_count,
    sample_then_sort,
    take_any,
    unpivot_readings,
)
from sensorlake.operators.sequence import number_rows, slice_keys, with_previous

__all__ = [
    "error_summary",
    "hash_range",
    "latest",
    "lookup",
    "newest_first",
    "number_rows",
    "page",
    "presentation",
    "range_flags",
    "report_columns",
    "row_count",
    "sample_then_sort",
    "select_columns",
    "slice_keys",
    "step_flags",
    "take_any",
    "temperature_residual",
    "token",
    "token_range",
    "token_splits",
    "type_readings",
    "unexpired",
    "unpivot_readings",
    "with_expiry",
    "with_id",
    "with_previous",
]
