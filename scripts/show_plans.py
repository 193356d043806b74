"""Write PLANS.md: the executed physical plan of each headline query at a given scale,
with long expressions shortened so operators, exchanges, pushed filters and read
schemas stand out.

Usage: python scripts/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sensorlake.plans.catalog import QUERIES  # noqa: E402
from sensorlake.session import get_session  # noqa: E402

NAMES = [
    "decode_readings",
    "split_good",
    "point_lookup",
    "latest_100",
    "page_3",
    "dashboard",
    "row_numbers_hot_sensor",
    "step_flags_hot_sensor",
    "row_numbers_global",
    "error_summary",
    "csv_skip_max",
]

KEEP = re.compile(
    r"(Exchange|Window|Join|Aggregate|TakeOrderedAndProject|Sort|Scan|Generate|Filter|"
    r"Limit|QueryStage|ReusedExchange|Union|Project|Expand|ColumnarToRow)"
)


def shorten(line: str, width: int = 160) -> str:
    if "FileScan" in line or "Scan " in line:
        # keep what the scan is told: pruned columns, partition and pushed filters
        line = re.sub(r"Batched: \w+, ", "", line)
        line = re.sub(r", Format: \w+, Location: .*?(?=, PartitionFilters)", "", line)
        line = re.sub(r"#\d+L?", "", line)
        return line if len(line) <= 2 * width else line[: 2 * width - 3] + "..."
    line = re.sub(r"invoke\(StructsToJsonEvaluator\(.*?\)\)\)", "to_json(...)", line)
    line = re.sub(r"from_json\(StructField.*?Some\(UTC\), false\)", "from_json(...)", line)
    line = re.sub(r"#\d+L?", "", line)
    return line if len(line) <= width else line[: width - 3] + "..."


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("+- == Initial Plan ==")[0]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    print(f"# Physical plans\n\nExecuted (adaptive, final) plans at `{sf_dir}`, local[8]; "
          "generated by `scripts/show_plans.py`. Expressions are shortened.\n")
    for name in NAMES:
        df = QUERIES[name](spark, sf_dir)
        plan = final_plan(df)
        lines = [shorten(x) for x in plan.split("\n") if KEEP.search(x)]
        print(f"## {name}\n\n```\n" + "\n".join(lines) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
