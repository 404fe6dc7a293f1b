"""Print the physical-plan shape of the main jobs (exchanges, joins, aggregates, scans).

Usage: python tools/explain.py [sf_dir] > PLANS.txt
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tableaudit.operators import charts as CH  # noqa: E402
from tableaudit.operators import clean as CL  # noqa: E402
from tableaudit.operators import conversations as CV  # noqa: E402
from tableaudit.operators import detect as D  # noqa: E402
from tableaudit.operators import features as FE  # noqa: E402
from tableaudit.plans import views as V  # noqa: E402
from tableaudit.session import local_session  # noqa: E402

KEEP = re.compile(r"(Exchange|Join|HashAggregate|ObjectHashAggregate|SortAggregate|Scan |ReadSchema|PushedFilters|"
                  r"Window|Generate|MapInPandas|TakeOrderedAndProject|MapInArrow|InMemoryTableScan|BroadcastExchange|"
                  r"WindowGroupLimit|Expand|CartesianProduct|BroadcastNestedLoopJoin)")


def shape(title: str, df) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    print(f"== {title}")
    for line in plan.splitlines():
        if KEEP.search(line):
            print("   " + line.strip()[:160])
    print()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    raw = V.table(spark, sf, "lineitem")
    seen = []
    # Operators collect small results: their plans are taken where they ask for them.
    collect = type(raw).collect
    type(raw).collect = lambda self: seen.append(self) or collect(self)
    det = D.detect(V.dirty_lineitem(spark, sf), V.DIRTY_LINEITEM_BOUNDS)
    for i, df in enumerate(seen):
        shape(f"D.detect, job {i + 1} of {len(seen)}", df)
    seen.clear()
    FE.correlations(V.dirty_lineitem(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], dict.fromkeys(["l_quantity"], 0.0))
    for df in seen:
        shape("FE.correlations", df)
    type(raw).collect = collect
    a = {"anomaly_type": "LOGICAL_VIOLATION", "column_name": "l_quantity", "lower_bound": 1.0, "upper_bound": 40.0}
    shape("CL.clean: one projection + filter, pruned scan", CL.apply_one(raw, a, "drop_rows").df.select("l_orderkey", "l_quantity"))
    conv = V.table(spark, sf, "conversations")
    shape("CV.conversation_context", CV.conversation_context(conv))
    orders = V.dirty_orders(spark, sf)
    shape("D.flag_rows: groups cut into chunks and dealt out", D.flag_rows(orders, D.detect(orders, V.DIRTY_ORDERS_BOUNDS)))
    shape("D.detect_duplicates: digests alone are shuffled", D.detect_duplicates(V.dirty_lineitem(spark, sf)))
    shape("CH.time_line", CH.time_line(V.table(spark, sf, "events"), "ts", "value"))
    assert det.records


if __name__ == "__main__":
    main()
