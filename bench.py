"""Bench: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion (reports collected, cleaned/engineered
tables written to the no-op sink). A short warm-up on the smallest tables
runs first so JVM start-up is not billed to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tableaudit.operators import clean as CL  # noqa: E402
from tableaudit.operators import detect as D  # noqa: E402
from tableaudit.operators import eda as EDA  # noqa: E402
from tableaudit.operators import features as FE  # noqa: E402
from tableaudit.operators import profile as P  # noqa: E402
from tableaudit.plans import views as V  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SPEAR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_DECISIONS = [
    {"anomaly_id": "DUPLICATE_ROWS", "action": "remove_duplicates"},
    {"anomaly_id": "MISSING_DATA|l_returnflag", "action": "drop_rows"},
    {"anomaly_id": "MISSING_DATA|l_quantity", "action": "fill_median"},
    {"anomaly_id": "LOGICAL_VIOLATION|l_discount", "action": "clamp_bounds"},
    {"anomaly_id": "STATISTICAL_OUTLIER|l_extendedprice", "action": "cap_iqr"},
    {"anomaly_id": "MISSING_DATA|l_shipdate", "action": "keep_as_is"},
]


def session() -> SparkSession:
    cpus = int(CPUS) if CPUS.isdigit() else os.cpu_count()
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("tableaudit-bench")
             .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_PARTITIONS", str(max(cpus, 8))))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        conf = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="tableaudit-bench-ckpt-"))
    return spark


def run_detect(spark, sf):
    det = D.detect(V.dirty_lineitem(spark, sf), V.DIRTY_LINEITEM_BOUNDS)
    return det.anomalies.collect(), det


def run_clean(spark, sf, det):
    res = CL.clean(V.dirty_lineitem(spark, sf), det, LINE_DECISIONS)
    res.df.write.format("noop").mode("overwrite").save()
    return res.changes.collect()


def run_engineer(spark, sf):
    eng = FE.engineer(V.order_lines(spark, sf))
    eng.df.write.format("noop").mode("overwrite").save()
    return eng.report.collect()


def run_column_stats(spark, sf):
    return P.column_stats(V.dirty_lineitem(spark, sf)).collect()


def run_pearson(spark, sf):
    return EDA.pearson_matrix(V.order_lines(spark, sf)).collect()


def run_spearman(spark, sf):
    return EDA.top_spearman(V.dirty_lineitem(spark, sf), 3, columns=SPEAR_COLS).collect()


def main():
    spark = session()
    warm = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else SF_DIR
    _, wdet = run_detect(spark, warm)  # JVM / JIT / Python-worker warm-up on the smallest tables
    run_clean(spark, warm, wdet)
    run_engineer(spark, warm)
    run_column_stats(spark, warm)
    run_pearson(spark, warm)
    run_spearman(spark, warm)
    times = {}
    t = time.time()
    _, det = run_detect(spark, SF_DIR)
    times["detect"] = time.time() - t
    for name, fn in [("clean", lambda: run_clean(spark, SF_DIR, det)),
                     ("engineer", lambda: run_engineer(spark, SF_DIR)),
                     ("column_stats", lambda: run_column_stats(spark, SF_DIR)),
                     ("pearson_matrix", lambda: run_pearson(spark, SF_DIR)),
                     ("top_spearman", lambda: run_spearman(spark, SF_DIR))]:
        t = time.time()
        fn()
        times[name] = time.time() - t
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()}, "sf": sf, "cpus": CPUS}))


if __name__ == "__main__":
    main()
