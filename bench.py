"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidewell import queries as catalogue
from tidewell.engine import Engine, Input, Query

HEADLINES = ["incremental_agg_localized_edit", "incremental_join_batch", "backdate_decisions", "reconcile_outcomes", "dependency_closure", "watcher_debounce", "json_sections", "import_resolution", "class_flatten", "canonical_digest"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        catalogue.Q[name](spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    # The engine's own cycle: cold, no change, 1 % edit, with its work counts.
    e = Engine(spark)
    orders = e.declare(Input("orders", ["o_orderkey"]))
    e.declare(Query("revenue", ["o_custkey"], ["orders"], catalogue._revenue, {"orders": lambda rows, tables: rows}))
    raw, counts = spark.read.parquet(f"{d}/orders.parquet"), {}
    for step, rows in (("engine_cold", raw), ("engine_unchanged", raw), ("engine_edit_1pct", catalogue._edited(raw))):
        e.reset_statistics()
        began = time.perf_counter()
        e.set(orders, rows)
        e.get("revenue").write.format("noop").mode("overwrite").save()
        seconds[step] = round(time.perf_counter() - began, 3)
        counts[step] = {k: v for k, v in e.statistics().items() if k.startswith("query_")}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "counts": counts, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
