"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["fk_edges_lineitem", "degree_stats", "column_stats", "zscore_orders", "children_width_bound", "context_rows", "context_tokens_budget", "attn_column", "attn_feature", "attn_neighbor", "wraparound_slots", "sequence_pack"]


def main() -> None:
    import tempfile

    from relata.plans.queries import QUERIES

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="relata-bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["num_batches"](spark, sf_dir).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
