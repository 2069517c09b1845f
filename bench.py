"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

import json
import os
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")

from larkspur.plans.queries import QUERIES, table  # noqa: E402
from larkspur.session import get_session  # noqa: E402

HEADLINES = [
    "flagship_hourly", "flagship_zone", "flagship_payment", "flagship_single", "flagship_rate", "flagship_net", "filter_predicate", "groupby_multi_ops",
    "groupby_category", "join_inner", "join_left", "sort_desc_topk", "cumsum_global", "value_counts", "describe_quartiles", "string_indexer", "one_hot", "standard_scaler", "csv_roundtrip", "ndjson_scan_select",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, sf_dir, "lineitem").df.write.format("noop").mode("overwrite").save()  # the JVM's first job
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
