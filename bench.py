"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from dealscope import catalog

NAMES = ["D1_global_kpis", "D2_quarterly", "D8_top_clients_revenue", "D21_period_revenue", "C2_numeric_overview", "C11_correlation", "E1_iqr_outliers", "B15_zscores", "F1_interpolated", "I12_metrics", "H5_dbscan_kinds_5d", "H7_silhouette_squared", "G1_pca_scores", "F9_trend_year", "D12_ratio_describe", "C16_ecdf"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            t = time.time()
            catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
            if sum(runs) > 15:  # a long query is not repeated
                break
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
