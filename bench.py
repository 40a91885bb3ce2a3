"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON with the seconds of each."""

import json
import os
import time

from pyspark.sql import SparkSession

from lexloom import plans

HEADLINE = ["o_longest_match", "p_canonical_text", "p_language", "p_status", "g_tokens", "g_ngrams", "a_keyness", "a_cvalue", "a_oov", "r_bm25", "e_retrieval", "a_pair_counts", "p_fold", "g_protected_raw"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = plans.queries(), {}
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()  # start the JVM's readers
    segments = plans.queries()["g_line_segments"](spark, folder).count()
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "seconds over all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")), "segments": segments, "segments_per_second": round(segments / took["o_longest_match"])}))


if __name__ == "__main__":
    main()
