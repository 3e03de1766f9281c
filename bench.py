"""Times the headline queries: python bench.py prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
HEADLINE = (
    "q_left_join_chain", "q_alias_index", "q_vector_topk", "q_dedup_per_parent", "q_expand_adaptive", "q_context_budget", "q_word_tokens", "q_uuid5", "q_legacy_split", "q_fixed_chunks", "q_document_tree", "q_child_chunks", "q_html_tables",
    "q_semantic_edges", "q_layout_standard", "q_length_stats", "q_cer", "p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_packed", "p8_mixture", "p9_found",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(HERE))
    spec = importlib.util.spec_from_file_location("spark_entry", HERE / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = entry.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # warm-up
    took: dict[str, float] = {}
    for name in HEADLINE:
        if name in queries:
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
