"""Times the headline queries and prints one line of JSON.

Not the corpus operators: those have a tool and budgets of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

from pyspark.sql import SparkSession  # noqa: E402

from terrasift.queries import QUERIES  # noqa: E402

#: Queries over saved pages that aren't timed: building their plan outweighs all else, as for the one of them that is.
#: Of the queries over archives one is timed: writing and reading them is most of each.
OMITTED = {"search_page_metadata", "community_units", "property_choice", "listing_enrichment", "archive_candidates", "archive_sanitized", "archive_templates"}
#: Runs of each query, of which the best counts; and one before them all, to start the JVM and workers. One that takes
#: longer than LONG seconds runs once.
RUNS, LONG = 2, 15


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["topk_per_group_unknown_last"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name, run in QUERIES.items():
        if name in OMITTED:
            continue
        for _ in range(RUNS):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(min(took.get(name, 1e9), time.perf_counter() - began), 3)
            if took[name] > LONG:
                break
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
