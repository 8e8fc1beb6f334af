"""Time the headline queries and print one JSON line.

Settings come from the environment: BENCH_SF_DIR (default the sf0.1 tables),
BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pairloom.staging import session_builder  # noqa: E402
from pairloom.workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "split_sentences",
    "most_ambiguous_words",
    "tag_words",
    "tag_entities",
    "prepare_corpus",
    "text_segments",
    "raw_patterns",
    "centroids",
    "pattern_matches",
    "tuple_confidence",
    "hist_match_similarity",
    "final_patterns",
    "bootstrap_relations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = (
        session_builder("pairloom-bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        started = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "relation extraction, total of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
