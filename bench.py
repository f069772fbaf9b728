"""Headline queries over one scale factor; prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores (default 8)
BENCH_QUERIES comma-separated names, or "all" for every query
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clubspark.plans.catalog import QUERIES
from clubspark.session import local_session, release

HEADLINE = [
    "weather_impact",
    "player_summary",
    "monthly_trends",
    "performers_by_conditions",
    "player_history",
    "unpivot_rounds",
    "clean_weather",
    "assign_dates_weighted",
    "adjust_scores",
    "adjust_scores_compound",
    "adjust_scores_eda",
    "round_numbers",
    "handicaps",
    "handicaps_eda",
    "player_stats",
    "best_per_player",
    "assign_player_ids",
    "load_players",
    "load_rounds",
    "load_audit",
    "check_foreign_keys",
    "describe_scores",
    "top_scores_poor",
    "box_by_season",
    "describe_distribution",
    "bootstrap_moments",
    "fit_compare",
    "welch_tests",
    "corr_handicap_score",
    "training_features",
    "scale_features",
    "book_requests",
    "stream_player_stats",
    "model_linear",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="16g")
    QUERIES["weather_impact"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
