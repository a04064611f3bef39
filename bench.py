"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from colloquy.plans.registry import QUERIES
from colloquy.session import local_session

HEADLINES = [
    "agg1_stage_transition_flow", "agg2_state_nodes", "agg15_merged_nodes", "agg18_merged_edges", "agg7_agreement", "agg10_cooccurrence", "tag1_matrix", "tag2_merge_strategies",
    "win9_dialogue_units", "win16_packed", "join4_interval_join", "join11_word_to_segment", "rec1_pair_evaluation", "gr5_neighbours", "gr11_as_of", "gr13_superseded", "gr18_label_propagation",
    "vec1_cosine_top_k", "join15_nearest_label_centroid", "ret8_jaccard_search", "ev10_value_scores", "ev18_jensen_shannon", "win18_threshold_sweep", "st2_frame_events", "fn_pii_scrub",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        for run in ("warm", "timed"):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run == "timed":
                seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("/")[2].removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
