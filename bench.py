"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated subset.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geoquarry.plans.catalogue import QUERIES  # noqa: E402
from geoquarry.session import build_session  # noqa: E402

HEADLINE = [
    "a10_vqa_metrics", "a11_change_qa_metrics", "a8_routing_accuracy", "f10_route", "j16_rule_hits", "w7_best_tasks",
    "p4_stretch", "p6_display_rgb", "p8_nd_index", "a3_sar_physics", "a1_channel_stats", "j11_resample_bilinear",
    "j13_morph_open_close", "a5_diff_stats", "a7_mask_metrics", "a6_mask_quality", "j17_label_scores", "a13_recall_at_k",
    "a14_macro", "w9_softmax_delta", "f5_bleu_ref", "f6_rouge_l", "f7_cider_proxy", "j19_box_iou", "l2_best_box",
    "j5_pair_targets", "j6_verify_pairs", "j7_verify_manifest", "a19_summarize", "p19_check_pairs", "p25_validate_results",
    "a25_trace_stats", "t1_route_stream",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session("geoquarry-bench")
    # start the JVM, the code generator and the Python workers outside the clock
    QUERIES["d1_user_encoder"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
