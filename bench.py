"""Headline queries on one table set; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query is run to its last row into the no-op sink. A first pass over the smallest query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievelab.plans.queries import all_queries  # noqa: E402
from sievelab.session import get_spark  # noqa: E402

HEADLINE = [
    "dedup_message", "drop_conflicts", "stratified_regions", "size_ladder", "inject_mislabel", "clean_noise_pool",
    "union_noise_pool", "mix_noisy_train", "dataset_summary", "normalize_text", "tokenize_words", "stem_tokens",
    "drop_rare_tokens", "build_dictionary", "doc2bow", "ngrams", "count_vectorize", "tfidf", "tfidf_sublinear",
    "encode_fixed_length", "knn_selfjoin", "lof_flag_by_class", "lof_flag_global", "confident_joint",
    "find_label_errors", "elliptic_envelope", "isolation_forest", "truncated_svd", "lsa_fold_in_scaled",
    "micro_macro_weighted", "classification_report", "best_epoch", "ovr_linear_svm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    queries["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
