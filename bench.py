"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query runs once to its last row after one warm-up of the flagship.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "to_sentences", "text_profile", "char_vocab", "word_vocab", "dedupe_prioritised", "cap_words", "holdout_by_content",
    "contains_holdout", "score_by_language", "bootstrap_ci", "mixture_sample", "length_buckets", "nb_scores", "argmax_route",
    "router_agreement", "apply_marks", "punct_probe", "ngram_counts", "kn_discounts", "rescore_grid", "validate_submission",
]


def main() -> None:
    from tessitura.plans import catalog
    from tessitura.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), name="bench")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    queries["score_by_language"](spark, small if os.path.isdir(small) else sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
