"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import all_queries
from tidemark.session import local_session

HEADLINE = [
    "a4_consensus_buys", "a3_consensus_holdings", "j2_quarter_moves", "a1_portfolio_positions",
    "w1_resolved_filings", "v3_quality_gate", "j4_price_asof", "j10_forward_returns",
    "v1_portfolio_valuation", "a7_insider_activity", "v4_feature_table", "k11_score_windows",
    "b4_metrics_by_split", "w12_average_ranks", "j6_resolution_chain", "s1_info_table_xml",
    "s3_form4_xml", "a15_price_validation", "a17_form4_validation", "v7_ticker_flow",
    "a18_status_rollup", "a24_closeout_keys", "st4_rate_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    queries = all_queries()
    # One untimed run starts the code generator and the file system caches.
    queries["p3_long_only"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
