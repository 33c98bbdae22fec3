"""Time the headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (threads), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import time

from towline.catalog import REGISTRY
from towline.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALL_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.01")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "a08_quantiles",
    "a16_pivot_sum",
    "a18_crosstab",
    "b01_bootstrap_exact",
    "b01_bootstrap_poisson",
    "b01_bootstrap_split",
    "b02_bootstrap_ratio",
    "b03_bootstrap_summary",
    "b05_design_study",
    "b06_compare_designs",
    "d01_allocate_lengths",
    "d01_expand_lengths",
    "d04_density_grid",
    "d05_log_log_fit",
    "d06_ks_two_sample",
    "e03_expand_estimate",
    "e04_clapper_estimate",
    "e05_cpue",
    "e07_tow_summary",
    "e12_t_interval",
    "e14_final_report",
    "e17_number_harvest",
    "j03_complete_zero_full",
    "p17_duplicates",
    "w01_number_harvest",
    "w02_weight_harvest",
    "w03_clapper_summary",
    "w04_class_table",
    "w05_sample_size_study",
    "w06_expanded_heights",
)


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to plan the query and compute every row of the result; nothing is sent to the driver."""
    start = time.time()
    REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    spark = build_session(
        "towline-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    # The first run of a query also compiles its generated code, so the better of two counts.
    seconds = {name: round(min(run(spark, name, SF_DIR), run(spark, name, SF_DIR)), 3) for name in names}
    result = {"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds}
    result["sf"] = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    # A second size, run when everything is compiled, tells time that follows the data from time that planning takes.
    if os.path.isdir(SMALL_DIR) and os.path.realpath(SMALL_DIR) != os.path.realpath(SF_DIR):
        result["small_sf"] = os.path.basename(SMALL_DIR).removeprefix("sf")
        result["small_queries"] = {name: round(run(spark, name, SMALL_DIR), 3) for name in names}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
