"""Write the physical plans of the headline queries to docs/PLANS.md.

Usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOTES = {
    "city_day_slice": "Point filter on the ingested table: time range and city are parquet "
                      "PushedFilters; only the needed columns are read.",
    "range_kpis": "Range + city filter pushed to the scan; one partial/final aggregate.",
    "rule_engine": "Rules are inline CASE expressions: the only exchange is the city-day "
                   "aggregate.",
    "advisory_bulletin": "Summary, mode level and extremes in one aggregate; the level "
                         "dimension (5 rows) is broadcast.",
    "rolling_means": "No hot series at this size, so the auto layout is one exchange by city "
                     "and one sort; medians come from a histogram aggregate job before it.",
    "rolling_means_halo": "Halo layout (what hot series get): core rows go straight to the "
                          "final exchange; block tails are a map-side top-11 "
                          "(WindowGroupLimit) joined with the small block-pairs table.",
    "box_stats": "One pass over the rows builds the (level, variable, value) histogram; "
                 "quartiles and tails come from the histogram, fences are broadcast.",
    "stratified_split": "Exact class ranks: (label, md5-bucket) counts become broadcast "
                        "offsets; rows are ranked inside (label, bucket) partitions.",
    "days_per_level": "Distinct days per level as a two-level aggregate (no global sort).",
    "corr_matrix": "Fifteen correlations in one aggregate, then an inline of 25 structs.",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from stormcell.queries import QUERIES
    from stormcell.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    out = ["# Physical plans of the headline queries",
           "",
           f"Generated by `tools/show_plans.py` on `{os.path.basename(sf_dir)}` "
           "(initial adaptive plans; AQE may still coalesce partitions or switch joins).",
           ""]
    for name, note in NOTES.items():
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r"file:[^\]\s,]+", "<path>", plan)
        out += [f"## {name}", "", note, "", "```", plan.rstrip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                        "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
