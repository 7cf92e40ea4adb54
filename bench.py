"""Headline query timings: one warm-up, median of 3, results fully materialised.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillstar.operators import analytics as A  # noqa: E402
from tillstar.operators.merge import load  # noqa: E402
from tillstar.plans import catalog  # noqa: E402
from tillstar.plans.testdata import batch_a, batch_b, dirty_export  # noqa: E402
from tillstar.schema import WIDE  # noqa: E402
from tillstar.session import build_session, scratch_path  # noqa: E402
from tillstar.sources.warehouse import Warehouse  # noqa: E402

HEADLINE = (
    "country_top",
    "product_flop_1997",
    "monthly_sales",
    "product_price_list",
    "quality_report",
    "clean_rows",
    "rejected_rows",
    "pair_top",
)
# timed on a warehouse that is loaded once, outside the timing
ON_WAREHOUSE = {
    "warehouse_country_top": lambda star: A.ranking(star, "country"),
    "warehouse_monthly": A.monthly,
    "warehouse_price_list": A.price_list,
}


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def load_detail(spark, sf_dir):
    """Two monthly batches merged into a fresh warehouse, then the fact read back."""
    return loaded(spark, sf_dir).table("detailinvoice")


def loaded(spark, sf_dir):
    wh = Warehouse(spark, scratch_path(spark, "bench-warehouse"), WIDE)
    dirty = dirty_export(spark, sf_dir)
    load(wh, batch_a(dirty), "A")
    load(wh, batch_b(dirty), "B")
    return wh


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app="tillstar-bench")
    qs = catalog.queries()
    jobs = {name: qs[name] for name in HEADLINE}
    jobs["load_detail"] = load_detail
    wh = loaded(spark, sf_dir)
    for name, fn in ON_WAREHOUSE.items():
        jobs[name] = lambda *_, fn=fn: fn(wh.star())
    out = {}
    for name, fn in jobs.items():
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            materialise(fn(spark, sf_dir))
            if i:
                times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
