"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from hexafact import catalogue
from hexafact.operators.compile import FACT_SCHEMA
from hexafact.operators.substrate import Substrate, discover, query
from hexafact.sources.sinks import to_parquet

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

#: Over stored facts: name -> what to run on the orders, lines and parts stores.
STORED = {
    "one_dim_eq": lambda s: query(s["orders"], 'WHERE.nation = "NATION_3"', None).ids,
    "three_dim_and": lambda s: query(s["orders"], 'WHERE.nation = "NATION_3" AND WHY.priority = "1-URGENT" AND WHEN.year = "1998"', None).ids,
    "five_dim_and": lambda s: query(s["orders"], 'WHO.customer PREFIX "Customer" AND WHAT.status = "F" AND WHERE.region = "ASIA" AND WHY.priority = "2-HIGH" AND WHEN.year <= "1995"', None).ids,
    "dnf_of_three": lambda s: query(s["orders"], 'WHERE.nation = "NATION_1" AND WHEN.year = "1996" OR WHERE.nation = "NATION_2" AND WHEN.year = "1997" OR WHY.priority = "5-LOW" AND WHAT.status = "P"', None).ids,
    "between_numbers": lambda s: query(s["orders"], "WHAT.total BETWEEN 1000 AND 20000", None).ids,
    "contains": lambda s: query(s["parts"], 'WHO.brand CONTAINS "#1"', None).ids,
    "only_set": lambda s: query(s["lines"], 'WHAT.returnflag ONLY ("R", "A")', None).ids,
    "discover_all": lambda s: discover(s["lines"], "*").rows,
    "discover_dimension": lambda s: discover(s["lines"], "WHAT|*").rows,
    "discover_field": lambda s: discover(s["lines"], "WHO|supplier|*").rows,
    "hydrate": lambda s: query(s["parts"], "HOW.size >= 48", None).to_dataframe(),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    sizes: dict[str, int] = {}

    def timed(name: str, run, runs: int = RUNS) -> None:
        took = []
        for _ in range(runs + (runs > 1)):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[runs > 1 :]), 3)

    with tempfile.TemporaryDirectory() as top:
        stores = {}
        for name in ("orders", "lines", "parts"):
            path = f"{top}/{name}"
            timed(f"compile_{name}", lambda n=name, p=path: to_parquet(catalogue.facts(spark, SF_DIR, n), p), 1)
            facts = spark.read.schema(FACT_SCHEMA).parquet(path)
            sizes[name] = facts.count()
            stores[name] = Substrate(facts, catalogue.FRAMES[name][1]["lens_id"])
        for name, make in STORED.items():
            timed(name, lambda m=make: m(stores).write.format("noop").mode("overwrite").save())
        for name in ("pivot_wide", "multi_table_merge", "marc_facts", "record_explode"):
            timed(name, lambda n=name: catalogue.queries()[n](spark, SF_DIR).write.format("noop").mode("overwrite").save())
        disk = sum(f.stat().st_size for f in Path(top).rglob("*.parquet"))
    out = {"metric": "total of the median times of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name, "facts": sizes, "fact_bytes": disk}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
