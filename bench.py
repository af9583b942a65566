"""Times the catalogue's and the kernels' queries; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8).
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


def main() -> None:
    from pulseloom.plans import admission, assembly, catalogue, kernels, live, modelling, moments, signals
    from pulseloom.session import local_session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench", spark__sql__shuffle__partitions=cpus)
    catalogue.QUERIES["json_status_fields"](spark, sf).collect()  # the session's own start
    taken = {}
    for name, f in {**catalogue.QUERIES, **admission.QUERIES, **assembly.QUERIES, **kernels.QUERIES, **live.QUERIES, **moments.QUERIES, **signals.QUERIES, **modelling.QUERIES}.items():
        began = time.perf_counter()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds for all queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
