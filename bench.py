"""Time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (nothing is
collected to the driver). Prints one JSON line on stdout at the end; every result is
also written as it comes, to stderr and to $BENCH_LOG if that is set.

A query that runs longer than $BENCH_LIMIT seconds is cancelled and reported under
``failed``; the next one goes on. No query starts after $BENCH_BUDGET seconds: those left
are listed under ``not_run``. The iterative queries come last, so that they cannot
cost the others their figures."""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

GRACE = 120  # seconds after the budget at which a running query is cancelled
LAST = ("word_betweenness", "network_metrics")


def run_limited(spark, fn, sf_dir: str, limit: float) -> float:
    """Seconds of one run; its Spark jobs are cancelled, again and again, once ``limit`` is over."""
    done = threading.Event()
    late = threading.Event()

    def watch() -> None:
        if not done.wait(limit):
            late.set()
            while not done.wait(1):
                spark.sparkContext.cancelAllJobs()
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    t0 = time.perf_counter()
    try:
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"cancelled after {limit:g} s") from None
        raise
    finally:
        done.set()
        watcher.join()
        for q in spark.streams.active:  # a cancelled stream must not run on
            q.stop()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    limit = float(os.environ.get("BENCH_LIMIT", "240"))
    budget = float(os.environ.get("BENCH_BUDGET", "1500"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from chorus.plans.catalog import load_all
    from chorus.session import get_spark

    start = time.perf_counter()
    spark = get_spark("chorus-bench", cpus=cpus, shuffle_partitions=int(cpus) * 2)
    cat = load_all()
    names = sorted((n for n in cat if not only or n in only), key=lambda n: (n in LAST, n))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": 0.0, "unit": "sec", "queries": {},
           "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "n_queries": 0}

    def report(*_signal) -> None:
        out["value"] = round(sum(out["queries"].values()), 3)
        out["n_queries"] = len(out["queries"])
        left = [n for n in names if n not in out["queries"] and n not in out.get("failed", {})]
        if left:
            out["not_run"] = left
        print(json.dumps(out), flush=True)
        if _signal:
            os._exit(0)
    signal.signal(signal.SIGTERM, report)  # a run that is ended still gives its figures
    log = open(os.environ["BENCH_LOG"], "w") if os.environ.get("BENCH_LOG") else None
    # warm-up: JVM, parquet footers, codegen caches
    cat["word_frequencies"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        if time.perf_counter() - start > budget:
            break
        try:
            left = budget + GRACE - (time.perf_counter() - start)  # the last query ends in time, too
            out["queries"][name] = run_limited(spark, cat[name][0], sf_dir, min(limit, left))
        except Exception as e:  # keep timing the rest; report the failure
            out.setdefault("failed", {})[name] = str(e).splitlines()[0][:200]
        line = json.dumps({name: out["queries"].get(name, out.get("failed", {}).get(name))})
        for to in filter(None, (sys.stderr, log)):
            print(line, file=to, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
