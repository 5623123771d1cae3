"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8).  Each query is forced with a no-op sink (full computation, no
collect).  The main experiment also reports model quality and batch
scoring cost per row, the figures the reference publishes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "late_rate_by_traffic_rush",
    "label_from_delay",
    "median_impute",
    "dedup_keep_first",
    "factor_lift",
    "classification_report",
    "pr_curve",
    "model_summary",
    "stratified_split",
    "time_split",
    "stratified_group_split",
    "build_trip_table",
    "expand_jitter_relabel",
    "generated_trips",
    "timetable_from_rendered_pages",
    "csv_roundtrip",
]


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.environ.setdefault("PUNCTUAL_DRIVER_MEMORY", "16g")  # local mode: the driver JVM is the executor
    cpus = os.environ.get("BENCH_CPUS", "8")
    from punctual.session import local_session
    from punctual.plans.registry import load_all

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="punctual-bench")
    reg = load_all()
    force(reg["late_rate_by_traffic_rush"].build(spark, "/root/testdata/sf0.001"))  # JVM warm-up

    times: dict[str, float] = {}
    # One-off: the derived trips table is written once per source snapshot
    # (reused if an earlier run already wrote it) and read by every query.
    from punctual.sources.fixture import trips as _trips
    t0 = time.perf_counter()
    _trips(spark, sf_dir).count()
    times["materialize_trips"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        force(reg[name].build(spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    # Main experiment end to end + batch scoring cost (the reference's published figures).
    from punctual.operators import models as M
    from punctual.plans import experiments as EX
    from punctual.sources.fixture import trips

    t0 = time.perf_counter()
    rounds = int(os.environ.get("BENCH_BOOST_ROUNDS", "20"))  # as in earlier benches; the registered queries take 400
    r = EX.run_main(trips(spark, sf_dir), rounds=rounds)
    summary = {row["model"]: {k: round(row[k], 4) for k in
                              ("accuracy", "macro_f1", "balanced_accuracy", "f1_late", "average_precision",
                               "roc_auc") if row[k] is not None}
               for row in r["summary"].collect()}
    times["main_experiment"] = round(time.perf_counter() - t0, 3)
    test = r["test"]
    n_test = test.count()
    per_row = {}
    for name, model in (("LogisticRegression", r["lr"]), ("BoostedTrees", r["gbt"])):
        t0 = time.perf_counter()
        force(M.score(model, test, keep=["trip_key"]).select("trip_key", "score"))
        dt = time.perf_counter() - t0
        times[f"score_{name}"] = round(dt, 3)
        per_row[name] = dt * 1000.0 / max(n_test, 1)

    # Classifier-only cost on an already encoded, cached batch (the reference's
    # batch figure also excludes encoding).
    from pyspark.ml import PipelineModel
    for name, model in (("LogisticRegression", r["lr"]), ("BoostedTrees", r["gbt"])):
        encoded = PipelineModel(stages=model.model.stages[:-1]).transform(test).select("features").persist()
        encoded.count()
        t0 = time.perf_counter()
        force(model.classifier.transform(encoded).select("probability"))
        per_row[f"{name}_encoded_batch"] = (time.perf_counter() - t0) * 1000.0 / max(n_test, 1)
        encoded.unpersist()

    # Scoring cost per row on the whole prepared table (encoding included).
    prepared = r["data"]
    n_all = prepared.count()
    for name, model in (("LogisticRegression", r["lr"]), ("BoostedTrees", r["gbt"])):
        t0 = time.perf_counter()
        force(M.score(model, prepared, keep=["trip_key"]).select("trip_key", "score"))
        per_row[f"{name}_all_{n_all}"] = (time.perf_counter() - t0) * 1000.0 / max(n_all, 1)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
                      "model_quality": summary, "inference_ms_per_row": per_row, "test_rows": n_test, "boost_rounds": rounds}))
    spark.stop()


if __name__ == "__main__":
    main()
