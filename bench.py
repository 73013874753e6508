"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
COPIES = int(os.environ.get("BENCH_COPIES", "50"))


def main() -> dict:
    import numpy as np
    from pyspark.sql import functions as F

    from atomweave.operators import coding, consensus, matrix, update
    from atomweave.operators.errors import pursuit_totals
    from atomweave.plans.fit import fit_dictionary
    from atomweave.session import local_session
    from atomweave.workloads import data

    spark = local_session(CPUS, shuffle_partitions=CPUS)
    signals = data.embeddings(spark, SF_DIR)
    events = data.event_signals(spark, SF_DIR)
    months = data.part_months(spark, SF_DIR)
    d64 = data.formula_dictionary(spark)
    d256 = data.formula_dictionary(spark, 256)
    ring = consensus.metropolis_weights(data.ring(spark, SF_DIR))
    # every embedding many times over, so that rates are not those of starting a job
    copies = (
        signals.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        .select((F.col("signal_id") * COPIES + F.col("c")).alias("signal_id"), "node_id", "vec").repartition(4 * CPUS).persist()
    )
    n_signals, n_copies = signals.count(), copies.count()

    def rows(df):
        df.write.format("noop").mode("overwrite").save()

    found_codes = coding.omp(signals, d64, n_nonzero=3)
    queries = {
        "best_atom": lambda: rows(coding.best_atom(signals, d64)),
        "matching_pursuit_4": lambda: rows(coding.matching_pursuit(signals, d64, 4)),
        "omp_tol_k64": lambda: rows(coding.omp(signals, d64, tol=0.75)),
        "omp_10_k64": lambda: rows(coding.omp(signals, d64, n_nonzero=10)),
        "omp_10_k256": lambda: rows(coding.omp(signals, d256, n_nonzero=10)),
        "block_omp_events": lambda: rows(coding.block_omp(events, data.formula_dictionary(spark, 5, 5), 1.0)),
        "gramian": lambda: rows(matrix.gramian(signals)),
        "gramian_of_months": lambda: rows(matrix.gramian_of_entries(months, data.MONTHS)),
        "qr": lambda: [rows(part) for part in matrix.tall_skinny_qr(events)],
        "relative_error": lambda: rows(coding.relative_error(signals, d64, found_codes)),
        "svd_update": lambda: rows(update.svd_dictionary_update(signals, d64, found_codes)),
        "metropolis": lambda: rows(consensus.metropolis_weights(data.supply_edges(spark, SF_DIR))),
        "consensus_update": lambda: rows(consensus.consensus_update(signals, d64, found_codes, 2, 3, ring)),
        # every signal a site, alike: nothing but sums of the dictionary's size may move
        "consensus_signal_sites": lambda: rows(consensus.consensus_update(consensus.assign_sites(signals), d64, found_codes, 2, mix="after", node_id=0)),
        "svd_update_by_passes": lambda: rows(update.svd_dictionary_update(signals, d64, found_codes, "passes")),
        "supply_weight_power": lambda: rows(matrix.matrix_power(consensus.metropolis_weights(data.supply_edges(spark, SF_DIR)), 2)),
    }
    scaled = {
        "omp_tol_k64": lambda: rows(coding.omp(copies, d64, tol=0.75)),
        "omp_10_k64": lambda: rows(coding.omp(copies, d64, n_nonzero=10)),
        "omp_10_k256": lambda: rows(coding.omp(copies, d256, n_nonzero=10)),
        "statistics_scan": lambda: pursuit_totals(copies, d64, 10, None),
    }
    rows(coding.best_atom(signals, d64))  # start the workers before the clock
    seconds = {}
    for name, run in queries.items():
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
    rates = {"signals": n_copies}
    for name, run in scaled.items():
        start = time.perf_counter()
        run()
        took = time.perf_counter() - start
        rates[name] = {"sec": round(took, 3), "signals_per_sec": round(n_copies / took)}
    fits = {}
    for method in ("svd", "consensus"):
        start = time.perf_counter()
        result = fit_dictionary(signals, 10, method, tol=0.75 * (1 if method == "consensus" else n_signals ** 0.5), dictionary=d64,
                                power_rounds=2, consensus_rounds=3, weights=ring if method == "consensus" else None)
        took = time.perf_counter() - start
        last = result.report.orderBy("iter").collect()[-1]
        seconds[f"fit_{method}_10"] = round(took, 3)
        fits[method] = {"sec_per_iteration": round(took / 10, 3), "relative_error": round(last["relative_error"], 6),
                        "updated_relative_error": round(last["updated_relative_error"], 6), "nnz": last["nnz"]}
    spark.stop()
    return {"metric": "headline queries, total wall time", "value": round(float(np.sum(list(seconds.values()))), 3), "unit": "sec",
            "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "scaled": rates, "fits": fits}


if __name__ == "__main__":
    with contextlib.redirect_stdout(sys.stderr):
        outcome = main()
    print(json.dumps(outcome))
