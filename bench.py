"""Runs the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    import tempfile

    from ledgerloom import session
    from ledgerloom.config import PRESETS
    from ledgerloom.operators import metrics as M
    from ledgerloom.operators import stress as X
    from ledgerloom.plans import montecarlo as MC
    from ledgerloom.plans.queries import QUERIES
    from ledgerloom.plans.tables import trades_li

    shared = tempfile.mkdtemp(prefix="bench-shared-")
    spark = session.build("bench", f"local[{CPUS}]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(2 * int(CPUS)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}"})
    spark.sparkContext.setLogLevel("ERROR")

    # the workload of the published figures: one log of 250 days, 4 trades a day, full excursions
    rng_days = 250
    from pyspark.sql import functions as F

    i = F.col("id")
    u = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(k), i)), 1, 8), 16, 10).cast("double") / 4294967296.0
    normal = F.sqrt(-2 * F.ln(u("a") + 1e-12)) * F.cos(2 * 3.141592653589793 * u("b"))
    start = F.unix_timestamp(F.lit("2025-01-06 15:00:00")) + (F.floor(i / 20) * 7 + F.floor(i / 4) % 5) * 86400 + (i % 4) * 3600
    pnl = F.round(15 + 180 * normal, 2)
    one = spark.range(rng_days * 4).select(
        F.lit(0).cast("bigint").alias("log_id"), (i + 1).alias("trade_seq"), F.timestamp_seconds(start).alias("entry_time"), F.timestamp_seconds(start + 1200).alias("exit_time"), F.lit("MNQ").alias("symbol"),
        F.lit("long").alias("side"), F.lit(1.0).alias("quantity"), pnl.alias("pnl"), F.lit(None).cast("double").alias("entry_price"), F.lit(None).cast("double").alias("exit_price"), F.lit(0.0).alias("fees"),
        (F.least(pnl, F.lit(0.0)) - 40 * u("c")).alias("mae"), (F.greatest(pnl, F.lit(0.0)) + 40 * u("d")).alias("mfe"),
    ).cache()
    one.count()
    firm, big = PRESETS["topstep_50k"], MC.Config(n_paths=10_000, challenge_days=250, funded_days=250, seed=1)
    variants = QUERIES["pbo"]
    work = {
        "n1_monte_carlo_10k": lambda: MC.run(one, firm, big),
        "n2_monte_carlo_10k_vol_target": lambda: MC.run(one.where("trade_seq <= 480"), firm, MC.Config(n_paths=10_000, challenge_days=250, funded_days=250, seed=1, sizing="vol_target")),
        "n3_uncertainty_100x500": lambda: MC.uncertainty(one, firm),
        "n4_pbo_16": lambda: variants(spark, SF_DIR),
        "n5_metrics_all_logs": lambda: M.full(trades_li(spark, SF_DIR)),
        "metrics_headline": lambda: QUERIES["metrics_headline"](spark, SF_DIR),
        "cost_sweep": lambda: QUERIES["cost_sweep"](spark, SF_DIR),
        "evaluation_windows": lambda: QUERIES["evaluation_windows"](spark, SF_DIR),
        "bootstrap_mean_4000": lambda: X.bootstrap_mean(one),
        "permutation_drawdown_5000": lambda: X.permutation_drawdown(one),
        "replay_chain": lambda: QUERIES["replay_chain"](spark, SF_DIR),
    }
    # the session's first queries pay for its start and for the Python workers'; a cold run costs a few seconds more
    work["metrics_headline"]().collect()
    MC.run(one, firm, MC.Config(n_paths=8 * MC.BLOCK, challenge_days=5, funded_days=5)).collect()
    out = {}
    for name, f in work.items():
        t = time.perf_counter()
        f().collect()
        out[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
