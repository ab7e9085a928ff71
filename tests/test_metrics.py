import math

import numpy as np
import pytest
from ledger_data import log, random_days, trade_rows

from ledgerloom.operators import metrics as M
from ledgerloom.operators import series as S
from ledgerloom.operators import stress as X
from ledgerloom.schema import TRADES


def first(d):
    return d.first().asDict()


def test_hand_computed(spark):
    m = first(M.full(log(spark, [[100, -50], [-30, -20], [200]])))
    assert m["trade_count"] == 5 and m["net_profit"] == 200 and m["win_rate"] == 0.4 and m["trading_days"] == 3
    assert m["profit_factor"] == 3 and m["payoff_ratio"] == pytest.approx(150 / (100 / 3)) and m["longest_losing_streak"] == 3
    assert m["max_drawdown"] == 100 and m["best_day"] == 200 and m["best_day_share"] == 1 and m["top5_trade_share"] == 1
    assert m["cadence_defaulted"] and m["sessions_per_week"] == 5


def test_degenerate_logs(spark):
    win = first(M.full(log(spark, [[10], [10]])))
    assert win["profit_factor"] == win["payoff_ratio"] == win["expectancy_r"] == win["sharpe"] == win["sortino"] == win["mar"] == math.inf
    lose = first(M.full(log(spark, [[-10], [-10]])))
    assert lose["profit_factor"] == 0 and lose["sharpe"] == -math.inf and lose["mar"] < 0 and lose["longest_losing_streak"] == 2
    one = first(M.full(log(spark, [[0.0]])))
    assert one["sharpe"] == 0 and one["expectancy_tstat"] == 0 and one["max_drawdown"] == 0


def test_path_equals_a_loop_for_many_logs(spark):
    rows, want = [], {}
    for k in range(12):
        r = np.random.default_rng(k)
        days = [[float(x) for x in np.round(r.normal(0, 50, r.integers(1, 6)))] for _ in range(r.integers(1, 30))]
        rows += trade_rows(days, k)
        e = peak = dd = run = best = 0.0
        for p in (p for d in days for p in d):
            e += p
            peak = max(peak, e)
            dd = max(dd, peak - e)
            run = run + 1 if p < 0 else 0
            best = max(best, run)
        want[k] = (dd, best)
    got = M.headline(spark.createDataFrame(rows, TRADES)).collect()
    assert {r.log_id: (r.max_drawdown, r.longest_losing_streak) for r in got} == want


def test_cadence(spark):
    days = [[1.0]] * 30
    c = first(M.cadence(M.days(log(spark, days))))
    assert c["sessions_per_week"] == 5 and not c["cadence_defaulted"]


def test_trend_and_concordance(spark):
    up = log(spark, [[float(i + (i % 3))] for i in range(60)])
    h = first(S.hac_slope(up))
    assert h["slope"] == pytest.approx(1, abs=0.05) and h["t"] > 10
    v = np.random.default_rng(4).integers(0, 9, 200).astype(float)
    assert S._concordance(v) == sum(int(np.sign(b - a)) for i, a in enumerate(v) for b in v[i + 1 :])
    assert first(S.mann_kendall(up))["mk_z"] > 5
    assert S.hac_slope(log(spark, [[1.0]] * 5)).count() == 0


def test_ewma_is_the_recursion(spark):
    r = np.random.default_rng(3).normal(0, 100, 50).round(2)
    got = [x.sigma for x in S.ewma(M.indexed(M.days(log(spark, [[float(x)] for x in r])))).orderBy("day_idx").collect()]
    from ledgerloom.operators.kernel import ewma_sigma

    want = ewma_sigma(r)
    assert all(g is None for g in got[:20]) and np.allclose(got[20:], want[20:])


def test_deflated_worked_examples():
    d = S.deflate(1000, 0.1, 1.0, 0.0, 3.0, 45)
    assert 4.5 < d["minbtl_years"] < 5.5 and d["dsr"] < d["psr"] and 0 < d["haircut_pct"] < 1
    assert S.deflate(10, 5.0, 0.0, 0.0, 3.0)["psr"] == 1.0 and S.deflate(10, -5.0, 0.0, 0.0, 3.0)["sr"] == -math.inf
    with pytest.raises(ValueError):
        S.deflate(2, 1.0, 1.0, 0.0, 3.0)


def test_haircut_of_a_long_log_is_finite():
    """At t statistics of 8 and 18, where 1 less the tail is 1 or nearly so, the haircut still falls smoothly."""
    pct = [S.deflate(n, 0.03, 1.0, 0.0, 3.0, 20)["haircut_pct"] for n in (40_000, 60_000, 75_000, 360_000, 3_600_000)]
    assert all(0 < b < a < 0.1 for a, b in zip(pct, pct[1:]))


def test_bootstrap_never_gathers_trades_in_the_driver(spark):
    plan = X.bootstrap_mean_sql(log(spark, random_days(1)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [log_id" in plan and "BroadcastHashJoin [log_id" not in plan


def test_clustering_tells_calm_from_clustered(spark):
    r = np.random.default_rng(1)
    days = [[float(round(r.normal(0, 400.0 if d // 15 % 2 else 20.0), 2))] for d in range(300)]
    assert first(S.clustering(M.indexed(M.days(log(spark, days)))))["clustered"]
    short = first(S.clustering(M.indexed(M.days(log(spark, days[:20])))))
    assert not short["tested"] and short["arch_lm_p"] == 1


def test_costs_only_take(spark):
    t = log(spark, random_days(1))
    rows = {r.point: r.net for r in X.cost_sweep(t).collect()}
    assert rows[0] > rows[2] > rows[4] and rows[1] < rows[0] and len(rows) == 7
    net = X.with_costs(t, 1, 1).groupBy().sum("pnl").first()[0]
    assert net == pytest.approx(rows[2])
    with pytest.raises(Exception, match="no tick value"):
        X.cost_sweep(log(spark, [[1.0]], symbol="AAPL"))


def test_bootstrap_and_permutation(spark):
    t = log(spark, random_days(2, mean=40.0, sd=150.0))
    a, b = first(X.bootstrap_mean(t)), first(X.bootstrap_mean(t.repartition(7)))
    assert a == b and a["ci_lo"] < t.groupBy().avg("pnl").first()[0] < a["ci_hi"] and a["p_positive"] > 0.9
    p = first(X.permutation_drawdown(t, 1000, 1e9))
    assert p["dd_p05"] < p["dd_p50"] < p["dd_p95"] and p["p_ruin"] == 0
    one = first(X.bootstrap_mean(log(spark, [[5.0]])))
    assert one["ci_lo"] == one["ci_hi"] == 5 and one["p_positive"] == 0


def test_pbo_of_noise_and_of_skill(spark):
    r = np.random.default_rng(8)
    noise = [(d, "v%d" % v, float(x)) for v in range(8) for d, x in enumerate(r.normal(0, 1, 120))]
    got = first(X.pbo(spark.createDataFrame(noise, "day int, variant string, pnl double"), 8))
    assert got["n_splits"] == 70 and 0.2 < got["pbo"] <= 1
    skill = [(d, v, x + (1.0 if v == "v3" else 0)) for d, v, x in noise]
    assert first(X.pbo(spark.createDataFrame(skill, "day int, variant string, pnl double"), 8))["pbo"] == 0
    assert len(X.split_masks(16)) == 12_870 and len(set(X.split_masks(30))) == 12_870


def test_scorecard_grades(spark):
    t = log(spark, random_days(5, n=200, mean=60.0, sd=120.0))
    s = first(X.scorecard(M.full(t), X.bootstrap_mean(t, 500), X.trimmed_pf(t), S.deflated(t)))
    assert s["edge"] == "A" and s["sample"] == "A" and s["overall"] in "AB"
    bad = log(spark, random_days(5, n=40, mean=-60.0))
    s = first(X.scorecard(M.full(bad), X.bootstrap_mean(bad, 500), X.trimmed_pf(bad), S.deflated(bad)))
    assert s["overall"] == "F"


def test_overfitting_fills_gaps_and_refuses_nonsense(spark):
    import pytest
    from ledgerloom.errors import LedgerError
    from ledgerloom.operators.stress import pbo

    rows = [(d, v, float((d * 7 + k * 3) % 11 - 5)) for d in range(40) for k, v in enumerate("abc")]
    full = [(d, v, 0.0 if v == "b" and 10 <= d < 20 else x) for d, v, x in rows]
    gaps = [r for r in full if not (r[1] == "b" and 10 <= r[0] < 20)]
    make = lambda r: spark.createDataFrame(r, "day int, variant string, pnl double")
    a, b = pbo(make(full), 4).first(), pbo(make(gaps), 4).first()
    assert a == b and a.n_variants == 3 and a.n_days == 40
    for bad in ([r for r in rows if r[1] == "a"], [(d, v, float(d)) for d, v, _ in rows], [(d, v, float("nan") if d == 3 else x) for d, v, x in rows]):
        with pytest.raises(LedgerError):
            pbo(make(bad), 4)


def test_digests_are_those_of_hashlib():
    import hashlib

    from ledgerloom.functions import digests as D

    want = lambda p, s, i: int(hashlib.md5(f"{p}|{s}|{i}".encode()).hexdigest()[:8], 16) / 2.0**32
    for prefix in ("7|3", "7|90210", f"{10**30}|{10**18}"):  # the last doesn't fit a block
        for s in ([0, 9], [10, 99], [1000, 3999]):
            for a, b in D.by_digits(1, 1003):
                i = np.array(sorted({a, b - 1}))
                assert D.uniforms(prefix, np.array(s), i).tolist() == [[want(prefix, x, y) for y in i.tolist()] for x in s]


def test_resamples_that_sum_to_nothing_are_not_positive(spark):
    """0.1 + 0.2 - 0.3 is above 0 in doubles; against whole cents, drawn one by one."""
    import hashlib

    cents = [10, 20, -30, 70, -70, 110, -110]
    got = first(X.bootstrap_mean_sql(log(spark, [[c / 100 for c in cents]]), 400))
    u = lambda s, i: int(hashlib.md5(f"7|0|{s}|{i}".encode()).hexdigest()[:8], 16) / 2.0**32
    sums = [sum(cents[int(u(s, i) * len(cents))] for i in range(1, len(cents) + 1)) for s in range(400)]
    assert 0 in sums and got["p_positive"] == sum(x > 0 for x in sums) / 400
    lo, hi = np.percentile(np.array(sums) / 100 / len(cents), [2.5, 97.5])
    assert got["ci_lo"] == pytest.approx(lo, abs=1e-12) and got["ci_hi"] == pytest.approx(hi, abs=1e-12)


def test_permuted_orders_are_uniform_and_logs_come_in_parts(spark):
    """Also where random numbers tie: here there are two for four values."""
    from collections import Counter

    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2, (24_000, 4), dtype=np.uint64) << np.uint64(2) | np.arange(4, dtype=np.uint64)
    X._shuffle(keys, 2, rng)
    seen = Counter(map(tuple, (keys & np.uint64(3)).tolist()))
    assert len(seen) == 24 and sum((k - 1000) ** 2 / 1000 for k in seen.values()) < 50  # chi-square, 23 degrees: 0.1 %
    x = rng.normal(0, 1, (3, 100_000))
    values, codes = np.unique(x, return_inverse=True)
    dd, least = X._falls(values, codes.reshape(x.shape))
    e = np.cumsum(x, axis=1)
    assert np.allclose(dd, (np.maximum(np.maximum.accumulate(e, axis=1), 0) - e).max(1)) and np.allclose(least, e.min(1))
    plan = X.permutation_drawdown(log(spark, random_days(1)), 10)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan  # no row grows with its log
