import pytest
from ledger_data import log, random_days

from ledgerloom import config as C
from ledgerloom.errors import ConfigError, LedgerError
from ledgerloom.plans import montecarlo as MC

FIRM = C.PRESETS["tpt_50k"]
SMALL = MC.Config(n_paths=700, challenge_days=60, funded_days=60)


@pytest.fixture(scope="module")
def trades(spark):
    return log(spark, random_days(1, 120, 4, 40.0, 150.0)).unionByName(log(spark, random_days(2, 100, 3, 0.0, 200.0), 1)).cache()


def rows(d):
    return {r.log_id: r.asDict() for r in d.collect()}


def test_runs_repeat_whatever_the_partitions(spark, trades):
    a, b = rows(MC.run(trades, FIRM, SMALL)), rows(MC.run(trades.repartition(13), FIRM, SMALL))
    assert all(b[i][k] == pytest.approx(v) if isinstance(v, float) else b[i][k] == v for i in a for k, v in a[i].items())
    assert a[0]["n_paths"] == 700 and a[0]["pass_prob"] > a[1]["pass_prob"]


def test_parts_add_up_and_bounds_hold(trades):
    for r in rows(MC.run(trades, C.with_fees(FIRM, extra_monthly=30.0, per_payout=5.0, payout_haircut=0.1), SMALL)).values():
        assert r["ev_eval_fees"] + r["ev_payout_value"] + r["ev_activation"] + r["ev_overheads"] == pytest.approx(r["expected_net"], abs=1e-6)
        assert r["pass_lo"] <= r["pass_prob"] <= r["pass_hi"] and r["cvar_95"] <= r["var_95"]
        c = MC.campaign(r, FIRM)
        assert len(c["ev_with_resets"]) == 5 and c["cost_to_funded"] > 0


def test_frontier_at_one_is_the_plain_run(trades):
    f = {(r.log_id, r.scale): r.expected_net for r in MC.frontier(trades, FIRM, SMALL, (0.5, 1.0)).collect()}
    plain = rows(MC.run(trades, FIRM, SMALL))
    assert all(f[i, 1.0] == pytest.approx(plain[i]["expected_net"]) for i in plain) and f[0, 0.5] != f[0, 1.0]


def test_zero_buffer_is_asap(trades):
    p = {(r.log_id, r.keep_buffer, r.extract_weight): r for r in MC.policies(trades, FIRM, SMALL, (0.0, 500.0)).collect()}
    plain = rows(MC.run(trades, FIRM, SMALL))
    assert all(p[i, 0.0, None].expected_net == pytest.approx(plain[i]["expected_net"]) for i in plain)
    assert p[0, 0.0, None].extract_inert  # no qualifying days in this rule set


@pytest.mark.parametrize("kw", [{"sizing": "vol_target"}, {"sizing": "cushion"}, {"bootstrap": "iid_day"}, {"bootstrap": "iid_trade"}])
def test_modes_run(trades, kw):
    from dataclasses import replace

    assert len(rows(MC.run(trades, FIRM, replace(SMALL, **kw)))) == 2


def test_uncertainty_and_accounts(trades):
    u = rows(MC.uncertainty(trades, FIRM, MC.Config(n_paths=100, challenge_days=60, funded_days=60), 6))
    assert u[0]["n_outer"] == 6 and u[0]["pass_lo"] <= u[0]["pass_mid"] <= u[0]["pass_hi"]
    prof = MC.profiles(trades, FIRM)
    m = rows(MC.multi_account(MC.paths(trades, FIRM, [SMALL], logs=prof), FIRM, 3))
    assert m[0]["copied_ev"] == pytest.approx(m[0]["independent_ev"]) and m[0]["copied_cvar"] <= m[0]["independent_cvar"] + 1e-6


def test_clock_rules_are_refused(spark):
    import datetime as dt

    late = log(spark, [[10.0]] * 3)
    late = late.withColumn("exit_time", late.exit_time + dt.timedelta(hours=7))
    with pytest.raises(LedgerError, match="session close"):
        MC.run(late, C.PRESETS["topstep_50k"], SMALL)


@pytest.mark.parametrize("bad", [{"n_paths": 0}, {"bootstrap": "x"}, {"scale": -1.0}, {"sizing": "x"}, {"vol_clip": (2.0, 1.0)}, {"extract_weight": 0.0}, {"keep_buffer": -1.0}, {"payout_path": "x"}, {"block_len": 0}])
def test_bad_configs(bad):
    with pytest.raises(ConfigError):
        MC.Config(**bad)


def test_kept_paths_are_those_of_the_simulation(trades):
    kept = MC.samples(trades, FIRM, SMALL, 50)
    last = {(r.log_id, r.path_id): r.equity for r in kept.groupBy("log_id", "path_id").agg({"t": "max"}).join(kept, ["log_id", "path_id"]).where("t = `max(t)`").collect()}
    final = {(r.log_id, r.path_id): r.final_balance for r in MC.paths(trades, FIRM, [SMALL]).where("path_id < 50").collect()}
    assert len(last) == 100 and all(last[k] == pytest.approx(final[k]) for k in last)
    f = MC.fan(kept).where("t = 0").collect()
    assert all(r.alive == 50 and r.p05 <= r.p50 <= r.p95 for r in f)


def test_no_row_grows_with_its_log(spark, trades):
    """Logs come in parts; where a part ends, within a day too, makes no difference."""
    want = MC.paths(trades, FIRM, [SMALL]).orderBy("log_id", "path_id").collect()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = MC.profiles(trades, FIRM).selectExpr("log_id", "length(data) as n").collect()
        assert max(r.n for r in parts) <= 7 * MC.TRADE.itemsize and sum(r.n for r in parts) == 780 * MC.TRADE.itemsize
        assert MC.paths(trades, FIRM, [SMALL]).orderBy("log_id", "path_id").collect() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
