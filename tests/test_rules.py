"""The path kernel against the replay, on the record itself, for every preset and phase; and facts that hold for any draws."""

import datetime as dt
import math

import numpy as np
import pytest
from ledger_data import log, random_days, trade_rows, weekdays

from ledgerloom import config as C
from ledgerloom.operators import kernel as K
from ledgerloom.operators import replay as R

NAMES = ("incomplete", "passed", "breached", "expired", "survived")


def both(days, phase, firm, payout=None, base=1.0, **kw):
    rows = trade_rows(days)
    sessions, at = [], 0
    idx, lo, hi, cl, lf = [], [], [], [], []
    for k, (date, day) in enumerate(zip(weekdays(len(days)), days)):
        ts, run = [], 0.0
        for _ in day:
            r = rows[at]
            at += 1
            t = R.Trade(r[2].replace(tzinfo=dt.timezone.utc), r[3].replace(tzinfo=dt.timezone.utc), r[6], r[7], r[11], r[12])
            ts.append(t)
            a, b, c, f = R.points(t.pnl, t.mae, t.mfe)
            idx.append(k)
            lo.append(run + a)
            hi.append(run + b)
            cl.append(run + c)
            lf.append(f)
            run += t.pnl
        sessions.append((date, ts))
    p = K.Profile.of(idx, lo, hi, cl, lf)
    g = K.simulate(p, np.arange(p.days)[None], phase, firm, 5.0, payout=payout, base=base, **kw)
    return g, R.replay(sessions, phase, firm, payout, base=base, **kw)


def without_clock(phase):
    from dataclasses import replace

    return replace(phase, rules=tuple(r for r in phase.rules if not isinstance(r, (C.SessionClose, C.TimeLimit))))


LOGS = {"winner": (1, 120, 4, 40.0, 150.0), "loser": (2, 120, 4, -40.0, 150.0), "wild": (3, 60, 6, 10.0, 900.0), "grinder": (4, 200, 2, 25.0, 60.0), "strong": (5, 15, 5, 300.0, 200.0)}


@pytest.mark.parametrize("name", sorted(C.PRESETS))
@pytest.mark.parametrize("kind", sorted(LOGS))
def test_kernel_equals_replay(name, kind):
    firm, (seed, n, per, mean, sd) = C.PRESETS[name], LOGS[kind]
    days = random_days(seed, n, per, mean, sd)
    for phase in (*firm.phases, firm.funded):
        terms = K.payout_terms(firm, phase.initial(firm.account_size), 5.0) if phase.profit_target is None else None
        for base in (1.0, 12.0):
            g, r = both(days, without_clock(phase), firm, terms, base)
            o = {"active": "incomplete" if phase.profit_target else "survived", "retired": "survived"}.get(K.OUTCOMES[g.outcome[0]], K.OUTCOMES[g.outcome[0]])
            assert o == r.outcome, (phase.name, base)
            if o in ("passed", "breached"):
                assert g.end_day[0] + 1 == r.days_consumed
            if o == "breached":
                assert g.names[g.fail_rule[0]] == r.breach.rule
            assert g.balance[0] == pytest.approx(r.final_balance, abs=1e-6) and g.lockout_days[0] == r.lockout_days
            assert g.withdrawn[0] == pytest.approx(r.withdrawn, abs=1e-6) and g.payouts[0] == r.payouts


@pytest.mark.parametrize("kw", [{"vol": K.VolTarget(200.0)}, {"cushion": (0.25, 1.5)}])
def test_sizing_equals_replay(kw):
    firm = C.PRESETS["apex40_50k_intraday"]
    for kind in LOGS:
        seed, n, per, mean, sd = LOGS[kind]
        g, r = both(random_days(seed, n, per, mean, sd), without_clock(firm.phases[0]), firm, **kw)
        assert g.balance[0] == pytest.approx(r.final_balance, abs=1e-6)


def firm_of(*rules, target=3000.0, payout=C.Payout(period_days=0), funded=()):
    return C.Firm("t", 50_000.0, (C.Phase("challenge", target, None, tuple(rules)),), C.Phase("funded", None, None, tuple(funded)), payout=payout)


def test_hand_cases():
    f = firm_of(C.TrailingDrawdown(1000.0))
    g, r = both([[(500.0, -10.0, 2000.0)], [(-600.0, -600.0, 0.0)]], f.phases[0], f)
    assert r.outcome == "incomplete"  # the end-of-day trail moves with closes: floor 49500, balance 49900
    f = firm_of(C.TrailingDrawdown(1000.0, ratchet="intraday"))
    g, r = both([[(500.0, -10.0, 2000.0)]], f.phases[0], f)
    assert r.outcome == "breached" and K.OUTCOMES[g.outcome[0]] == "breached"
    f = firm_of(C.DailyLossLimit(500.0, effect="lockout"), C.TrailingDrawdown(5000.0))
    g, r = both([[-600.0, 900.0], [100.0]], f.phases[0], f)
    assert r.lockout_days == 1 and r.final_balance == 49_600
    f = firm_of(C.Consistency(50.0, "total_profit"))
    g, r = both([[3000.0]], f.phases[0], f)
    assert r.outcome == "incomplete" and r.effective_target == 6000
    f = firm_of(C.MinTradingDays(3))
    assert both([[4000.0], [0.0], [0.0]], f.phases[0], f)[1].days_consumed == 3


def test_time_limit_is_calendar_in_replay_and_trading_days_in_the_kernel():
    f = firm_of(C.TimeLimit(7))
    g, r = both([[1.0]] * 20, f.phases[0], f)
    assert r.outcome == "expired" and r.days_consumed == 5 and K.OUTCOMES[g.outcome[0]] == "expired" and g.end_day[0] == 4


def test_session_close_breaches(spark):
    f = firm_of(C.SessionClose(hard_close="09:02"))
    t = log(spark, [[10.0], [10.0]])
    assert R.close_violations(t, f, f.phases[0].rules[0]).first()["violations"] == 2
    assert R.evaluate(t, f, "challenge").first()["breach_rule"] == "session_close"


def test_chained_phases_use_up_days(spark):
    f = C.PRESETS["ftmo_2step_100k"]
    r = R.evaluate(log(spark, [[3000.0]] * 12), f).collect()
    assert [(x.phase, x.outcome, x.days_consumed) for x in r] == [("challenge", "passed", 4), ("verification", "passed", 4), ("funded", "survived", 4)]


@pytest.mark.parametrize("floor,target", [(2000.0, 3000.0), (1000.0, 1000.0)])
def test_static_floor_anchor(floor, target):
    """A fair walk passes with probability D / (T + D)."""
    f = firm_of(C.StaticMaxLoss(floor, inclusive=True), target=target)
    r = np.random.default_rng(1)
    p = K.Profile.of(np.arange(2), [-50.0, 50.0], [-50.0, 50.0], [-50.0, 50.0], [False, False])
    g = K.simulate(p, r.integers(0, 2, (3000, 12_000)), f.phases[0], f)
    assert g.passed.mean() == pytest.approx(floor / (target + floor), abs=0.045)


def test_trailing_anchor():
    """Against an uncapped trail it is close to exp(-T / D)."""
    f = firm_of(C.TrailingDrawdown(2000.0, ratchet="intraday"), target=2000.0)
    p = K.Profile.of(np.arange(2), [-40.0, 40.0], [-40.0, 40.0], [-40.0, 40.0], [False, False])
    g = K.simulate(p, np.random.default_rng(2).integers(0, 2, (3000, 12_000)), f.phases[0], f)
    assert g.passed.mean() == pytest.approx(math.exp(-1), abs=0.045)


def test_tighter_is_never_easier():
    days = random_days(9, 100, 4, 20.0, 300.0)
    rates = []
    for width in (1000.0, 2000.0, 4000.0):
        for ratchet in ("intraday", "eod"):
            f = firm_of(C.TrailingDrawdown(width, ratchet=ratchet))
            idx, lo, hi, cl, lf = [], [], [], [], []
            for k, d in enumerate(days):
                run = 0.0
                for p, a, b in d:
                    x = R.points(p, a, b)
                    idx.append(k), lo.append(run + x[0]), hi.append(run + x[1]), cl.append(run + x[2]), lf.append(x[3])
                    run += p
            prof = K.Profile.of(idx, lo, hi, cl, lf)
            rates.append(K.simulate(prof, K.draw_days(np.random.default_rng(0), prof.days, 800, 120, 5), f.phases[0], f).passed.mean())
    assert rates[0] <= rates[1] <= rates[3] <= rates[5] and rates[0] <= rates[2] <= rates[4]


def test_draws():
    d = K.draw_days(np.random.default_rng(0), 10, 500, 60, 8)
    step = (d[:, 1:] - d[:, :-1]) % 10 == 1
    assert 0.85 < step.mean() < 0.92 and d.min() == 0 and d.max() == 9
    r = np.random.default_rng(3)
    x = r.normal(size=400)
    y = np.convolve(r.normal(size=410), np.ones(8), "valid")[:400]
    assert K.auto_block(y) > K.auto_block(x) >= 2 and K.auto_block(np.ones(100)) == K.rough_block(100)


def test_marks_check(spark):
    f = C.PRESETS["ftmo_2step_100k"]
    rows = [(1, dt.datetime(2026, 1, 5, 10 + k), k, 100_000.0 + v) for k, v in enumerate([0, 500, -1000, -5200, 0])]
    m = spark.createDataFrame(rows, "log_id bigint, ts timestamp, ordinal bigint, equity double")
    r = R.check_marks(m, f, "challenge").first()
    assert r.breached and r.rule == "daily_loss_limit[fail]" and r.intraday_marks and r.level == 95_000


def test_replay_reads_no_more_days_than_it_needs():
    """Days may come one by one; what a phase leaves is there for the next."""
    firm = C.PRESETS["tpt_50k"]
    phase = firm.phases[0]
    at = dt.datetime(2026, 1, 5, 15, tzinfo=dt.timezone.utc)
    days = iter([(dt.date(2026, 1, 5) + dt.timedelta(i), [R.Trade(at, at, 1.0, -10_000.0 if i == 2 else 1.0)]) for i in range(9)])
    assert R.replay(days, phase, firm).outcome == "breached" and next(days)[0] == dt.date(2026, 1, 8)


def test_quiet_days_are_not_gone_through_trade_by_trade():
    """300,000 trades a path that come near no level; a step a trade took tens of microseconds."""
    import time

    days, k, rng = 20, 3000, np.random.default_rng(1)
    close = np.cumsum(rng.normal(0, 0.01, (days, k)), axis=1)
    p = K.Profile.of(np.repeat(np.arange(days), k), (close - 0.01).ravel(), (close + 0.01).ravel(), close.ravel(), np.zeros(days * k, bool))
    firm, idx = C.PRESETS["topstep_50k"], rng.integers(0, days, (300, 100))
    at = time.perf_counter()
    r = K.simulate(p, idx, firm.phases[0], firm, base=4.0)
    assert time.perf_counter() - at < 5
    assert (r.outcome == K.ACTIVE).all() and np.allclose(r.balance, firm.phases[0].initial(firm.account_size) + p.day_pnl[idx].sum(1))
