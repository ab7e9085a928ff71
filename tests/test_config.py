import pytest

from ledgerloom import config as C
from ledgerloom.errors import ConfigError

GOOD = {"name": "x", "account_size": 50000, "phases": [{"name": "challenge", "profit_target": 3000, "rules": [{"type": "trailing_drawdown", "amount": 2000}]}], "funded": {"name": "funded"}}


def changed(**kw):
    return {**GOOD, **kw}


def test_good():
    f = C.parse(GOOD)
    assert f.phases[0].rules[0].width(f.account_size) == 2000 and f.phase("challenge").name == "challenge"
    assert len(C.PRESETS) == 18 and all(C.load_firm(n).name == n for n in C.PRESETS)


@pytest.mark.parametrize(
    "bad",
    [
        changed(extra=1),
        changed(account_size=-1),
        changed(account_size="50000"),
        changed(phases=[]),
        changed(phases=[{"name": "challenge"}]),
        changed(funded={"name": "funded", "profit_target": 5}),
        changed(funded={"name": "challenge"}),
        changed(fees={"monthly": 1, "one_time": 1}),
        changed(fees={"payout_haircut": 1.0}),
        changed(payout={"path": "consistency"}),
        changed(sources=["ftp://x"]),
        changed(funded={"name": "funded", "rules": [{"type": "scaling_plan", "half_until_safety_net": True}]}),
        changed(funded={"name": "funded", "rules": [{"type": "min_trading_days"}, {"type": "min_trading_days"}]}),
        changed(funded={"name": "funded", "rules": [{"type": "trailing_drawdown", "amount": 1, "pct": 1}]}),
        changed(funded={"name": "funded", "rules": [{"type": "trailing_drawdown"}]}),
        changed(funded={"name": "funded", "rules": [{"type": "unknown"}]}),
        changed(funded={"name": "funded", "rules": [{"type": "session_close", "tz": "Mars/Base"}]}),
        changed(funded={"name": "funded", "rules": [{"type": "session_close", "hard_close": "25:00"}]}),
        changed(funded={"name": "funded", "rules": [{"type": "scaling_plan", "tiers": [{"min_balance": 5, "max_contracts": 1}, {"min_balance": 5, "max_contracts": 2}]}]}),
    ],
)
def test_bad(bad):
    with pytest.raises((ConfigError, TypeError)):
        C.parse(bad)


def test_options():
    f = C.PRESETS["topstep_50k"]
    d = C.with_options(f, dll=True, promo=True)
    assert d.payout.payout_cap_ladder == (4000.0,) and d.payout.consistency.payout_cap_ladder == (6000.0,)
    assert all(p.of(C.DailyLossLimit)[0].amount == 1000 for p in (*d.phases, d.funded)) and not f.phases[0].of(C.DailyLossLimit)
    for bad in (dict(dll=True, pdll=500.0), dict(promo=True), dict(pdll=500.0, promo=True)):
        with pytest.raises(ConfigError):
            C.with_options(f, **bad)
    with pytest.raises(ConfigError):
        C.with_options(C.PRESETS["tpt_50k"], dll=True)
    with pytest.raises(ConfigError):
        C.with_promo_caps(d)
    assert C.with_fees(f, extra_monthly=50.0).fees.extra_monthly == 50
