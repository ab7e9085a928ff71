"""Rule sets of funded accounts: typed, validated, and the built-in presets.

A rule set is data: phases with rules, fees, a payout policy. `parse` takes the nested mapping of a YAML file;
unknown keys, wrong types and contradictions are refused.
"""

from __future__ import annotations

import dataclasses as dc
import math
from dataclasses import dataclass, field, replace
from typing import Any

from .errors import ConfigError
from .functions.sessions import Boundary


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigError(why)


def _number(x: Any, name: str, low: float | None = None, strict: bool = False) -> float:
    _need(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x), f"{name} must be a finite number, not {x!r}")
    if low is not None:
        _need(x > low if strict else x >= low, f"{name} must be {'above' if strict else 'at least'} {low}, not {x}")
    return float(x)


class _Sized:
    """A width given as an amount or as a percentage of the account."""

    amount: float | None
    pct: float | None

    def _check(self) -> None:
        _need((self.amount is None) != (self.pct is None), f"{type(self).__name__} needs exactly one of amount and pct")
        _number(self.amount if self.amount is not None else self.pct, "amount or pct", 0, True)

    def width(self, account: float) -> float:
        return self.amount if self.amount is not None else account * self.pct / 100.0


@dataclass(frozen=True)
class TrailingDrawdown(_Sized):
    amount: float | None = None
    pct: float | None = None
    ratchet: str = "eod"
    threshold_cap: float | None = None
    inclusive: bool = True

    def __post_init__(self):
        self._check()
        _need(self.ratchet in ("eod", "intraday"), "ratchet is eod or intraday")

    @property
    def name(self) -> str:
        return f"trailing_drawdown[{self.ratchet}]"


@dataclass(frozen=True)
class StaticMaxLoss(_Sized):
    amount: float | None = None
    pct: float | None = None
    inclusive: bool = False
    name = "static_max_loss"

    def __post_init__(self):
        self._check()


@dataclass(frozen=True)
class DailyLossLimit(_Sized):
    amount: float | None = None
    pct: float | None = None
    anchor: str = "day_open_balance"
    effect: str = "fail"
    inclusive: bool = True

    def __post_init__(self):
        self._check()
        _need(self.effect in ("fail", "lockout"), "effect is fail or lockout")
        _need(self.anchor in ("day_open_balance", "prev_midnight_balance"), "unknown anchor")

    @property
    def name(self) -> str:
        return f"daily_loss_limit[{self.effect}]"


@dataclass(frozen=True)
class Consistency:
    max_best_day_pct: float = 50.0
    basis: str = "total_profit"
    effect: str = "raise_target"

    def __post_init__(self):
        _need(0 < _number(self.max_best_day_pct, "max_best_day_pct") <= 100, "max_best_day_pct is in (0, 100]")
        _need(self.basis in ("total_profit", "profit_target"), "basis is total_profit or profit_target")
        _need(self.effect in ("raise_target", "gate_payout"), "effect is raise_target or gate_payout")

    @property
    def frac(self) -> float:
        return self.max_best_day_pct / 100.0


@dataclass(frozen=True)
class MinTradingDays:
    days: int = 1

    def __post_init__(self):
        _need(isinstance(self.days, int) and self.days >= 0, "days is a count")


@dataclass(frozen=True)
class TimeLimit:
    max_calendar_days: int = 30

    def __post_init__(self):
        _need(isinstance(self.max_calendar_days, int) and self.max_calendar_days > 0, "max_calendar_days is a positive count")


@dataclass(frozen=True)
class ContractLimit:
    max_contracts: float
    micros_multiplier: float = 10.0

    def __post_init__(self):
        _number(self.max_contracts, "max_contracts", 0, True)
        _number(self.micros_multiplier, "micros_multiplier", 0, True)


@dataclass(frozen=True)
class Tier:
    min_balance: float
    max_contracts: float


@dataclass(frozen=True)
class ScalingPlan:
    tiers: tuple[Tier, ...] = ()
    half_until_safety_net: bool = False

    def __post_init__(self):
        _need(bool(self.tiers) != self.half_until_safety_net, "a scaling plan has tiers or half_until_safety_net")
        b = [t.min_balance for t in self.tiers]
        _need(b == sorted(set(b)), "tier balances must rise")
        for t in self.tiers:
            _number(t.min_balance, "min_balance", 0)
            _number(t.max_contracts, "max_contracts", 0, True)


@dataclass(frozen=True)
class SessionClose:
    tz: str = "America/Chicago"
    hard_close: str = "15:10:00"
    early_closes: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        from zoneinfo import ZoneInfo

        try:
            ZoneInfo(self.tz)
        except Exception:
            raise ConfigError(f"unknown time zone {self.tz!r}") from None
        for t in (self.hard_close, *(x for _, x in self.early_closes)):
            p = t.split(":")
            _need(len(p) in (2, 3) and all(x.isdigit() for x in p) and int(p[0]) < 24 and all(int(x) < 60 for x in p[1:]), f"bad clock time {t!r}")


RULES = {
    "trailing_drawdown": TrailingDrawdown,
    "static_max_loss": StaticMaxLoss,
    "daily_loss_limit": DailyLossLimit,
    "consistency": Consistency,
    "min_trading_days": MinTradingDays,
    "time_limit": TimeLimit,
    "contract_limit": ContractLimit,
    "scaling_plan": ScalingPlan,
    "session_close": SessionClose,
}
_SINGLE = (MinTradingDays, TimeLimit, ContractLimit, ScalingPlan, SessionClose)


@dataclass(frozen=True)
class Phase:
    name: str
    profit_target: float | None = None
    initial_balance: float | None = None
    rules: tuple = ()

    def __post_init__(self):
        _need(bool(self.name), "a phase needs a name")
        if self.profit_target is not None:
            _number(self.profit_target, "profit_target", 0, True)
        if self.initial_balance is not None:
            _number(self.initial_balance, "initial_balance", 0)
        for kind in _SINGLE:
            _need(len(self.of(kind)) <= 1, f"phase {self.name}: more than one {kind.__name__}")

    def of(self, kind: type) -> list:
        return [r for r in self.rules if isinstance(r, kind)]

    def one(self, kind: type):
        return next(iter(self.of(kind)), None)

    def initial(self, account: float) -> float:
        return account if self.initial_balance is None else self.initial_balance


@dataclass(frozen=True)
class Fees:
    monthly: float = 0.0
    one_time: float = 0.0
    reset: float = 0.0
    free_resets_per_cycle: int = 0
    activation: float = 0.0
    refundable_on_first_payout: bool = False
    extra_monthly: float = 0.0
    per_payout: float = 0.0
    payout_haircut: float = 0.0

    def __post_init__(self):
        for f in ("monthly", "one_time", "reset", "activation", "extra_monthly", "per_payout", "payout_haircut"):
            _number(getattr(self, f), f, 0)
        _need(self.payout_haircut < 1, "payout_haircut is below 1")
        _need(not (self.monthly and self.one_time), "fees are monthly or one_time, not both")


@dataclass(frozen=True)
class QualifyingDays:
    count: int = 0
    min_daily_profit: float = 0.0


@dataclass(frozen=True)
class ConsistencyPath:
    min_days: int = 3
    min_trades_per_day: int = 1
    max_best_day_pct: float = 40.0
    payout_cap_ladder: tuple[float, ...] = ()


@dataclass(frozen=True)
class Reactivations:
    max: int = 0
    fees: tuple[float, ...] = ()


@dataclass(frozen=True)
class Payout:
    profit_split: float = 1.0
    min_payout: float = 0.0
    period_days: int = 14
    qualifying_days: QualifyingDays = QualifyingDays()
    payout_cap_ladder: tuple[float, ...] = ()
    max_lifetime_payouts: int | None = None
    payout_share_of_balance: float | None = None
    safety_net_floor: float | None = None
    buffer_above_initial: float | None = None
    reactivations: Reactivations = Reactivations()
    path: str = "standard"
    consistency: ConsistencyPath | None = None
    require_profit_since_prior_payout: bool = False
    mll_reset_on_payout: bool = False

    def __post_init__(self):
        _need(0 < self.profit_split <= 1, "profit_split is in (0, 1]")
        _need(self.payout_share_of_balance is None or 0 < self.payout_share_of_balance <= 1, "payout_share_of_balance is in (0, 1]")
        _need(self.path in ("standard", "consistency"), "path is standard or consistency")
        _need(self.path == "standard" or self.consistency is not None, "the consistency path needs its own block")


@dataclass(frozen=True)
class Firm:
    name: str
    account_size: float
    phases: tuple[Phase, ...]
    funded: Phase
    fees: Fees = Fees()
    payout: Payout = Payout()
    day_boundary: Boundary = Boundary()
    display_name: str = ""
    firm: str = ""
    fee_profile: str = ""
    dll_provenance: str = ""
    verified_as_of: str = ""
    sources: tuple[str, ...] = ()
    notes: str = ""

    def __post_init__(self):
        _number(self.account_size, "account_size", 0, True)
        _need(bool(self.phases), "a firm needs an evaluation phase")
        names = [p.name for p in self.phases] + [self.funded.name]
        _need(len(set(names)) == len(names), "phase names repeat")
        _need(all(p.profit_target is not None for p in self.phases), "evaluation phases need a profit target")
        _need(self.funded.profit_target is None, "the funded phase has no profit target")
        _need(all(s.startswith(("http://", "https://")) for s in self.sources), "sources are web addresses")
        for p in (*self.phases, self.funded):
            plan = p.one(ScalingPlan)
            _need(not (plan and plan.half_until_safety_net) or self.payout.safety_net_floor is not None, "half_until_safety_net needs payout.safety_net_floor")

    def phase(self, name: str) -> Phase:
        for p in (*self.phases, self.funded):
            if p.name == name:
                return p
        if name in ("challenge", "funded"):
            return self.phases[0] if name == "challenge" else self.funded
        raise ConfigError(f"no phase {name!r} in {self.name}")


_NESTED = {
    (Firm, "funded"): Phase, (Firm, "fees"): Fees, (Firm, "payout"): Payout, (Firm, "day_boundary"): Boundary,
    (Payout, "qualifying_days"): QualifyingDays, (Payout, "consistency"): ConsistencyPath, (Payout, "reactivations"): Reactivations,
}
_LISTS = {(Firm, "phases"): Phase, (ScalingPlan, "tiers"): Tier}


def _build(kind: type, data: Any, where: str):
    _need(isinstance(data, dict), f"{where} must be a mapping")
    known = {f.name: f for f in dc.fields(kind)}
    for k in data:
        _need(k in known, f"{where}: unknown key {k!r}")
    out = {}
    for k, v in data.items():
        at = f"{where}.{k}"
        if kind is Phase and k == "rules":
            v = tuple(_rule(r, f"{at}[{i}]") for i, r in enumerate(v))
        elif v is not None and (kind, k) in _NESTED:
            v = _build(_NESTED[kind, k], v, at)
        elif (kind, k) in _LISTS:
            v = tuple(_build(_LISTS[kind, k], x, f"{at}[{i}]") for i, x in enumerate(v))
        elif k == "early_closes":
            v = tuple(sorted((str(a), str(b)) for a, b in v.items()))
        elif isinstance(v, list):
            v = tuple(v)
        want = str(known[k].type)
        if want.startswith(("float", "int")) and v is not None:
            _need(not isinstance(v, (bool, str)), f"{at} must be a number")
        if want.startswith("bool"):
            _need(isinstance(v, bool), f"{at} must be true or false")
        if want.startswith("str"):
            v = str(v)
        out[k] = v
    missing = [f.name for f in dc.fields(kind) if f.default is dc.MISSING and f.default_factory is dc.MISSING and f.name not in out]
    _need(not missing, f"{where}: missing {', '.join(missing)}")
    return kind(**out)


def _rule(data: Any, where: str):
    _need(isinstance(data, dict) and data.get("type") in RULES, f"{where}: rule type must be one of {', '.join(RULES)}")
    return _build(RULES[data["type"]], {k: v for k, v in data.items() if k != "type"}, where)


def parse(data: dict) -> Firm:
    return _build(Firm, data, "firm")


def from_yaml(path: str) -> Firm:
    try:
        import yaml
    except ImportError:
        raise ConfigError("reading rule sets from YAML needs PyYAML") from None
    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))


# --- presets: fixed values of the published rule sets, one function a family -----------------


def _futures(name: str, size: float, rules: list, funded: list, fees: dict, payout: dict, target: float, initial: float | None = None) -> Firm:
    return Firm(name, size, (Phase("challenge", target, None, tuple(rules)),), Phase("funded", None, initial, tuple(funded)), Fees(**fees), Payout(**payout), firm=name.split("_")[0])


def _topstep(k: int) -> Firm:
    target, width, monthly, cap, path_cap, react, tiers = {
        50: (3000, 2000, 49, 2000, 3000, 599, ((0, 2), (1500, 3), (2000, 5))),
        100: (6000, 3000, 99, 3000, 4000, 699, ((0, 3), (1500, 4), (2000, 5), (3000, 10))),
        150: (9000, 4500, 199, 5000, 6000, 829, ((0, 3), (1500, 4), (2000, 5), (3000, 10), (4500, 15))),
    }[k]
    close = SessionClose()
    rules = [TrailingDrawdown(width, threshold_cap=k * 1000.0), Consistency(50, "profit_target"), close]
    funded = [TrailingDrawdown(width, threshold_cap=0.0), close, ScalingPlan(tuple(Tier(*t) for t in tiers)), ContractLimit(tiers[-1][1])]
    fees = dict(monthly=monthly, reset=monthly, free_resets_per_cycle=1, activation=149)
    payout = dict(profit_split=0.9, min_payout=125, period_days=0, qualifying_days=QualifyingDays(5, 150), payout_cap_ladder=(float(cap),), payout_share_of_balance=0.5, reactivations=Reactivations(2, (react, react)), require_profit_since_prior_payout=True, mll_reset_on_payout=True, consistency=ConsistencyPath(3, 1, 40, (float(path_cap),)))
    return _futures(f"topstep_{k}k", k * 1000.0, rules, funded, fees, payout, target, 0.0)


def _apex(k: int, ratchet: str) -> Firm:
    target, width, dll, limit, net = {25: (1500, 1000, 500, 4, 26100), 50: (3000, 2000, 1000, 10, 52100), 100: (6000, 3000, 1500, 14, 103100), 150: (9000, 4000, 2000, 17, 154100)}[k]
    price, active, q, ladder = {
        ("eod", 25): (177, 89, 100, (1000,) * 6),
        ("eod", 50): (197, 99, 250, (1500, 1500, 2000, 2500, 2500, 3000)),
        ("eod", 100): (297, 119, 300, (2000, 2500, 3000, 3000, 3500, 4000)),
        ("eod", 150): (397, 149, 350, (2500, 3000, 3000, 3500, 3500, 5000)),
        ("intraday", 25): (118, 69, 100, (1000,) * 6),
        ("intraday", 50): (131, 79, 200, (1500, 2000, 2000, 2500, 3000, 3500)),
        ("intraday", 100): (198, 99, 250, (2000, 2500, 3000, 3500, 3500, 4500)),
        ("intraday", 150): (265, 129, 300, (2500, 3000, 3500, 3500, 4000, 5500)),
    }[ratchet, k]
    size = k * 1000.0
    daily = [DailyLossLimit(dll, effect="lockout")] if ratchet == "eod" else []
    rules = [TrailingDrawdown(width, ratchet=ratchet, threshold_cap=size + target), *daily, TimeLimit(30)]
    funded = [TrailingDrawdown(width, ratchet=ratchet, threshold_cap=size + 100), *daily, Consistency(50, effect="gate_payout"), ScalingPlan(half_until_safety_net=True), ContractLimit(limit)]
    payout = dict(min_payout=500, period_days=8, qualifying_days=QualifyingDays(5, q), payout_cap_ladder=tuple(map(float, ladder)), max_lifetime_payouts=6, safety_net_floor=float(net))
    return _futures(f"apex40_{k}k_{ratchet}", size, rules, funded, dict(one_time=price, activation=active), payout, target)


def _tpt(k: int) -> Firm:
    target, width, monthly, reset = {25: (1500, 1500, 150, 79), 50: (3000, 2000, 170, 99), 75: (4500, 2500, 245, 139), 100: (6000, 3000, 330, 169), 150: (9000, 4500, 360, 199)}[k]
    size = k * 1000.0
    rules = [TrailingDrawdown(width, threshold_cap=size), Consistency(50), MinTradingDays(5)]
    funded = [TrailingDrawdown(width, ratchet="intraday", threshold_cap=size)]
    return _futures(f"tpt_{k}k", size, rules, funded, dict(monthly=monthly, reset=reset, activation=130), dict(profit_split=0.8, period_days=0, buffer_above_initial=float(width)), target)


def _ftmo(steps: int) -> Firm:
    size, edge = 100_000.0, Boundary("Europe/Prague", 0)
    if steps == 2:
        loss = (StaticMaxLoss(pct=10, inclusive=False), DailyLossLimit(pct=5, anchor="prev_midnight_balance", inclusive=False))
        phases = tuple(Phase(n, t, None, (*loss, MinTradingDays(4))) for n, t in (("challenge", 10_000.0), ("verification", 5_000.0)))
        return Firm("ftmo_2step_100k", size, phases, Phase("funded", None, None, loss), Fees(one_time=540, refundable_on_first_payout=True), Payout(profit_split=0.8, period_days=14), edge, firm="ftmo")
    loss = (TrailingDrawdown(pct=10, inclusive=False), DailyLossLimit(pct=3, anchor="prev_midnight_balance", inclusive=False))
    phase = Phase("challenge", 10_000.0, None, (*loss, Consistency(50)))
    return Firm("ftmo_1step_100k", size, (phase,), Phase("funded", None, None, (*loss, Consistency(50, effect="gate_payout"))), Fees(one_time=499), Payout(profit_split=0.9, period_days=14), edge, firm="ftmo")


PRESETS = {
    f.name: f
    for f in (
        *map(_topstep, (50, 100, 150)),
        *(_apex(k, r) for r in ("eod", "intraday") for k in (25, 50, 100, 150)),
        *map(_tpt, (25, 50, 75, 100, 150)),
        _ftmo(2),
        _ftmo(1),
    )
}


def load_firm(name: str) -> Firm:
    """A preset by name, or a rule set from a YAML file."""
    if name in PRESETS:
        return PRESETS[name]
    if name.endswith((".yaml", ".yml")):
        return from_yaml(name)
    raise ConfigError(f"unknown rule set {name!r}; presets: {', '.join(sorted(PRESETS))}")


# --- options -----------------------------------------------------------------------------------

# fixed values: the purchase daily-loss limit, baseline and promotional payout caps (standard, consistency) by size
PURCHASE_DLL = {50_000: 1000.0, 100_000: 2000.0, 150_000: 3000.0}
BASE_CAPS = {50_000: (2000.0, 3000.0), 100_000: (3000.0, 4000.0), 150_000: (5000.0, 6000.0)}
PROMO_CAPS = {50_000: (4000.0, 6000.0), 100_000: (6000.0, 8000.0), 150_000: (10000.0, 12000.0)}


def _each_phase(firm: Firm, f) -> Firm:
    return replace(firm, phases=tuple(map(f, firm.phases)), funded=f(firm.funded))


def with_daily_lockout(firm: Firm, amount: float, provenance: str) -> Firm:
    _need(firm.firm == "topstep", "this option belongs to another firm's accounts")
    _number(amount, "daily loss limit", 0, True)
    _need(not any(p.of(DailyLossLimit) for p in (*firm.phases, firm.funded)), "the rule set has a daily loss limit already")
    rule = DailyLossLimit(amount, effect="lockout")
    return replace(_each_phase(firm, lambda p: replace(p, rules=(*p.rules, rule))), dll_provenance=provenance)


def with_purchase_dll(firm: Firm, provenance: str = "combine_purchase") -> Firm:
    _need(provenance in ("combine_purchase", "xfa_activation"), "unknown provenance")
    _need(firm.account_size in PURCHASE_DLL, "no purchase limit for this account size")
    return with_daily_lockout(firm, PURCHASE_DLL[firm.account_size], provenance)


def with_promo_caps(firm: Firm) -> Firm:
    """Promotional caps over the baseline ones, for accounts bought with the fixed limit only."""
    _need(firm.dll_provenance == "combine_purchase", "promotional caps need the purchase limit of a new account")
    for p in (*firm.phases, firm.funded):
        d = p.of(DailyLossLimit)
        _need(len(d) == 1 and d[0].effect == "lockout" and d[0].width(firm.account_size) == PURCHASE_DLL.get(firm.account_size), "the purchase limit is not the official one")
    base, promo = BASE_CAPS[firm.account_size], PROMO_CAPS[firm.account_size]
    _need(firm.payout.payout_cap_ladder == (base[0],), "promotional caps apply to the baseline caps, once")
    c = firm.payout.consistency
    _need(c is None or c.payout_cap_ladder == (base[1],), "promotional caps apply to the baseline caps, once")
    return replace(firm, payout=replace(firm.payout, payout_cap_ladder=(promo[0],), consistency=c and replace(c, payout_cap_ladder=(promo[1],))))


def with_options(firm: Firm, dll: bool = False, pdll: float | None = None, promo: bool = False) -> Firm:
    _need(not (dll and pdll is not None), "the purchase limit and a personal one exclude each other")
    _need(not promo or dll, "promotional caps need the purchase limit")
    if dll:
        firm = with_purchase_dll(firm)
    if pdll is not None:
        firm = with_daily_lockout(firm, pdll, "pdll")
    return with_promo_caps(firm) if promo else firm


def with_fees(firm: Firm, **fees: float) -> Firm:
    """firm with extra_monthly, per_payout or payout_haircut set."""
    _need(set(fees) <= {"extra_monthly", "per_payout", "payout_haircut"}, "unknown fee override")
    return replace(firm, fees=replace(firm.fees, **{k: v for k, v in fees.items() if v}))
