"""Deterministic replay of one log through a phase, trade by trade: the record itself, not a resample.

Unlike the path kernel it knows the calendar: time limits in calendar days, session closes by the clock. It is
written for one account at a time and shares no code with the kernel's step, so that each checks the other.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Consistency, ContractLimit, DailyLossLimit, Firm, MinTradingDays, Phase, ScalingPlan, SessionClose, StaticMaxLoss, TimeLimit, TrailingDrawdown
from .kernel import MARGIN, PayoutTerms, payout_terms

INF = math.inf


@dataclass
class Trade:
    entry: dt.datetime
    exit: dt.datetime
    quantity: float
    pnl: float
    mae: float | None = None
    mfe: float | None = None
    entry_session: dt.date | None = None


@dataclass
class Breach:
    rule: str
    level: float
    equity: float
    date: dt.date
    day: int
    trade: int


@dataclass
class Replay:
    outcome: str
    breach: Breach | None = None
    days_consumed: int = 0
    final_balance: float = 0.0
    effective_target: float | None = None
    best_day: float = 0.0
    lockout_days: int = 0
    capped_days: int = 0
    pass_day: int | None = None
    pass_date: dt.date | None = None
    withdrawn: float = 0.0
    payouts: int = 0
    first_payout: dt.date | None = None
    timeline: list[dict] = field(default_factory=list)


def points(pnl: float, mae: float | None, mfe: float | None) -> tuple[float, float, float, bool]:
    """Low, high, close of a trade relative to its start, and whether the low is known to come first."""
    lo = min(mae, pnl) if mae is not None else pnl
    hi = max(mfe, pnl) if mfe is not None else pnl
    return lo, hi, pnl, mae is not None and mfe is None


class _Trail:
    def __init__(self, rule: TrailingDrawdown, init: float, size: float):
        self.rule, self.amount, self.hwm = rule, rule.width(size), init
        self.cap = INF if rule.threshold_cap is None else rule.threshold_cap

    @property
    def level(self) -> float:
        return min(self.hwm - self.amount, self.cap)

    def touched(self, x: float) -> bool:
        return x <= self.level if self.rule.inclusive else x < self.level


def close_deadline(rule: SessionClose, session: dt.date) -> dt.datetime:
    at = min([rule.hard_close, *(t for d, t in rule.early_closes if d == session.isoformat())], key=lambda s: [int(x) for x in s.split(":")])
    return dt.datetime.combine(session, dt.time(*[int(x) for x in at.split(":")]), ZoneInfo(rule.tz)).astimezone(dt.timezone.utc)


def replay(days: Iterable[tuple[dt.date, list[Trade]]], phase: Phase, firm: Firm, payout: PayoutTerms | None = None, base: float | None = None, vol=None, cushion: tuple[float, float] | None = None) -> Replay:
    size = firm.account_size
    init = phase.initial(size)
    trails = [_Trail(r, init, size) for r in phase.of(TrailingDrawdown)]
    statics = [(init - r.width(size), r) for r in phase.of(StaticMaxLoss)]
    daily = [(r.width(size), r) for r in phase.of(DailyLossLimit) if r.effect == "fail"]
    locks = [(r.width(size), r) for r in phase.of(DailyLossLimit) if r.effect == "lockout"]
    raises = [c for c in phase.of(Consistency) if c.effect == "raise_target"]
    limit, plan, close = phase.one(TimeLimit), phase.one(ScalingPlan), phase.one(SessionClose)
    need_days = m.days if (m := phase.one(MinTradingDays)) else 0
    cap_rule = phase.one(ContractLimit)
    target = phase.profit_target
    if plan and not (base and base > 0):
        from ..errors import ConfigError

        raise ConfigError(f"phase {phase.name!r} scales contracts, but the log shows no base size")
    half = 0.5 * (cap_rule.max_contracts if cap_rule else base) / base if plan and plan.half_until_safety_net else None
    room = init - max([t.level for t in trails] + [v for v, _ in statics]) if cushion else None

    bal, unlocked, var = init, False, vol.target**2 if vol else 0.0
    out = Replay("survived" if target is None else "incomplete", final_balance=init, effective_target=target)
    qual = since = 0
    best_since, anchor, start_date = 0.0, init, None
    for day, (date, trades) in enumerate(days):
        start_date = start_date or date
        if limit and (date - start_date).days >= limit.max_calendar_days:
            out.outcome = "expired"
            break
        out.days_consumed += 1
        start, w = bal, 1.0
        if vol:
            w = min(max(vol.target / math.sqrt(var), vol.lo), vol.hi)
        if room:
            w *= min(max(max(bal - max([t.level for t in trails] + [v for v, _ in statics]), 0) / room, cushion[0]), cushion[1])
        cap = INF
        if plan and plan.tiers:
            reached = [t.max_contracts for t in plan.tiers if bal >= t.min_balance] or [plan.tiers[0].max_contracts]
            cap = reached[-1] / base
        if half is not None and not unlocked:
            cap = min(cap, half)
        if cap < w:
            w = cap
            out.capped_days += 1
        gained, locked, over = 0.0, False, False
        for i, tr in enumerate(trades):
            lo, hi, cl, low_first = points(tr.pnl * w, None if tr.mae is None else tr.mae * w, None if tr.mfe is None else tr.mfe * w)
            low, high, done = start + gained + lo, start + gained + hi, start + gained + cl
            if not low_first:
                for t in trails:
                    if t.rule.ratchet == "intraday":
                        t.hwm = max(t.hwm, high)
            hits = [(t.level, t.rule.name) for t in trails if t.touched(low)]
            hits += [(v, r.name) for v, r in statics if (low <= v if r.inclusive else low < v)]
            hits += [(start - v, r.name) for v, r in daily if (low <= start - v if r.inclusive else low < start - v)]
            shut = [(start - v, v) for v, r in locks if (low <= start - v if r.inclusive else low < start - v)]
            worst = max(hits, key=lambda h: h[0], default=None)
            lock = max(shut, default=None)
            if worst and (lock is None or worst[0] >= lock[0]):
                out.outcome, out.breach = "breached", Breach(worst[1], worst[0], low, date, day, i)
                gained, over = min(gained, worst[0] - start), True
                break
            if lock:
                gained, locked = -lock[1], True
                out.lockout_days += 1
                break
            if low_first:
                for t in trails:
                    if t.rule.ratchet == "intraday":
                        t.hwm = max(t.hwm, high)
            gained = done - start
            gone = next((t for t in trails if t.touched(done)), None)
            if gone:
                out.outcome, out.breach, over = "breached", Breach(gone.rule.name, gone.level, done, date, day, i), True
                break
            if close and tr.exit >= close_deadline(close, tr.entry_session or date):
                out.outcome, out.breach, over = "breached", Breach("session_close", done, done, date, day, i), True
                break
        bal = start + gained
        out.best_day = max(out.best_day, gained)
        if vol:
            var = vol.lam * var + (1 - vol.lam) * sum(t.pnl for t in trades) ** 2
        if half is not None and bal >= firm.payout.safety_net_floor:
            unlocked = True
        for t in trails:
            if t.rule.ratchet == "eod":
                t.hwm = max(t.hwm, bal)
        paid = 0.0
        if target is not None and not over:
            need, blocked = target, False
            for c in raises:
                if out.best_day > c.frac * target:
                    need = max(need, out.best_day / c.frac)
                if c.basis == "total_profit" and out.best_day > 0 and out.best_day >= c.frac * (bal - init):
                    blocked = True
            out.effective_target = need
            if not blocked and bal - init >= need and out.days_consumed >= need_days:
                out.outcome, out.pass_day, out.pass_date, over = "passed", day, date, True
        if payout is not None and not over:
            qual += gained >= payout.q_profit
            since += 1
            best_since = max(best_since, gained)
            gain = bal - anchor
            if payout.consistency:
                may = since >= max(payout.consistency[0], payout.period, 1) and gain > 0 and best_since <= payout.consistency[1] * gain
            else:
                may = qual >= payout.q_count and since >= max(payout.period, 1) and (not payout.need_profit or not out.payouts or gain >= 0.01)
            may = may and all(gain > 0 and best_since < g * gain for g in payout.gates)
            if may:
                floor = payout.floor
                for t in trails:
                    floor = max(floor, init - t.amount + MARGIN if t.cap == INF else t.level + MARGIN)
                    if payout.snap and t.cap < INF:
                        floor = max(floor, t.cap + MARGIN)
                sum_ = min(bal - floor - payout.keep, float(payout.ladder[min(out.payouts, len(payout.ladder) - 1)]))
                if payout.share is not None:
                    sum_ = min(sum_, payout.share * bal)
                if sum_ >= payout.least:
                    paid = sum_
                    bal -= paid
                    out.withdrawn += paid
                    out.payouts += 1
                    out.first_payout = out.first_payout or date
                    for t in trails:
                        if t.cap == INF:
                            t.hwm = max(t.hwm - paid, init)
                        elif payout.snap:
                            t.hwm = max(t.hwm, t.cap + t.amount)
                    qual, since, best_since, anchor = 0, 0, 0.0, bal
                    over = payout.lifetime is not None and out.payouts >= payout.lifetime
        out.final_balance = bal
        out.timeline.append({"date": date, "day_pnl": gained, "balance": bal, "hwm": max((t.hwm for t in trails), default=None), "trailing_floor": max((t.level for t in trails), default=None), "locked": locked, "trades": len(trades), "payout": paid})
        if over:
            break
    return out


def sessions_of(rows: Iterable) -> Iterator[tuple[dt.date, list[Trade]]]:
    """Days of a log's rows, which come in order; one day is held at a time."""
    none = lambda x: None if pd.isna(x) else float(x)
    date = lambda n: dt.date(1970, 1, 1) + dt.timedelta(int(n))
    at = lambda n: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=int(n))
    for day, trades in itertools.groupby(rows, key=lambda r: r.session_date):
        yield date(day), [Trade(at(r.entry_time), at(r.exit_time), r.quantity, r.pnl, none(r.mae), none(r.mfe), date(r.entry_session)) for r in trades]


_RESULT = "log_id bigint, phase string, outcome string, breach_rule string, breach_level double, breach_date date, days_consumed int, final_balance double, effective_target double, best_day double, lockout_days int, capped_days int, pass_date date, withdrawn double, payouts int, first_payout date"


def _replayed(trades: DataFrame, firm: Firm, base: DataFrame, schema: str, run) -> DataFrame:
    """Rows of run(log_id, base, days) of each log; base is (log_id, base). Trades pass by in order, so no log is held whole."""
    b = firm.day_boundary
    t = trades.join(base, "log_id", "left")
    w = Window.partitionBy("log_id").orderBy("trade_seq")  # deals and sorts: rows reach the function log by log, in order
    day = lambda c: F.unix_date(b.date(c))
    t = t.select("log_id", F.row_number().over(w).alias("i"), F.unix_micros("entry_time").alias("entry_time"), F.unix_micros("exit_time").alias("exit_time"), "quantity", "pnl", "mae", "mfe", day("exit_time").alias("session_date"), day("entry_time").alias("entry_session"), "base")
    names = [c.split()[0] for c in schema.split(", ")]

    def logs(frames):
        for log_id, rows in itertools.groupby((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.log_id):
            first = next(rows)
            size = None if pd.isna(first.base) else float(first.base)
            yield pd.DataFrame(run(int(log_id), size, sessions_of(itertools.chain([first], rows))), columns=names)

    return t.mapInPandas(logs, schema)


def evaluate(trades: DataFrame, firm: Firm, phase: str | None = None, per_week: float = 5.0, base: DataFrame | None = None) -> DataFrame:
    """Per log, a row a phase: the named phase, or the chain of phases, each on the days the ones before have left."""
    chain = [firm.phase(phase)] if phase else [*firm.phases, firm.funded]
    if base is None:
        base = trades.select("log_id").distinct().withColumn("peak_exposure", F.lit(None).cast("double"))

    def run(log_id, size, days):
        rows = []
        for p in chain:  # each phase takes its days from those that are left
            terms = payout_terms(firm, p.initial(firm.account_size), per_week) if p.profit_target is None else None
            r = replay(days, p, firm, terms, base=size)
            b = r.breach
            rows.append([log_id, p.name, r.outcome, b and b.rule, b and b.level, b and b.date, r.days_consumed, r.final_balance, r.effective_target, r.best_day, r.lockout_days, r.capped_days, r.pass_date, r.withdrawn, r.payouts, r.first_payout])
            if r.outcome != "passed":
                break
        return rows

    return _replayed(trades, firm, base.select("log_id", F.col("peak_exposure").cast("double").alias("base")), _RESULT, run)


def timeline(trades: DataFrame, firm: Firm, phase: str) -> DataFrame:
    """Per log and session of the phase: balance, floor, payouts."""
    schema = "log_id bigint, date date, day_pnl double, balance double, hwm double, trailing_floor double, locked boolean, trades int, payout double"
    p = firm.phase(phase)

    def run(log_id, size, days):
        terms = payout_terms(firm, p.initial(firm.account_size), 5.0) if p.profit_target is None else None
        return [{"log_id": log_id} | x for x in replay(days, p, firm, terms, base=size).timeline]

    return _replayed(trades, firm, trades.groupBy("log_id").agg(F.max("quantity").alias("base")), schema, run)


def close_violations(trades: DataFrame, firm: Firm, rule: SessionClose) -> DataFrame:
    """Per log: trades still open at the hard close of the session that they were opened in. Plain column expressions."""
    s = firm.day_boundary.date("entry_time")
    hhmmss = lambda t: t if t.count(":") == 2 else t + ":00"
    at = F.lit(hhmmss(rule.hard_close))
    for day, t in rule.early_closes:
        at = F.when(s == F.lit(day).cast("date"), F.least(F.lit(hhmmss(t)), at)).otherwise(at)
    dead = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", s.cast("string"), at)), rule.tz)
    return trades.groupBy("log_id").agg(F.count_if(F.col("exit_time") >= dead).alias("violations"))


def check_marks(marks: DataFrame, firm: Firm, phase: str) -> DataFrame:
    """Per log, over equity marks (log_id, ts, ordinal, equity): first breach, lockouts, worst level, mark density."""
    schema = "log_id bigint, breached boolean, rule string, level double, equity double, ts timestamp, lockouts int, sessions int, intraday_marks boolean, final_balance double"
    p, size = firm.phase(phase), firm.account_size
    m = marks.select("log_id", "ts", "ordinal", "equity", firm.day_boundary.date("ts").alias("session_date"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "ordinal"]).drop_duplicates("ts", keep="last")
        init = p.initial(size)
        trails = [_Trail(r, init, size) for r in p.of(TrailingDrawdown)]
        statics = [(init - r.width(size), r) for r in p.of(StaticMaxLoss)]
        limits = [(r.width(size), r) for r in p.of(DailyLossLimit)]
        offset = init - float(pdf.equity.iloc[0])
        bal = start = init
        session, locked, lockouts, found = None, False, 0, None
        for r in pdf.itertuples():
            if r.session_date != session:
                if session is not None:
                    for t in trails:
                        if t.rule.ratchet == "eod":
                            t.hwm = max(t.hwm, bal)
                if locked:
                    offset, locked = bal - last, False
                session, start = r.session_date, bal
            last = r.equity
            if locked:
                continue
            now = r.equity + offset
            for t in trails:
                if t.rule.ratchet == "intraday":
                    t.hwm = max(t.hwm, now)
            hits = [(t.level, t.rule.name) for t in trails if t.touched(now)] + [(v, x.name) for v, x in statics if (now <= v if x.inclusive else now < v)]
            shut = []
            for v, x in limits:
                if now <= start - v if x.inclusive else now < start - v:
                    (hits if x.effect == "fail" else shut).append((start - v, x.name))
            worst, lock = max(hits, default=None), max(shut, default=None)
            if worst and (lock is None or worst[0] >= lock[0]):
                found = (worst[1], worst[0], now, r.ts)
                bal = now
                break
            if lock:
                locked, bal = True, lock[0]
                lockouts += 1
                continue
            bal = now
        n = pdf.session_date.nunique()
        row = [pdf.log_id.iloc[0], found is not None, *(found or (None, None, None, None)), lockouts, n, len(pdf) > 1.5 * n, bal]
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    return m.groupBy("log_id").applyInPandas(kernel, schema)
