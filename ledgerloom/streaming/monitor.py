"""A live monitor of account rules over a stream of closed trades.

State is one small row an account: balance, high-water mark, session, day's open. Trades of an account must come in
order; a watermark on exit_time bounds how long Spark waits for late ones, and a trade older than the account's last
one is reported as late instead of being replayed out of order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DailyLossLimit, Firm, StaticMaxLoss, TrailingDrawdown
from ..operators.replay import points

_OUT = "log_id bigint, exit_time timestamp, balance double, floor double, status string, rule string"
_STATE = "balance double, hwm double, day_open double, session string, last timestamp, status string, rule string"


def monitor(trades: DataFrame, firm: Firm, phase: str, delay: str = "10 minutes") -> DataFrame:
    """A row a trade: the account's balance, its floor, and whether a rule has been broken by then."""
    p, size = firm.phase(phase), firm.account_size
    init = p.initial(size)
    trails = [(r.width(size), float("inf") if r.threshold_cap is None else r.threshold_cap, r.ratchet == "intraday", r.inclusive, r.name) for r in p.of(TrailingDrawdown)]
    statics = [(init - r.width(size), r.inclusive, r.name) for r in p.of(StaticMaxLoss)]
    daily = [(r.width(size), r.inclusive, r.effect, r.name) for r in p.of(DailyLossLimit)]
    b = firm.day_boundary
    rows = trades.withColumn("session", b.date("exit_time").cast("string")).withWatermark("exit_time", delay)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bal, hwm, start, session, last, status, rule = state.get if state.exists else (init, init, init, "", pd.Timestamp(0), "active", None)
        out = []
        for t in pd.concat(list(frames)).sort_values(["exit_time", "trade_seq"]).itertuples():
            floor = max([min(hwm - w, cap) for w, cap, *_ in trails] + [v for v, *_ in statics], default=float("-inf"))
            if t.exit_time < last:
                out.append((key[0], t.exit_time, bal, floor, "late", None))
                continue
            last = t.exit_time
            if t.session != session:
                if session:
                    hwm = max(hwm, bal)
                session, start = t.session, bal
                status = "active" if status == "locked" else status
            if status == "active":
                lo, hi, close, low_first = points(t.pnl, None if pd.isna(t.mae) else t.mae, None if pd.isna(t.mfe) else t.mfe)
                intraday = any(x[2] for x in trails)
                if intraday and not low_first:
                    hwm = max(hwm, bal + hi)
                low = bal + lo
                under = lambda level, incl: low <= level if incl else low < level  # noqa: B023, E731
                hits = [(min(hwm - w, cap), n) for w, cap, _, incl, n in trails if under(min(hwm - w, cap), incl)]
                hits += [(v, n) for v, incl, n in statics if under(v, incl)]
                hits += [(start - w, n) for w, incl, effect, n in daily if effect == "fail" and under(start - w, incl)]
                locks = [(start - w, n) for w, incl, effect, n in daily if effect == "lockout" and under(start - w, incl)]
                worst, lock = max(hits, default=None), max(locks, default=None)
                if worst and (lock is None or worst[0] >= lock[0]):
                    status, rule, bal = "breached", worst[1], min(bal, worst[0])
                elif lock:
                    status, bal = "locked", lock[0]
                else:
                    bal += close
                    if intraday and low_first:
                        hwm = max(hwm, bal - close + hi)
            floor = max([min(hwm - w, cap) for w, cap, *_ in trails] + [v for v, *_ in statics], default=float("-inf"))
            out.append((key[0], t.exit_time, bal, floor, status, rule))
        state.update((bal, hwm, start, session, last.to_pydatetime(), status, rule))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return rows.groupBy("log_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
