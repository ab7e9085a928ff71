"""Trade logs for the tests."""

import datetime as dt

import numpy as np

from ledgerloom.schema import TRADES

START = dt.date(2026, 1, 5)


def weekdays(n):
    out, d = [], START
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def trade_rows(days, log_id=0, symbol="MNQ", excursions=None):
    """Rows of a log given as a list of days of pnl (or (pnl, mae, mfe)); trades of 20 minutes from 09:00 Chicago."""
    rows, seq = [], 0
    for date, trades in zip(weekdays(len(days)), days):
        for k, t in enumerate(trades):
            pnl, mae, mfe = t if isinstance(t, tuple) else (t, min(t, 0.0) if excursions else None, max(t, 0.0) if excursions else None)
            seq += 1
            entry = dt.datetime.combine(date, dt.time(15)) + dt.timedelta(minutes=5 * k)
            rows.append((log_id, seq, entry, entry + dt.timedelta(minutes=4), symbol, "long", 1.0, float(pnl), None, None, 0.0, mae, mfe))
    return rows


def random_days(seed, n=120, per=4, mean=15.0, sd=180.0, excursions=True):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        day = []
        for p in np.round(r.normal(mean, sd, per), 2).tolist():
            kind = r.integers(0, 4) if excursions else 3
            mae, mfe = round(min(p, 0) - float(r.random()) * 80, 2), round(max(p, 0) + float(r.random()) * 80, 2)
            day.append((p, mae if kind < 3 else None, mfe if kind < 2 else None))
        out.append(day)
    return out


def log(spark, days, log_id=0, **kw):
    return spark.createDataFrame(trade_rows(days, log_id, **kw), TRADES)
