"""Ordered statistics of a log: rolling means, halves, trend, runs, EWMA, regimes, clustering, deflated ratios."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from .kernel import ewma_sigma
from .metrics import profit_factor, ratio

LAMBDA, BURN_IN, MIN_CLASSIFIED = 0.94, 20, 30
EULER = 0.5772156649015329
LABELS = ("low", "mid", "high")


def rolling_mean(trades: DataFrame, window: int = 30) -> DataFrame:
    """(log_id, trade_seq, mean) of each full window."""
    w = Window.partitionBy("log_id").orderBy("trade_seq")
    t = trades.select("log_id", "trade_seq", F.avg("pnl").over(w.rowsBetween(1 - window, 0)).alias("mean"))
    return t.where(F.col("trade_seq") >= window)


def halves(trades: DataFrame) -> DataFrame:
    """Per log: size, expectancy and profit factor of the first n // 2 trades and of the rest."""
    n = F.count("*").over(Window.partitionBy("log_id"))
    t = trades.select("log_id", "pnl", (F.col("trade_seq") <= F.floor(n / 2)).alias("first"))
    out = []
    for name, mine in (("first", F.col("first")), ("second", ~F.col("first"))):
        p = F.when(mine, F.col("pnl"))
        out += [F.count(p).alias(f"{name}_n"), F.coalesce(F.avg(p), F.lit(0.0)).alias(f"{name}_expectancy")]
        win, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
        out.append(profit_factor(win, loss).alias(f"{name}_profit_factor"))
    return t.groupBy("log_id").agg(*out)


def walk_forward(trades: DataFrame, oos_start: str) -> DataFrame:
    """Per log: mean pnl from oos_start on over the mean before it, or the reason why not."""
    old = F.col("exit_time") < F.lit(oos_start).cast("timestamp")
    g = trades.groupBy("log_id").agg(F.count_if(old).alias("n_is"), F.count_if(~old).alias("n_oos"), F.avg(F.when(old, F.col("pnl"))).alias("m_is"), F.avg(F.when(~old, F.col("pnl"))).alias("m_oos"))
    reason = F.when(F.col("n_is") < 10, "too few in-sample trades").when(F.col("n_oos") < 10, "too few out-of-sample trades").when(F.col("m_is") <= 0, "no in-sample edge")
    return g.select("log_id", "n_is", "n_oos", F.when(reason.isNull(), ratio(F.col("m_oos"), F.col("m_is"))).alias("wfe"), reason.alias("wfe_reason"))


def runs(trades: DataFrame) -> DataFrame:
    """Per log: wins, losses, runs and the runs test's z; scratches are left out."""
    s = trades.where("pnl <> 0").select("log_id", "trade_seq", F.signum("pnl").alias("s"))
    s = s.withColumn("new", F.col("s") != F.lag("s").over(Window.partitionBy("log_id").orderBy("trade_seq")))
    g = s.groupBy("log_id").agg(F.count_if(F.col("s") > 0).alias("n1"), F.count_if(F.col("s") < 0).alias("n2"), (1 + F.count_if("new")).alias("r"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    ok = (n1 > 0) & (n2 > 0) & (n >= 20)
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / F.greatest(n * n * (n - 1), F.lit(1.0))
    z = F.when(ok & (var > 0), (F.col("r") - (1 + 2 * n1 * n2 / F.greatest(n, F.lit(1.0)))) / F.sqrt(F.when(var > 0, var))).otherwise(0.0)
    return g.select("log_id", F.col("n1").alias("wins"), F.col("n2").alias("losses"), F.when(ok, F.col("r")).otherwise(0).alias("runs"), z.alias("runs_z"))


def hac_slope(trades: DataFrame) -> DataFrame:
    """Per log: trend of pnl on the trade index, its Newey-West error and t; a log under 8 trades has none."""
    y, i = F.col("pnl"), F.col("trade_seq").cast("double")
    base = trades.groupBy("log_id").agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(i).alias("mx"), F.regr_slope(y, i).alias("slope"), F.regr_sxx(y, i).alias("sxx")).where("n >= 8")
    base = base.withColumn("lag", F.least(F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))), F.col("n") - 2))
    s = trades.select("log_id", "trade_seq", "pnl").join(base, "log_id")
    x = F.col("trade_seq") - F.col("mx")
    s = s.select("log_id", "trade_seq", "lag", "slope", "sxx", "n", (x * (y - F.col("my") - F.col("slope") * x)).alias("u"))
    most = int(base.agg(F.max("lag")).first()[0] or 0)  # grows with the 2/9th power of a log's length
    w = Window.partitionBy("log_id").orderBy("trade_seq")
    for k in range(1, most + 1):
        s = s.withColumn(f"u{k}", F.lag("u", k).over(w))
    term = lambda k: F.when(F.col("lag") >= k, 2.0 * (1.0 - k / (F.col("lag") + 1.0)) * F.coalesce(F.col("u") * F.col(f"u{k}"), F.lit(0.0))).otherwise(0.0)
    products = F.col("u") * F.col("u")
    for k in range(1, most + 1):
        products = products + term(k)
    g = s.groupBy("log_id").agg(*[F.first(c).alias(c) for c in ("lag", "slope", "sxx", "n")], F.sum(products).alias("lrv"))
    g = g.withColumn("se", F.sqrt(F.greatest("lrv", F.lit(0.0))) / F.col("sxx"))
    return g.select("log_id", "n", "slope", "se", ratio(F.col("slope"), F.col("se")).alias("t"), F.col("lag").cast("int").alias("lag"))


def _concordance(v: np.ndarray) -> int:
    """Concordant less discordant pairs of a sequence, by merging blocks with searchsorted."""
    total, block = 0, []
    for i in range(0, len(v), 256):
        part = v[i : i + 256]
        total += int(np.triu(np.sign(part[None, :] - part[:, None]), 1).sum())
        block.append(np.sort(part))
    while len(block) > 1:
        out = []
        for a, b in zip(block[::2], block[1::2]):
            below = np.searchsorted(a, b, "left").sum()
            above = (len(a) - np.searchsorted(a, b, "right")).sum()
            total += int(below - above)
            out.append(np.sort(np.concatenate([a, b]), kind="stable"))
        if len(block) % 2:
            out.append(block[-1])
        block = out
    return total


def mann_kendall(trades: DataFrame) -> DataFrame:
    """Per log: S, its tie-corrected z (0 under 8 trades). S is O(n log n) in one kernel a log; ties are grouped."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("trade_seq").pnl.to_numpy()
        return pd.DataFrame({"log_id": [pdf.log_id.iloc[0]], "s": [_concordance(v) if len(v) >= 8 else 0]})

    s = trades.select("log_id", "trade_seq", "pnl").groupBy("log_id").applyInPandas(kernel, "log_id bigint, s bigint")
    tie = trades.groupBy("log_id", "pnl").agg(F.count("*").cast("double").alias("c"))
    c = F.col("c")
    g = tie.groupBy("log_id").agg(F.sum("c").alias("n"), F.sum(c * (c - 1) * (2 * c + 5)).alias("t"))
    n = F.col("n")
    var = (n * (n - 1) * (2 * n + 5) - F.col("t")) / 18.0
    j = g.join(s, "log_id")
    z = F.when((n >= 8) & (var > 0), (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(F.when(var > 0, var))).otherwise(0.0)
    return j.select("log_id", F.col("s").alias("mk_s"), z.alias("mk_z"))


def decay(trades: DataFrame, oos_start: str | None = None) -> DataFrame:
    """One row a log: halves, trend with its t, Mann-Kendall, runs, walk-forward ratio if a date is given, and whether the edge decayed.

    Decayed is a falling trend at 5 % whose second half keeps less than half of the first's gain. A log too short for
    a test has its neutral value: trend and t 0, z 0, no runs.
    """
    j = halves(trades).join(hac_slope(trades).select("log_id", "slope", F.col("t").alias("slope_t")), "log_id", "left")
    j = j.join(mann_kendall(trades), "log_id", "left").join(runs(trades).select("log_id", "runs", "runs_z"), "log_id", "left")
    j = j.fillna(0, ["slope", "slope_t", "mk_s", "mk_z", "runs", "runs_z"])
    z95 = 1.959963984540054
    falling = (F.col("slope") < 0) & (F.abs("slope_t") > z95)
    j = j.withColumn("decayed", falling & (F.col("first_expectancy") > 0) & (F.col("second_expectancy") < 0.5 * F.col("first_expectancy")))
    return j if oos_start is None else j.join(walk_forward(trades, oos_start).select("log_id", "wfe", "wfe_reason"), "log_id")


def ewma(daily: DataFrame, lam: float = LAMBDA, burn_in: int = BURN_IN) -> DataFrame:
    """(log_id, day_idx, day_pnl, sigma): forecast volatility from earlier days only; null inside the burn-in.

    Each day's forecast needs the day's before, so a log's days go through one fold, a task a log, seeded with the
    mean square of the first burn_in days.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_idx")
        return pdf.assign(sigma=ewma_sigma(pdf.day_pnl.to_numpy(), lam, burn_in))

    rows = daily.select("log_id", F.col("day_idx").cast("bigint").alias("day_idx"), "day_pnl")
    s = rows.groupBy("log_id").applyInPandas(fold, "log_id bigint, day_idx bigint, day_pnl double, sigma double")
    return s.withColumn("sigma", F.when(~F.isnan("sigma"), F.col("sigma")))


def regime_codes(sigmas: DataFrame) -> DataFrame:
    """sigmas with code: terciles of the log's sigma 0, 1, 2; -1 unclassified (burn-in, or under 3 classified)."""
    cut = sigmas.where("sigma is not null").groupBy("log_id").agg(F.percentile("sigma", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.count("*").alias("n"))
    j = sigmas.join(cut, "log_id", "left")
    s = F.col("sigma")
    code = F.when(s.isNull() | F.col("n").isNull() | (F.col("n") < 3), -1).when(s <= F.col("q")[0], 0).when(s <= F.col("q")[1], 1).otherwise(2)
    return j.select("log_id", "day_idx", "day_pnl", "sigma", code.alias("code"))


def regimes(coded: DataFrame, daily: DataFrame, trades_wins: DataFrame) -> DataFrame:
    """Per log and regime: days, trades, net, day mean, trade win rate, persistence. trades_wins: (log_id, day_idx, n_trades, wins)."""
    w = Window.partitionBy("log_id").orderBy("day_idx")
    c = coded.withColumn("next", F.lead("code").over(w)).join(trades_wins, ["log_id", "day_idx"])
    keep = F.when((F.col("next") >= 0), (F.col("next") == F.col("code")).cast("double"))
    return (
        c.where("code >= 0")
        .groupBy("log_id", "code")
        .agg(F.count("*").alias("n_days"), F.sum("n_trades").alias("n_trades"), F.sum("day_pnl").alias("net"), F.avg("day_pnl").alias("day_expectancy"), (F.sum("wins") / F.sum("n_trades")).alias("win_rate"), F.coalesce(F.avg(keep), F.lit(0.0)).alias("persistence"))
    )


def regime_summary(reg: DataFrame) -> DataFrame:
    """Per log: classified days, tested, worst regime by day mean, and whether the edge depends on regime."""
    g = reg.groupBy("log_id").agg(F.sum("n_days").alias("n_classified"), F.min_by("code", F.struct("day_expectancy", "code")).alias("worst"), F.sum("net").alias("total"), F.min("net").alias("least"))
    tested = F.col("n_classified") >= MIN_CLASSIFIED
    dep = tested & (F.col("total") > 0) & (F.col("least") < 0) & (-F.col("least") >= 0.2 * F.col("total"))
    return g.select("log_id", "n_classified", tested.alias("tested"), F.when(tested, F.col("worst")).alias("worst_code"), dep.alias("regime_dependent"))


def market_days(bars: DataFrame, session: Column) -> DataFrame:
    """Per session of bars: close, ATR(14), SMA(20), trend and volatility label; sessions without both are left out."""
    b = bars.withColumn("session_date", session)
    d = b.groupBy("session_date").agg(F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"))
    w = Window.orderBy("session_date")  # one row a session of one instrument
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.coalesce(prev, F.col("high"))), F.abs(F.col("low") - F.coalesce(prev, F.col("low"))))
    d = d.withColumn("tr", tr).withColumn("i", F.row_number().over(w))
    d = d.withColumn("atr", F.avg("tr").over(w.rowsBetween(-13, 0))).withColumn("sma", F.avg("close").over(w.rowsBetween(-19, 0))).where("i >= 20")
    q = d.agg(F.percentile("atr", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    d = d.crossJoin(F.broadcast(q))  # one row
    vol = F.when(F.col("atr") <= F.col("q")[0], "low_vol").when(F.col("atr") <= F.col("q")[1], "mid_vol").otherwise("high_vol")
    return d.select("session_date", "close", "atr", "sma", F.concat_ws("_", F.when(F.col("close") >= F.col("sma"), "up").otherwise("down"), vol).alias("regime"))


def market_regimes(daily: DataFrame, market: DataFrame) -> DataFrame:
    """Per log and market regime: days, net, day mean over the days that the bars cover."""
    j = daily.join(market, "session_date")
    return j.groupBy("log_id", "regime").agg(F.count("*").alias("n_days"), F.sum("day_pnl").alias("net"), F.avg("day_pnl").alias("day_expectancy"))


def _lags(n: int) -> int:
    return 10 if n >= 100 else 5


def _squares_tests(r: np.ndarray) -> tuple[int, bool, float, float, float, float, int]:
    n, q = len(r), _lags(len(r))
    if n < max(30, q + 10):
        return n, False, 0.0, 1.0, 0.0, 1.0, q
    s = (r - r.mean()) ** 2
    y = s[q:]
    x = np.column_stack([np.ones(n - q), *(s[q - k : n - k] for k in range(1, q + 1))])
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    tot = ((y - y.mean()) ** 2).sum()
    lm = (n - q) * max(1 - ((y - fit) ** 2).sum() / tot, 0.0) if tot > 0 else 0.0
    c = s - s.mean()
    den = (c * c).sum()
    ml = n * (n + 2.0) * sum(((c[k:] * c[:-k]).sum() / den) ** 2 / (n - k) for k in range(1, q + 1)) if den > 0 else 0.0
    return n, True, lm, special.chi2_sf(lm, q), ml, special.chi2_sf(ml, q) if den > 0 else 1.0, q


def clustering(daily: DataFrame) -> DataFrame:
    """Per log: ARCH-LM and McLeod-Li tests of daily pnl; one kernel over a log's days."""
    schema = "log_id bigint, n_days bigint, tested boolean, arch_lm double, arch_lm_p double, mcleod_li double, mcleod_li_p double, lags int, clustered boolean"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _squares_tests(pdf.sort_values("day_idx").day_pnl.to_numpy())
        return pd.DataFrame([[pdf.log_id.iloc[0], *t, bool(t[1] and (t[3] < 0.05 or t[5] < 0.05))]], columns=[c.split()[0] for c in schema.split(", ")])

    return daily.select("log_id", "day_idx", "day_pnl").groupBy("log_id").applyInPandas(kernel, schema)


def moments(trades: DataFrame) -> DataFrame:
    """Per log: n, mean, sd (n - 1), population skewness, raw kurtosis of trade pnl."""
    return trades.groupBy("log_id").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)).alias("sd"), F.coalesce(F.skewness("pnl"), F.lit(0.0)).alias("skew"), (F.coalesce(F.kurtosis("pnl"), F.lit(0.0)) + 3).alias("kurt"))


def deflate(n: int, mean: float, sd: float, skew: float, kurt: float, trials: int = 1) -> dict:
    """Deflated statistics from the moments of a log."""
    if n < 3:
        raise ValueError("deflated statistics need three trades")
    if trials < 1:
        raise ValueError("the number of trials is at least 1")
    out = dict.fromkeys(("sr", "psr", "min_trl", "sqn", "sqn_capped", "sr0", "dsr", "minbtl_years", "haircut_sharpe", "haircut_pct"))
    if sd == 0:
        sr = math.copysign(math.inf, mean) if mean else 0.0
        return out | {"sr": sr, "sqn": sr, "sqn_capped": sr, "psr": 1.0 if sr > 0 else 0.0}
    sr = mean / sd
    den = math.sqrt(max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12))
    psr = lambda b: float(special.normal_cdf((sr - b) * math.sqrt(n - 1) / den))
    out |= {"sr": sr, "psr": psr(0.0), "sqn": sr * math.sqrt(n), "sqn_capped": sr * math.sqrt(min(n, 100))}
    if sr > 0:
        out["min_trl"] = 1 + (den * special.normal_ppf(0.95) / sr) ** 2
    if trials > 1:
        top = (1 - EULER) * special.normal_ppf(1 - 1 / trials) + EULER * special.normal_ppf(1 - 1 / (trials * math.e))
        sr0 = den / math.sqrt(n - 1) * top
        out |= {"sr0": sr0, "dsr": psr(sr0), "minbtl_years": top * top}
        if sr > 0:
            # the tail keeps its digits as a logarithm: 1 less a tail is 1 from a t statistic of 8.3 on
            cut = special.normal_log_isf(special.normal_log_sf(sr * math.sqrt(n)) + math.log(trials)) / math.sqrt(n)
            out |= {"haircut_sharpe": cut, "haircut_pct": 1 - cut / sr}
    return out


def deflated(trades: DataFrame, trials: int = 1) -> DataFrame:
    """Per log with three trades or more: the deflated statistics. Moments are aggregates; the tails run on one row a log."""
    names = ("sr", "psr", "min_trl", "sqn", "sqn_capped", "sr0", "dsr", "minbtl_years", "haircut_sharpe", "haircut_pct")
    schema = "log_id bigint, n bigint, skew double, kurt double, n_trials int, " + ", ".join(f"{x} double" for x in names)

    def kernel(frames):
        for f in frames:
            rows = [[r.log_id, r.n, r.skew, r.kurt, trials, *deflate(r.n, r.mean, r.sd, r.skew, r.kurt, trials).values()] for r in f.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return moments(trades).where("n >= 3").mapInPandas(kernel, schema)


def smoothness(trades: DataFrame) -> DataFrame:
    """Per log: R^2 of the equity curve on the trade index (0 under 10 trades, 1 if it never moves)."""
    w = Window.partitionBy("log_id").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    e = trades.select("log_id", "trade_seq", F.sum("pnl").over(w).alias("eq"))
    g = e.groupBy("log_id").agg(F.count("*").alias("n"), F.regr_r2("eq", F.col("trade_seq").cast("double")).alias("r2"))
    return g.select("log_id", F.when(F.col("n") >= 10, F.coalesce("r2", F.lit(1.0))).otherwise(0.0).alias("r2"))
