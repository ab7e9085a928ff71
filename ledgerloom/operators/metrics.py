"""Headline and full metrics of many logs in one plan.

Trades are reduced to session days first (sum, extremes and losing runs of the day's path), so what is ordered per
log is one row a day, however many trades a day or log has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sessions import CME, Boundary

INF = float("inf")
EQUITY, YEAR_DAYS, DEFAULT_CADENCE = 50_000.0, 252, 5.0


def ratio(a: Column, b: Column, when_zero: Column | float = 0.0) -> Column:
    """a / b without ANSI's error: when_zero where b is 0."""
    z = when_zero if isinstance(when_zero, Column) else F.lit(when_zero)
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(z)


def profit_factor(win: Column, loss: Column) -> Column:
    """Gross win over gross loss (a positive number); inf if nothing was lost, 0 if nothing was won."""
    return ratio(win, loss, F.when(win > 0, F.lit(INF)).otherwise(F.lit(0.0)))


def days(trades: DataFrame, boundary: Boundary = CME) -> DataFrame:
    """A row a log and session: day_pnl, n_trades and the day's path (all relative to its open)."""
    t = trades.withColumn("session_date", boundary.date("exit_time"))
    w = Window.partitionBy("log_id", "session_date").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("run", F.sum("pnl").over(w)).withColumn("i", F.row_number().over(Window.partitionBy("log_id", "session_date").orderBy("trade_seq")))
    t = t.withColumn("top", F.greatest(F.lit(0.0), F.max("run").over(w)))
    t = t.withColumn("kept", F.max(F.when(F.col("pnl") >= 0, F.col("i"))).over(w))
    lose = F.when(F.col("pnl") < 0, F.col("i") - F.coalesce("kept", F.lit(0))).otherwise(0)
    return t.groupBy("log_id", "session_date").agg(
        F.max_by("run", "i").alias("day_pnl"),
        F.count("*").alias("n_trades"),
        F.max("top").alias("hi"),
        F.least(F.lit(0.0), F.min("run")).alias("lo"),
        F.max(F.col("top") - F.col("run")).alias("dd"),
        F.max(lose).alias("best_run"),
        (F.coalesce(F.min(F.when(F.col("pnl") >= 0, F.col("i"))) - 1, F.count("*"))).alias("head_run"),
        (F.count("*") - F.coalesce(F.max(F.when(F.col("pnl") >= 0, F.col("i"))), F.lit(0))).alias("tail_run"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)).alias("win"),
        F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)).alias("loss"),
    )


def indexed(daily: DataFrame) -> DataFrame:
    """daily with day_idx 0, 1, ... per log."""
    return daily.withColumn("day_idx", (F.row_number().over(Window.partitionBy("log_id").orderBy("session_date")) - 1).cast("bigint"))


def path(daily: DataFrame) -> DataFrame:
    """Per log: max_drawdown (start included) and longest_losing_streak."""
    before = Window.partitionBy("log_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    d = daily.withColumn("eq", F.coalesce(F.sum("day_pnl").over(before), F.lit(0.0)))
    d = d.withColumn("peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("eq") + F.col("hi")).over(before), F.lit(0.0))))
    day = F.struct("session_date", "n_trades", "head_run", "tail_run", "best_run")
    g = d.groupBy("log_id").agg(F.max(F.greatest("dd", F.col("peak") - F.col("eq") - F.col("lo"))).alias("max_drawdown"), F.sort_array(F.collect_list(day)).alias("p"))

    def step(s, x):
        run = s["run"] + x["head_run"]
        whole = x["head_run"] == x["n_trades"]
        return F.struct(F.greatest(s["best"], run, x["best_run"]).cast("bigint").alias("best"), F.when(whole, run).otherwise(x["tail_run"]).cast("bigint").alias("run"))

    zero = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("run"))
    return g.select("log_id", "max_drawdown", F.aggregate("p", zero, step, lambda s: s["best"]).alias("longest_losing_streak"))


def headline(trades: DataFrame, boundary: Boundary = CME) -> DataFrame:
    """Per log: trades, days, net, win rate, profit factor, drawdown, losing streak."""
    t = trades.groupBy("log_id").agg(
        F.count("*").alias("n_trades"),
        F.sum("pnl").alias("net_profit"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        profit_factor(F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))).alias("profit_factor"),
    )
    d = days(trades, boundary)
    n = d.groupBy("log_id").agg(F.count("*").alias("trading_days"))
    return t.join(n, "log_id").join(path(d), "log_id")


def cadence(daily: DataFrame) -> DataFrame:
    """Per log: sessions_per_week over complete Monday-to-Sunday weeks, cadence_defaulted.

    Weeks start at the first Monday on or after the first session and end on or before the last one; under two of
    them, or without sessions in them, the default stands.
    """
    ends = daily.groupBy("log_id").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    monday = F.date_add("a", (7 - F.weekday("a")) % 7)
    ends = ends.withColumn("from", monday).withColumn("weeks", F.floor((F.datediff("b", "from") + 1) / 7))
    n = daily.select("log_id", "session_date").join(ends, "log_id").where((F.col("session_date") >= F.col("from")) & (F.col("session_date") < F.date_add("from", (F.col("weeks") * 7).cast("int"))))
    n = n.groupBy("log_id").agg(F.count("*").alias("k"))
    e = ends.join(n, "log_id", "left")
    ok = (F.col("weeks") >= 2) & (F.coalesce("k", F.lit(0)) > 0)
    spw = F.when(ok, F.least(F.lit(7.0), F.col("k") / F.col("weeks"))).otherwise(F.lit(DEFAULT_CADENCE))
    return e.select("log_id", spw.alias("sessions_per_week"), (~ok).alias("cadence_defaulted"))


def _by_sign(x: Column) -> Column:
    return F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF)).otherwise(F.lit(0.0))


def full(trades: DataFrame, boundary: Boundary = CME, equity: float = EQUITY) -> DataFrame:
    """The whole record of each log, the bootstrap excepted (resample.bootstrap_mean adds it)."""
    pnl = F.col("pnl")
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("pnl"), "trade_seq"))
    top = trades.select("log_id", "pnl", rank.alias("r")).where("r <= 5").groupBy("log_id").agg(F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("top5"))
    t = trades.groupBy("log_id").agg(
        F.count("*").alias("n"),
        F.sum(pnl).alias("net"),
        F.avg(pnl).alias("mean"),
        F.coalesce(F.stddev_samp(pnl), F.lit(0.0)).alias("sd"),
        F.count_if(pnl > 0).alias("wins"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gp"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("gl"),
        F.coalesce(F.avg(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("aw"),
        F.coalesce(F.avg(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("al"),
        F.coalesce(F.min(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("worst"),
    )
    d = days(trades, boundary)
    r = F.col("day_pnl") / equity
    day = d.groupBy("log_id").agg(
        F.count("*").alias("k"),
        F.max("day_pnl").alias("best_day"),
        F.min("day_pnl").alias("worst_day"),
        F.coalesce(F.stddev_samp("day_pnl"), F.lit(0.0)).alias("dsd"),
        F.avg(r).alias("rm"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("down"),
    )
    j = t.join(day, "log_id").join(path(d), "log_id").join(cadence(d), "log_id").join(top, "log_id")
    periods = F.lit(float(YEAR_DAYS)) * F.col("sessions_per_week") / 5.0
    j = j.withColumn("periods", periods).withColumn("annual", F.col("net") / equity / (F.col("k") / F.col("periods")))
    flat = F.col("best_day") == F.col("worst_day")

    def annualised(den: Column) -> Column:
        safe = F.when(den != 0, den)
        x = F.when(den == 0, _by_sign(F.col("rm"))).otherwise(F.col("rm") / safe * F.sqrt("periods"))
        return F.when(F.col("k") < 2, F.lit(0.0)).otherwise(x)

    edge = F.when(F.col("wins") > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return j.select(
        "log_id",
        F.col("n").alias("trade_count"),
        F.col("net").alias("net_profit"),
        (F.col("wins") / F.col("n")).alias("win_rate"),
        F.col("aw").alias("avg_win"),
        F.col("al").alias("avg_loss"),
        ratio(F.col("aw"), F.abs("al"), edge).alias("payoff_ratio"),
        F.col("mean").alias("expectancy"),
        ratio(F.col("mean"), F.abs("al"), edge).alias("expectancy_r"),
        ratio(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("expectancy_tstat"),
        profit_factor(F.col("gp"), F.col("gl")).alias("profit_factor"),
        "max_drawdown",
        (F.col("max_drawdown") / equity).alias("max_drawdown_pct"),
        annualised(F.when(flat, 0.0).otherwise(F.col("dsd") / equity)).alias("sharpe"),
        annualised(F.col("down")).alias("sortino"),
        F.when(F.col("max_drawdown") > 0, F.col("annual") / F.when(F.col("max_drawdown") > 0, F.col("max_drawdown") / equity)).when(F.col("annual") > 0, INF).otherwise(0.0).alias("mar"),
        "longest_losing_streak",
        "best_day",
        F.when(F.col("net") > 0, F.col("best_day") / F.when(F.col("net") > 0, F.col("net"))).otherwise(0.0).alias("best_day_share"),
        ratio(F.col("top5"), F.col("gp")).alias("top5_trade_share"),
        F.col("k").alias("trading_days"),
        F.col("dsd").alias("daily_pnl_std"),
        F.col("sd").alias("per_trade_pnl_std"),
        "sessions_per_week",
        "cadence_defaulted",
        ratio(F.abs("worst"), F.abs("al")).alias("worst_over_avg_loss"),
    )


def fidelity(trades: DataFrame, boundary: Boundary = CME) -> DataFrame:
    """Per log: what excursions it carries, cross-session trades, overlaps, greatest quantity, fee coverage."""
    full_row = F.col("mae").isNotNull() & F.col("mfe").isNotNull()
    some = F.col("mae").isNotNull() | F.col("mfe").isNotNull()
    before = Window.partitionBy("log_id").orderBy("entry_time", "trade_seq").rowsBetween(Window.unboundedPreceding, -1)
    t = trades.withColumn("over", F.col("entry_time") < F.max("exit_time").over(before))
    return t.groupBy("log_id").agg(
        F.when(F.bool_and(full_row), "full").when(F.bool_or(some), "partial").otherwise("close-only").alias("fidelity"),
        F.count_if(boundary.date("entry_time") != boundary.date("exit_time")).alias("cross_session"),
        F.coalesce(F.bool_or("over"), F.lit(False)).alias("overlapping"),
        F.max(F.abs("quantity")).alias("max_quantity"),
        F.bool_and(F.col("fees") == 0).alias("no_fees"),
        F.bool_or(F.col("fees") == 0).alias("some_without_fees"),
    )


def peak_exposure(trades: DataFrame, units: Column | None = None) -> DataFrame:
    """Per log: the greatest quantity open at once, entries before exits at equal times."""
    q = units if units is not None else F.abs("quantity")
    e = trades.select("log_id", "trade_seq", F.explode(F.array(F.struct(F.col("entry_time").alias("ts"), F.lit(0).alias("kind"), q.alias("q")), F.struct(F.col("exit_time").alias("ts"), F.lit(1).alias("kind"), (-q).alias("q")))).alias("e"))
    w = Window.partitionBy("log_id").orderBy("e.ts", "e.kind", "trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("open", F.sum("e.q").over(w)).groupBy("log_id").agg(F.max("open").alias("peak_exposure"))


def symbol_months(trades: DataFrame) -> DataFrame:
    """Per log: number of symbol-months, the best one and its pnl."""
    m = trades.groupBy("log_id", "symbol", F.date_format("exit_time", "yyyy-MM").alias("month")).agg(F.sum("pnl").alias("pnl"), F.min("trade_seq").alias("first"))
    best = F.max_by(F.struct("symbol", "month", "pnl"), F.struct(F.col("pnl"), -F.col("first")))
    g = m.groupBy("log_id").agg(F.count("*").alias("buckets"), best.alias("b"))
    return g.select("log_id", "buckets", F.col("b.symbol").alias("symbol"), F.col("b.month").alias("month"), F.col("b.pnl").alias("best_pnl"))


def exposure_advice(trades: DataFrame, limit: float, units: Column | None = None) -> DataFrame:
    """Per log: peak exposure against a contract limit; advice only, nothing is enforced by it."""
    p = peak_exposure(trades, units)
    return p.withColumn("contract_limit", F.lit(float(limit))).withColumn("exceeds", F.col("peak_exposure") > limit)


def dominant_symbol(trades: DataFrame) -> DataFrame:
    """Per log: the symbol with most trades; of several, the one that comes first."""
    n = trades.groupBy("log_id", "symbol").agg(F.count("*").alias("n"), F.min("trade_seq").alias("first"))
    return n.groupBy("log_id").agg(F.max_by("symbol", F.struct("n", -F.col("first"))).alias("symbol"), F.max("n").alias("n_trades"))
