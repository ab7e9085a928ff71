"""The evaluation phase without balance feedback as a pure window plan, draws included.

Draws are a function of MD5 keys, so any engine gives the same paths; running sums and maxima give balances, floors
and best days; the first breach and the first pass are minima. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stress import uniform


@dataclass(frozen=True)
class Limits:
    start: float = 50_000.0
    target: float = 3_000.0
    trail: float = 2_000.0
    cap: float = 50_000.0
    raise_frac: float = 0.5
    min_days: int = 0


def draws(daily: DataFrame, paths: int, horizon: int, block: float, seed: int) -> DataFrame:
    """(log_id, path_id, t, day_idx): a stationary block bootstrap; a block goes on to the next day and wraps around."""
    n = daily.groupBy("log_id").agg(F.count("*").alias("n"))
    g = n.select("log_id", "n", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path_id")).select("log_id", "n", "path_id", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("t"))
    fresh = (F.col("t") == 0) | (uniform(seed, F.lit("b"), "log_id", "path_id", "t") < 1.0 / block)
    g = g.withColumn("s", F.when(fresh, F.floor(uniform(seed, F.lit("d"), "log_id", "path_id", "t") * F.col("n"))))
    w = Window.partitionBy("log_id", "path_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    since = F.max(F.when(F.col("s").isNotNull(), F.col("t"))).over(w)
    day = (F.last("s", ignorenulls=True).over(w) + F.col("t") - since) % F.col("n")
    return g.select("log_id", F.col("path_id").cast("bigint").alias("path_id"), F.col("t").cast("bigint").alias("t"), day.cast("bigint").alias("day_idx"))


def evaluate_days(daily: DataFrame, paths: DataFrame, r: Limits) -> DataFrame:
    """Per log: paths that pass, breach or stay active, and the mean day of passing; day closes only.

    One exchange by (log, path) serves every window. The days of a log are few against the paths' rows, so Spark
    broadcasts or co-partitions them as their size asks.
    """
    d = paths.join(daily.select("log_id", "day_idx", F.round("day_pnl", 4).alias("p"), F.round("lo", 4).alias("lo")), ["log_id", "day_idx"])
    w = Window.partitionBy("log_id", "path_id").orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("bal", F.round(r.start + F.sum("p").over(upto), 4))
    hwm = F.greatest(F.lit(r.start), F.coalesce(F.max("bal").over(before), F.lit(r.start)))
    floor = F.least(hwm - r.trail, F.lit(r.cap))
    best = F.greatest(F.lit(0.0), F.max("p").over(upto))
    d = d.withColumn("hit", F.round(F.col("bal") - F.col("p") + F.col("lo"), 4) <= floor).withColumn("best", best)
    need = F.when(F.col("best") > r.raise_frac * r.target, F.col("best") / r.raise_frac).otherwise(r.target)
    ok = (F.col("bal") - r.start >= need) & (F.col("t") + 1 >= r.min_days)
    first = d.groupBy("log_id", "path_id").agg(F.min(F.when(F.col("hit"), F.col("t"))).alias("b"), F.min(F.when(ok, F.col("t"))).alias("a"))
    passed = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") < F.col("b")))
    return first.groupBy("log_id").agg(
        F.count("*").alias("n_paths"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed & F.col("b").isNotNull()).alias("breached"),
        F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("active"),
        F.avg(F.when(passed, (F.col("a") + 1).cast("double"))).alias("mean_days_to_pass"),
    )


from .tables import TRADES_LI_SQL  # noqa: E402

_U = "(('0x' || substr(md5({k}), 1, 8))::bigint / 4294967296.0)"


def _draws_sql(paths: int, horizon: int) -> str:
    b, d = (_U.format(k=f"'42|{x}|' || log_id || '|' || path_id || '|' || t") for x in "bd")
    return (
        "with " + TRADES_LI_SQL + f""", r0 as (select log_id, session_date, trade_seq, sum(pnl) over (partition by log_id, session_date order by trade_seq rows unbounded preceding) as run, pnl from trades_li),
daily as (select log_id, session_date, round(sum(pnl), 4) as p, round(least(0, min(run)), 4) as lo, row_number() over (partition by log_id order by session_date) - 1 as day_idx from r0 group by log_id, session_date),
n as (select log_id, count(*) as n from daily group by log_id), g as (select log_id, n, path_id, unnest(range(0, {horizon})) as t from (select log_id, n, unnest(range(0, {paths})) as path_id from n)),
s as (select *, case when t = 0 or {b} < 0.2 then floor({d} * n)::bigint end as s from g),
draws as (select log_id, path_id, t, (last_value(s ignore nulls) over w + t - max(case when s is not null then t end) over w) % n as day_idx from s window w as (partition by log_id, path_id order by t rows unbounded preceding))"""
    )


DRAWS_SQL = _draws_sql(20, 40) + " select log_id, path_id, t, day_idx from draws"
PHASE_SQL = (
    _draws_sql(200, 60)
    + """, x as (select d.log_id, path_id, t, p, lo, round(50000 + sum(p) over (partition by d.log_id, path_id order by t rows unbounded preceding), 4) as bal from draws d join daily using (log_id, day_idx)),
y as (select *, greatest(50000, coalesce(max(bal) over (partition by log_id, path_id order by t rows between unbounded preceding and 1 preceding), 50000)) as hwm, greatest(0, max(p) over (partition by log_id, path_id order by t rows unbounded preceding)) as best from x),
f as (select log_id, path_id, min(t) filter (round(bal - p + lo, 4) <= least(hwm - 2000, 50000)) as b, min(t) filter (bal - 50000 >= case when best > 1500 then best / 0.5 else 3000 end) as a from y group by log_id, path_id),
z as (select *, a is not null and (b is null or a < b) as ok from f)
select log_id, count(*) as n_paths, count(*) filter (ok) as passed, count(*) filter (not ok and b is not null) as breached, count(*) filter (a is null and b is null) as active, round(avg(a + 1) filter (ok), 4) as mean_days_to_pass from z group by log_id"""
)
