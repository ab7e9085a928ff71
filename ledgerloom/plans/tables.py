"""Test tables as trade logs, bars, marks and variants: the same expressions stand in oracle SQL (tables_sql)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import sequenced
from ..session import pin

LI_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trades_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten logs with a long daily history."""
    l = _read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    exit_s = F.unix_seconds("l_shipdate") + 60 * (810 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 360)
    pnl = F.round((F.col("l_discount") - 0.049) * F.col("l_extendedprice") * 0.05, 2)
    t = l.select(
        (F.col("l_suppkey") % 10).alias("log_id"),
        F.timestamp_seconds(exit_s - 60 * (5 + F.col("l_orderkey") % 55)).alias("entry_time"),
        F.timestamp_seconds(exit_s).alias("exit_time"),
        F.element_at(F.array(*map(F.lit, ("MNQ", "MES", "NQ", "ES"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("symbol"),
        F.when(F.col("l_returnflag") != "R", "long").otherwise("short").alias("side"),
        (1 + F.col("l_partkey") % 3).cast("double").alias("quantity"),
        pnl.alias("pnl"),
        F.lit(None).cast("double").alias("entry_price"),
        F.lit(None).cast("double").alias("exit_price"),
        F.round(F.col("l_tax") * 10, 2).alias("fees"),
        F.when(F.col("l_linenumber") % 7 != 0, F.round(F.least(pnl, F.lit(0.0)) - F.col("l_quantity"), 2)).alias("mae"),
        F.when((F.col("l_linenumber") % 5 != 0) & (F.col("l_linenumber") % 7 != 0), F.round(F.greatest(pnl, F.lit(0.0)) + 0.8 * F.col("l_quantity"), 2)).alias("mfe"),
        *LI_TIES,
    )
    return sequenced(t, *LI_TIES).drop(*LI_TIES)


def trades_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small intraday logs over all hours."""
    e = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = e.select(
        F.col("user_id").alias("log_id"),
        (F.col("ts") - F.make_interval(mins=(1 + F.col("event_id") % 90).cast("int"))).alias("entry_time"),
        F.col("ts").alias("exit_time"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("side"),
        (1 + F.col("event_id") % 3).cast("double").alias("quantity"),
        F.round(F.col("value") - 49.0, 2).alias("pnl"),
        F.lit(None).cast("double").alias("entry_price"),
        F.lit(None).cast("double").alias("exit_price"),
        F.lit(0.0).alias("fees"),
        F.lit(None).cast("double").alias("mae"),
        F.lit(None).cast("double").alias("mfe"),
        "event_id",
    )
    return sequenced(t, "event_id").drop("event_id")


def bars_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem prices."""
    l = _read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    exit_s = F.unix_seconds("l_shipdate") + 60 * (810 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 360)
    place = F.struct(exit_s.alias("s"), (-(F.col("l_orderkey") % 55)).alias("e"), *[F.col(c) for c in LI_TIES])
    p = F.col("l_extendedprice")
    g = l.groupBy(F.col("l_shipdate").alias("datetime"))
    return g.agg(F.min_by(p, place).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, place).alias("close"), F.sum("l_quantity").alias("volume"))


def variants_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, variant, pnl): a brand a variant, missing days 0."""
    l = _read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    p = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("variant"))
    pnl = F.round((F.col("l_discount") - 0.049) * F.col("l_extendedprice") * 0.05, 2)
    d = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy(F.to_date("l_shipdate").alias("day"), "variant").agg(F.sum(pnl).alias("pnl"))
    grid = d.select("day").distinct().crossJoin(F.broadcast(d.select("variant").distinct()))  # days x variants is the matrix itself
    return grid.join(d, ["day", "variant"], "left").select("day", "variant", F.round(F.coalesce("pnl", F.lit(0.0)), 2).alias("pnl"))


def marks_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, ts, ordinal, equity): running account marks a user."""
    e = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("log_id"), "ts", F.col("event_id").alias("ordinal"), F.round(50000 + F.sum(F.col("value") - 49).over(w), 2).alias("equity"))


# --- the same in SQL, for oracles -----------------------------------------------------------

TRADES_LI_SQL = """
li as (
  select *, l_shipdate::timestamp + to_minutes(810 + (l_orderkey * 7 + l_linenumber * 13) % 360) as exit_time,
         round((l_discount - 0.049) * l_extendedprice * 0.05, 2) as pnl
  from lineitem
), trades_li as (
  select l_suppkey % 10 as log_id, exit_time - to_minutes(5 + l_orderkey % 55) as entry_time, exit_time,
         ['MNQ', 'MES', 'NQ', 'ES'][l_linenumber % 4 + 1] as symbol,
         case when l_returnflag <> 'R' then 'long' else 'short' end as side,
         (1 + l_partkey % 3)::double as quantity, pnl, round(l_tax * 10, 2) as fees,
         case when l_linenumber % 7 <> 0 then round(least(pnl, 0) - l_quantity, 2) end as mae,
         case when l_linenumber % 5 <> 0 and l_linenumber % 7 <> 0 then round(greatest(pnl, 0) + 0.8 * l_quantity, 2) end as mfe,
         l_shipdate::date as session_date,
         row_number() over (partition by l_suppkey % 10 order by exit_time, exit_time - to_minutes(5 + l_orderkey % 55),
                            l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as trade_seq
  from li
)"""

TRADES_EV_SQL = """
trades_ev as (
  select user_id as log_id, ts - to_minutes(1 + event_id % 90) as entry_time, ts as exit_time, event_type as symbol,
         (1 + event_id % 3)::double as quantity, round(value - 49.0, 2) as pnl,
         row_number() over (partition by user_id order by ts, ts - to_minutes(1 + event_id % 90), event_id) as trade_seq,
         (timezone('America/Chicago', timezone('UTC', ts)) + interval 7 hours)::date as session_date,
         (timezone('America/Chicago', timezone('UTC', ts - to_minutes(1 + event_id % 90))) + interval 7 hours)::date as entry_session
  from events
)"""
