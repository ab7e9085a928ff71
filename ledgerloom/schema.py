"""The trade table: one row a closed round trip, many logs at once by log_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TRADES = T.StructType(
    [
        T.StructField("log_id", T.LongType(), False),
        T.StructField("trade_seq", T.LongType(), False),
        T.StructField("entry_time", T.TimestampType(), False),
        T.StructField("exit_time", T.TimestampType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("side", T.StringType(), False),
        T.StructField("quantity", T.DoubleType(), False),
        T.StructField("pnl", T.DoubleType(), False),
        T.StructField("entry_price", T.DoubleType(), True),
        T.StructField("exit_price", T.DoubleType(), True),
        T.StructField("fees", T.DoubleType(), False),
        T.StructField("mae", T.DoubleType(), True),
        T.StructField("mfe", T.DoubleType(), True),
    ]
)
LOGS = "log_id bigint, account_currency string, source string, schema_version int"
SCHEMA_VERSION = 1


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def reject_reason() -> Column:
    """Why a row is not a trade, null if it is one; the first reason in this order."""
    optional = lambda c: F.col(c).isNull() | finite(F.col(c))
    return (
        F.when(F.col("entry_time").isNull() | F.col("exit_time").isNull(), "bad timestamp")
        .when(F.col("entry_time") > F.col("exit_time"), "entry after exit")
        .when(F.trim(F.coalesce("symbol", F.lit(""))) == "", "blank symbol")
        .when(~F.coalesce(F.col("side").isin("long", "short"), F.lit(False)), "bad side")
        .when(~finite(F.col("pnl")), "bad pnl")
        .when(~finite(F.col("quantity")) | (F.col("quantity") <= 0), "bad quantity")
        .when(~finite(F.col("fees")), "bad fees")
        .when(~optional("entry_price") | ~optional("exit_price"), "bad price")
        .when(~optional("mae") | (F.col("mae") > 0), "mae above zero")
        .when(~optional("mfe") | (F.col("mfe") < 0), "mfe below zero")
    )


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, rejects with reason): no row is lost."""
    r = rows.withColumn("reason", reject_reason())
    return r.where("reason is null").drop("reason"), r.where("reason is not null")


def sequenced(trades: DataFrame, *ties: str) -> DataFrame:
    """trades with trade_seq, the order of each log by exit, entry and the given ties. The one place that sorts a log."""
    w = Window.partitionBy("log_id").orderBy("exit_time", "entry_time", *ties)
    return trades.withColumn("trade_seq", F.row_number().over(w).cast("bigint"))
