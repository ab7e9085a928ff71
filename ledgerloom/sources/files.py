"""Readers and writers: messy CSV and JSON exports in, canonical Parquet out. Every bad row comes back with a reason."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import IngestError
from ..functions.money import parse_money
from ..functions.timestamps import DATE_ONLY, FORMATS, TIME_ONLY, is_naive, joined, parse_instant, pattern
from ..schema import LOGS, SCHEMA_VERSION, TRADES, finite, sequenced, split_valid
from ..session import pin
from . import mapping as MP


@dataclass
class Ingested:
    rows: DataFrame
    rejects: DataFrame
    columns: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    d = pin(spark).read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    if not d.columns:
        raise IngestError(f"{path} is empty")
    d = d.toDF(*[c.strip() for c in d.columns])
    order = Window.orderBy(F.monotonically_increasing_id())  # a file's own order; a log file is one small file
    return d.withColumn("_row", F.row_number().over(order) - 1)


def _sample(d: DataFrame, c: str) -> list[str]:
    return [r[0].strip() for r in d.where(F.col(f"`{c}`").isNotNull()).select(f"`{c}`").limit(20).collect()]


def _companion(headers: list[str], but: str, words: tuple[str, ...]) -> str | None:
    by = {}
    for h in headers:
        by.setdefault(MP.normalise(h), h)
    return next((by[w] for w in words if w in by and by[w] != but), None)


def _time_text(d: DataFrame, column: str, prefix: str = "") -> tuple[Column, str]:
    """The text of a time column, with the date or time column beside it where it holds one of the two only."""
    import re

    v, headers = _sample(d, column), d.columns
    c = F.col(f"`{column}`")
    if v and all(re.match(TIME_ONLY, x) for x in v):
        date = _companion(headers, column, tuple(prefix + w for w in ("date", "tradedate", "tradeday", "day")) + ("date", "tradedate", "tradeday", "day"))
        if date is None:
            raise IngestError(f"column {column!r} holds times of day only, and no date column stands beside it")
        return joined(F.col(f"`{date}`"), c), f"{date} + {column}"
    if v and all(re.match(DATE_ONLY, x) for x in v):
        time = _companion(headers, column, tuple(prefix + w for w in ("time",)) + ("time", "bartime", "timeofday"))
        t = _sample(d, time) if time else []
        if t and all(re.match(TIME_ONLY, x) for x in t):
            return joined(c, F.col(f"`{time}`")), f"{column} + {time}"
    return c, column


def read_trades_csv(spark: SparkSession, path: str, mapping: dict | MP.Mapping | None = None, log_id: int = 0) -> Ingested:
    """Trades of one CSV file: rows of the canonical schema, rejects with row number and reason."""
    d = _csv(spark, path)
    headers = [c for c in d.columns if c != "_row"]
    m = mapping.check(headers) if isinstance(mapping, MP.Mapping) else MP.detect(headers, mapping)
    tz = m.tz or "UTC"
    try:
        from zoneinfo import ZoneInfo

        ZoneInfo(tz)
    except Exception:
        raise IngestError(f"unknown time zone {tz!r}") from None
    col = lambda f: F.col(f"`{getattr(m, f)}`") if getattr(m, f) else None
    exit_text, shown = _time_text(d, m.exit_time, "exit")
    formats = (pattern(m.datetime_format),) if m.datetime_format else FORMATS
    exit_ = parse_instant(exit_text, tz, formats)
    entry = parse_instant(_time_text(d, m.entry_time, "entry")[0], tz, formats) if m.entry_time else exit_
    qty = parse_money(col("quantity")) if m.quantity else F.lit(1.0)
    if m.side:
        word = F.lower(F.trim(col("side")))
        side = F.when(word.isin(*m.long_values), "long").when(word.isin(*m.short_values), "short")
    else:
        side = F.when(qty < 0, "short").otherwise("long")
    optional = lambda f: parse_money(col(f)) if getattr(m, f) else F.lit(None).cast("double")
    unread = lambda f: (col(f).isNotNull() & parse_money(col(f)).isNull()) if getattr(m, f) else F.lit(False)
    rows = d.select(
        "_row", F.lit(log_id).cast("bigint").alias("log_id"), entry.alias("entry_time"), exit_.alias("exit_time"),
        (F.trim(col("symbol")) if m.symbol else F.lit(m.default_symbol)).alias("symbol"), side.alias("side"), F.abs(qty).alias("quantity"),
        parse_money(col("pnl")).alias("pnl"), optional("entry_price").alias("entry_price"), optional("exit_price").alias("exit_price"),
        (F.when(col("fees").isNull(), 0.0).otherwise(parse_money(col("fees"))) if m.fees else F.lit(0.0)).alias("fees"),
        (-F.abs(optional("mae"))).alias("mae"), F.abs(optional("mfe")).alias("mfe"),
        F.greatest(*[unread(f) for f in ("entry_price", "exit_price", "mae", "mfe")]).alias("_bad"),
    )
    good, bad = split_valid(rows)
    odd = good.where("_bad").withColumn("reason", F.lit("unreadable number"))
    bad = bad.unionByName(odd).select(F.col("_row").alias("row"), "reason")
    good = sequenced(good.where("not _bad"), "_row")
    warnings = []
    if m.tz is None:
        n = d.where(exit_text.isNotNull() & is_naive(exit_text)).count()
        if n:
            warnings.append(f"{n} time(s) without a zone were read as UTC; name the zone if they are local")
    if not m.side and m.quantity and (n := good.where("side = 'short'").count()):
        warnings.append(f"{n} short trade(s) told by negative quantity")
    if good.isEmpty():
        raise IngestError(f"no trade could be read from {path}; first reason: {(bad.first() or ['', 'no rows'])[1]}")
    return Ingested(good.select(*TRADES.names), bad, m.columns() | {"exit_time": shown}, warnings)


def read_bars_csv(spark: SparkSession, path: str, tz: str = "UTC") -> Ingested:
    """Bars (datetime, open, high, low, close, volume), one a timestamp; conflicting repeats are refused."""
    d = _csv(spark, path)
    by: dict[str, str] = {}
    for h in d.columns:
        by.setdefault(MP.normalise(h), h)
    cols = {f: next((by[w] for w in ws if w in by), None) for f, ws in MP.BAR_SYNONYMS.items()}
    missing = [f for f, c in cols.items() if c is None and f != "volume"]
    if missing:
        raise IngestError(f"no column for {', '.join(missing)} in {path}")
    text, shown = _time_text(d, cols["datetime"])
    num = lambda f: F.col(f"`{cols[f]}`").try_cast("double") if cols[f] else F.lit(0.0)
    b = d.select(F.col("_row").alias("row"), parse_instant(text, tz).alias("datetime"), *[num(f).alias(f) for f in ("open", "high", "low", "close", "volume")])
    price = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    reason = (
        F.when(F.col("datetime").isNull(), "time can't be read, or the zone has it twice or not at all")
        .when(~(price("open") & price("high") & price("low") & price("close")), "prices must be positive numbers")
        .when(~(finite(F.col("volume")) & (F.col("volume") >= 0)), "volume must be a number from 0 on")
        .when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), "high and low must hold open and close")
    )
    b = b.withColumn("reason", reason)
    good, bad = b.where("reason is null"), b.where("reason is not null").select("row", "reason")
    clash = good.groupBy("datetime").agg(F.countDistinct(F.struct("open", "high", "low", "close", "volume")).alias("n")).where("n > 1").first()
    if clash:
        raise IngestError(f"different bars at {clash[0]}")
    if good.isEmpty():
        raise IngestError(f"no bar could be read from {path}")
    kept = good.dropDuplicates(["datetime"]).select("datetime", "open", "high", "low", "close", "volume")
    return Ingested(kept, bad, {k: v for k, v in cols.items() if v} | {"datetime": shown})


def weekday_gaps(bars: DataFrame, at: str = "datetime") -> DataFrame:
    """Weekdays without a bar between the first and the last one."""
    days = bars.select(F.to_date(at).alias("day")).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return span.join(days, "day", "left_anti")


def write_bars_csv(bars: DataFrame, path: str) -> None:
    bars.orderBy("datetime").select(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "open", "high", "low", "close", "volume").coalesce(1).write.option("header", True).csv(path)


def read_marks_csv(spark: SparkSession, path: str, log_id: int = 0) -> DataFrame:
    """Equity marks (log_id, ts, ordinal, equity); rows that can't be read are left out."""
    d = _csv(spark, path)
    by = {c.lower(): c for c in d.columns}
    if "datetime" not in by or "equity" not in by:
        raise IngestError(f"{path} needs the columns datetime and equity")
    m = d.select(F.lit(log_id).cast("bigint").alias("log_id"), parse_instant(by["datetime"]).alias("ts"), F.col("_row").cast("bigint").alias("ordinal"), F.col(by["equity"]).try_cast("double").alias("equity"))
    return m.where(F.col("ts").isNotNull() & finite(F.col("equity")))


def last_marks(marks: DataFrame) -> DataFrame:
    """One mark a log and instant, the last one given."""
    return marks.groupBy("log_id", "ts").agg(F.max_by("equity", "ordinal").alias("equity"), F.max("ordinal").alias("ordinal"))


def daily_marks(marks: DataFrame) -> DataFrame:
    """The last mark of each log and UTC day; days without marks are left out."""
    return marks.groupBy("log_id", F.to_date("ts").alias("day")).agg(F.max_by("equity", F.struct("ts", "ordinal")).alias("equity"))


def _looks_like_index(d: DataFrame, c: str) -> bool:
    """Whether a first column counts or dates the rows: by name, by not being numeric, by being 0.. or 1.., rising dates or epochs."""
    if MP.normalise(c) in ("", "index", "date", "day", "time", "datetime", "timestamp", "unnamed0", "c0"):
        return True
    w = Window.orderBy("_row")
    v = d.select("_row", F.col(f"`{c}`").try_cast("double").alias("v"))
    s = v.withColumn("step", F.col("v") - F.lag("v").over(w)).agg(F.count("*").alias("n"), F.count("v").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("step").alias("a"), F.max("step").alias("b")).first()
    if s["k"] < s["n"]:
        return True
    if s["a"] == s["b"] == 1 and s["lo"] in (0, 1):
        return True
    return bool(s["a"] and s["a"] > 0 and (19000101 <= s["lo"] and s["hi"] <= 21001231 or s["lo"] > 1e8))


def read_variants_csv(spark: SparkSession, path: str) -> DataFrame:
    """(day, variant, pnl) of a CSV with one column a variant and one row a day; an index column in front is told and dropped."""
    d = _csv(spark, path)
    names = [c for c in d.columns if c != "_row"]
    if _looks_like_index(d, names[0]):
        names = names[1:]
    long = d.select(F.col("_row").alias("day"), F.explode(F.array(*[F.struct(F.lit(c).alias("variant"), F.col(f"`{c}`").try_cast("double").alias("pnl")) for c in names])).alias("x")).select("day", "x.variant", "x.pnl")
    if long.where(~finite(F.col("pnl"))).limit(1).count():
        raise IngestError(f"{path} holds values that are not finite numbers")
    same = long.groupBy("variant").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("day", "pnl")))).alias("h"), F.stddev_pop("pnl").alias("s"))
    r = same.agg(F.count("*"), F.countDistinct("h"), F.max("s")).first()
    if r[0] < 2 or r[1] < 2 or not r[2]:
        raise IngestError("overfitting needs two different variants that vary")
    return long


# --- backtest results -------------------------------------------------------------------------------


def read_result_trades(spark: SparkSession, path: str, log_id: int = 0) -> Ingested:
    """Closed trades of a backtest result: net is profitLoss less totalFees; direction 0 is long, 1 short."""
    d = _result(spark, path)
    perf = _field(d.schema, "totalperformance")
    if perf is None:
        raise IngestError(f"{path} holds no totalPerformance")
    kind = next(f.dataType for f in d.schema if f.name == perf)
    trades = _field(kind, "closedtrades")
    if trades is None:
        raise IngestError(f"{path} holds no closed trades")
    x = d.select(F.posexplode(f"`{perf}`.`{trades}`").alias("row", "t"))
    t = x.schema["t"].dataType
    name = {f.name.lower(): f for f in t}
    get = lambda k: F.col(f"t.`{name[k].name}`") if k in name else F.lit(None).cast("string")
    symbol = F.lit(None).cast("string")
    if "symbol" in name:
        s = name["symbol"].dataType
        if hasattr(s, "fields"):
            inner = {f.name.lower(): f.name for f in s}
            symbol = F.coalesce(*[F.col(f"t.`{name['symbol'].name}`.`{inner[k]}`").cast("string") for k in ("value", "permtick", "id") if k in inner])
        else:
            symbol = get("symbol").cast("string")
    elif "symbols" in name:
        e = name["symbols"].dataType.elementType
        first = F.get(F.col(f"t.`{name['symbols'].name}`"), F.lit(0))
        symbol = F.coalesce(*[first[f.name].cast("string") for f in e if f.name.lower() in ("value", "permtick", "id")]) if hasattr(e, "fields") else first
    num = lambda k: get(k).try_cast("double")
    direction = get("direction").cast("string")
    rows = x.select(
        "row", F.lit(log_id).cast("bigint").alias("log_id"), parse_instant(get("entrytime").cast("string")).alias("entry_time"), parse_instant(get("exittime").cast("string")).alias("exit_time"),
        symbol.alias("symbol"), F.when(F.lower(direction).isin("0", "long"), "long").when(F.lower(direction).isin("1", "short"), "short").alias("side"),
        F.abs(num("quantity")).alias("quantity"), (num("profitloss") - F.coalesce(num("totalfees"), F.lit(0.0))).alias("pnl"),
        num("entryprice").alias("entry_price"), num("exitprice").alias("exit_price"), F.coalesce(num("totalfees"), F.lit(0.0)).alias("fees"),
        (-F.abs(num("mae"))).alias("mae"), F.abs(num("mfe")).alias("mfe"),
    )
    good, bad = split_valid(rows)
    return Ingested(sequenced(good, "row").select(*TRADES.names), bad.select("row", "reason"))


def _result(spark: SparkSession, path: str) -> DataFrame:
    d = pin(spark).read.option("multiLine", True).option("allowNonNumericNumbers", False).option("mode", "FAILFAST").json(path)
    for wrap in ("backtest", "result", "results"):
        inner = _field(d.schema, wrap)
        if inner and _field(d.schema, "totalperformance") is None and hasattr(d.schema[inner].dataType, "fields"):
            d = d.select(f"`{inner}`.*")
    return d


def _field(schema, name: str) -> str | None:
    return next((f.name for f in schema if f.name.lower() == name), None)


def read_result_equity(spark: SparkSession, path: str, log_id: int = 0, chart: str = "Strategy Equity", series: str = "Equity") -> DataFrame:
    """Marks of a result's equity chart. Points are [time, value], [time, open, high, low, close] or {x, y}; seconds or milliseconds."""
    text = "".join(r[0] for r in pin(spark).read.text(path, wholetext=True).collect())  # one result document
    try:
        doc = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(IngestError(f"{path} holds {c}")))
    except ValueError as e:
        raise IngestError(f"{path} is not JSON: {e}") from None

    def low(x, *keys):
        for k in keys:
            x = next((v for n, v in x.items() if n.lower() == k.lower()), None) if isinstance(x, dict) else None
        return x

    doc = next((low(doc, w) for w in ("backtest", "result") if low(doc, w) and not low(doc, "charts")), doc)
    rows = []
    for i, p in enumerate(low(doc, "charts", chart, "series", series, "values") or []):
        t, v = (low(p, "x"), low(p, "y")) if isinstance(p, dict) else (p[0], p[4] if len(p) >= 5 else p[1])
        if t is None or v is None or not math.isfinite(float(v)):
            continue
        t = float(t)
        rows.append((log_id, t / 1000 if t >= 1e11 else t, i, float(v)))
    m = spark.createDataFrame(rows, "log_id bigint, s double, ordinal bigint, equity double")
    return last_marks(m.select("log_id", F.timestamp_seconds("s").alias("ts"), "ordinal", "equity"))


# --- canonical Parquet ----------------------------------------------------------------------------------


def write_log(trades: DataFrame, path: str, currency: str = "USD", source: str = "csv") -> None:
    """Trades under path/trades, one row a log under path/logs; each write is committed as a whole."""
    trades.select(*TRADES.names).write.mode("overwrite").parquet(f"{path}/trades")
    trades.select("log_id").distinct().select("log_id", F.lit(currency).alias("account_currency"), F.lit(source).alias("source"), F.lit(SCHEMA_VERSION).alias("schema_version")).write.mode("overwrite").parquet(f"{path}/logs")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Trades written by write_log; optional columns that are missing are null, newer versions are refused."""
    logs = pin(spark).read.schema(LOGS).parquet(f"{path}/logs")
    new = logs.agg(F.max("schema_version")).first()[0]
    if new is not None and new > SCHEMA_VERSION:
        raise IngestError(f"{path} is of version {new}; this reads up to {SCHEMA_VERSION}")
    d = spark.read.parquet(f"{path}/trades")
    missing = [f.name for f in TRADES if f.name not in d.columns and not f.nullable and f.name not in ("fees", "log_id", "trade_seq")]
    if missing:
        raise IngestError(f"{path} lacks {', '.join(missing)}")
    for f in TRADES:
        if f.name not in d.columns and f.name != "trade_seq":
            d = d.withColumn(f.name, F.lit(0 if f.name in ("fees", "log_id") else None).cast(f.dataType))
    if "trade_seq" not in d.columns:
        d = sequenced(d, "symbol", "pnl", "quantity")
    return d.select(*[F.col(f.name).cast(f.dataType) for f in TRADES])


# --- synthetic logs ----------------------------------------------------------------------------------------


def geometry_log(spark: SparkSession, win_rate: float = 0.5, reward_risk: float = 1.0, per_day: int = 3, risk: float = 100.0, ev: float = 0.0, days: int = 250, seed: int = 1, log_id: int = 0) -> DataFrame:
    """A log of given geometry: exactly round(p n) winners in hashed order, mean moved to ev; weekdays from 2026-01-05, 08:30 Chicago on."""
    if not (0 < win_rate < 1 and reward_risk > 0 and per_day >= 1 and risk > 0 and days >= 1):
        raise IngestError("a geometry needs a win rate inside (0, 1), positive reward, risk and counts")
    n = days * per_day
    shift = ev - risk * (win_rate * reward_risk - (1 - win_rate))
    wins = round(win_rate * n)
    win, loss = reward_risk * risk + shift, -risk + shift
    off = ev - (wins * win + (n - wins) * loss) / n
    w = Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "i")), "i")  # n rows of one synthetic log
    t = pin(spark).range(n).withColumnRenamed("id", "i").withColumn("win", F.row_number().over(w) <= wins)
    day = F.floor(F.col("i") / per_day)
    date = F.date_add(F.lit("2026-01-05").cast("date"), (F.floor(day / 5) * 7 + day % 5).cast("int"))
    step = 6.5 * 60 / (per_day + 0.5)
    start = F.to_utc_timestamp(date.cast("timestamp") + F.make_interval(hours=F.lit(8), mins=F.lit(30)), "America/Chicago")
    entry = F.timestamp_seconds(F.unix_seconds(start) + F.floor((F.col("i") % per_day) * step * 60))
    t = t.select(
        F.lit(log_id).cast("bigint").alias("log_id"), (F.col("i") + 1).cast("bigint").alias("trade_seq"), entry.alias("entry_time"),
        F.timestamp_seconds(F.unix_seconds(entry) + int(step * 30)).alias("exit_time"), F.lit("SYN").alias("symbol"), F.lit("long").alias("side"), F.lit(1.0).alias("quantity"),
        F.when(F.col("win"), F.lit(win + off)).otherwise(F.lit(loss + off)).alias("pnl"),
        *[F.lit(None).cast("double").alias(c) for c in ("entry_price", "exit_price")], F.lit(0.0).alias("fees"), *[F.lit(None).cast("double").alias(c) for c in ("mae", "mfe")],
    )
    return t


def distorted(win_rate: float, reward_risk: float, risk: float, ev: float) -> bool:
    """Whether moving the mean to ev bends the geometry by more than a hundredth of the risk."""
    return abs(ev - risk * (win_rate * reward_risk - (1 - win_rate))) > 0.01 * risk
