"""The registered queries: each an operator over the test tables, beside SQL that gives the same rows in another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.contracts import root
from ..functions.money import parse_money
from ..functions.sessions import CME, localised
from ..operators import metrics as M
from ..operators import replay as R
from ..operators import series as S
from ..operators import stress as X
from ..sources import files
from . import montecarlo as MC
from . import windowed as W
from .tables import TRADES_EV_SQL, TRADES_LI_SQL, bars_li, marks_ev, trades_ev, trades_li, variants_li

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(d: DataFrame, places: int = 6, **per: int) -> DataFrame:
    """Doubles rounded, whole numbers as bigint: what a comparison across engines can hold."""
    out = []
    for c, t in d.dtypes:
        if t == "double":
            out.append((F.round(F.col(c), per.get(c, places)) + F.lit(0.0)).alias(c))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


LI = "with " + TRADES_LI_SQL
EV = "with " + TRADES_EV_SQL
PF = "case when sum(case when {p} < 0 then -{p} else 0 end) > 0 then sum(case when {p} > 0 then {p} else 0 end) / sum(case when {p} < 0 then -{p} else 0 end) when count(*) filter ({p} > 0) > 0 then 'inf'::double else 0 end"
DAILY = """, daily as (
  select log_id, session_date, sum(pnl) as day_pnl, count(*) as n_trades,
         row_number() over (partition by log_id order by session_date) - 1 as day_idx
  from trades_li group by log_id, session_date
)"""
PATH = """, eq as (
  select log_id, trade_seq, pnl, sum(pnl) over w as e, count(*) filter (pnl >= 0) over w as island
  from trades_li window w as (partition by log_id order by trade_seq rows unbounded preceding)
), dd as (
  select log_id, max(greatest(0, top) - e) as max_drawdown
  from (select log_id, e, max(e) over (partition by log_id order by trade_seq rows unbounded preceding) as top from eq) group by log_id
), streak as (
  select log_id, max(k) as longest_losing_streak from (select log_id, island, count(*) filter (pnl < 0) as k from eq group by log_id, island) group by log_id
)"""


# --- metrics ---------------------------------------------------------------------------------------------


@query(
    LI + PATH + f"""
select t.log_id, count(*) as n_trades, round(sum(pnl), 4) as net_profit, round(avg((pnl > 0)::int), 6) as win_rate, round({PF.format(p="pnl")}, 6) as profit_factor,
       count(distinct session_date) as trading_days, round(any_value(max_drawdown), 4) as max_drawdown, any_value(longest_losing_streak) as longest_losing_streak
from trades_li t join dd using (log_id) join streak using (log_id) group by t.log_id"""
)
def q_metrics_headline(spark, sf_dir):
    return _r(M.headline(trades_li(spark, sf_dir)), net_profit=4, max_drawdown=4)


@query(
    LI + DAILY + """
select log_id, session_date, round(sum(pnl), 4) as day_pnl, count(*) as n_trades from trades_li group by log_id, session_date"""
)
def q_daily_pnl(spark, sf_dir):
    return _r(M.days(trades_li(spark, sf_dir)).select("log_id", "session_date", "day_pnl", "n_trades"), 4)


@query(
    LI + DAILY + PATH + """, ends as (
  select log_id, min(session_date) as a, max(session_date) as b, count(*) as k, max(day_pnl) as best_day, stddev_samp(day_pnl) as dsd, avg(day_pnl / 50000) as rm,
         sqrt(avg(power(least(day_pnl / 50000, 0), 2))) as down from daily group by log_id
), wk as (
  select *, (a + ((7 - (isodow(a) - 1)) % 7)::int)::date as mon from ends
), cad as (
  select *, ((b - mon + 1) // 7) as weeks, (select count(*) from daily d where d.log_id = wk.log_id and d.session_date >= mon and d.session_date < mon + 7 * ((b - mon + 1) // 7)::int) as inside from wk
), per as (
  select *, case when weeks >= 2 and inside > 0 then least(7, inside / weeks) else 5 end as spw from cad
), top as (
  select log_id, sum(greatest(pnl, 0)) as top5 from (select log_id, pnl, row_number() over (partition by log_id order by pnl desc, trade_seq) as r from trades_li) where r <= 5 group by log_id
), t as (
  select log_id, count(*) as n, sum(pnl) as net, avg(pnl) as mean, stddev_samp(pnl) as sd, count(*) filter (pnl > 0) as wins, sum(greatest(pnl, 0)) as gp,
         avg(pnl) filter (pnl > 0) as aw, avg(pnl) filter (pnl < 0) as al, sum(greatest(-pnl, 0)) as gl from trades_li group by log_id
)
select log_id, n as trade_count, round(aw / abs(al), 6) as payoff_ratio, round(mean, 6) as expectancy, round(mean / abs(al), 6) as expectancy_r, round(mean / (sd / sqrt(n)), 6) as expectancy_tstat,
       round(gp / gl, 6) as profit_factor, round(rm / (dsd / 50000) * sqrt(252 * spw / 5), 4) as sharpe, round(rm / down * sqrt(252 * spw / 5), 4) as sortino,
       round(net / 50000 / (k / (252 * spw / 5)) / (max_drawdown / 50000), 4) as mar, round(case when net > 0 then best_day / net else 0 end, 6) as best_day_share,
       round(top5 / gp, 6) as top5_trade_share, round(spw, 6) as sessions_per_week, longest_losing_streak
from t join per using (log_id) join top using (log_id) join dd using (log_id) join streak using (log_id)"""
)
def q_metrics_full(spark, sf_dir):
    c = ("log_id", "trade_count", "payoff_ratio", "expectancy", "expectancy_r", "expectancy_tstat", "profit_factor", "sharpe", "sortino", "mar", "best_day_share", "top5_trade_share", "sessions_per_week", "longest_losing_streak")
    return _r(M.full(trades_li(spark, sf_dir)).select(*c), sharpe=4, sortino=4, mar=4)


@query(
    EV + """, o as (
  select *, entry_time < max(exit_time) over (partition by log_id order by entry_time, trade_seq rows between unbounded preceding and 1 preceding) as over from trades_ev
)
select log_id, 'close-only' as fidelity, count(*) filter (session_date <> entry_session) as cross_session, coalesce(bool_or(over), false) as overlapping, max(quantity) as max_quantity from o group by log_id"""
)
def q_fidelity_overlaps(spark, sf_dir):
    return M.fidelity(trades_ev(spark, sf_dir)).select("log_id", "fidelity", "cross_session", "overlapping", "max_quantity")


@query(
    LI + """, e as (
  select log_id, trade_seq, entry_time as ts, 0 as kind, quantity as q from trades_li union all select log_id, trade_seq, exit_time, 1, -quantity from trades_li
)
select log_id, max(o) as peak_exposure from (select log_id, sum(q) over (partition by log_id order by ts, kind, trade_seq rows unbounded preceding) as o from e) group by log_id"""
)
def q_peak_exposure(spark, sf_dir):
    return M.peak_exposure(trades_li(spark, sf_dir))


@query(
    LI + """, m as (
  select log_id, symbol, strftime(exit_time, '%Y-%m') as month, sum(pnl) as pnl, min(trade_seq) as f from trades_li group by all
)
select log_id, count(*) as buckets, arg_max(symbol, (round(pnl, 4), -f)) as symbol, arg_max(month, (round(pnl, 4), -f)) as month, round(max(pnl), 4) as best_pnl from m group by log_id"""
)
def q_symbol_months(spark, sf_dir):
    return _r(M.symbol_months(trades_li(spark, sf_dir)), 4)


@query(LI + ", n as (select log_id, symbol, count(*) as n, min(trade_seq) as f from trades_li group by all) select log_id, arg_max(symbol, (n, -f)) as symbol, max(n) as n_trades from n group by log_id")
def q_dominant_symbol(spark, sf_dir):
    return M.dominant_symbol(trades_li(spark, sf_dir))


@query(
    LI + """, e as (select log_id, trade_seq, entry_time as ts, 0 as kind, case when symbol in ('MNQ', 'MES') then quantity / 10 else quantity end as q from trades_li union all
  select log_id, trade_seq, exit_time, 1, -(case when symbol in ('MNQ', 'MES') then quantity / 10 else quantity end) from trades_li)
select log_id, round(max(o), 6) as peak_exposure, 5.0::double as contract_limit, round(max(o), 6) > 5 as exceeds from (select log_id, sum(q) over (partition by log_id order by ts, kind, trade_seq rows unbounded preceding) as o from e) group by log_id"""
)
def q_exposure_advice(spark, sf_dir):
    from ..functions.contracts import mini_units

    return _r(M.exposure_advice(trades_li(spark, sf_dir), 5.0, mini_units(10.0)))


# --- ordered statistics --------------------------------------------------------------------------------------


@query(
    LI + """
select log_id, trade_seq, round(m, 4) as mean from (
  select log_id, trade_seq, avg(pnl) over (partition by log_id order by trade_seq rows between 29 preceding and current row) as m from trades_li) where trade_seq >= 30"""
)
def q_rolling_expectancy(spark, sf_dir):
    return _r(S.rolling_mean(trades_li(spark, sf_dir)), 4)


@query(
    LI + f""", h as (select *, trade_seq <= (count(*) over (partition by log_id)) // 2 as first from trades_li)
select log_id, count(*) filter (first) as first_n, round(avg(pnl) filter (first), 6) as first_expectancy, round(sum(greatest(pnl, 0)) filter (first) / sum(greatest(-pnl, 0)) filter (first), 6) as first_profit_factor,
       count(*) filter (not first) as second_n, round(avg(pnl) filter (not first), 6) as second_expectancy, round(sum(greatest(pnl, 0)) filter (not first) / sum(greatest(-pnl, 0)) filter (not first), 6) as second_profit_factor
from h group by log_id"""
)
def q_halves(spark, sf_dir):
    return _r(S.halves(trades_li(spark, sf_dir)))


@query(
    LI + """
select log_id, count(*) filter (exit_time < timestamp '1998-01-01') as n_is, count(*) filter (exit_time >= timestamp '1998-01-01') as n_oos,
       round(case when avg(pnl) filter (exit_time < timestamp '1998-01-01') > 0 then avg(pnl) filter (exit_time >= timestamp '1998-01-01') / avg(pnl) filter (exit_time < timestamp '1998-01-01') end, 5) as wfe
from trades_li group by log_id"""
)
def q_walk_forward(spark, sf_dir):
    return _r(S.walk_forward(trades_li(spark, sf_dir), "1998-01-01").select("log_id", "n_is", "n_oos", "wfe"), 5)


@query(
    LI + """, s as (select log_id, sign(pnl) as s, lag(sign(pnl)) over (partition by log_id order by trade_seq) as p from trades_li where pnl <> 0),
g as (select log_id, count(*) filter (s > 0)::double as n1, count(*) filter (s < 0)::double as n2, 1 + count(*) filter (s <> p) as r from s group by log_id)
select log_id, n1::bigint as wins, n2::bigint as losses, r as runs,
       round((r - (1 + 2 * n1 * n2 / (n1 + n2))) / sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))), 6) as runs_z from g"""
)
def q_runs_test(spark, sf_dir):
    return _r(S.runs(trades_li(spark, sf_dir)))


@query(
    LI + """, b as (select log_id, count(*) as n, avg(pnl) as my, avg(trade_seq) as mx, regr_slope(pnl, trade_seq) as slope, regr_sxx(pnl, trade_seq) as sxx from trades_li group by log_id),
u as (select log_id, trade_seq, least(floor(4 * power(n / 100.0, 2.0 / 9)), n - 2) as lag, slope, sxx, n, (trade_seq - mx) * (pnl - my - slope * (trade_seq - mx)) as u from trades_li join b using (log_id)),
c as (select a.log_id, any_value(a.n) as n, any_value(a.slope) as slope, any_value(a.sxx) as sxx, any_value(a.lag) as lag, sum(case when b.trade_seq = a.trade_seq then a.u * b.u else 2 * (1 - (a.trade_seq - b.trade_seq) / (a.lag + 1)) * a.u * b.u end) as lrv
      from u a join u b on a.log_id = b.log_id and b.trade_seq between a.trade_seq - 12 and a.trade_seq and a.trade_seq - b.trade_seq <= a.lag group by a.log_id)
select log_id, n, round(slope, 8) as slope, round(sqrt(greatest(lrv, 0)) / sxx, 8) as se, round(slope / (sqrt(greatest(lrv, 0)) / sxx), 4) as t, lag::bigint as lag from c"""
)
def q_hac_slope(spark, sf_dir):
    return _r(S.hac_slope(trades_li(spark, sf_dir)), 8, t=4)


@query(
    EV + """, p as (select a.log_id, sum(sign(b.pnl - a.pnl))::bigint as s from trades_ev a join trades_ev b on a.log_id = b.log_id and b.trade_seq > a.trade_seq group by a.log_id),
t as (select log_id, sum(c) as n, sum(c * (c - 1) * (2 * c + 5)) as t from (select log_id, pnl, count(*)::double as c from trades_ev group by log_id, pnl) group by log_id)
select log_id, case when n >= 8 then s else 0 end as mk_s, round(case when n >= 8 then (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - t) / 18) else 0 end, 6) as mk_z from t join p using (log_id)"""
)
def q_mann_kendall(spark, sf_dir):
    return _r(S.mann_kendall(trades_ev(spark, sf_dir)))


def _ev(name: str) -> str:
    """The SQL of a query over the other trade logs."""
    return ORACLE_SQL[name].replace(LI, EV).replace("trades_li", "trades_ev")


@query(
    f"""select h.*, coalesce(slope, 0) as slope, coalesce(t, 0) as slope_t, mk_s, mk_z, coalesce(runs, 0) as runs, coalesce(runs_z, 0) as runs_z,
       coalesce(slope < 0 and abs(t) > 1.959963984540054 and first_expectancy > 0 and second_expectancy < 0.5 * first_expectancy, false) as decayed
from ({_ev("halves")}) h left join ({_ev("hac_slope")}) s using (log_id) left join ({_ev("mann_kendall")}) m using (log_id) left join ({_ev("runs_test")}) r using (log_id)"""
)
def q_decay_panel(spark, sf_dir):
    return _r(S.decay(trades_ev(spark, sf_dir)), 6, slope=8, slope_t=4)


@query(
    LI + DAILY + """, recursive_seed as (select log_id, avg(day_pnl * day_pnl) as v from daily where day_idx < 20 group by log_id),
arr as (select log_id, list(day_pnl order by day_idx) as d from daily group by log_id),
f as (select log_id, unnest(range(20, len(d))) as day_idx, d, v from arr join recursive_seed using (log_id))
select log_id, day_idx, round(sqrt(power(0.94, day_idx - 20) * v + 0.06 * coalesce(list_sum(list_transform(range(greatest(20, day_idx - 700), day_idx), lambda k : power(0.94, day_idx - 1 - k) * d[k + 1] * d[k + 1])), 0)), 4) as sigma from f"""
)
def q_ewma_sigma(spark, sf_dir):
    """The oracle sums the closed form over the last 700 days; what is older weighs under 1e-18."""
    s = S.ewma(M.indexed(M.days(trades_li(spark, sf_dir)))).where("sigma is not null")
    return _r(s.select("log_id", "day_idx", "sigma"), 4)


def _coded(spark, sf_dir):
    t = trades_li(spark, sf_dir)
    daily = M.indexed(M.days(t))
    wins = t.select("log_id", "pnl", CME.date("exit_time").alias("session_date")).join(daily.select("log_id", "session_date", "day_idx"), ["log_id", "session_date"])
    wins = wins.groupBy("log_id", "day_idx").agg(F.count("*").alias("n_trades"), F.count_if(F.col("pnl") > 0).alias("wins"))
    return t, daily, S.regime_codes(S.ewma(daily)), wins


BARS = """with b0 as (select *, l_shipdate::timestamp as dt, 60 * (810 + (l_orderkey * 7 + l_linenumber * 13) % 360) as s from lineitem),
bars as (select dt as datetime, arg_min(l_extendedprice, (s, -(l_orderkey % 55), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as open, max(l_extendedprice) as high, min(l_extendedprice) as low,
                arg_max(l_extendedprice, (s, -(l_orderkey % 55), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as close, sum(l_quantity) as volume from b0 group by dt)"""


@query(BARS + " select datetime::date as day, open, high, low, close, volume from bars")
def q_daily_bars(spark, sf_dir):
    return bars_li(spark, sf_dir).select(F.to_date("datetime").alias("day"), "open", "high", "low", "close", "volume")


@query(
    BARS + """, w as (select datetime::date as session_date, close, greatest(high - low, abs(high - coalesce(lag(close) over o, high)), abs(low - coalesce(lag(close) over o, low))) as tr, row_number() over o as i from bars window o as (order by datetime)),
a as (select *, avg(tr) over (order by i rows between 13 preceding and current row) as atr, avg(close) over (order by i rows between 19 preceding and current row) as sma from w), k as (select * from a where i >= 20),
q as (select quantile_cont(atr, 1.0 / 3) as lo, quantile_cont(atr, 2.0 / 3) as hi from k)
select session_date, round(atr, 6) as atr, round(sma, 6) as sma, (case when close >= sma then 'up' else 'down' end) || '_' || (case when atr <= lo then 'low_vol' when atr <= hi then 'mid_vol' else 'high_vol' end) as regime from k, q"""
)
def q_market_regimes(spark, sf_dir):
    return _r(S.market_days(bars_li(spark, sf_dir), F.to_date("datetime")).select("session_date", "atr", "sma", "regime"), 6)


@query(
    LI + """, m as (select log_id, avg(pnl) as mu from trades_li group by log_id), c as (select log_id, count(*)::double as n, avg(power(pnl - mu, 2)) as m2, avg(power(pnl - mu, 3)) as m3, avg(power(pnl - mu, 4)) as m4, any_value(mu) as mu from trades_li join m using (log_id) group by log_id)
select log_id, n::bigint as n, round(m3 / power(m2, 1.5), 5) as skew, round(m4 / (m2 * m2), 5) as kurt, round(mu / sqrt(m2 * n / (n - 1)), 6) as sr, round(mu / sqrt(m2 * n / (n - 1)) * sqrt(n), 5) as sqn from c"""
)
def q_deflated_stats(spark, sf_dir):
    return _r(S.deflated(trades_li(spark, sf_dir), 20).select("log_id", "n", "skew", "kurt", "sr", "sqn"), 5, sr=6)


@query(
    LI + """, e as (select log_id, trade_seq, sum(pnl) over (partition by log_id order by trade_seq rows unbounded preceding) as e from trades_li)
select log_id, round(regr_r2(e, trade_seq), 5) as r2 from e group by log_id"""
)
def q_smooth_equity(spark, sf_dir):
    return _r(S.smoothness(trades_li(spark, sf_dir)), 5)


# --- stress -------------------------------------------------------------------------------------------------------


COSTS = """, k as (select *, case symbol when 'MNQ' then 0.5 when 'MES' then 1.25 when 'NQ' then 5.0 else 12.5 end as tv, case when symbol in ('MNQ', 'MES') then 1.5 else 3.0 end as cm from trades_li), o as (select log_id, case when bool_and(fees = 0) then 1 else 0 end as off from k group by log_id)"""


@query(
    LI + COSTS + f""", g as (select * from (values (0, 0, 1), (1, 0, 2), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 2, 2), (6, 2, 1)) v(point, slip, mult)),
p as (select log_id, point, pnl - quantity * (2 * slip * tv + (mult - 1 + off) * cm) as p from k join o using (log_id), g)
select log_id, point::bigint as point, round(sum(p), 3) as net, round(avg(p), 5) as expectancy, round({PF.format(p="p")}, 5) as profit_factor from p group by log_id, point"""
)
def q_cost_sweep(spark, sf_dir):
    return _r(X.cost_sweep(trades_li(spark, sf_dir)).select("log_id", "point", "net", "expectancy", "profit_factor"), 5, net=3)


@query(LI + COSTS + " select log_id, round(avg(pnl) - any_value(off) * avg(cm * quantity), 5) as breakeven_per_trade, round(greatest(0, (avg(pnl) - any_value(off) * avg(cm * quantity)) / avg(quantity * tv)), 5) as survives_ticks from k join o using (log_id) group by log_id")
def q_cost_breakeven(spark, sf_dir):
    return _r(X.breakeven(trades_li(spark, sf_dir)), 5)


@query(
    LI + f""", m as (select log_id, avg(pnl) as m from trades_li group by log_id having avg(pnl) > 0), p as (select log_id, h::double as haircut, pnl - h * m as p from trades_li join m using (log_id), (values (0.26), (0.5), (0.58), (0.9)) v(h))
select log_id, haircut, round(sum(p), 3) as net, round(avg(p), 5) as expectancy, round({PF.format(p="p")}, 5) as profit_factor from p group by log_id, haircut"""
)
def q_haircuts(spark, sf_dir):
    return _r(X.haircuts(trades_li(spark, sf_dir)), 5, net=3)


U = "(('0x' || substr(md5({k}), 1, 8))::bigint / 4294967296.0)"


@query(
    EV + f""", n as (select log_id, count(*) as n from trades_ev group by log_id), d as (select log_id, s, floor({U.format(k="'7|' || log_id || '|' || s || '|' || i")} * n)::bigint + 1 as trade_seq from (select log_id, n, s, unnest(range(1, n + 1)) as i from (select log_id, n, unnest(range(0, 20)) as s from n))),
m as (select log_id, s, avg(pnl) as m from d join trades_ev using (log_id, trade_seq) group by log_id, s)
select log_id, round(quantile_cont(m, 0.025), 7) as ci_lo, round(quantile_cont(m, 0.975), 7) as ci_hi, round(avg((m > 0)::int), 7) as p_positive from m group by log_id"""
)
def q_bootstrap_mean_hashed(spark, sf_dir):
    b = X.bootstrap_mean_sql(trades_ev(spark, sf_dir), 20)
    # rounded as the SQL does it, by the scaled number: halves of 1e-7 are frequent here, and the decimal text rounds some of them the other way
    return b.select("log_id", *[(F.round(F.col(c) * 1e7, 0) / 1e7 + F.lit(0.0)).alias(c) for c in ("ci_lo", "ci_hi", "p_positive")])


@query()
def q_bootstrap_mean(spark, sf_dir):
    return X.bootstrap_mean(trades_li(spark, sf_dir))


@query(
    EV + f""", i as (select log_id, trade_seq, pnl, unnest(range(0, 10)) as it from trades_ev), e as (select log_id, it, sum(pnl) over (partition by log_id, it order by {U.format(k="'7|' || log_id || '|' || it || '|' || trade_seq")}, trade_seq rows unbounded preceding) as e, {U.format(k="'7|' || log_id || '|' || it || '|' || trade_seq")} as u, trade_seq from i),
t as (select log_id, it, e, greatest(0, max(e) over (partition by log_id, it order by u, trade_seq rows unbounded preceding)) as top from e)
select log_id, it::bigint as it, round(max(top - e), 4) as dd from t group by log_id, it"""
)
def q_permutation_drawdown_hashed(spark, sf_dir):
    return _r(X.permutation_drawdown_sql(trades_ev(spark, sf_dir), 10), 4)


@query()
def q_permutation_drawdown(spark, sf_dir):
    return X.permutation_drawdown(trades_li(spark, sf_dir), capital=2000.0)


@query(
    """with v0 as (select l_shipdate::date as day, p_brand as variant, sum(round((l_discount - 0.049) * l_extendedprice * 0.05, 2)) as pnl from lineitem join part on l_partkey = p_partkey group by all),
days as (select day, (row_number() over (order by day) - 1) // ((select count(distinct l_shipdate) from lineitem) // 6) as b from (select distinct day from v0)),
c as (select d.b, v.variant, sum(coalesce(round(v0.pnl, 2), 0)) as s, sum(power(coalesce(round(v0.pnl, 2), 0), 2)) as q from days d cross join (select distinct variant from v0) v left join v0 on v0.day = d.day and v0.variant = v.variant where d.b < 6 group by all),
m as (select range as mask from range(64) where bit_count(range::integer) = 3),
x as (select mask, variant, sum(s) filter ((mask >> b) & 1 = 1) as si, sum(q) filter ((mask >> b) & 1 = 1) as qi, sum(s) filter ((mask >> b) & 1 = 0) as so, sum(q) filter ((mask >> b) & 1 = 0) as qo from m, c group by all),
n as (select 3.0 * ((select count(distinct l_shipdate) from lineitem) // 6) as h),
r as (select mask, variant, (si / h) / sqrt((qi - si * si / h) / (h - 1)) as a, (so / h) / sqrt((qo - so * so / h) / (h - 1)) as o from x, n),
k as (select mask, variant, o, row_number() over (partition by mask order by a desc, variant) as top, rank() over (partition by mask order by o) as rk, count(*) over (partition by mask) as nv from r),
w as (select rk / (nv + 1.0) as omega, o from k where top = 1)
select count(*) as n_splits, round(avg((omega < 0.5)::int) + 0.5 * avg((omega = 0.5)::int), 6) as pbo, round(quantile_cont(ln(omega / (1 - omega)), 0.5), 6) as median_logit, round(avg((o < 0)::int), 6) as p_oos_loss from w"""
)
def q_pbo_6(spark, sf_dir):
    return _r(X.pbo(variants_li(spark, sf_dir), 6).select("n_splits", "pbo", "median_logit", "p_oos_loss"))


@query()
def q_scorecard(spark, sf_dir):
    t = trades_li(spark, sf_dir)
    return X.scorecard(M.full(t), X.bootstrap_mean(t), X.trimmed_pf(t), S.deflated(t, 5))


@query(LI + " select log_id, round(sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)), 6) as pf_trimmed from (select *, row_number() over (partition by log_id order by pnl desc, trade_seq) as r from trades_li) where r > 5 group by log_id")
def q_trimmed_profit_factor(spark, sf_dir):
    return _r(X.trimmed_pf(trades_li(spark, sf_dir)))


@query()
def q_overfit_flags(spark, sf_dir):
    t, daily, coded, wins = _coded(spark, sf_dir)
    reg = S.regime_summary(S.regimes(coded, daily, wins))
    return X.flags(M.full(t), X.bootstrap_mean(t), S.halves(t), S.hac_slope(t), S.mann_kendall(t), S.runs(t), S.smoothness(t), M.symbol_months(t), S.clustering(daily), reg)


# --- parsing --------------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey, round(case when l_linenumber % 2 = 0 then -round(l_extendedprice, 2) else round(l_extendedprice, 2) end, 2) as amount from lineitem")
def q_money_parse(spark, sf_dir):
    """Money text of four styles read back: $1,234.56, (1.234,56), -$1234.56, EUR style with spaces."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    v = F.format_number(F.round("l_extendedprice", 2), 2)
    swap = F.translate(v, ",.", ".,")
    style = F.col("l_linenumber") % 4
    text = F.when(style == 0, F.concat(F.lit("($"), v, F.lit(")"))).when(style == 1, F.concat(F.lit("$"), v)).when(style == 2, F.concat(F.lit("−€"), swap)).otherwise(F.translate(F.concat(v, F.lit(" €")), ",", " "))
    return l.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", F.round(parse_money(text), 2).alias("amount"))


@query(
    """with s as (select distinct p_size as k, ['ES', 'MES', 'NQ', 'MNQ', 'CL', 'ZN', 'XX'][p_size % 7 + 1] as r, p_size % 5 as form from (select p_partkey % 50 as p_size from part))
select k, (case form when 0 then '/' || r when 1 then r || 'H26' when 2 then r || '1!' when 3 then r || '=F' else r || '15Z24' end) as symbol, case when r = 'XX' then null else r end as root from s"""
)
def q_contract_roots(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 50).alias("k")).distinct()
    r = F.element_at(F.array(*map(F.lit, ("ES", "MES", "NQ", "MNQ", "CL", "ZN", "XX"))), (F.col("k") % 7 + 1).cast("int"))
    form = F.col("k") % 5
    s = F.when(form == 0, F.concat(F.lit("/"), r)).when(form == 1, F.concat(r, F.lit("H26"))).when(form == 2, F.concat(r, F.lit("1!"))).when(form == 3, F.concat(r, F.lit("=F"))).otherwise(F.concat(r, F.lit("15Z24")))
    return p.select("k", s.alias("symbol"), root(s).alias("root"))


@query(
    """with w as (select event_id, timestamp '2025-01-01' + to_minutes((event_id * 37) % 525600) as wall from events), c as (select event_id, wall, timezone('UTC', timezone('America/Chicago', wall)) as u from w)
select event_id, case when timezone('America/Chicago', timezone('UTC', u)) <> wall then null when timezone('America/Chicago', timezone('UTC', u + interval 1 hour)) = wall or timezone('America/Chicago', timezone('UTC', u - interval 1 hour)) = wall then null else u end as instant from c"""
)
def q_localise_times(spark, sf_dir):
    """Wall clock of a zone to instants; the hour that is skipped and the one that comes twice are null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    wall = F.timestamp_seconds(F.lit(1735689600) + 60 * ((F.col("event_id") * 37) % 525600))
    return e.select("event_id", localised(wall, "America/Chicago").cast("timestamp_ntz").alias("instant"))


@query(EV + " select log_id, session_date, count(*) as n_trades, round(sum(pnl), 4) as pnl from trades_ev group by log_id, session_date")
def q_sessions(spark, sf_dir):
    t = trades_ev(spark, sf_dir)
    return _r(t.groupBy("log_id", CME.date("exit_time").alias("session_date")).agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("pnl")), 4)


@query(
    """with m as (select user_id as log_id, ts, event_id, round(50000 + sum(value - 49) over (partition by user_id order by ts, event_id rows unbounded preceding), 2) as equity from events)
select log_id, ts::date as day, arg_max(equity, (ts, event_id)) as equity from m group by log_id, ts::date"""
)
def q_daily_marks(spark, sf_dir):
    return files.daily_marks(marks_ev(spark, sf_dir))


# --- rules and simulation ---------------------------------------------------------------------------------------------


@query(EV + " select log_id, count(*) filter (exit_time >= timezone('UTC', timezone('America/Chicago', entry_session + interval '15 hours 10 minutes'))) as violations from trades_ev group by log_id")
def q_session_close(spark, sf_dir):
    return R.close_violations(trades_ev(spark, sf_dir), C.PRESETS["topstep_50k"], C.SessionClose())


@query()
def q_replay_chain(spark, sf_dir):
    t = trades_li(spark, sf_dir)
    return R.evaluate(t, C.PRESETS["apex40_50k_eod"], base=M.peak_exposure(t))


@query()
def q_replay_timeline(spark, sf_dir):
    return R.timeline(trades_li(spark, sf_dir), C.PRESETS["tpt_50k"], "challenge")


@query()
def q_equity_check(spark, sf_dir):
    return R.check_marks(marks_ev(spark, sf_dir), C.PRESETS["ftmo_2step_100k"], "challenge")


@query(W.DRAWS_SQL)
def q_block_bootstrap(spark, sf_dir):
    return W.draws(M.indexed(M.days(trades_li(spark, sf_dir))), 20, 40, 5.0, 42)


@query(W.PHASE_SQL)
def q_evaluation_windows(spark, sf_dir):
    """The evaluation phase without feedback as windows and first hits: end-of-day trail, consistency raise, target."""
    daily = M.indexed(M.days(trades_li(spark, sf_dir)))
    return _r(W.evaluate_days(daily, W.draws(daily, 200, 60, 5.0, 42), W.Limits()), 4)


@query()
def q_monte_carlo(spark, sf_dir):
    return MC.run(trades_li(spark, sf_dir), C.PRESETS["topstep_50k"], MC.Config())


@query()
def q_monte_carlo_vol_target(spark, sf_dir):
    return MC.run(trades_li(spark, sf_dir), C.PRESETS["tpt_50k"], MC.Config(n_paths=2000, sizing="vol_target"))


@query()
def q_monte_carlo_cushion(spark, sf_dir):
    return MC.run(trades_li(spark, sf_dir), C.PRESETS["apex40_50k_intraday"], MC.Config(n_paths=2000, sizing="cushion"))


@query()
def q_fail_breakdown(spark, sf_dir):
    t, firm = trades_li(spark, sf_dir), C.PRESETS["ftmo_2step_100k"]
    return MC.fail_breakdown(MC.paths(t, firm, [MC.Config(n_paths=2000)]))


@query()
def q_scale_frontier(spark, sf_dir):
    return MC.frontier(trades_li(spark, sf_dir), C.PRESETS["topstep_50k"], MC.Config(n_paths=1000))


@query()
def q_payout_policies(spark, sf_dir):
    return MC.policies(trades_li(spark, sf_dir), C.PRESETS["topstep_50k"], MC.Config(n_paths=1000))


@query()
def q_sampling_uncertainty(spark, sf_dir):
    return MC.uncertainty(trades_li(spark, sf_dir), C.PRESETS["topstep_50k"])


@query()
def q_equity_fan(spark, sf_dir):
    return MC.fan(MC.samples(trades_li(spark, sf_dir), C.PRESETS["topstep_50k"], MC.Config(n_paths=1000)))


@query()
def q_multi_account(spark, sf_dir):
    t, firm = trades_li(spark, sf_dir), C.PRESETS["topstep_50k"]
    prof = MC.profiles(t, firm)
    return MC.multi_account(MC.paths(t, firm, [MC.Config(n_paths=1000)], logs=prof), firm, 3)


@query()
def q_worst_regime(spark, sf_dir):
    """The simulation on the days of each log's worst volatility regime only."""
    t, daily, coded, wins = _coded(spark, sf_dir)
    worst = S.regime_summary(S.regimes(coded, daily, wins)).where("tested").select("log_id", "worst_code")
    keep = coded.join(worst, "log_id").where("code = worst_code").select("log_id", F.col("day_idx").cast("int").alias("day"))
    firm = C.PRESETS["topstep_50k"]
    prof = MC.profiles(t, firm)
    return MC.economics(MC.paths(t, firm, [MC.Config(n_paths=1000)], logs=prof, days=keep), firm)


from . import proofs  # noqa: E402, F401  the rest of the queries, registered by import
