"""More registered queries, each with SQL that works its rows out by another road: regimes, deflated statistics, flags,
grades, economics of given paths, and the path kernel on draws that any engine can repeat."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import kernel as K
from ..operators import metrics as M
from ..operators import series as S
from ..operators import stress as X
from ..sources import files
from . import montecarlo as MC
from . import windowed as W
from .queries import BARS, DAILY, LI, ORACLE_SQL, U, _coded, _r, query
from .tables import TRADES_EV_SQL, bars_li, trades_ev, trades_li, variants_li

# --- volatility ------------------------------------------------------------------------------------

SIGMA = """, seed as (select log_id, avg(day_pnl * day_pnl) as v from daily where day_idx < 20 group by log_id),
arr as (select log_id, list(day_pnl order by day_idx) as d from daily group by log_id),
f as (select log_id, unnest(range(20, len(d))) as day_idx, d, v from arr join seed using (log_id)),
sig as (select log_id, day_idx, sqrt(power(0.94, day_idx - 20) * v + 0.06 * coalesce(list_sum(list_transform(range(greatest(20, day_idx - 700), day_idx), lambda k : power(0.94, day_idx - 1 - k) * d[k + 1] * d[k + 1])), 0)) as sigma from f)"""
REGIMES = SIGMA + """, cut as (select log_id, quantile_cont(sigma, 1.0 / 3) as lo, quantile_cont(sigma, 2.0 / 3) as hi from sig group by log_id),
coded as (select log_id, day_idx, day_pnl, case when sigma is null then -1 when sigma <= lo + 1e-9 then 0 when sigma <= hi + 1e-9 then 1 else 2 end as code from daily left join sig using (log_id, day_idx) left join cut using (log_id)),
nx as (select *, lead(code) over (partition by log_id order by day_idx) as next from coded),
won as (select log_id, session_date, count(*) as k, count(*) filter (pnl > 0) as wins from trades_li group by all),
reg as (select nx.log_id, code, count(*) as n_days, sum(k)::bigint as n_trades, sum(nx.day_pnl) as net, avg(nx.day_pnl) as day_expectancy, sum(wins) / sum(k) as win_rate, coalesce(avg((next = code)::int) filter (next >= 0), 0) as persistence
  from nx join daily using (log_id, day_idx) join won on won.log_id = nx.log_id and won.session_date = daily.session_date where code >= 0 group by nx.log_id, code)"""


@query(LI + DAILY + REGIMES + " select log_id, code::bigint as code, n_days, n_trades, round(net, 4) as net, round(day_expectancy, 4) as day_expectancy, round(win_rate, 4) as win_rate, round(persistence, 4) as persistence from reg")
def q_vol_regimes(spark, sf_dir):
    _, daily, coded, wins = _coded(spark, sf_dir)
    return _r(S.regimes(coded, daily, wins), 4)


SUMMARY = """ select log_id, sum(n_days)::bigint as n_classified, sum(n_days) >= 30 as tested, (case when sum(n_days) >= 30 then arg_min(code, (day_expectancy, code)) end)::int as worst_code,
 sum(n_days) >= 30 and sum(net) > 0 and min(net) < 0 and -min(net) >= 0.2 * sum(net) as regime_dependent from reg group by log_id"""


@query(LI + DAILY + REGIMES + SUMMARY)
def q_regime_summary(spark, sf_dir):
    _, daily, coded, wins = _coded(spark, sf_dir)
    return S.regime_summary(S.regimes(coded, daily, wins))


@query(
    "with recursive " + LI.removeprefix("with ") + DAILY + SIGMA + """, med as (select log_id, quantile_cont(sigma, 0.5) as m from sig group by log_id),
want as (select daily.log_id, daily.day_idx, day_pnl, case when sigma is null or sigma <= 0 then 1.0 else least(1.5, greatest(0.5, m / sigma)) end as w from daily left join sig using (log_id, day_idx) join med using (log_id)),
rec as (select log_id, day_idx, day_pnl, (case when abs(w - 1) > 0.15 then w else 1.0 end)::double as now from want where day_idx = 0
  union all select want.log_id, want.day_idx, want.day_pnl, case when abs(w - now) > 0.15 then w else now end from rec join want on want.log_id = rec.log_id and want.day_idx = rec.day_idx + 1),
e as (select *, sum(day_pnl) over o as e1, sum(day_pnl * now) over o as e2 from rec window o as (partition by log_id order by day_idx rows unbounded preceding)),
t as (select *, greatest(0, max(e1) over o) - e1 as d1, greatest(0, max(e2) over o) - e2 as d2 from e window o as (partition by log_id order by day_idx rows unbounded preceding)),
mo as (select log_id, round(min(a), 4) as fixed_worst_month, round(min(b), 4) as target_worst_month from (select rec.log_id, sum(rec.day_pnl) as a, sum(rec.day_pnl * now) as b from rec join daily using (log_id, day_idx) group by rec.log_id, strftime(session_date, '%Y-%m')) group by log_id)
select t.log_id, any_value(fixed_worst_month) as fixed_worst_month, any_value(target_worst_month) as target_worst_month, count(*) as n_days, round(sum(day_pnl), 4) as fixed_net, round(stddev_samp(day_pnl), 4) as fixed_sd, round(max(d1), 4) as fixed_drawdown, round(sum(day_pnl * now), 4) as target_net, round(stddev_samp(day_pnl * now), 4) as target_sd, round(max(d2), 4) as target_drawdown
from t join mo on mo.log_id = t.log_id group by t.log_id having count(*) >= 60"""
)
def q_vol_target_counterfactual(spark, sf_dir):
    daily = M.indexed(M.days(trades_li(spark, sf_dir)))
    return _r(X.vol_counterfactual(X.vol_weights(S.ewma(daily)), dates=daily.select("log_id", "day_idx", "session_date")), 4)


def _eliminated(lags: int) -> str:
    """Gaussian elimination of the constant and the lags from the cross products, a common table a pivot."""
    out = ", e0 as (select log_id, i, j, sum(x * y) as g from (select a.log_id, a.t, a.k as i, b.k as j, a.v as x, b.v as y from lagged a join lagged b using (log_id, t)) group by log_id, i, j)"
    pivots = [lags + 1, *range(1, lags + 1)]
    for n, p in enumerate(pivots):
        out += f", e{n + 1} as (select a.log_id, a.i, a.j, a.g - b.g * c.g / d.g as g from e{n} a join e{n} b on b.log_id = a.log_id and b.i = a.i and b.j = {p} join e{n} c on c.log_id = a.log_id and c.i = {p} and c.j = a.j join e{n} d on d.log_id = a.log_id and d.i = {p} and d.j = {p} where a.i <> {p} and a.j <> {p})"
    return out


CHI10 = "exp(-{x} / 2) * (1 + {x} / 2 + power({x} / 2, 2) / 2 + power({x} / 2, 3) / 6 + power({x} / 2, 4) / 24)"
CLUSTERS = (
    """, sq0 as (select log_id, day_idx, power(day_pnl - avg(day_pnl) over (partition by log_id), 2) as s from daily),
sq as (select log_id, day_idx as t, s / avg(s) over (partition by log_id) as s from sq0),
lagged as (select a.log_id, a.t, k, b.s as v from (select *, unnest(range(0, 11)) as k from sq where t >= 10) a join sq b on b.log_id = a.log_id and b.t = a.t - k union all select log_id, t, 11, 1.0 from sq where t >= 10)"""
    + _eliminated(10)
    + """, lm as (select a.log_id, (select count(*) from sq where sq.log_id = a.log_id and t >= 10) * greatest(0, 1 - b.g / a.g) as lm from e1 a join e11 b using (log_id) where a.i = 0 and a.j = 0 and b.i = 0 and b.j = 0),
ac as (select a.log_id, b.k, sum((a.s - 1) * (c.s - 1)) as g from sq a, (select unnest(range(0, 11)) as k) b join sq c on c.log_id = a.log_id and c.t = a.t - b.k group by a.log_id, b.k),
nd as (select log_id, count(*) as n from daily group by log_id),
ml as (select a.log_id, any_value(n) as n, any_value(n * (n + 2.0)) * sum(power(a.g / z.g, 2) / (n - a.k)) as ml from ac a join ac z on z.log_id = a.log_id and z.k = 0 join nd on nd.log_id = a.log_id where a.k > 0 group by a.log_id),
clu as (select log_id, n as n_days, lm as arch_lm, """
    + CHI10.format(x="lm") + " as arch_lm_p, ml as mcleod_li, " + CHI10.format(x="ml") + " as mcleod_li_p from lm join ml using (log_id))"
)


@query(LI + DAILY + CLUSTERS + " select log_id, n_days, true as tested, round(arch_lm, 5) as arch_lm, round(arch_lm_p, 5) as arch_lm_p, round(mcleod_li, 5) as mcleod_li, round(mcleod_li_p, 5) as mcleod_li_p, 10::bigint as lags, arch_lm_p < 0.05 or mcleod_li_p < 0.05 as clustered from clu")
def q_vol_clustering(spark, sf_dir):
    """The SQL knows the tail for ten lags only, which is what a log of 100 days or more has."""
    return _r(S.clustering(M.indexed(M.days(trades_li(spark, sf_dir)))), 5)


@query(
    BARS + ", d as (select * from bars where datetime::date is not null and day(datetime) % 9 <> 4), a as (select min(datetime)::date as a, max(datetime)::date as b from d), g as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from a) select day from g where isodow(day) < 6 and day not in (select datetime::date from d)"
)
def q_weekday_gaps(spark, sf_dir):
    """Bars without those of some days of the month, so that there are gaps."""
    return files.weekday_gaps(bars_li(spark, sf_dir).where(F.dayofmonth("datetime") % 9 != 4))


@query(
    BARS + """, w as (select datetime::date as session_date, close, greatest(high - low, abs(high - coalesce(lag(close) over o, high)), abs(low - coalesce(lag(close) over o, low))) as tr, row_number() over o as i from bars window o as (order by datetime)),
a as (select *, avg(tr) over (order by i rows between 13 preceding and current row) as atr, avg(close) over (order by i rows between 19 preceding and current row) as sma from w), k as (select * from a where i >= 20),
q as (select quantile_cont(atr, 1.0 / 3) as lo, quantile_cont(atr, 2.0 / 3) as hi from k),
m as (select session_date, (case when close >= sma then 'up' else 'down' end) || '_' || (case when atr <= lo then 'low_vol' when atr <= hi then 'mid_vol' else 'high_vol' end) as regime from k, q), """
    + LI.removeprefix("with ") + DAILY + """ select log_id, regime, count(*) as n_days, round(sum(day_pnl), 4) as net, round(avg(day_pnl), 6) as day_expectancy from daily join m using (session_date) group by log_id, regime"""
)
def q_market_regime_days(spark, sf_dir):
    market = S.market_days(bars_li(spark, sf_dir), F.to_date("datetime"))
    return _r(S.market_regimes(M.days(trades_li(spark, sf_dir)), market), 6, net=4)


# --- deflated statistics, grades, flags -------------------------------------------------------------

_Z = NormalDist()


def phi(x: str) -> str:
    """SQL of the normal distribution function, by its series in odd powers."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k : {term})))"


def deflated_sql(trials: int) -> str:
    """Common tables: mo (moments), de (everything but the haircut), of trades_li."""
    top = (1 - S.EULER) * _Z.inv_cdf(1 - 1 / trials) + S.EULER * _Z.inv_cdf(1 - 1 / (trials * math.e))
    return f""", mu as (select log_id, avg(pnl) as mu from trades_li group by log_id),
mo as (select log_id, count(*)::double as n, any_value(mu) as mu, avg(power(pnl - mu, 2)) as m2, avg(power(pnl - mu, 3)) as m3, avg(power(pnl - mu, 4)) as m4 from trades_li join mu using (log_id) group by log_id),
d0 as (select log_id, n, m3 / power(m2, 1.5) as skew, m4 / (m2 * m2) as kurt, mu / sqrt(m2 * n / (n - 1)) as sr from mo),
d1 as (select *, sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) as den from d0),
d2 as (select *, den / sqrt(n - 1) * {top!r} as sr0 from d1),
d3 as (select *, sr * sqrt(n - 1) / den as z0, (sr - sr0) * sqrt(n - 1) / den as z1 from d2),
de as (select *, {phi("z0")} as psr, {phi("z1")} as dsr, sr * sqrt(n) as sqn, sr * sqrt(least(n, 100)) as sqn_capped, case when sr > 0 then 1 + power(den * {_Z.inv_cdf(0.95)!r} / sr, 2) end as min_trl, {top * top!r}::double as minbtl_years from d3)"""


@query(
    "with recursive " + LI.removeprefix("with ") + deflated_sql(20) + f""", goal as (select log_id, sr, n, 1 - least(2 * (1 - {phi("abs(sqn)")}) * 20, 1) / 2 as u from de where sr > 0),
bis as (select log_id, u, 0.0::double as lo, 12.0::double as hi, 0 as it from goal union all
  select log_id, u, case when {phi("((lo + hi) / 2)")} < u then (lo + hi) / 2 else lo end, case when {phi("((lo + hi) / 2)")} < u then hi else (lo + hi) / 2 end, it + 1 from bis where it < 45),
cut as (select bis.log_id, hi / sqrt(n) as cut from bis join goal using (log_id) where it = 45)
select log_id, n::bigint as n, round(skew, 5) as skew, round(kurt, 5) as kurt, 20::bigint as n_trials, round(sr, 6) as sr, round(psr, 5) as psr, round(min_trl, 2) as min_trl, round(sqn, 5) as sqn, round(sqn_capped, 5) as sqn_capped, round(sr0, 5) as sr0, round(dsr, 5) as dsr,
       round(minbtl_years, 5) as minbtl_years, round(cut, 5) as haircut_sharpe, round(1 - cut / sr, 3) as haircut_pct from de left join cut using (log_id)"""
)
def q_deflated_full(spark, sf_dir):
    return _r(S.deflated(trades_li(spark, sf_dir), 20), 5, sr=6, min_trl=2, haircut_pct=3)


BOOT = f""", bn as (select log_id, count(*) as n from trades_li group by log_id), bd as (select log_id, s, floor({U.format(k="'7|' || log_id || '|' || s || '|' || i")} * n)::bigint + 1 as trade_seq from (select log_id, n, s, unnest(range(1, n + 1)) as i from (select log_id, n, unnest(range(0, 4000)) as s from bn))),
bm as (select log_id, s, avg(pnl) as m from bd join trades_li using (log_id, trade_seq) group by log_id, s),
boot as (select log_id, quantile_cont(m, 0.025) as ci_lo, quantile_cont(m, 0.975) as ci_hi, avg((m > 0)::int) as p_positive from bm group by log_id)"""
TRIM = ", trim5 as (select log_id, sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) as pf_trimmed from (select *, row_number() over (partition by log_id order by pnl desc, trade_seq) as r from trades_li) where r > 5 group by log_id)"
WORST = ", wo as (select log_id, abs(min(pnl) filter (pnl < 0)) / abs(avg(pnl) filter (pnl < 0)) as worst_over_avg_loss from trades_li group by log_id)"


@query(
    LI + BOOT + TRIM + WORST + deflated_sql(5) + f""", j as (select log_id, f.trade_count, f.profit_factor, f.sharpe, f.mar, f.expectancy_tstat, p_positive, pf_trimmed, worst_over_avg_loss, psr, dsr from ({ORACLE_SQL["metrics_full"]}) f join boot using (log_id) join trim5 using (log_id) join wo using (log_id) join de using (log_id)),
g as (select log_id,
  case when profit_factor >= 1.75 and sharpe >= 2 then 'A' when profit_factor >= 1.5 and sharpe >= 1.5 then 'B' when profit_factor >= 1.3 and sharpe >= 1 then 'C' when profit_factor >= 1.15 and sharpe >= 0.5 then 'D' else 'F' end as edge,
  case when p_positive >= 0.99 and pf_trimmed >= 1.3 and psr >= 0.95 then 'A' when p_positive >= 0.95 and pf_trimmed >= 1.15 and psr >= 0.9 then 'B' when p_positive >= 0.9 and pf_trimmed >= 1 then 'C' when p_positive >= 0.8 then 'D' else 'F' end as r0, dsr,
  case when mar >= 2 and worst_over_avg_loss <= 4 then 'A' when mar >= 1 and worst_over_avg_loss <= 6 then 'B' when mar >= 0.5 and worst_over_avg_loss <= 8 then 'C' when mar >= 0.25 then 'D' else 'F' end as risk,
  case when trade_count >= 500 and expectancy_tstat >= 3 then 'A' when trade_count >= 300 and expectancy_tstat >= 2.5 then 'B' when trade_count >= 150 and expectancy_tstat >= 2 then 'C' when trade_count >= 75 and expectancy_tstat >= 1.5 then 'D' else 'F' end as sample from j),
h as (select *, case when dsr < 0.5 and r0 in ('A', 'B') then 'C' else r0 end as robustness from g),
p as (select *, 0.3 * (5 - strpos('ABCDF', edge)) + 0.3 * (5 - strpos('ABCDF', robustness)) + 0.2 * (5 - strpos('ABCDF', risk)) + 0.2 * (5 - strpos('ABCDF', sample)) as raw, (5 - strpos('ABCDF', sample))::double as cap from h)
select log_id, edge, robustness, risk, sample, case when least(raw, cap) >= 3.5 then 'A' when least(raw, cap) >= 2.5 then 'B' when least(raw, cap) >= 1.5 then 'C' when least(raw, cap) >= 0.5 then 'D' else 'F' end as overall, round(least(raw, cap), 6) as points, cap < raw as capped_by_sample from p"""
)
def q_scorecard_hashed(spark, sf_dir):
    """The grades with a bootstrap whose draws SQL can repeat."""
    t = trades_li(spark, sf_dir)
    return X.scorecard(M.full(t), X.bootstrap_mean_sql(t, 4000), X.trimmed_pf(t), S.deflated(t, 5))


def _sub(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


@query(
    LI + DAILY + BOOT + CLUSTERS + REGIMES + """, mkp as (select a.log_id, sum(sign(b.pnl - a.pnl))::double as s from trades_li a join trades_li b on a.log_id = b.log_id and b.trade_seq > a.trade_seq group by a.log_id),
mkt as (select log_id, sum(c) as n, sum(c * (c - 1) * (2 * c + 5)) as t from (select log_id, pnl, count(*)::double as c from trades_li group by log_id, pnl) group by log_id),
mkz as (select log_id, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - t) / 18) as mk_z from mkt join mkp using (log_id)),
ba as (select log_id, sum(pnl) as net, avg(pnl) filter (pnl > 0) as aw, avg(pnl) filter (pnl < 0) as al, avg((pnl > 0)::int) as wr, count(*) as k from trades_li group by log_id),
top as (select log_id, sum(greatest(pnl, 0)) as top5 from (select log_id, pnl, row_number() over (partition by log_id order by pnl desc, trade_seq) as r from trades_li) where r <= 5 group by log_id),
rs as (""" + SUMMARY + f""")
select log_id, coalesce(r2 > 0.98 and k < 200, false) as suspiciously_smooth_equity, coalesce(ci_lo <= 0 and ci_hi >= 0, false) as expectancy_ci_straddles_zero, net > 0 and top5 > 0.5 * net as top5_trade_concentration, abs(wr * (1 + aw / abs(al)) - 1) < 0.02 as hugging_breakeven_frontier,
  net > 0 and k >= 20 and buckets >= 3 and best_pnl > 0.5 * net as single_symbol_month_dependency, h.slope < 0 and abs(h.t) > 1.959963984540054 and first_expectancy > 0 and second_expectancy < 0.5 * first_expectancy as edge_decaying_over_log,
  mk_z < -1.959963984540054 as mann_kendall_downtrend, runs_z < -1.959963984540054 as streak_dependence, arch_lm_p < 0.05 or mcleod_li_p < 0.05 as volatility_clustering, regime_dependent as regime_dependent_edge
from ba join top using (log_id) join boot using (log_id) join mkz using (log_id) join clu using (log_id) join rs using (log_id) join {_sub("smooth_equity")} using (log_id) join {_sub("symbol_months")} using (log_id) join {_sub("hac_slope")} h using (log_id) join {_sub("halves")} using (log_id) join {_sub("runs_test")} using (log_id)"""
)
def q_overfit_flags_hashed(spark, sf_dir):
    """The ten flags with a bootstrap whose draws SQL can repeat."""
    t, daily, coded, wins = _coded(spark, sf_dir)
    reg = S.regime_summary(S.regimes(coded, daily, wins))
    return X.flags(M.full(t), X.bootstrap_mean_sql(t, 4000), S.halves(t), S.hac_slope(t), S.mann_kendall(t), S.runs(t), S.smoothness(t), M.symbol_months(t), S.clustering(daily), reg)


def pbo_sql(blocks: int) -> str:
    return f"""with v0 as (select l_shipdate::date as day, p_brand as variant, sum(round((l_discount - 0.049) * l_extendedprice * 0.05, 2)) as pnl from lineitem join part on l_partkey = p_partkey group by all),
per as (select (select count(distinct l_shipdate) from lineitem) // {blocks} as per),
days as (select day, (row_number() over (order by day) - 1) // (select per from per) as b from (select distinct day from v0)),
c as (select d.b, v.variant, sum(coalesce(round(v0.pnl, 2), 0)) as s, sum(power(coalesce(round(v0.pnl, 2), 0), 2)) as q from days d cross join (select distinct variant from v0) v left join v0 on v0.day = d.day and v0.variant = v.variant where d.b < {blocks} group by all),
m as (select range as mask from range({1 << blocks}) where bit_count(range::integer) = {blocks // 2}),
x as (select mask, variant, sum(s) filter ((mask >> b) & 1 = 1) as si, sum(q) filter ((mask >> b) & 1 = 1) as qi, sum(s) filter ((mask >> b) & 1 = 0) as so, sum(q) filter ((mask >> b) & 1 = 0) as qo from m, c group by all),
n as (select {blocks / 2} * (select per from per) as h),
r as (select mask, variant, (si / h) / sqrt((qi - si * si / h) / (h - 1)) as a, (so / h) / sqrt((qo - so * so / h) / (h - 1)) as o from x, n),
k as (select mask, variant, a, o, row_number() over (partition by mask order by a desc, variant) as top, rank() over (partition by mask order by o) as rk, count(*) over (partition by mask) as nv from r),
w as (select rk / (nv + 1.0) as omega, a, o, nv from k where top = 1)
select count(*) as n_splits, round(avg((omega < 0.5)::int) + 0.5 * avg((omega = 0.5)::int), 6) as pbo, round(quantile_cont(ln(omega / (1 - omega)), 0.5), 6) as median_logit, round(regr_slope(o, a), 6) as degradation_slope, round(avg((o < 0)::int), 6) as p_oos_loss, any_value(nv)::bigint as n_variants, {blocks} * (select per from per) as n_days,
  case when round(avg((omega < 0.5)::int) + 0.5 * avg((omega = 0.5)::int), 6) >= 0.5 then 'severe' when round(avg((omega < 0.5)::int) + 0.5 * avg((omega = 0.5)::int), 6) >= 0.2 then 'elevated' else 'low' end as verdict from w"""


@query(pbo_sql(16))
def q_pbo(spark, sf_dir):
    return _r(X.pbo(variants_li(spark, sf_dir), 16))


# --- economics of given paths -------------------------------------------------------------------------

PATHS_SQL = ", pa as (select log_id, (symbol in ('MNQ', 'MES'))::int as cell, trade_seq as path_id, pnl > 0 as passed, 5 + trade_seq % 60 as days_used, trade_seq % 3 as funded_outcome, trade_seq % 200 as funded_end, case when mfe > 60 then round(mfe * 10, 2) else 0 end as withdrawn, case when mfe > 60 then 1 + trade_seq % 3 else 0 end as payouts, trade_seq % 50 as first_payout, round(abs(pnl) * 3, 2) as max_drawdown, trade_seq % 2 as lockouts, case when pnl <= 0 then symbol end as fail_rule, case when log_id % 2 = 0 then 5.0 else 4.5 end as spw from trades_li)"


def given_paths(spark, sf_dir) -> DataFrame:
    """A table of paths made from trades, of the shape that the simulation gives."""
    t, i = trades_li(spark, sf_dir), F.col("trade_seq")
    paid = F.coalesce(F.col("mfe") > 60, F.lit(False))
    return t.select(
        "log_id",
        F.col("symbol").isin("MNQ", "MES").cast("int").alias("cell"),
        i.alias("path_id"),
        (F.col("pnl") > 0).alias("passed"),
        (5 + i % 60).cast("int").alias("days_used"),
        (i % 3).cast("int").alias("funded_outcome"),
        (i % 200).cast("int").alias("funded_end"),
        F.when(paid, F.round(F.col("mfe") * 10, 2)).otherwise(0.0).alias("withdrawn"),
        F.when(paid, 1 + i % 3).otherwise(0).cast("int").alias("payouts"),
        (i % 50).cast("int").alias("first_payout"),
        F.round(F.abs("pnl") * 3, 2).alias("max_drawdown"),
        (i % 2).cast("int").alias("lockouts"),
        F.when(F.col("pnl") <= 0, F.col("symbol")).alias("fail_rule"),
        F.when(F.col("log_id") % 2 == 0, 5.0).otherwise(4.5).alias("sessions_per_week"),
    )


def money_sql(firm: C.Firm) -> str:
    f, p = firm.fees, firm.payout
    kept = 1 - f.payout_haircut
    once = f"{f.one_time}" if f.one_time > 0 else f"{f.monthly} * months"
    back = f"case when payouts >= 1 then {f.one_time * kept} else 0 end" if f.refundable_on_first_payout else "0"
    return f""", m0 as (select *, 21 * spw / 5 as pm, greatest(ceil(days_used / (21 * spw / 5)), 1) as months from pa),
m1 as (select *, {once} + {f.extra_monthly} * months as fee, withdrawn * {p.profit_split} * {kept} as gross, {back} as refund, {f.per_payout} * payouts + {f.extra_monthly} * ceil((funded_end + 1) / pm) as overhead from m0),
m2 as (select *, gross + refund - {f.activation} - overhead as val from m1), m as (select *, -fee + case when passed then val else 0 end as net from m2)"""


QUANTILES = ("05", "25", "50", "75", "95")


def _spread(name: str, value: str, where: str = "true") -> str:
    return ", ".join(f"round(quantile_cont({value}, 0.{q}) filter ({where}), 4) as {name}_{q}" for q in QUANTILES)


@query(
    LI + PATHS_SQL + money_sql(C.PRESETS["ftmo_2step_100k"]) + f""", v as (select log_id, cell, quantile_cont(net, 0.05) as q from m group by all),
tail as (select log_id, cell, avg(net) as cvar from m join v using (log_id, cell) where net <= q group by all),
e as (select log_id, cell, count(*)::double as n, count(*) filter (passed) as k, avg(passed::int) as s from m group by all)
select log_id, cell::bigint as cell, count(*) as n_paths, count(*) filter (passed) as n_passed, round(avg(passed::int), 6) as pass_prob, round(avg(net), 4) as expected_net, round(quantile_cont(net, 0.05), 4) as var_95, round(any_value(cvar), 4) as cvar_95, round(-avg(fee), 4) as ev_eval_fees,
  round(avg(case when passed then gross + refund else 0 end), 4) as ev_payout_value, round(-avg(case when passed then {C.PRESETS["ftmo_2step_100k"].fees.activation} else 0 end) + 0.0, 4) as ev_activation, round(-avg(case when passed then overhead else 0 end) + 0.0, 4) as ev_overheads, round(avg(fee) filter (not passed), 4) as cost_fail, round(avg(fee) filter (passed), 4) as cost_pass,
  round(avg(val), 4) as value_funded, round(avg((payouts >= 1)::int), 6) as p_payout, round(avg((funded_outcome = 2 and payouts < 1)::int), 6) as ruin, round(avg(withdrawn), 4) as mean_withdrawn, round(avg((lockouts > 0)::int), 6) as lockout_rate,
  {_spread("days_to_pass", "days_used", "passed")}, {_spread("days_to_payout", "days_used + first_payout + 1", "passed and payouts >= 1")}, {_spread("drawdown", "max_drawdown")},
  round(any_value(greatest(0, (s + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(s * (1 - s) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n))), 6) as pass_lo,
  round(any_value(least(1, (s + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(s * (1 - s) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n))), 6) as pass_hi
from m join tail using (log_id, cell) join e using (log_id, cell) group by log_id, cell"""
)
def q_economics_of_paths(spark, sf_dir):
    """Probabilities, quantiles, tail mean, interval and expected values of a given table of paths."""
    e = MC.economics(given_paths(spark, sf_dir), C.PRESETS["ftmo_2step_100k"])
    for new, old in (("days_to_pass", "days_to_pass"), ("days_to_payout", "days_to_first_payout"), ("drawdown", "drawdown_quantiles")):
        for i, q in enumerate(QUANTILES):
            e = e.withColumn(f"{new}_{q}", F.get(old, F.lit(i)))
    e = e.drop("days_to_pass", "days_to_first_payout", "drawdown_quantiles", "fresh_value", "cost_any")
    return _r(e, 4, pass_prob=6, p_payout=6, ruin=6, lockout_rate=6, pass_lo=6, pass_hi=6)


@query(LI + PATHS_SQL + ", n as (select log_id, cell, count(*) as n from pa group by all) select log_id, cell::bigint as cell, fail_rule, round(count(*) / any_value(n), 8) as share from pa join n using (log_id, cell) where fail_rule is not null group by log_id, cell, fail_rule")
def q_fail_shares_of_paths(spark, sf_dir):
    return _r(MC.fail_breakdown(given_paths(spark, sf_dir)), 8)


@query(LI + " select log_id, (trade_seq % 25)::bigint as t, count(*) as alive, " + ", ".join(f"round(quantile_cont(pnl, 0.{q}), 6) as p{q}" for q in QUANTILES) + " from trades_li group by log_id, trade_seq % 25")
def q_fan_of_values(spark, sf_dir):
    t = trades_li(spark, sf_dir).select("log_id", F.col("trade_seq").alias("path_id"), (F.col("trade_seq") % 25).cast("int").alias("t"), F.col("pnl").alias("equity"))
    return _r(MC.fan(t))


@query(
    LI + PATHS_SQL + money_sql(C.PRESETS["topstep_50k"]) + f""", o as (select log_id, path_id, net, count(*) over (partition by log_id) as n, row_number() over (partition by log_id order by {U.format(k="'accounts|' || path_id")}, path_id) - 1 as i from m where cell = 1),
ind as (select log_id, (i + j * (n // 3)) % n as i, sum(net) as x from (select *, unnest([0, 1, 2]) as j from o) group by all),
a as (select log_id, quantile_cont(3 * net, 0.05) as q from o group by log_id), b as (select log_id, quantile_cont(x, 0.05) as q from ind group by log_id),
c as (select log_id, avg(3 * net) as ev, avg(3 * net) filter (3 * net <= q) as cv from o join a using (log_id) group by log_id), d as (select log_id, avg(x) as ev, avg(x) filter (x <= q) as cv from ind join b using (log_id) group by log_id)
select c.log_id, round(c.ev, 4) as copied_ev, round(c.cv, 4) as copied_cvar, round(d.ev, 4) as independent_ev, round(d.cv, 4) as independent_cvar from c join d on c.log_id = d.log_id"""
)
def q_accounts_of_paths(spark, sf_dir):
    """Three copied accounts against three independent ones, of given paths."""
    return _r(MC.multi_account(given_paths(spark, sf_dir).where("cell = 1"), C.PRESETS["topstep_50k"], 3), 4)


@query("with " + TRADES_EV_SQL + " select log_id, count(distinct session_date) as n_days, 'stationary' as asked, case when count(distinct session_date) < 30 then 'iid_day' else 'stationary' end as used from trades_ev group by log_id")
def q_samplers(spark, sf_dir):
    """Which sampler each log's simulation really uses."""
    return MC.samplers(trades_ev(spark, sf_dir), C.PRESETS["topstep_50k"])


# --- the path kernel on given draws --------------------------------------------------------------------

N_PATHS, HORIZON, BASE = 40, 80, 4.0
#: Day results are taken so many times, so that paths breach, lock in and pay out.
TIMES = 5.0
_OUT = "log_id bigint, path_id bigint, outcome bigint, end_day bigint, balance double, max_drawdown double, withdrawn double, payouts bigint, first_payout bigint"


def drawn(daily: DataFrame, draws: DataFrame, firm: C.Firm, base: float) -> DataFrame:
    """Per log and path: the funded account of firm run by the kernel on given day draws; a day is one trade with its low, high and close."""
    day = daily.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("day_idx", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("day_pnl", 4).alias("p")))).alias("d"))
    path = draws.groupBy("log_id", "path_id").agg(F.sort_array(F.collect_list(F.struct("t", "day_idx"))).alias("x"))
    terms = K.payout_terms(firm, firm.funded.initial(firm.account_size), 5.0)

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                n = range(len(r.d))
                p = K.Profile.of(list(n), [min(x["lo"], x["p"]) for x in r.d], [max(x["hi"], x["p"]) for x in r.d], [x["p"] for x in r.d], [False] * len(r.d)).scaled(TIMES)
                s = K.simulate(p, np.array([[x["day_idx"] for x in r.x]]), firm.funded, firm, 5.0, payout=terms, base=base)
                rows.append([r.log_id, r.path_id, *(v[0] for v in (s.outcome, s.end_day, s.balance, s.max_drawdown, s.withdrawn, s.payouts, s.first_payout))])
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
            out[["balance", "max_drawdown", "withdrawn"]] += 1e-6  # halves are rounded alike everywhere
            yield out

    return path.join(day, "log_id").mapInPandas(run, _OUT)


def funded_sql(init: float, weight: str, trail: float, cap: float, intraday: bool, floor: str, ladder: str, share: str, least: float, q_count: int, q_profit: float, period: int, may: str, snap: bool, lifetime: int, net: float) -> str:
    """The funded account as a recursion over days; state in columns, one step of the rules a nested select."""
    up = "greatest(hwm, high)" if intraday else "hwm"
    return (
        "with recursive " + W._draws_sql(N_PATHS, HORIZON).removeprefix("with ").replace("round(least(0, min(run)), 4) as lo", "round(least(0, min(run)), 4) as lo, round(greatest(0, max(run)), 4) as hi") + f""",
dd as (select draws.log_id, path_id, t, {TIMES} * p as p, {TIMES} * least(lo, p) as lo, {TIMES} * greatest(hi, p) as hi from draws join daily using (log_id, day_idx)),
st as (select log_id, path_id, -1::bigint as t, {init}::double as bal, {init}::double as hwm, {init}::double as peak, 0.0::double as dd, 0 as outcome, {HORIZON - 1}::bigint as end_day, 0 as qual, 0 as since, 0.0::double as best, {init}::double as anchor, 0.0::double as taken, 0 as k, -1::bigint as fp, false as free from (select distinct log_id, path_id from draws)
union all
select log_id, path_id, t, bal - pay, case when pay > 0 and {str(snap).lower()} then greatest(hwm, {cap} + {trail}) else hwm end, peak - pay, dd, case when pay > 0 and k + 1 >= {lifetime} then 4 else outcome end, case when pay > 0 and k + 1 >= {lifetime} then t else end_day end,
  case when pay > 0 then 0 else qual end, case when pay > 0 then 0 else since end, case when pay > 0 then 0 else best end, case when pay > 0 then bal - pay else anchor end, taken + pay, k + (pay > 0)::int, case when pay > 0 and fp < 0 then t else fp end, free
from (select *, case when live and {may} and least(bal - {floor}, {ladder}, {share}) >= {least} then least(bal - {floor}, {ladder}, {share}) else 0 end as pay
from (select *, bal - anchor as gain from (select * replace (qual + (live and bal - open >= {q_profit})::int as qual, since + live::int as since, case when live then greatest(best, bal - open) else best end as best)
from (select * replace (case when live and not {str(intraday).lower()} then greatest(hwm, bal) else hwm end as hwm, greatest(peak, bal) as peak, greatest(dd, greatest(peak, bal) - bal) as dd, free or bal >= {net} as free)
from (select *, outcome = 0 as live from (select * replace (case when was and outcome = 0 and bal <= least(hwm - {trail}, {cap}) then 2 else outcome end as outcome, case when was and outcome = 0 and bal <= least(hwm - {trail}, {cap}) then t else end_day end as end_day)
from (select * replace (case when hit then 2 else outcome end as outcome, case when hit then t else end_day end as end_day, case when hit then least(bal, least(hwm - {trail}, {cap})) when was then close else bal end as bal)
from (select * , was and low <= least(hwm - {trail}, {cap}) as hit from (select * replace (case when was then {up} else hwm end as hwm, case when was then greatest(dd, greatest(peak, high) - low) else dd end as dd, case when was then greatest(peak, high) else peak end as peak)
from (select *, bal as open, bal + w * lo as low, bal + w * hi as high, bal + w * p as close, outcome = 0 as was from (select st.* replace (dd.t as t), dd.p, dd.lo, dd.hi, {weight} as w from st join dd on dd.log_id = st.log_id and dd.path_id = st.path_id and dd.t = st.t + 1)))))))))))
)
select log_id, path_id, outcome::bigint as outcome, end_day, round(bal + 1e-6, 3) as balance, round(dd + 1e-6, 3) as max_drawdown, round(taken + 1e-6, 3) as withdrawn, k::bigint as payouts, fp as first_payout from st where t = {HORIZON - 1}"""
    )


@query(
    funded_sql(0.0, f"least(1.0, (case when bal >= 2000 then 5 when bal >= 1500 then 3 else 2 end) / {BASE})", 2000.0, 0.0, False, "0.01", "2000.0", "0.5 * bal", 125.0, 5, 150.0, 0, "qual >= 5 and since >= 1 and (k = 0 or gain >= 0.01)", True, 1_000_000, 1e18)
)
def q_funded_on_draws(spark, sf_dir):
    """Trail on closes, contract tiers, a share of the balance, qualifying days, profit since the last payout, floor reset."""
    daily = M.indexed(M.days(trades_li(spark, sf_dir)))
    return _r(drawn(daily, W.draws(daily, N_PATHS, HORIZON, 5.0, 42), C.PRESETS["topstep_50k"], BASE), 3)


@query(
    funded_sql(50_000.0, f"case when free then 1.0 else least(1.0, 0.5 * 10 / {BASE * 2}) end", 2000.0, 50_100.0, True, "greatest(52100.0, least(hwm - 2000.0, 50100.0) + 0.01)", "([1500.0, 2000.0, 2000.0, 2500.0, 3000.0, 3500.0])[least(k, 5) + 1]", "1e18", 500.0, 5, 200.0, 6, "qual >= 5 and since >= 6 and gain > 0 and best < 0.5 * gain", False, 6, 52_100.0)
)
def q_funded_intraday_on_draws(spark, sf_dir):
    """Intraday trail, half size until the safety net, a ladder of caps, the best-day gate, a limited number of payouts."""
    daily = M.indexed(M.days(trades_li(spark, sf_dir)))
    return _r(drawn(daily, W.draws(daily, N_PATHS, HORIZON, 5.0, 42), C.PRESETS["apex40_50k_intraday"], BASE * 2), 3)
