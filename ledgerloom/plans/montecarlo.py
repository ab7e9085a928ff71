"""Monte Carlo of evaluation and funded phases as one Spark job: blocks of paths are rows, grids are key columns.

Draws come from a counter generator keyed by (seed, log, stream, block), so a path's days are the same in every
cell of a grid (common random numbers) and don't depend on partitions. A log's trades are packed into rows of a few
thousand; a task reads those of one log, one after another, and runs its share of the log's blocks. The path kernel
(operators.kernel) gives one row a path, and everything after is aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ContractLimit, Firm, ScalingPlan, SessionClose
from ..errors import ConfigError, LedgerError
from ..functions.contracts import mini_units
from ..operators import kernel as K
from ..operators import metrics as M
from ..operators.replay import close_violations
from ..operators.stress import uniform

BLOCK = 1250
MIN_DAYS = 30
TRADE = np.dtype([("day", "<i4"), ("pnl", "<f8"), ("lo", "<f8"), ("hi", "<f8"), ("lf", "?")])


@dataclass(frozen=True)
class Config:
    n_paths: int = 10_000
    challenge_days: int = 120
    funded_days: int = 252
    bootstrap: str = "stationary"
    block_len: int | None = None
    seed: int = 42
    scale: float = 1.0
    challenge_scale: float | None = None
    funded_scale: float | None = None
    base_contracts: float | None = None
    sizing: str = "fixed"
    vol_lambda: float = 0.94
    vol_target: float | None = None
    vol_clip: tuple[float, float] = (0.5, 1.5)
    cushion_clip: tuple[float, float] = (0.25, 1.5)
    payout_policy: str = "asap"
    keep_buffer: float = 0.0
    payout_path: str | None = None
    extract_weight: float | None = None

    def __post_init__(self):
        def need(ok, why):
            if not ok:
                raise ConfigError(why)

        for k in ("n_paths", "challenge_days", "funded_days"):
            need(isinstance(getattr(self, k), int) and getattr(self, k) >= 1, f"{k} is a positive count")
        need(self.bootstrap in ("stationary", "iid_day", "iid_trade"), f"unknown bootstrap {self.bootstrap!r}")
        need(self.block_len is None or self.block_len >= 1, "block_len is a positive count")
        need(self.sizing in ("fixed", "vol_target", "cushion"), f"unknown sizing {self.sizing!r}")
        for k in ("scale", "challenge_scale", "funded_scale", "base_contracts", "vol_target"):
            v = getattr(self, k)
            need(v is None or (math.isfinite(v) and v > 0), f"{k} must be finite and positive")
        need(0 < self.vol_lambda < 1, "vol_lambda is in (0, 1)")
        for lo, hi in (self.vol_clip, self.cushion_clip):
            need(0 < lo <= hi < math.inf, "a clip is a finite 0 < low <= high")
        need(self.payout_policy in ("asap", "keep_buffer"), f"unknown payout policy {self.payout_policy!r}")
        need(self.payout_path in (None, "standard", "consistency"), f"unknown payout path {self.payout_path!r}")
        need(math.isfinite(self.keep_buffer) and self.keep_buffer >= 0, "keep_buffer is at least 0")
        need(self.extract_weight is None or 0 < self.extract_weight <= 1, "extract_weight is in (0, 1]")


# --- profiles -----------------------------------------------------------------------------------


def profiles(trades: DataFrame, firm: Firm) -> DataFrame:
    """(log_id, part, data, base): each log's trades in order, some thousands packed in a row, so no row grows with its log.

    base, the greatest quantity open at once, is null where no phase scales contracts.
    """
    w = Window.partitionBy("log_id").orderBy("trade_seq")  # deals and sorts: rows reach the function log by log, in order
    t = trades.select("log_id", F.row_number().over(w).alias("i"), F.unix_date(firm.day_boundary.date("exit_time")).alias("day"), "pnl", "mae", "mfe")

    def pack(frames):
        for f in frames:
            log = f["log_id"].to_numpy()
            pnl, mae, mfe = (f[c].to_numpy(float) for c in ("pnl", "mae", "mfe"))
            x = np.empty(len(f), TRADE)
            x["day"], x["pnl"] = f["day"].to_numpy(), pnl
            x["lo"] = np.where(np.isnan(mae), pnl, np.minimum(mae, pnl))
            x["hi"] = np.where(np.isnan(mfe), pnl, np.maximum(mfe, pnl))
            x["lf"] = ~np.isnan(mae) & np.isnan(mfe)
            at = np.concatenate([[0], np.flatnonzero(log[1:] != log[:-1]) + 1, [len(f)]]) if len(f) else [0]
            yield pd.DataFrame({"log_id": log[at[:-1]], "part": f["i"].to_numpy()[at[:-1]], "data": [x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]})

    p = t.mapInPandas(pack, "log_id bigint, part int, data binary")
    if not any(ph.one(ScalingPlan) for ph in (*firm.phases, firm.funded)):
        return p.withColumn("base", F.lit(None).cast("double"))
    limit = next((c for ph in (*firm.phases, firm.funded) for c in ph.of(ContractLimit)), None)
    units = mini_units(limit.micros_multiplier) if limit else F.abs("quantity")
    return p.join(M.peak_exposure(trades, units).select("log_id", F.col("peak_exposure").cast("double").alias("base")), "log_id")


def cadence_of(days: np.ndarray) -> float:
    """Sessions a complete Monday-to-Sunday week of day numbers since 1970-01-01 (a Thursday); 5 where under two weeks are complete."""
    d = np.unique(days)
    first = int(d[0]) + (4 - int(d[0])) % 7
    weeks = (int(d[-1]) - first + 1) // 7
    inside = ((d >= first) & (d < first + 7 * weeks)).sum() if weeks > 0 else 0
    return min(7.0, inside / weeks) if weeks >= 2 and inside else M.DEFAULT_CADENCE


def samplers(trades: DataFrame, firm: Firm, cfg: Config = Config()) -> DataFrame:
    """Per log: source days, the sampler asked for and the one used; under MIN_DAYS days there are no blocks to resample, so days come one by one."""
    n = trades.groupBy("log_id").agg(F.count_distinct(firm.day_boundary.date("exit_time")).alias("n_days"))
    used = F.when((F.lit(cfg.bootstrap) == "stationary") & (F.col("n_days") < MIN_DAYS), "iid_day").otherwise(cfg.bootstrap)
    return n.select("log_id", "n_days", F.lit(cfg.bootstrap).alias("asked"), used.alias("used"))


def screen(trades: DataFrame, firm: Firm) -> None:
    """Refuses logs whose trades break a session close: resampling such days would count what can't happen."""
    for ph in (*firm.phases, firm.funded):
        rule = ph.one(SessionClose)
        if rule:
            bad = close_violations(trades, firm, rule).where("violations > 0").agg(F.count("*"), F.sum("violations")).first()
            if bad[0]:
                raise LedgerError(f"{bad[1]} trade(s) in {bad[0]} log(s) are open past the session close of phase {ph.name!r}; the simulation can't replay clock rules")
            return


# --- a block ------------------------------------------------------------------------------------

_PATH = "log_id bigint, cell int, path_id bigint, passed boolean, days_used int, outcome int, end_day int, funded_outcome int, funded_end int, withdrawn double, payouts int, first_payout int, max_drawdown double, funded_drawdown double, lockouts int, fail_rule string, final_balance double, sessions_per_week double"


def _generator(seed: int, log_id: int, stream: int, block: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[(seed << 32) + stream, (int(log_id) << 32) + block & (1 << 63) - 1]))


def _iid_trades(p: K.Profile, pnls: np.ndarray, parts: tuple, rng: np.random.Generator, days: int = 1000) -> K.Profile:
    """Synthetic days: the log's day sizes resampled, filled with resampled trades (excursions relative to each trade)."""
    lo, hi, lf = parts
    n = rng.choice(p.n, days)
    pick = rng.integers(0, len(pnls), int(n.sum()))
    day = np.repeat(np.arange(days), n)
    run = np.cumsum(pnls[pick])
    start = np.concatenate([[0.0], run[np.cumsum(n)[:-1] - 1]])
    before = run - pnls[pick] - np.repeat(start, n)
    return K.Profile.of(day, before + lo[pick], before + hi[pick], before + pnls[pick], lf[pick])


def _sized(p: K.Profile, cfg: Config, scale: float, base: float | None):
    """The profile at a scale, its volatility target, and the contracts that stand for full size there."""
    q = p.scaled(scale) if scale != 1 else p
    vol = K.VolTarget(cfg.vol_target or K.auto_target(q.day_pnl, cfg.vol_lambda), cfg.vol_lambda, *cfg.vol_clip) if cfg.sizing == "vol_target" else None
    return q, vol, base * scale if base else None


def run_block(p: K.Profile, firm: Firm, cfg: Config, n: int, seed: tuple, per_week: float, base: float | None) -> dict[str, np.ndarray]:
    """n paths through all phases and the funded account; one array a column."""
    block = None
    if cfg.bootstrap == "stationary" and p.days >= MIN_DAYS:
        block = cfg.block_len or K.auto_block(p.day_pnl)
    c_scale, f_scale = cfg.challenge_scale or cfg.scale, cfg.funded_scale or cfg.scale
    base = cfg.base_contracts or base
    clip = cfg.cushion_clip if cfg.sizing == "cushion" else None

    sized = lambda scale: _sized(p, cfg, scale, base)

    passed, used, going = np.ones(n, bool), np.zeros(n, int), np.ones(n, bool)
    lockouts, dd = np.zeros(n, int), np.zeros(n)
    rule = np.full(n, None, object)
    q, vol, size = sized(c_scale)
    for i, ph in enumerate(firm.phases):
        idx = K.draw_days(_generator(*seed[:2], i, seed[2]), p.days, n, cfg.challenge_days, block)
        r = K.simulate(q, idx, ph, firm, per_week, vol=vol, cushion=clip, base=size)
        used = np.where(going, used + r.end_day + 1, used)
        for k, name in enumerate(r.names):
            rule[going & (r.fail_rule == k)] = name
        if i == 0:
            first = r
        lockouts += np.where(going, r.lockout_days, 0)
        dd = np.maximum(dd, np.where(going, r.max_drawdown, 0))
        passed &= r.passed
        going &= r.passed
    q, vol, size = sized(f_scale)
    idx = K.draw_days(_generator(*seed[:2], 100, seed[2]), p.days, n, cfg.funded_days, block)
    terms = K.payout_terms(firm, firm.funded.initial(firm.account_size), per_week, cfg.keep_buffer if cfg.payout_policy == "keep_buffer" else 0.0, cfg.payout_path)
    f = K.simulate(q, idx, firm.funded, firm, per_week, payout=terms, vol=vol, cushion=clip, base=size, extract=cfg.extract_weight)
    return {
        "passed": passed, "days_used": used, "outcome": first.outcome, "end_day": first.end_day, "funded_outcome": f.outcome, "funded_end": f.end_day,
        "withdrawn": f.withdrawn, "payouts": f.payouts, "first_payout": f.first_payout, "max_drawdown": dd, "funded_drawdown": f.max_drawdown,
        "lockouts": lockouts, "fail_rule": rule, "final_balance": f.balance,
    }


@dataclass
class Source:
    """A log as the kernel needs it."""

    log_id: int
    profile: K.Profile
    trades: np.ndarray | None  # as they are packed, where single ones are drawn
    per_week: float
    base: float | None

    @classmethod
    def each(cls, frames, key: tuple[str, ...], whole: bool = False):
        """(first row, Source) of each run of rows of one key; rows come key by key, parts in order."""
        first, at, days, levels, kept, carry = None, None, [], [], [], (None, 0.0)

        def done():
            day = np.concatenate(days)
            p = K.Profile.of(np.unique(day, return_inverse=True)[1], *(np.concatenate(x) for x in zip(*levels)))
            base = None if first.base is None or math.isnan(first.base) else first.base
            return first, cls(first.log_id, p, np.concatenate(kept) if whole else None, cadence_of(day), base)

        for f in frames:
            for r in f.itertuples(index=False):
                now = tuple(getattr(r, k) for k in key)
                if now != at:
                    if at is not None:
                        yield done()
                    first, at, days, levels, kept, carry = r._replace(data=None), now, [], [], [], (None, 0.0)
                x = np.frombuffer(r.data, TRADE)
                before, carry = _before(x["day"], x["pnl"], *carry)
                days.append(x["day"].copy())
                levels.append((before + x["lo"], before + x["hi"], before + x["pnl"], x["lf"].copy()))
                if whole:
                    kept.append(x)
        if at is not None:
            yield done()


def _before(day: np.ndarray, pnl: np.ndarray, last: int | None, run: float) -> tuple[np.ndarray, tuple[int, float]]:
    """The day's running sum before each trade, and what the next part goes on from; sums start anew each day."""
    first = np.flatnonzero(np.concatenate([[True], day[1:] != day[:-1]]))
    out = np.empty(len(day))
    for n, (i, j) in enumerate(zip(first, [*first[1:], len(day)])):
        run = np.cumsum(np.concatenate([[run if n == 0 and day[0] == last else 0.0], pnl[i:j]]))
        out[i:j], run = run[:-1], run[-1]
    return out, (day[-1], run)


def paths(trades: DataFrame, firm: Firm, cells: list[Config], outer: list[int] | None = None, logs: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """A row a log, cell and path. cells are the grid; outer ids, where given, resample the source days first (one cell each).

    days, where given, is (log_id, day): only those days are source days.
    """
    prof = logs if logs is not None else profiles(trades, firm)
    if days is not None:
        prof = prof.join(days.groupBy("log_id").agg(F.collect_set("day").alias("keep")), "log_id")
    ids = outer if outer is not None else [-1]
    size = BLOCK
    blocks = math.ceil(max(c.n_paths for c in cells) / size)
    work = [(i, o, b) for i in range(len(cells)) for o in ids for b in range(blocks) if cells[i].n_paths > b * size]
    # a log is sent as often as it takes to keep the cores busy, not once a block
    many = max(trades.select("log_id").distinct().count(), 1)
    width = 2 * trades.sparkSession.sparkContext.defaultParallelism
    shares = min(len(work), -(-width // many))
    todo = _dealt(prof.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), min(many * shares, width), "log_id", "share")
    names = [c.split()[0] for c in _PATH.split(", ")]
    subset, single = days is not None, any(c.bootstrap == "iid_trade" for c in cells)

    def run(frames):
        for first, s in Source.each(frames, ("log_id", "share"), single):
            source = s.profile.rows(np.sort(np.asarray(first.keep, int))) if subset else s.profile
            for i, o, b in work[first.share :: shares]:
                cfg, p = cells[i], source
                n = min(size, cfg.n_paths - b * size)
                if o >= 0:
                    rng = _generator(cfg.seed, s.log_id, 1000 + o, 0)
                    block = (cfg.block_len or K.auto_block(p.day_pnl)) if p.days >= MIN_DAYS else None
                    p = p.rows(K.draw_days(rng, p.days, 1, p.days, block)[0])
                if cfg.bootstrap == "iid_trade":
                    t = s.trades
                    p = _iid_trades(p, t["pnl"], (t["lo"], t["hi"], t["lf"]), _generator(cfg.seed, s.log_id, 900, 0))
                out = run_block(p, firm, cfg, n, (cfg.seed, s.log_id, b), s.per_week, s.base)
                yield pd.DataFrame({"log_id": s.log_id, "cell": i if o < 0 else o, "path_id": b * size + np.arange(n), "sessions_per_week": s.per_week} | out)[names]

    return todo.mapInPandas(run, _PATH)


def _dealt(prof: DataFrame, keys: int, *key: str) -> DataFrame:
    """Packed logs, each key's rows in one partition and in order; three partitions a key, so that few share one."""
    return prof.repartition(max(3 * keys, 1), *key).sortWithinPartitions(*key, "part")


# --- economics ------------------------------------------------------------------------------------


def with_money(p: DataFrame, firm: Firm) -> DataFrame:
    """Paths with fees, value and net of each."""
    fees, pay = firm.fees, firm.payout
    j = p.withColumn("per_month", 21.0 * F.col("sessions_per_week") / 5.0)
    months = F.greatest(F.ceil(F.col("days_used") / F.col("per_month")), F.lit(1)).cast("double")
    base = F.lit(float(fees.one_time)) if fees.one_time > 0 else fees.monthly * months
    j = j.withColumn("attempt_fees", base + fees.extra_monthly * months)
    kept = 1.0 - fees.payout_haircut
    j = j.withColumn("gross", F.col("withdrawn") * pay.profit_split * kept)
    refund = F.when(F.col("payouts") >= 1, F.lit(fees.one_time * kept)).otherwise(0.0) if fees.refundable_on_first_payout else F.lit(0.0)
    overhead = fees.per_payout * F.col("payouts") + fees.extra_monthly * F.ceil((F.col("funded_end") + 1) / F.col("per_month"))
    j = j.withColumn("refund", refund).withColumn("overhead", overhead.cast("double"))
    j = j.withColumn("funded_value", F.col("gross") + F.col("refund") - fees.activation - F.col("overhead"))
    return j.withColumn("net", -F.col("attempt_fees") + F.when(F.col("passed"), F.col("funded_value")).otherwise(0.0))


def economics(p: DataFrame, firm: Firm) -> DataFrame:
    """Per log and cell: probabilities, quantiles, expected values and their exact parts."""
    m = with_money(p, firm)
    ok = F.col("passed")
    got = F.col("payouts") >= 1
    # the tail mean needs the quantile first: both come from the sorted nets of a cell, paths a cell being bounded by the configuration
    part = lambda c: F.avg(F.when(ok, c).otherwise(0.0))
    quantiles = F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))
    g = m.groupBy("log_id", "cell").agg(
        F.count("*").alias("n_paths"),
        F.count_if(ok).alias("n_passed"),
        F.avg(ok.cast("double")).alias("pass_prob"),
        F.avg("net").alias("expected_net"),
        F.percentile("net", F.lit(0.05)).alias("var_95"),
        F.collect_list("net").alias("_nets"),
        (-F.avg("attempt_fees")).alias("ev_eval_fees"),
        part(F.col("gross") + F.col("refund")).alias("ev_payout_value"),
        (-part(F.lit(float(firm.fees.activation)))).alias("ev_activation"),
        (-part(F.col("overhead"))).alias("ev_overheads"),
        F.avg(F.when(~ok, F.col("attempt_fees"))).alias("cost_fail"),
        F.avg(F.when(ok, F.col("attempt_fees"))).alias("cost_pass"),
        F.avg("attempt_fees").alias("cost_any"),
        F.avg("funded_value").alias("value_funded"),
        F.avg(F.col("gross") - firm.fees.per_payout * F.col("payouts")).alias("fresh_value"),
        F.avg(got.cast("double")).alias("p_payout"),
        F.avg(((F.col("funded_outcome") == K.BREACHED) & ~got).cast("double")).alias("ruin"),
        F.avg("withdrawn").alias("mean_withdrawn"),
        F.percentile(F.when(ok, F.col("days_used")), quantiles).alias("days_to_pass"),
        F.percentile(F.when(ok & got, F.col("days_used") + F.col("first_payout") + 1), quantiles).alias("days_to_first_payout"),
        F.percentile("max_drawdown", quantiles).alias("drawdown_quantiles"),
        F.avg((F.col("lockouts") > 0).cast("double")).alias("lockout_rate"),
    )
    low = F.filter("_nets", lambda x: x <= F.col("var_95"))
    g = g.withColumn("cvar_95", F.aggregate(F.array_sort(low), F.lit(0.0), lambda a, x: a + x) / F.size(low)).drop("_nets")
    n, k, z = F.col("n_paths").cast("double"), F.col("n_passed").cast("double"), 1.959963984540054
    share = k / n
    mid, den = share + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return g.withColumn("pass_lo", F.greatest((mid - half) / den, F.lit(0.0))).withColumn("pass_hi", F.least((mid + half) / den, F.lit(1.0)))


def campaign(row: dict, firm: Firm) -> dict:
    """Closed forms on one row of economics: value of up to five tries, cost to get funded, value of reactivation."""
    fees, p = firm.fees, row["pass_prob"]
    fail = row["cost_fail"] if row["cost_fail"] is not None else row["cost_any"]
    win = row["cost_pass"] if row["cost_pass"] is not None else row["cost_any"]
    full = fees.monthly or fees.one_time
    off = full - fees.reset if full > 0 and fees.reset > 0 else 0.0
    refail, rewin = max(fail - off, 0.0), max(win - off, 0.0)
    value = row["value_funded"]
    revalue = value - (off * row["p_payout"] * (1 - fees.payout_haircut) if fees.refundable_on_first_payout and fees.one_time > 0 else 0.0)
    ev, spent, total = {}, 0.0, 0.0
    for k in range(1, 6):
        total += (1 - p) ** (k - 1) * p * ((value - win if k == 1 else revalue - rewin) - spent)
        spent += fail if k == 1 else refail
        ev[k] = total - (1 - p) ** k * spent
    out = {"ev_with_resets": ev, "cost_to_funded": p * win + (1 - p) * (fail + refail * (1 - p) / p + rewin) if p > 0 else math.inf}
    r = firm.payout.reactivations
    if r.max and r.fees:
        steps = [r.fees[min(i, len(r.fees) - 1)] for i in range(r.max)]
        up = sum(row["ruin"] ** (i + 1) * max(row["fresh_value"] - f, 0.0) for i, f in enumerate(steps))
        out["reactivation"] = {"uplift_per_funded": up, "uplift_per_attempt": p * up, "worth_it": row["fresh_value"] > min(steps)}
    return out


def fail_breakdown(p: DataFrame) -> DataFrame:
    """Per log and cell: share of all paths that each rule ended."""
    k = p.groupBy("log_id", "cell", "fail_rule").agg(F.count("*").alias("k"))  # a few rows a cell; paths are run once
    k = k.withColumn("n", F.sum("k").over(Window.partitionBy("log_id", "cell")))
    return k.where("fail_rule is not null").select("log_id", "cell", "fail_rule", (F.col("k") / F.col("n")).alias("share"))


def run(trades: DataFrame, firm: Firm, cfg: Config = Config()) -> DataFrame:
    """The simulation of every log: a row a log."""
    screen(trades, firm)
    prof = profiles(trades, firm)
    return economics(paths(trades, firm, [cfg], logs=prof), firm)


def samples(trades: DataFrame, firm: Firm, cfg: Config = Config(), keep: int = 200) -> DataFrame:
    """(log_id, path_id, t, equity) of the first `keep` funded paths at each day's end, after payouts; none once a path is over."""
    prof = profiles(trades, firm)
    keep = min(keep, cfg.n_paths, BLOCK)

    def run(frames):
        for _, s in Source.each(frames, ("log_id",)):
            block = (cfg.block_len or K.auto_block(s.profile.day_pnl)) if cfg.bootstrap == "stationary" and s.profile.days >= MIN_DAYS else None
            n = min(BLOCK, cfg.n_paths)  # the same block of draws as the simulation's first
            idx = K.draw_days(_generator(cfg.seed, s.log_id, 100, 0), s.profile.days, n, cfg.funded_days, block)[:keep]
            q, vol, size = _sized(s.profile, cfg, cfg.funded_scale or cfg.scale, cfg.base_contracts or s.base)
            terms = K.payout_terms(firm, firm.funded.initial(firm.account_size), s.per_week, cfg.keep_buffer if cfg.payout_policy == "keep_buffer" else 0.0, cfg.payout_path)
            clip = cfg.cushion_clip if cfg.sizing == "cushion" else None
            x = K.simulate(q, idx, firm.funded, firm, s.per_week, payout=terms, vol=vol, cushion=clip, base=size, extract=cfg.extract_weight, keep_samples=keep).samples
            path, t = np.nonzero(~np.isnan(x))
            yield pd.DataFrame({"log_id": s.log_id, "path_id": path, "t": t, "equity": x[path, t]})

    return _dealt(prof, 2 * trades.sparkSession.sparkContext.defaultParallelism, "log_id").mapInPandas(run, "log_id bigint, path_id bigint, t int, equity double")


def fan(kept: DataFrame) -> DataFrame:
    """Per log and day: how many kept paths are alive and the quantiles of their equity."""
    q = F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))
    g = kept.groupBy("log_id", "t").agg(F.count("*").alias("alive"), F.percentile("equity", q).alias("q"))
    return g.select("log_id", "t", "alive", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])


# --- grids ------------------------------------------------------------------------------------------

SCALES = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
BUFFERS, EXTRACTS = (0.0, 1000.0, 2000.0, 4000.0), (None, 0.5)


def frontier(trades: DataFrame, firm: Firm, cfg: Config = Config(n_paths=2000), scales=SCALES, ruin_cap: float = 0.5) -> DataFrame:
    """Per log and scale: economics, whether it has the best EV, and whether it is the largest within the ruin cap."""
    screen(trades, firm)
    prof = profiles(trades, firm)
    e = economics(paths(trades, firm, [replace(cfg, scale=s) for s in scales], logs=prof), firm)
    e = e.withColumn("scale", F.element_at(F.array(*map(F.lit, scales)), F.col("cell") + 1))
    w = Window.partitionBy("log_id")
    best = F.max_by("cell", F.struct("expected_net", -F.col("cell"))).over(w)
    safe = F.max(F.when(F.col("ruin") <= ruin_cap, F.col("scale"))).over(w)
    return e.withColumn("best_ev", F.col("cell") == best).withColumn("largest_safe", F.coalesce(F.col("scale") == safe, F.lit(False)))


def policies(trades: DataFrame, firm: Firm, cfg: Config = Config(n_paths=2000), buffers=BUFFERS, extracts=EXTRACTS) -> DataFrame:
    """Per log, buffer and extraction weight: economics; best EV and lowest ruin are marked, inert axes too."""
    screen(trades, firm)
    prof = profiles(trades, firm)
    grid = [(b, x) for b in buffers for x in extracts]
    cells = [replace(cfg, payout_policy="keep_buffer" if b else "asap", keep_buffer=b, extract_weight=x) for b, x in grid]
    e = economics(paths(trades, firm, cells, logs=prof), firm)
    keys = trades.sparkSession.createDataFrame([(i, float(b), None if x is None else float(x)) for i, (b, x) in enumerate(grid)], "cell int, keep_buffer double, extract_weight double")
    e = e.join(F.broadcast(keys), "cell")
    w = Window.partitionBy("log_id")
    e = e.withColumn("best_ev", F.col("cell") == F.max_by("cell", F.struct("expected_net", -F.col("cell"))).over(w))
    e = e.withColumn("least_ruin", F.col("cell") == F.min_by("cell", F.struct("ruin", "cell")).over(w))
    same = lambda by: F.min("expected_net").over(Window.partitionBy("log_id", by)) == F.max("expected_net").over(Window.partitionBy("log_id", by))
    e = e.withColumn("_b", same(F.coalesce("extract_weight", F.lit(-1.0)))).withColumn("_x", same("keep_buffer"))
    return e.withColumn("buffer_inert", F.bool_and("_b").over(w)).withColumn("extract_inert", F.bool_and("_x").over(w)).drop("_b", "_x")


def uncertainty(trades: DataFrame, firm: Firm, cfg: Config = Config(n_paths=500), outer: int = 100) -> DataFrame:
    """Per log: what the source sample alone leaves open: quantiles over outer resamples of the source days, one job."""
    prof = profiles(trades, firm)
    e = economics(paths(trades, firm, [cfg], outer=list(range(outer)), logs=prof), firm)
    q = F.array(*map(F.lit, (0.05, 0.5, 0.95)))
    g = e.groupBy("log_id").agg(F.count("*").alias("n_outer"), F.percentile("pass_prob", q).alias("p"), F.percentile("expected_net", q).alias("ev"))
    return g.select("log_id", "n_outer", *[F.col("p")[i].alias(f"pass_{n}") for i, n in enumerate(("lo", "mid", "hi"))], *[F.col("ev")[i].alias(f"ev_{n}") for i, n in enumerate(("lo", "mid", "hi"))], (F.col("p")[2] - F.col("p")[0] > 0.2).alias("wide"))


def multi_account(p: DataFrame, firm: Firm, k: int) -> DataFrame:
    """Per log: k copies of one account against the sum of k independent ones, by expected net and CVaR.

    Copies lose together: k times the path. Independent accounts are k paths a fixed hash apart.
    """
    m = with_money(p, firm).select("log_id", "path_id", "net")
    n = m.groupBy("log_id").agg(F.count("*").alias("n"))
    m = m.join(n, "log_id").withColumn("i", F.row_number().over(Window.partitionBy("log_id").orderBy(uniform(F.lit("accounts"), "path_id"), "path_id")) - 1)
    ind = m.select("log_id", "i", "n", "net", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    ind = ind.groupBy("log_id", F.pmod(F.col("i") + F.col("j") * F.floor(F.col("n") / k), F.col("n")).alias("i")).agg(F.sum("net").alias("x"))

    def tail(d: DataFrame, c: str, name: str) -> DataFrame:
        q = d.groupBy("log_id").agg(F.percentile(c, F.lit(0.05)).alias("q"), F.avg(c).alias(f"{name}_ev"))
        return d.join(q, "log_id").groupBy("log_id").agg(F.first(f"{name}_ev").alias(f"{name}_ev"), F.avg(F.when(F.col(c) <= F.col("q"), F.col(c))).alias(f"{name}_cvar"))

    return tail(m.withColumn("x", F.col("net") * k), "x", "copied").join(tail(ind, "x", "independent"), "log_id")
