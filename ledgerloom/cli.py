"""Command line: python -m ledgerloom.cli COMMAND ... ; a mistake of the user's ends with one line and exit code 1."""

from __future__ import annotations

import argparse
import sys

from .errors import LedgerError


def _spark():
    from . import session

    s = session.build()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _log(spark, path: str):
    from .sources import files

    return files.read_log(spark, path) if not path.endswith(".csv") else files.read_trades_csv(spark, path).rows


def _firm(a):
    from . import config as C

    f = C.with_options(C.load_firm(a.firm), getattr(a, "dll", False), getattr(a, "pdll", None), getattr(a, "promo_caps", False))
    return C.with_fees(f, extra_monthly=a.extra_monthly, per_payout=a.per_payout_fee, payout_haircut=a.payout_haircut)


def _config(a, paths: int | None = None):
    from .plans.montecarlo import Config

    return Config(
        n_paths=paths or a.paths, challenge_days=a.challenge_horizon, funded_days=a.funded_horizon, bootstrap=a.bootstrap, block_len=a.block_len, seed=a.seed, scale=a.scale, challenge_scale=a.challenge_scale,
        funded_scale=a.funded_scale, base_contracts=a.base_contracts, sizing=a.sizing, vol_lambda=a.vol_lambda, vol_target=a.vol_target, vol_clip=tuple(a.vol_clip), cushion_clip=tuple(a.cushion_clip),
        payout_policy="keep_buffer" if a.keep_buffer else "asap", keep_buffer=a.keep_buffer, payout_path=a.payout_path, extract_weight=a.extract,
    )


def _show(a, sections: dict, title: str) -> None:
    from .report import render as R

    data = {k: R.records(v) if hasattr(v, "limit") else v for k, v in sections.items()}
    for k, v in data.items():
        print(R.table(v, k) if isinstance(v, list) and v and isinstance(v[0], dict) else f"{k}: {v}\n")
    if getattr(a, "json", None):
        R.save(a.json, R.to_json(data))
    if getattr(a, "html", None):
        parts = [(k, R.table(v)) for k, v in data.items() if isinstance(v, list)]
        for row in data.get("simulation") or []:
            parts.append((f"expected value of log {row['log_id']}", R.bars_svg(R.waterfall(row))))
        R.save(a.html, R.page(title, parts))


# --- commands --------------------------------------------------------------------------------------------


def ingest_trades(a):
    from .sources import files
    from .sources.mapping import from_pairs, from_yaml

    given = (from_yaml(a.mapping) if a.mapping else {}) | from_pairs(a.map or [])
    r = files.read_trades_csv(_spark(), a.csv, given or None)
    files.write_log(r.rows, a.output or a.csv.rsplit(".", 1)[0], a.currency)
    print(f"{r.rows.count()} trade(s), {r.rejects.count()} row(s) left out; columns: {r.columns}")
    for x in r.rejects.limit(10).collect():
        print(f"  row {x['row']}: {x['reason']}")
    for w in r.warnings:
        print(f"  note: {w}")


def ingest_ohlcv(a):
    from .sources import files

    r = files.read_bars_csv(_spark(), a.csv, a.tz)
    files.write_bars_csv(r.rows, a.output or f"{a.symbol.lower()}-bars")
    print(f"{r.rows.count()} bar(s) of {a.symbol}, {r.rejects.count()} row(s) left out, {files.weekday_gaps(r.rows).count()} weekday(s) without bars")


def ingest_results(a):
    from .sources import files

    s = _spark()
    r = files.read_result_trades(s, a.file)
    files.write_log(r.rows, a.output or a.file.rsplit(".", 1)[0], source="backtest")
    print(f"{r.rows.count()} trade(s), {r.rejects.count()} left out, {files.read_result_equity(s, a.file).count()} equity mark(s)")


def metrics(a):
    from .operators import metrics as M
    from .operators import stress as X

    t = _log(_spark(), a.trades)
    _show(a, {"metrics": M.full(t, equity=a.equity).join(X.bootstrap_mean(t), "log_id")}, "metrics")


def verdict(a):
    from .plans import reality

    _show(a, reality.verdict(_log(_spark(), a.trades), a.trials, a.equity).tables, "verdict")


def stress(a):
    from .plans import reality
    from .sources import files

    s = _spark()
    values = {k: v for k, v in (("tick_value", a.tick_value), ("commission", a.commission)) if v is not None}
    bars = files.read_bars_csv(s, a.ohlcv).rows if a.ohlcv else None
    p = reality.reality_check(_log(s, a.trades), _firm(a) if a.firm else None, _config(a) if a.firm else None, a.trials, a.stop_slip, a.oos_start, bars, a.ruin_capital, a.outer, a.inner, a.window, **values)
    _show(a, {k: v for k, v in p.tables.items() if k != "rolling"}, "reality check")


def report(a):
    from .plans import montecarlo as MC
    from .plans import reality

    s = _spark()
    t, firm = _log(s, a.trades), _firm(a)
    sim = MC.run(t, firm, _config(a))
    sections = reality.verdict(t, a.trials, a.equity or firm.account_size, firm.day_boundary).tables | {"simulation": sim, "campaign": [{"log_id": r["log_id"]} | MC.campaign(r.asDict(), firm) for r in sim.collect()]}
    if not a.no_reality:
        sections |= {k: v for k, v in reality.reality_check(t, firm, _config(a, 2000), a.trials, outer=a.outer, inner=a.inner).tables.items() if k != "rolling"}
    _show(a, sections, "report")


def pbo(a):
    from .operators.stress import pbo as run
    from .sources import files

    _show(a, {"overfitting": run(files.read_variants_csv(_spark(), a.variants), a.partitions, a.seed)}, "overfitting")


def firms_list(a):
    from .config import PRESETS

    for n, f in sorted(PRESETS.items()):
        print(f"{n:24} {f.account_size:>10,.0f}  target {f.phases[0].profit_target:,.0f}")


def firms_show(a):
    import dataclasses
    import pprint

    from .config import load_firm

    pprint.pprint(dataclasses.asdict(load_firm(a.name)), sort_dicts=False, width=120)


def prop_evaluate(a):
    from .operators import metrics as M
    from .operators import replay as R
    from .sources import files

    s = _spark()
    t, firm = _log(s, a.trades), _firm(a)
    sections = {"replay": R.evaluate(t, firm, a.phase, base=M.peak_exposure(t))}
    if a.equity_csv:
        m = R.check_marks(files.read_marks_csv(s, a.equity_csv), firm, a.phase or firm.phases[0].name)
        sections["marks"] = m
        one, two = sections["replay"].first(), m.first()
        if one and two and (one["outcome"] == "breached") != two["breached"]:
            sections["note"] = "the trade record and the equity marks disagree on a breach; marks see what closed trades can't"
    _show(a, sections, "replay")


def prop_simulate(a):
    from .plans import montecarlo as MC

    t, firm, cfg = _log(_spark(), a.trades), _firm(a), _config(a)
    MC.screen(t, firm)
    p = MC.paths(t, firm, [cfg])
    sim = MC.economics(p, firm)
    out = {"simulation": sim, "failed_by": MC.fail_breakdown(p), "campaign": [{"log_id": r["log_id"]} | MC.campaign(r.asDict(), firm) for r in sim.collect()]}
    if a.accounts > 1:
        out["accounts"] = MC.multi_account(p, firm, a.accounts)
    _show(a, out, "simulation")


def prop_frontier(a):
    from .plans import montecarlo as MC

    _show(a, {"frontier": MC.frontier(_log(_spark(), a.trades), _firm(a), _config(a), tuple(a.scales or MC.SCALES), a.ruin_cap)}, "frontier")


def prop_policies(a):
    from .plans import montecarlo as MC

    _show(a, {"policies": MC.policies(_log(_spark(), a.trades), _firm(a), _config(a), tuple(a.buffers or MC.BUFFERS), (None, a.extract or 0.5))}, "policies")


def prop_geometry(a):
    from .plans import montecarlo as MC
    from .sources import files

    if files.distorted(a.win_rate, a.rr, a.risk, a.ev):
        print("note: moving the mean to the asked value bends the geometry by over a hundredth of the risk")
    g = files.geometry_log(_spark(), a.win_rate, a.rr, a.per_day, a.risk, a.ev, a.days, a.seed)
    _show(a, {"simulation": MC.run(g, _firm(a), MC.Config(n_paths=a.paths, seed=a.seed))}, "geometry")


# --- arguments --------------------------------------------------------------------------------------------


def _firm_args(p, need=True):
    p.add_argument("--firm", required=need)
    p.add_argument("--extra-monthly", type=float, default=0.0)
    p.add_argument("--per-payout-fee", type=float, default=0.0)
    p.add_argument("--payout-haircut", type=float, default=0.0)
    p.add_argument("--dll", action="store_true")
    p.add_argument("--pdll", type=float)
    p.add_argument("--promo-caps", action="store_true")


def _mc_args(p, paths):
    p.add_argument("--paths", type=int, default=paths)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--bootstrap", default="stationary", choices=("stationary", "iid_day", "iid_trade"))
    p.add_argument("--block-len", type=int)
    p.add_argument("--challenge-horizon", type=int, default=120)
    p.add_argument("--funded-horizon", type=int, default=252)
    p.add_argument("--sizing", default="fixed", choices=("fixed", "vol_target", "cushion"))
    for n in ("scale", "vol-lambda", "keep-buffer"):
        p.add_argument(f"--{n}", type=float, default={"scale": 1.0, "vol-lambda": 0.94, "keep-buffer": 0.0}[n])
    for n in ("challenge-scale", "funded-scale", "base-contracts", "vol-target", "extract"):
        p.add_argument(f"--{n}", type=float)
    p.add_argument("--vol-clip", type=float, nargs=2, default=(0.5, 1.5))
    p.add_argument("--cushion-clip", type=float, nargs=2, default=(0.25, 1.5))
    p.add_argument("--payout-path", choices=("standard", "consistency"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("ledgerloom")
    sub = top.add_subparsers(dest="command", required=True)

    def add(where, name, run, *positional, json=True):
        p = where.add_parser(name)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        if json:
            p.add_argument("--json")
            p.add_argument("--html")
        return p

    ing = sub.add_parser("ingest").add_subparsers(dest="what", required=True)
    p = add(ing, "trades", ingest_trades, "csv", json=False)
    p.add_argument("--mapping")
    p.add_argument("--map", action="append")
    p.add_argument("--output")
    p.add_argument("--currency", default="USD")
    p = add(ing, "ohlcv", ingest_ohlcv, "csv", "symbol", json=False)
    p.add_argument("--tz", default="UTC")
    p.add_argument("--output")
    p = add(ing, "results", ingest_results, "file", json=False)
    p.add_argument("--output")

    p = add(sub, "metrics", metrics, "trades")
    p.add_argument("--equity", type=float, default=50_000.0)
    p = add(sub, "verdict", verdict, "trades")
    p.add_argument("--equity", type=float, default=50_000.0)
    p.add_argument("--trials", type=int, default=1)
    p = add(sub, "report", report, "trades")
    p.add_argument("--equity", type=float)
    p.add_argument("--trials", type=int, default=1)
    p.add_argument("--no-reality", action="store_true")
    p.add_argument("--outer", type=int, default=100)
    p.add_argument("--inner", type=int, default=500)
    _firm_args(p)
    _mc_args(p, 10_000)
    p = add(sub, "stress", stress, "trades")
    for n in ("tick-value", "commission", "ruin-capital"):
        p.add_argument(f"--{n}", type=float)
    p.add_argument("--stop-slip", type=float, default=1.0)
    p.add_argument("--trials", type=int, default=1)
    p.add_argument("--window", type=int, default=30)
    p.add_argument("--oos-start")
    p.add_argument("--ohlcv")
    p.add_argument("--outer", type=int, default=100)
    p.add_argument("--inner", type=int, default=500)
    _firm_args(p, need=False)
    _mc_args(p, 2000)
    p = add(sub, "pbo", pbo, "variants")
    p.add_argument("--partitions", type=int, default=16)
    p.add_argument("--seed", type=int, default=0)

    prop = sub.add_parser("prop").add_subparsers(dest="what", required=True)
    firms = prop.add_parser("firms").add_subparsers(dest="which", required=True)
    add(firms, "list", firms_list, json=False)
    add(firms, "show", firms_show, "name", json=False)
    p = add(prop, "evaluate", prop_evaluate, "trades")
    p.add_argument("--phase")
    p.add_argument("--equity-csv")
    _firm_args(p)
    p = add(prop, "simulate", prop_simulate, "trades")
    p.add_argument("--accounts", type=int, default=1)
    _firm_args(p)
    _mc_args(p, 10_000)
    p = add(prop, "frontier", prop_frontier, "trades")
    p.add_argument("--scales", type=float, nargs="*")
    p.add_argument("--ruin-cap", type=float, default=0.5)
    _firm_args(p)
    _mc_args(p, 2000)
    p = add(prop, "policies", prop_policies, "trades")
    p.add_argument("--buffers", type=float, nargs="*")
    _firm_args(p)
    _mc_args(p, 2000)
    p = add(prop, "geometry", prop_geometry)
    for n, v in (("win-rate", 0.5), ("rr", 1.0), ("risk", 100.0), ("ev", 0.0)):
        p.add_argument(f"--{n}", type=float, default=v)
    p.add_argument("--per-day", type=int, default=3)
    p.add_argument("--days", type=int, default=250)
    p.add_argument("--paths", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=42)
    _firm_args(p)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except (LedgerError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
