import json
import math

import pytest
from ledger_data import log, random_days, trade_rows

from ledgerloom import cli
from ledgerloom import config as C
from ledgerloom.plans import montecarlo as MC
from ledgerloom.plans import reality
from ledgerloom.report import render as R
from ledgerloom.schema import TRADES
from ledgerloom.sources import files


def test_json_is_strict():
    t = R.to_json({"a": [{"x": math.inf, "y": math.nan, "z": -math.inf}]})
    assert json.loads(t)["a"] == [{"x": "inf", "y": None, "z": "-inf"}]


def test_text_and_figures(spark):
    assert "no rows" in R.table([]) and R.money(-5.0) == "-$5.00" and R.money(None) == "-" and R.percent(0.125) == "12.5%"
    assert R.table([{"a": 1.5, "b": None, "c": True}]).splitlines()[-1].split() == ["1.5", "-", "yes"]
    p = R.page("<t>", [("s", R.bars_svg({"x": 1.0, "y": -2.0})), ("l", R.line_svg({"k": [1.0, 2.0, math.nan]})), ("e", "a < b")])
    assert "&lt;t&gt;" in p and p.count("<svg") == 2 and "http" not in p
    h = R.histogram(spark.createDataFrame([(float(i),) for i in range(100)] + [(None,), (math.inf,)], "v double"), "v", 10)
    assert sum(h.values()) == 100 and len(h) == 10


def test_waterfall_adds_up(spark):
    t = log(spark, random_days(1, 80, 3, 40.0, 150.0))
    e = MC.run(t, C.PRESETS["tpt_50k"], MC.Config(n_paths=300, challenge_days=60, funded_days=60)).first().asDict()
    w = R.waterfall(e)
    assert sum(v for k, v in w.items() if k != "expected net") == pytest.approx(w["expected net"])


def test_reality_check_panels(spark):
    t = log(spark, random_days(3, 100, 3, 30.0, 150.0))
    p = reality.reality_check(t, C.PRESETS["tpt_50k"], MC.Config(n_paths=100, challenge_days=40, funded_days=40), trials=5, oos_start="2026-03-02", outer=3, inner=50)
    for name, d in p.tables.items():
        assert "log_id" in d.columns, name
        assert d.count() > 0 or name in ("walk_forward",), name
    assert p.cost_simulations.count() == 3 and len(p.caveats.first()["caveats"]) >= 1
    with pytest.raises(AttributeError):
        p.nothing
    v = reality.verdict(t)
    assert v.scorecard.first()["overall"] in "ABCDF" and len(v.flags.columns) == 11


@pytest.fixture
def stored_log(spark, tmp_path):
    files.write_log(log(spark, random_days(2, 60, 3, 40.0, 150.0)), str(tmp_path / "log"))
    return str(tmp_path / "log")


def test_commands(spark, stored_log, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("prop", "firms", "list") == 0 and "topstep_50k" in capsys.readouterr().out
    assert run("prop", "firms", "show", "tpt_25k") == 0
    assert run("metrics", stored_log, "--json", tmp_path / "sub/m.json") == 0
    assert json.loads((tmp_path / "sub/m.json").read_text())["metrics"][0]["trade_count"] == 180
    assert run("prop", "evaluate", stored_log, "--firm", "tpt_50k") == 0
    small = ("--paths", 100, "--challenge-horizon", 40, "--funded-horizon", 40)
    assert run("prop", "simulate", stored_log, "--firm", "tpt_50k", *small, "--accounts", 2, "--html", tmp_path / "s.html") == 0
    assert "<svg" in (tmp_path / "s.html").read_text()
    assert run("prop", "frontier", stored_log, "--firm", "tpt_50k", *small, "--scales", 0.5, 1) == 0
    assert run("verdict", stored_log) == 0
    assert run("prop", "geometry", "--firm", "tpt_50k", "--paths", 50, "--days", 40, "--ev", 30) == 0
    capsys.readouterr()
    assert run("prop", "evaluate", stored_log, "--firm", "nobody") == 1 and "error:" in capsys.readouterr().err
    csv = tmp_path / "t.csv"
    csv.write_text("Exit Time,PnL\n2026-01-05 10:00:00,5\nbad,5\n")
    assert run("ingest", "trades", csv, "--output", tmp_path / "in") == 0
    assert "1 trade(s), 1 row(s) left out" in capsys.readouterr().out
    v = tmp_path / "v.csv"
    v.write_text("a,b,c\n" + "\n".join(f"{i % 3},{(i * 7) % 5 - 2},{(i * 11) % 4 - 1}" for i in range(40)))
    assert run("pbo", v, "--partitions", 4) == 0


def test_live_monitor_agrees_with_replay(spark, tmp_path):
    from ledgerloom.operators import replay
    from ledgerloom.streaming.monitor import monitor

    firm = C.PRESETS["tpt_50k"]
    rows = trade_rows(random_days(4, 40, 3, -40.0, 250.0)) + trade_rows(random_days(5, 20, 3, 20.0, 100.0), 1)
    d = spark.createDataFrame(rows, TRADES)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = monitor(spark.readStream.schema(TRADES).parquet(str(tmp_path / "in")), firm, "challenge")
    q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select log_id, max(status = 'breached') as hit, min_by(rule, exit_time) filter (where rule is not null) as rule from live group by log_id").collect()
    want = {r.log_id: (r.outcome == "breached", r.breach_rule) for r in replay.evaluate(d, firm, "challenge").collect()}
    assert {r.log_id: (r.hit, r.rule) for r in got} == want and want[0][0]
