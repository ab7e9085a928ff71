import json

import pytest

from ledgerloom.errors import IngestError
from ledgerloom.operators import metrics as M
from ledgerloom.sources import files
from ledgerloom.sources.mapping import detect, from_pairs


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_trades_csv(spark, tmp_path):
    p = write(
        tmp_path, "t.csv",
        "Entry DateTime, Exit DateTime,Symbol,Type,Qty,Net P/L,Net P/L %,Fees,MAE,MFE\n"
        '2026-01-05 09:00:00,2026-01-05 09:20:00,MNQ,Buy,2,"$1,234.56",3,$1.24,($12.00),$90.00\n'
        "2026-01-05 10:00:00,2026-01-05 10:20:00,MNQ,Sell,1,($151.57),-1,0,151,5\n"
        "2026-01-06 10:00:00,2026-01-06 09:00:00,MNQ,Sell,1,5,-1,0,,\n"
        "not a time,2026-01-06 09:00:00,MNQ,Sell,1,5,-1,0,,\n"
        "2026-01-06 10:00:00,2026-01-06 11:00:00,MNQ,Hold,1,5,-1,0,,\n"
        "2026-01-06 10:00:00,2026-01-06 11:00:00,MNQ,Sell,1,n/a,-1,0,,\n",
    )
    r = files.read_trades_csv(spark, p, {"tz": "America/Chicago"})
    rows = r.rows.orderBy("trade_seq").collect()
    assert [(x.side, x.quantity, x.pnl, x.fees, x.mae, x.mfe) for x in rows] == [("long", 2, 1234.56, 1.24, -12, 90), ("short", 1, -151.57, 0, -151, 5)]
    assert str(rows[0].entry_time) == "2026-01-05 15:00:00"
    assert {x.row: x.reason for x in r.rejects.collect()} == {2: "entry after exit", 3: "bad timestamp", 4: "bad side", 5: "bad pnl"}
    assert r.columns["pnl"] == "Net P/L" and not r.warnings
    assert files.read_trades_csv(spark, p).warnings


def test_split_date_and_time_and_signed_quantity(spark, tmp_path):
    p = write(tmp_path, "s.csv", "Date,Time,Qty,PnL\n2026-01-05,9:30,-1,5\n2026-01-05,10:30,2,-3\n")
    r = files.read_trades_csv(spark, p)
    assert [(str(x.exit_time), x.side, x.symbol) for x in r.rows.orderBy("trade_seq").collect()] == [("2026-01-05 09:30:00", "short", "UNKNOWN"), ("2026-01-05 10:30:00", "long", "UNKNOWN")]
    with pytest.raises(IngestError):
        files.read_trades_csv(spark, write(tmp_path, "u.csv", "Time,PnL\n9:30,5\n"))


def test_mapping():
    m = detect(["Exit Time", "P/L %", "Profit", "Instrument"])
    assert (m.exit_time, m.pnl, m.symbol) == ("Exit Time", "Profit", "Instrument")
    with pytest.raises(IngestError, match="could all be"):
        detect(["Exit Time", "Net PnL", "NetPnL"])
    with pytest.raises(IngestError):
        detect(["a", "b"])
    assert detect(["a", "b"], from_pairs(["exit_time=a", "pnl = b"])).pnl == "b"
    with pytest.raises(IngestError):
        from_pairs(["nonsense"])


def test_bars(spark, tmp_path):
    p = write(tmp_path, "b.csv", "Date,Open,High,Low,Close,Vol\n20260105,10,12,9,11,5\n20260106,10,12,9,11,5\n20260106,10,12,9,11,5\n20260108,10,9,9,11,5\n20260109,-1,12,9,11,5\n20260109,10,12,9,11,-5\n20260112,10,12,9,11,\nx,10,12,9,11,1\n20260113,1,2,1,2,3\n")
    r = files.read_bars_csv(spark, p)
    assert r.rows.count() == 3 and {x.row for x in r.rejects.collect()} == {3, 4, 5, 6, 7}
    assert [str(x.day) for x in files.weekday_gaps(r.rows).orderBy("day").collect()] == ["2026-01-07", "2026-01-08", "2026-01-09", "2026-01-12"]
    with pytest.raises(IngestError, match="different bars"):
        files.read_bars_csv(spark, write(tmp_path, "c.csv", "datetime,open,high,low,close\n2026-01-05,1,2,1,2\n2026-01-05,1,3,1,2\n"))
    files.write_bars_csv(r.rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["datetime"] == "2026-01-05T00:00:00Z"


def test_marks_and_variants(spark, tmp_path):
    m = files.read_marks_csv(spark, write(tmp_path, "m.csv", "DateTime,Equity\n2026-01-05 10:00:00,100\n2026-01-05 11:00:00,x\n2026-01-05 12:00:00,102\n2026-01-07 12:00:00,103\n"))
    assert [r.equity for r in files.daily_marks(m).orderBy("day").collect()] == [102, 103]
    v = files.read_variants_csv(spark, write(tmp_path, "v.csv", "idx,a,b\n0,1,2\n1,3,4\n2,5,1\n"))
    assert {r.variant for r in v.select("variant").distinct().collect()} == {"a", "b"}
    with pytest.raises(IngestError):
        files.read_variants_csv(spark, write(tmp_path, "w.csv", "a,b\n1,1\n2,2\n5,5\n"))


def test_results(spark, tmp_path):
    t = {"symbol": {"value": "ES", "id": "x"}, "entryTime": "2026-01-05T15:00:00Z", "exitTime": "2026-01-05T15:30:00Z", "direction": 0, "quantity": 1, "entryPrice": 1.0, "exitPrice": 2.0, "profitLoss": 50.0, "totalFees": 4.0, "mae": 3.0, "mfe": 60.0}
    doc = {"TotalPerformance": {"ClosedTrades": [t, {**t, "direction": 1, "profitLoss": -20.0}, {**t, "direction": 7}]}, "charts": {"Strategy Equity": {"series": {"Equity": {"values": [[1767600000, 100.0], [1767603600000, 1, 2, 0, 101.0], {"x": 1767607200, "y": 99.0}, [1767607200, 98.0]]}}}}}
    p = write(tmp_path, "r.json", json.dumps(doc))
    r = files.read_result_trades(spark, p)
    assert [(x.symbol, x.side, x.pnl, x.fees, x.mae) for x in r.rows.orderBy("trade_seq").collect()] == [("ES", "long", 46, 4, -3), ("ES", "short", -24, 4, -3)]
    assert [x.reason for x in r.rejects.collect()] == ["bad side"]
    assert [x.equity for x in files.read_result_equity(spark, p).orderBy("ts").collect()] == [100, 101, 98]


def test_parquet_round_trip(spark, tmp_path):
    g = files.geometry_log(spark, 0.5, 1.0, 3, 100.0, 5.0, 20)
    files.write_log(g, str(tmp_path / "log"), source="synthetic")
    back = files.read_log(spark, str(tmp_path / "log"))
    assert back.count() == 60 and back.schema.names == g.schema.names
    m = M.full(back).first()
    assert m.expectancy == pytest.approx(5.0) and m.win_rate == 0.5 and m.trading_days == 20
    spark.createDataFrame([(0, "USD", "x", 99)], "log_id bigint, account_currency string, source string, schema_version int").write.mode("overwrite").parquet(str(tmp_path / "log/logs"))
    with pytest.raises(IngestError, match="version"):
        files.read_log(spark, str(tmp_path / "log"))


def test_time_format_of_a_mapping(spark, tmp_path):
    from ledgerloom.errors import IngestError
    from ledgerloom.sources.files import read_trades_csv

    p = tmp_path / "t.csv"
    p.write_text("Exit Time,Profit\n03/02/2026 14:05,10\n25/12/2026 09:30,-4\n")
    r = read_trades_csv(spark, str(p), {"datetime_format": "%d/%m/%Y %H:%M"})
    assert [str(x.exit_time) for x in r.rows.orderBy("trade_seq").collect()] == ["2026-02-03 14:05:00", "2026-12-25 09:30:00"] and r.rejects.count() == 0
    with pytest.raises(IngestError):
        read_trades_csv(spark, str(p), {"datetime_format": "%Q"})


def test_mapping_files_are_strict(tmp_path):
    from ledgerloom.errors import IngestError
    from ledgerloom.sources.mapping import from_yaml

    for text in ("- a\n", "pnl: [1]\n", "a: {b: [}\n", "side: {column: s, long: buy}\n"):
        (tmp_path / "m.yaml").write_text(text)
        with pytest.raises(IngestError):
            from_yaml(str(tmp_path / "m.yaml"))
    with pytest.raises(IngestError):
        from_yaml(str(tmp_path / "none.yaml"))
    (tmp_path / "m.yaml").write_text("")
    assert from_yaml(str(tmp_path / "m.yaml")) == {}


def test_percent_columns_and_rivals():
    from ledgerloom.errors import IngestError

    assert detect(["Exit Time", "P/L", "P/L %"]).pnl == "P/L"
    assert detect(["Exit Time", "Net PnL", "NetPnL", "PnL"]).pnl == "PnL"
    with pytest.raises(IngestError):
        detect(["Exit Time", "Net PnL", "NetPnL", "Profit %"])
