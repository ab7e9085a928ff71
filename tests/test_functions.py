import datetime as dt
import math
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import special
from ledgerloom.functions.contracts import mini_units, root
from ledgerloom.functions.money import parse_money
from ledgerloom.functions.sessions import CME, PRAGUE, localised
from ledgerloom.functions.timestamps import parse_instant


def values(spark, texts, f, kind="string"):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in d.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_money(spark):
    cases = {
        "$1,234.56": 1234.56, "($151.57)": -151.57, "$(2.5)": -2.5, "−€1.234,56": -1234.56, "1 234,5": 1234.5, "1 000": 1000.0, "1,23,456": 123456.0, "0,500": 0.5, "1,500": 1500.0, "12,5": 12.5,
        "1.234.567": 1234567.0, "1.2.3": None, "-3": -3.0, "+7.25": 7.25, "": None, "-": None, "--": None, "abc": None, "1e400": None, "NaN": None, "Infinity": None, ".5": 0.5, "£9": 9.0, "(5)": -5.0,
    }
    assert values(spark, list(cases), parse_money) == list(cases.values())
    assert values(spark, [None], parse_money) == [None]


def test_times(spark):
    got = values(spark, ["2026-01-05 09:30:00", "2026-01-05T09:30", "1/5/2026 9:30:00 AM", "20260105", "2026-01-05 09:30:00Z", "2026-01-05 09:30:00+02:00", "2026-01-05T09:30:00-0530", "junk", None, "2026-13-01"], parse_instant)
    utc = lambda *a: dt.datetime(*a)
    assert got == [utc(2026, 1, 5, 9, 30)] * 3 + [utc(2026, 1, 5), utc(2026, 1, 5, 9, 30), utc(2026, 1, 5, 7, 30), utc(2026, 1, 5, 15, 0), None, None, None]
    chicago = values(spark, ["2025-03-09 02:15:00", "2025-11-02 01:15:00", "2025-07-01 12:00:00"], lambda c: parse_instant(c, "America/Chicago"))
    assert chicago == [None, None, dt.datetime(2025, 7, 1, 17)]


@pytest.mark.parametrize("tz", ["America/Chicago", "Australia/Lord_Howe", "Europe/Prague"])
def test_localise_agrees_with_zoneinfo(spark, tz):
    z = ZoneInfo(tz)
    d = spark.range(0, 365 * 48).select((F.lit(1735689600) + F.col("id") * 1800).alias("s"))
    for r in d.select("s", F.unix_seconds(localised(F.timestamp_seconds("s"), tz)).alias("u")).collect():
        wall = dt.datetime.fromtimestamp(r.s, dt.timezone.utc).replace(tzinfo=None)
        seen = {wall.replace(tzinfo=z, fold=f).timestamp() for f in (0, 1) if dt.datetime.fromtimestamp(wall.replace(tzinfo=z, fold=f).timestamp(), z).replace(tzinfo=None) == wall}
        assert r.u == (int(next(iter(seen))) if len(seen) == 1 else None), wall


def test_sessions(spark):
    d = spark.sql("select timestamp'2026-01-05 22:59:59' a, timestamp'2026-01-05 23:00:00' b, timestamp'2026-01-05 23:30:00' c")
    r = d.select(CME.date("a"), CME.date("b"), PRAGUE.date("c")).first()
    assert [str(x) for x in r] == ["2026-01-05", "2026-01-06", "2026-01-06"]


def test_contracts(spark):
    got = values(spark, ["ES", "/ESH26", "@MESZ5", "MNQ1!", "NQ=F", "ES15H24", "ESX", "AAPL", " gc ", "ES0!", "ES32H24", None], root)
    assert got == ["ES", "ES", "MES", "MNQ", "NQ", "ES", None, None, "GC", None, None, None]
    d = spark.createDataFrame([("MES", 10.0), ("ES", -2.0)], "symbol string, quantity double")
    assert [r[0] for r in d.select(mini_units()).collect()] == [1.0, 2.0]


@given(st.floats(0.0001, 0.9999))
def test_normal_inverse(p):
    assert special.normal_cdf(special.normal_ppf(p)) == pytest.approx(p, abs=2e-9 + 2e-8)


def test_tails():
    assert special.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert special.chi2_sf(0, 3) == 1 and special.normal_ppf(0) == -math.inf and special.normal_ppf(1) == math.inf
    assert special.two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("z", [0.5, 2.0, 2.999, 3.0, 7.0, 12.0, 37.0, 60.0])
def test_tails_keep_their_digits(z):
    assert special.normal_log_isf(special.normal_log_sf(z)) == pytest.approx(z, rel=1e-12)
    if z <= 37:
        assert special.normal_log_sf(z) == pytest.approx(math.log(0.5 * math.erfc(z / math.sqrt(2.0))), rel=1e-12)
    assert special.normal_log_isf(math.log(0.5)) == special.normal_log_isf(0.0) == 0.0
