"""Every registered engine query with SQL beside it, on the smallest tables."""

import os

import numpy as np
import pytest

from ledgerloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def tidy(d):
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        if d[c].dtype == object or str(d[c].dtype).startswith(("datetime", "str")):
            d[c] = d[c].map(lambda v: "" if v is None or v != v else str(v).removesuffix(" 00:00:00"))
        else:
            d[c] = d[c].astype(float)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    a, b = tidy(QUERIES[name](spark, SF).toPandas()), tidy(duck.sql(ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all(), c
        else:
            assert np.allclose(a[c], b[c], rtol=1e-7, atol=1e-5, equal_nan=True), c


@pytest.mark.parametrize("name", ["vol_regimes", "regime_summary", "vol_clustering", "replay_chain", "equity_check", "vol_target_counterfactual", "overfit_flags"])
def test_others_give_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert QUERIES[name](spark, SF).count() > 0


def test_sampling_uncertainty_has_every_log(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    from ledgerloom.plans import queries as Q

    few, run = Q.MC.Config(n_paths=20), Q.MC.uncertainty
    monkeypatch.setattr(Q.MC, "uncertainty", lambda trades, firm: run(trades, firm, few, 2))
    want = {r.log_id for r in Q.trades_li(spark, SF).select("log_id").distinct().collect()}
    assert len(want) > 1 and {r.log_id for r in QUERIES["sampling_uncertainty"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["overfit_flags_hashed", "scorecard_hashed"])
def test_hashed_grades_draw_all_resamples(spark, monkeypatch, name):
    """As many as the queries whose draws SQL can't repeat, in code and SQL."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    import inspect

    from ledgerloom.operators import stress as X

    whole, run, got = inspect.signature(X.bootstrap_mean).parameters["samples"].default, X.bootstrap_mean_sql, []
    monkeypatch.setattr(X, "bootstrap_mean_sql", lambda trades, samples, *a: got.append(samples) or run(trades, samples, *a))
    QUERIES[name](spark, SF)
    assert got == [whole] and f"range(0, {whole})) as s from bn" in ORACLE_SQL[name]
