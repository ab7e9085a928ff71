import math

import numpy as np
import pytest

from llm.lattice import classes, decode_e8, dedup, minimal_vectors


def test_decoder_finds_the_nearest_point():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 8)) * 2
    p = decode_e8(x)
    d = ((x - p / 2) ** 2).sum(1)
    for v in minimal_vectors():
        assert (d <= ((x - (p + v) / 2) ** 2).sum(1) + 1e-9).all()
    assert len(minimal_vectors()) == 240 and (p.sum(1) % 4 == 0).all()


def test_links_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 64))
    rows = []
    for i in range(400):
        v = base[i % 40] + r.normal(size=64) * (0.05 if i % 2 else 0.9)
        rows.append((i, v.astype(np.float32).tolist(), i % 3))
    rows += [(900, rows[1][1], 1), (901, rows[1][1], 1), (902, rows[1][1], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in classes(df).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab, ids = np.array([l for *_, l in rows]), [i for i, *_ in rows]
    ok = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    links = sum(ok.sum(1) - 1)
    assert sum(g.n_links for g in got.values()) >= 0.98 * links > 0
    assert all(got[i].n_links <= ok[k].sum() - 1 for k, i in enumerate(ids))
    comp = {i: i for i in ids}
    for _ in range(len(ids)):
        new = {ids[k]: min(comp[ids[j]] for j in np.flatnonzero(ok[k])) for k in range(len(ids))}
        if new == comp:
            break
        comp = new
    assert np.mean([got[i].component_id == comp[i] for i in ids]) >= 0.98
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())
    assert dedup(df).count() == sum(g.kept for g in got.values())


def test_unusable_vectors_link_with_nothing(spark):
    v = [1.0] * 8
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [], 1), (5, [0.0] * 8, 1), (6, [math.nan] * 8, 1), (7, [math.inf] + v[1:], 1), (8, [None] + v[1:], 1), (9, v[:7], 1), (None, v, 1), (10, v, 1), (10, v, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = classes(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got if r.n_links} == {1: 1, 10: 1}
    assert {r.component_id for r in got if r.vec_id == 10} == {1}
    assert classes(df.limit(0)).count() == 0


def test_copies_are_folded(spark):
    """A thousand equal vectors link with each other and with their near neighbour, without a row a pair; labels of text link with nothing."""
    from llm.lattice import _folded, usable

    v, near = [1.0, 0.2, 0.1, 0.0, 0.5, 0.3, 0.2, 0.9], [1.0, 0.2, 0.1, 0.01, 0.5, 0.3, 0.2, 0.9]
    rows = [(i, v, "3") for i in range(10, 1010)] + [(5, near, "3"), (3, v, "x"), (4, v, None), (2000, [1e200] * 8, "3"), (2001, [1e-200] * 8, "3")]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in classes(d).collect()}
    assert got[10] == (1000, 5, False) and got[5] == (1000, 5, True) and got[1009] == (1000, 5, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 2000, 2001))
    assert _folded(usable(d))[0].count() == 2
    twice = spark.createDataFrame([(1, v, 3), (1, near, 3), (2, v, 3)], "vec_id bigint, embedding array<double>, label bigint")
    assert {(r.vec_id, r.n_links, r.component_id) for r in classes(twice).collect()} == {(1, 1, 1), (2, 1, 1)}
