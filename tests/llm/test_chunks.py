import numpy as np
from llm_data import prose

from llm.chunks import LEAST, RUN, cut, gear, removals, strip
from llm.common import keyed


def pieces(t):
    b = (t or "").encode()
    if not b:
        return []
    ends, _ = cut(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    return [b[i:j] for i, j in zip([0, *ends[:-1]], ends)]


def brute(texts):
    seen, out = set(), []
    for t in texts:
        kept, run = [], []
        for p in [*pieces(t), None]:
            if p is not None and p in seen:
                run.append(p)
                continue
            if sum(map(len, run)) < RUN:
                kept += run
            run = []
            if p is not None:
                kept.append(p)
                seen.add(p)
        out.append(b"".join(kept).decode())
    return out


def test_rolling_hash_depends_on_16_bytes():
    r = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    a, b = r.copy(), r.copy()
    b[:100] = 0
    assert (gear(a)[115:] == gear(b)[115:]).all() and (gear(a)[:100] != gear(b)[:100]).any()


def test_equals_brute_force_and_resists_shifts(make_docs, rng):
    shared = prose(rng, 120)
    texts = [prose(rng, 60) + " " + shared, prose(rng, 13) + shared + prose(rng, 40), shared[37:], "é" * 900, "é" * 900, None, "", "tiny"]
    assert b"".join(pieces(texts[0])).decode() == texts[0]
    got = {r.doc_id: r.text for r in strip(make_docs(texts)).collect()}
    want = brute(texts)
    assert [got[i] or "" for i in range(len(texts))] == want
    assert len(want[1]) < len(texts[1]) - len(shared) // 2


def test_every_chunk_is_bounded(rng):
    n = [len(p) for p in pieces(prose(rng, 5000))]
    assert min(n[:-1]) >= LEAST and max(n) <= 1024 + 3


def test_clean_texts_and_equal_rows(spark, make_docs, rng):
    d = make_docs([prose(rng, 200) for _ in range(5)]).withColumnRenamed("lang", "place")
    d = d.unionByName(d)
    assert removals(keyed(d)).count() == 0
    assert strip(d).columns == d.columns and strip(d).count() == 10
    assert strip(d.limit(0)).count() == 0


def test_exact_copies_go_completely(make_docs, rng):
    texts = ["ok", "x" * 23, "a text of thirty bytes, or so..", *[prose(rng, 40)[:n] for n in (63, 64, 70, 87, 130, 151)]]
    got = strip(make_docs(texts * 3)).collect()
    by = {r.doc_id: r.text for r in got}
    assert [by[i] for i in range(len(texts))] == texts
    assert all(by[i] == "" for i in range(len(texts), 3 * len(texts)))


def test_columns_of_any_name(make_docs, rng):
    t = prose(rng, 60)
    d = make_docs([t, t]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "place")
    out = strip(d)
    assert out.columns == d.columns and sorted(r.text for r in out.collect()) == ["", t]
