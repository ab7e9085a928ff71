import hashlib
from collections import Counter

import pytest
from llm_data import prose

from llm import suffixes
from llm.suffixes import _named, removals


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b) - len(kept), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def got(docs, **kw):
    d = _named(docs)
    return {(r.t1, r.t2): (r.n_removed, len(r.spans), r.kept_sha256) for r in removals(d, **kw).collect()}, {r.text: (r.t1, r.t2) for r in d.collect()}


@pytest.mark.parametrize("first", [50, 100])
def test_equals_brute_force(make_docs, rng, first):
    a = [prose(rng, 120) for _ in range(6)]
    shared = prose(rng, 60)
    texts = [t[:k] + shared[j : j + 260] + t[k:] for t, k, j in zip(a, (0, 40, 300, 500, 100, 7), (0, 3, 50, 0, 0, 9))]
    texts += [a[0], a[0], "é" * 500, shared[:199], None, "", "xyz" * 300]
    near = list(a[1])
    for k in range(50, len(near), 170):
        near[k] = "#"
    texts.append("".join(near))
    want = brute(texts, 200)
    r, key = got(make_docs(texts), first=first)
    for i, (t, w) in enumerate(zip(texts, want)):
        k = key[t or ""]
        assert r.get(k, (0, 0, hashlib.sha256((t or "").encode()).hexdigest())) == w, i


def test_equal_rows_repeat_each_other_and_clean_tables_lose_nothing(spark, make_docs, rng):
    t = prose(rng, 80)
    d = make_docs([t, prose(rng, 80)])
    assert got(d)[0] == {}
    r, _ = got(d.unionByName(d.where("doc_id = 0")))
    assert [v[0] for v in r.values()] == [len(t.encode())]
    assert got(d.limit(0))[0] == {}


def test_query_shape(spark, make_docs, rng, tmp_path):
    t = prose(rng, 90)
    make_docs([t, "head " + t, None, "short"]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in suffixes.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert rows[2].n_bytes == 0 and rows[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].n_removed == rows[0].n_bytes and rows[3].n_removed == 0 and rows[1].n_spans == 1


def test_null_and_repeated_ids_keep_texts_apart(spark, make_docs, rng, tmp_path):
    a, b = prose(rng, 90), prose(rng, 95)
    rows = [(None, a), (None, b), (1, a), (1, b[:150]), (1, prose(rng, 80)), (None, None)]
    make_docs([t for _, t in rows], ids=[i for i, _ in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), len((t or "").encode()), *w) for (i, t), w in zip(rows, brute([t for _, t in rows], 200)))
    assert want == sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op6_suffix_dedup(spark, str(tmp_path)).collect())
    assert sum(w[2] > 0 for w in want) == 2


def test_very_long_text(spark, make_docs, rng):
    """A text longer than a segment is read in parts; repeats within it and with others are found wherever they stand."""
    word = [prose(rng, 4) for _ in range(3000)]
    long = " ".join(word[rng.randrange(3000)] + str(rng.random()) for _ in range(110_000))
    assert len(long) > suffixes._SEGMENT
    p, q = long[1000:1300], long[suffixes._SEGMENT - 150 : suffixes._SEGMENT + 250]
    r, key = got(make_docs([long + p, "x" + q + "y"]))
    assert r[key[long + p]][:2] == (300 + 400 + 300, 3)
    assert r[key["x" + q + "y"]][:2] == (400, 1)
