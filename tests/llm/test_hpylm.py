import math
import re
import zlib
from collections import Counter

import numpy as np
from llm_data import SCHEMA

from llm.hpylm import draw_tables, log_stirling, perplexity, scores


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_base_and_counts_equal_brute_force(spark, rng):
    vocab = ["w%d" % i for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[: 5 + i % 50]) for _ in range(rng.randint(0, 80))) + ("\tEnde\n" if i % 2 else "")) for i in range(120)]
    rows += [(None, "W1 w2"), (500, None), (501, ""), (3, "w1"), (3, "w1"), (502, "nie gesehen " * 3)]
    got = scores(spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA), batch_bytes=2000, bucket_bytes=2000).collect()
    count = {}
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    for i, t in rows:
        if not held(i):
            for w in tok(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tok(t)), sum(w in count for w in tok(t)), n, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = scores(spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA), batch_bytes=2000, bucket_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_model_beats_the_base_on_unseen_texts(spark, rng):
    a, b = (["%s%d%s" % (p, i, p) for i in range(300)] for p in ("a", "b"))
    zipf = [1 / (k + 1) for k in range(300)]
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, zipf, k=60))) for i in range(400)]
    p = {r.held_out: r for r in perplexity(scores(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert p[True].perplexity < 0.85 * p[True].base_perplexity


def test_seating_draws_have_the_exact_distribution():
    s = log_stirling(6, 0.6)
    a = 0.8
    w = np.exp(s[5, 1:6] + np.arange(1, 6) * math.log(a))
    t = draw_tables(np.full(40_000, 5), np.full(40_000, a), 0.6, s, np.random.default_rng(1))
    assert np.abs(np.bincount(t, minlength=6)[1:] / 40_000 - w / w.sum()).max() < 0.01
    big = draw_tables(np.array([1, 0, 5000]), np.full(3, 2.0), 0.6, s, np.random.default_rng(1))
    assert big[0] == 1 and big[1] == 0 and 1 < big[2] < 5000


def unseen(n):
    return [i for i in range(20_000, 40_000) if held(i)][:n]


def test_probabilities_sum_to_one(rng):
    """Of every context of a bucket, over its words, the rest of the vocabulary and one unknown word."""
    from llm.hpylm import Level, Restaurants, Root

    r = np.random.default_rng(3)
    words, per = 50, r.integers(1, 20, 30)
    w = np.concatenate([r.choice(words, k, replace=False) for k in per])
    c = r.integers(0, 9, len(w))
    c[np.cumsum(per) - 1] += 40
    cu = np.bincount(w, weights=np.minimum(c, 1), minlength=words).astype(np.int64)
    root = Root((cu > 0).sum(), 0.4, 3.0, float((cu > 0).sum()), 8)
    root.C, root.T = float(cu.sum()), float(root.tables(0, cu).sum())
    p = root.probabilities(0, cu)
    assert abs(p[cu > 0].sum() + (root.strength + root.d * root.T) * root.uniform / (root.strength + root.C) - 1) < 1e-9
    x = {"w": w, "c": c, "n": per, "hot": np.full(30, -1)}
    s = Restaurants(x, p, Level(0.6, 2.5), r)
    for _ in range(3):
        s.sweep()
        own, rest = s.predictive(), (s.strength + s.d * s.T) / (s.strength + s.C)
        for k in range(30):
            mine = slice(s.at[k], s.at[k + 1])
            assert abs(own[mine].sum() + rest[k] * (1 - s.p[mine].sum()) - 1) < 1e-9
    assert (s.t <= s.c).all() and (s.t >= np.minimum(s.c, 1)).all() and s.t.max() > 1


def test_word_histories_count(spark, rng):
    """Which word follows which decides between texts of the same words; a context of a third of all words is split, the result stays."""
    pairs = {"a%d" % i: "b%d" % (i * 7 % 40) for i in range(40)}
    rows = [(i, " ".join("%s %s the" % (k, pairs[k]) for k in rng.choices(list(pairs), k=20))) for i in range(300)]
    good = [" ".join("%s %s the" % (k, pairs[k]) for k in rng.choices(list(pairs), k=20)) for _ in range(20)]
    bad = []
    for g in good:
        w = g.split(" ")
        b = w[1::3]
        rng.shuffle(b)
        w[1::3] = b
        bad.append(" ".join(w))
    ids = unseen(40)
    d = spark.createDataFrame(rows + list(zip(ids, good + bad)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in scores(d, batch_bytes=4000, bucket_bytes=4000).collect()}
    for i in range(20):
        g, b = got[ids[i]], got[ids[20 + i]]
        assert g.score > b.score + 5 and abs(g.base_score - b.base_score) < 1e-6
    assert all(r.score > r.base_score + 10 for r in (got[i] for i in ids[:20]))


def test_parameters_come_back(rng):
    """Discount and strength are found from seatings that were drawn with them."""
    from llm.hpylm import draw_parameters

    g = np.random.default_rng(4)
    tables, customers, seats = Counter(), Counter(), Counter()
    for _ in range(1500):
        c, total = [], 0
        for _ in range(30):
            if g.random() < (2.0 + 0.7 * len(c)) / (2.0 + total):
                c.append(1)
            else:
                k = g.choice(len(c), p=(np.array(c) - 0.7) / (total - 0.7 * len(c)))
                c[k] += 1
            total += 1
        tables[len(c)] += 1
        customers[total] += 1
        for x in c:  # every table has a dish of its own
            seats[x, 1] += 1
    d, a = draw_parameters(tables, customers, seats, g)
    assert abs(d - 0.7) <= 0.1 and 1 < a < 4


def test_empty(spark):
    assert scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
