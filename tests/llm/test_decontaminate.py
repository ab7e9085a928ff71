from llm_data import SCHEMA, prose, words

from llm.decontaminate import decontaminate, overlaps


def brute(docs, items, min_words=13, identity=0.8):
    """Any stretch of enough words with enough equal ones, over every diagonal."""
    out = set()
    for d, t in docs:
        w = (t or "").split()
        for i, s in items:
            v = (s or "").split()
            need = max(5, min(min_words, len(v)))
            for diag in range(-len(v) + need, len(w) - need + 1):
                eq = [w[diag + k] == v[k] for k in range(len(v)) if 0 <= diag + k < len(w)]
                if sum(eq) < identity * need - 1e-9:
                    continue
                if any(sum(eq[a:z]) >= identity * (z - a) - 1e-9 for a in range(len(eq) - need + 1) for z in range(a + need, len(eq) + 1)):
                    out.add((d, i))
    return out


def test_planted_passages_are_found_and_clean_ones_left(spark, rng):
    items = [(i, prose(rng, 30)) for i in range(20)] + [(90, None), (91, ""), (92, "one two")]
    docs, truth = [], set()
    for d in range(60):
        w = words(rng, 80)
        if d % 3 == 0:
            v = items[d % 20][1].split()
            for k in range(4, 30, 9):
                v[k] = "changed"
            w[20:20] = v
            truth.add((d, d % 20))
        docs.append((d, " ".join(w)))
    docs += [(None, items[0][1]), (100, None), (101, ""), (102, "a")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    x = spark.createDataFrame([(d, t, "u", None, 1) for d, t in docs], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in overlaps(x, b).collect()}
    assert got == truth | {(None, 0)} == brute(docs, items)
    # a filter that lets nearly everything pass gives the same
    assert {(r.doc_id, r.item_id) for r in overlaps(x, b, filter_bits=8192).collect()} == got
    left = decontaminate(x, b)
    assert left.columns == x.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_short_items_and_case(spark):
    b = spark.createDataFrame([(1, "The quick brown fox jumps")], "item_id bigint, text string")
    x = spark.createDataFrame([(1, "so THE QUICK, brown fox jumps!"), (2, "the quick brown cat jumps")], "doc_id bigint, text string")
    assert [r.doc_id for r in overlaps(x, b).collect()] == [1]


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id bigint, text string")
    x = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert overlaps(x, b).count() == 0 and decontaminate(x, b).count() == 1
    assert overlaps(x.limit(0), b).count() == 0


def test_changed_words_at_any_place(spark, rng):
    """Items of 13 to 20 words, and shorter ones, with up to a fifth of their words changed."""
    items, docs = [], []
    for n in [*range(6, 21), 25]:
        for changed in range(1, int(n * 0.2 + 1e-9) + 1):
            for places in [[k] for k in range(n)] if changed == 1 else [rng.sample(range(n), changed) for _ in range(12)] + [[n * (i + 1) // (changed + 1) for i in range(changed)]]:
                v = words(rng, n)
                items.append((len(items), " ".join(v)))
                docs.append((len(docs), " ".join(words(rng, 20) + ["changed" if k in places else x for k, x in enumerate(v)] + words(rng, 20))))
    v = words(rng, 15)
    items.append((len(items), " ".join(v)))
    docs.append((len(docs), " ".join("changed" if k in (3, 7, 11) else x for k, x in enumerate(v))))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    x = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = overlaps(x, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(r.n_equal >= 0.8 * r.n_words - 1e-9 and r.n_words >= min(13, r.item_words) for r in got)


def test_words_again_and_again(spark):
    """One word a hundred thousand times against an item of that word: found, in bounded memory and time."""
    docs = spark.createDataFrame([(1, "la " * 20_000), (2, "la lo " * 5_000), (3, "other words here " * 9)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "la " * 300), (8, "lo la " * 20)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in overlaps(docs, bench).collect()}
    assert got == {(1, 7): 300, (2, 8): 40}


def test_the_query_against_brute_force_on_awkward_rows(spark, rng, tmp_path):
    """Null and repeated ids, equal rows, items of every length with up to a fifth changed, columns of clashing names."""
    items = [(i, prose(rng, n)) for i, n in enumerate([*range(5, 24), 60])] + [(3, None), (None, prose(rng, 14)), (4, "")]
    docs = [(None, ""), (1, None), (None, items[12][1]), (None, items[12][1])]
    for d in range(60):
        v = items[d % 20][1].split()
        for k in rng.sample(range(len(v)), int(len(v) * rng.choice([0.0, 0.1, 0.2, 0.3]) + 1e-9) if len(v) > 5 else 0):
            v[k] = "changed"
        docs.append((d // 2, " ".join(words(rng, 40) + v + words(rng, 300) + items[(d * 7) % 20][1].split() + words(rng, 5))))
    spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as _item", "2 as doc_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    x = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as _row", "3 as _bad_id", "4 as _th")
    x.write.parquet(f"{tmp_path}/documents.parquet")
    named = [(k, s) for k, (_, s) in enumerate(items)]
    truth = brute(list(enumerate(t for _, t in docs)), named)
    from llm.decontaminate import op1_decontamination

    got = op1_decontamination(spark, str(tmp_path)).collect()
    key = lambda p: tuple((v is None, v or 0) for v in p)
    assert sorted(((r.doc_id, r.item_id) for r in got), key=key) == sorted(((docs[d][0], items[i][0]) for d, i in truth), key=key)
    left = decontaminate(x, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert left.columns == x.columns
    bad = {docs[d] for d, _ in truth}
    assert sorted((r.text or "" for r in left.collect())) == sorted(t or "" for d, t in docs if (d, t) not in bad)
