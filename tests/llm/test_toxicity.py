import zlib

import numpy as np
from llm_data import SCHEMA, prose

from llm.toxicity import Model, _bag, reject_toxic, scores, train


def test_words_that_neither_class_knows_say_nothing():
    m = Model(_bag(["abab abac abad"]), _bag(["xyzzy xyzq"]))

    def ratio(word):
        b = np.frombuffer(word.encode(), np.uint8)
        return m.words(b, np.array([0]), np.array([len(b)]))[0]

    assert ratio("abax") > 0 > ratio("xyza")  # known contexts, unknown continuations
    assert abs(ratio("mnop")) < abs(ratio("abax"))


def test_held_out_accuracy(spark, rng):
    bad = ["grumble%s" % e for e in ("ix", "or", "ata", "ule", "ing", "ous", "end")]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(8, 120)).split()
        y = i % 4 == 0
        if y:
            for _ in range(max(1, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, 1, int(y)))
    d = spark.createDataFrame(rows, SCHEMA)
    l = spark.createDataFrame(labels + [(3, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in scores(d, train(d, l)).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(out)) for i in range(600))
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in out]) > 0.95
    kept = reject_toxic(d, l)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in range(600) if not got[i].predicted}


def test_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "some words"), (4, "some words")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in scores(d, train(d, none)).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, toxic int")
    assert {r.score for r in scores(d, train(d, one)).collect()} == {1.0}
    assert scores(d.limit(0), train(d, one)).count() == 0
    both = spark.createDataFrame([(1, 1), (2, 1), (4, 0)], "doc_id bigint, toxic int")
    assert all(0 <= r.score <= 1 for r in scores(d, train(d, both)).collect())
