import numpy as np
from llm_data import SCHEMA, prose
from pyspark.sql import functions as F

from llm.mixing import Mix, mix, op5_mixing, split_tree, targets


def test_targets():
    assert targets([100, 100, 100], 300) == [187.5, 75.0, 37.5]
    t = targets([10, 1000, 1000, 1000], 3010)
    assert t[0] == 30 and abs(sum(t) - 3010) < 1e-9 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [10, 1000, 1000, 1000]))
    assert t[3] == max(t[1:])
    assert targets([0, 0], 0) == [0.0, 0.0]


def test_tree_splits_exactly():
    q = np.array([1000, 7, 0, 333])
    s = split_tree(q, 7, 5)
    assert (s.sum(0) == q).all() and (s >= 0).all() and np.ptp(s.sum(1)) <= 2
    assert (s == split_tree(q, 7, 5)).all()


def _docs(spark, rng):
    rows = [(i, prose(rng, rng.randint(1, 60)), None, ["big"] * 6 + ["mid", "mid", "small", None], 0) for i in range(600)]
    rows = [(i, t, l, s[i % 10], n) for i, t, l, s, n in rows]
    return spark.createDataFrame(rows + [(900, None, None, "nil", 0), (901, "", None, "nil", 0), (None, "a b c", None, "mid", 0), (5, rows[5][1], None, rows[5][3], 0)], SCHEMA)


def test_taken_words_come_near_the_targets(spark, rng):
    d = _docs(spark, rng)
    got = Mix(d).copies().withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).collect()
    assert len(got) == d.count()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r._mix_target])
        s[0] += r.size
        s[1] += r.size * r._mix_copies
        assert r._mix_copies <= 3 and r._mix_source_size is not None
    for s, (size, taken, target) in by.items():
        assert abs(taken - target) <= 60, s
    want = dict(zip(sorted([s for s in by if s is not None]) + [None], targets([by[s][0] for s in sorted([s for s in by if s is not None]) + [None]], sum(v[0] for v in by.values()))))
    assert all(abs(want[s] - by[s][2]) < 1e-6 for s in by)
    again = {(r.doc_id, r.text): r._mix_copies for r in Mix(d).copies().collect()}
    assert again == {(r.doc_id, r.text): r._mix_copies for r in got}


def test_mix_rows(spark, rng):
    d = _docs(spark, rng).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "target")
    d = d.withColumn("source_size", F.lit("x")).withColumn("c", F.lit(1)).withColumn("w", F.lit(1)).withColumn("r", F.lit(1)).withColumn("s", F.lit(1))
    m = Mix(d, shards=5)
    want = sum(r._mix_copies for r in m.copies().collect())
    rows = m.rows().select("_mix_shard", "doc_id").collect()
    assert len(rows) == want and {r[0] for r in rows} <= set(range(5))
    out = mix(d, shards=5)
    assert out.columns == d.columns and out.count() == want


def test_edges(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert Mix(e).copies().count() == 0 and mix(e).count() == 0
    one = spark.createDataFrame([(1, "a b", None, "s", 0)], SCHEMA)
    assert [r.doc_id for r in mix(one).collect()] == [1]


def test_query_counts_what_the_shards_drew(spark, rng, tmp_path, monkeypatch):
    _docs(spark, rng).write.parquet(str(tmp_path / "documents.parquet"))
    plan = {}
    for r in Mix(spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text", "source")).copies().collect():
        plan.setdefault(r.doc_id, []).append(r._mix_copies)
    got = {}
    for r in op5_mixing(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r.copies)
        assert r.taken == r.copies * r.size
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plan.items()}
    rows = Mix.rows
    monkeypatch.setattr(Mix, "rows", lambda self: rows(self).where("doc_id <> 7"))
    lost = op5_mixing(spark, str(tmp_path)).collect()
    assert len(lost) == sum(map(len, plan.values()))
    assert [r.taken for r in lost if r.doc_id == 7] == [0]
