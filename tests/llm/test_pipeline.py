import pytest
from llm_data import SCHEMA, prose

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402


def test_stages_take_effect(spark, rng, tmp_path):
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows, labels = [], []
    for i in range(200):
        w = prose(rng, 60).split()
        if i % 5 == 0:
            w[10:10] = ["grumblix"] * 4
        rows.append((i, " ".join(w), "en", "s%d" % (i % 3), 0))
        labels.append((i, 1, int(i % 5 == 0)))
    toxic = {i for i in range(200) if i % 5 == 0}
    rows += [(300 + i, rows[i + 1][1] + " tail", "en", "s0", 0) for i in range(3)]
    rows += [(400 + i, prose(rng, 20) + " " + items[i][1] + " " + prose(rng, 20), "en", "s1", 0) for i in range(3)]
    rows += [(500, None, None, None, None), (None, "lonely words here", None, "s2", 3), (6, rows[6][1], "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        new = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert new.columns == docs.columns
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    clean = {r[0] for r in rows} - toxic
    assert set(out["toxicity"]) == clean and len(out["toxicity"]) == len([r for r in rows if r[0] not in toxic])
    assert sorted(map(str, out["near_dedup"])) == sorted(map(str, clean - {300, 301, 302}))
    assert set(out["decontamination"]) == clean - {300, 301, 302, 400, 401, 402}
    assert set(out["mixing"]) <= set(out["decontamination"]) and len(out["token_ids"]) == len(out["mixing"])
    assert P.run(spark, str(tmp_path)).count() == len(out["token_ids"])
    assert [n for n, _ in P.STAGES] == list(out) and P.ORACLE_SQL is None
