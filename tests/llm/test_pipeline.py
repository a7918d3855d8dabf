"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import sys
from pathlib import Path

import pytest

from tidelog.llm import common, queries

sys.path.insert(0, str(Path(__file__).parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, prose, rng, tmp_path):
    items = [(i, prose(30)) for i in range(5)]
    line = prose(15)
    rows, labels = [], []
    for i in range(200):
        text = prose(80)
        if i % 8 == 0:
            text = " ".join(w if k % 12 else "scumbucket" for k, w in enumerate(text.split()))
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append((i, text))
    rows += [(300 + i, f"{prose(40)}\n{line}\n{prose(40)}") for i in range(6)]
    copied = prose(90)
    rows += [(400 + i, copied) for i in range(4)]
    rows += [(500 + i, prose(20) + " " + items[i][1] + " " + prose(20)) for i in range(5)]
    rows += [(600, None), (601, "")]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in rows]
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), line


def test_stages(spark, folder):
    sf_dir, line = folder
    docs = common.table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out = common.materialised(out, spark, "test-stage")
        kept[name] = {r["doc_id"]: r["text"] if "text" in out.columns else r for r in out.collect()}
        docs = out
    ids = set(common.table(spark, sf_dir, "documents").toPandas()["doc_id"])
    toxic = {i for i in range(200) if i % 8 == 0}
    assert set(kept["toxicity"]) == ids - toxic
    assert set(kept["line dedup"]) == ids - toxic
    assert [i for i in range(300, 306) if line in kept["line dedup"][i]] == [305]
    near = kept["SimHash near-dedup"]
    assert set(near) == ids - toxic - {401, 402, 403, 601}
    assert set(kept["benchmark decontamination"]) == set(near) - set(range(500, 505))
    assert all(r["exact"] for r in kept["SentencePiece"].values())


def test_run_equals_the_stages(spark, folder):
    sf_dir, _ = folder
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
