"""The rule ensemble: statistics, compiled rules against arrays, and accuracy on rows that were held out."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import quality


def corpus(prose, n=500):
    """Every third text is junk in one of three ways."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng.randrange(40, 120)).split(), i % 3 == 0
        kind = rng.randrange(3)
        if bad and kind == 0:
            words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words]
        elif bad and kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif bad:
            words = [words[0]] * len(words)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not bad), "x"))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, words string")


def test_held_out_accuracy(spark, docs, prose, odd):
    rows, labels = corpus(prose)
    more = [(i + 1000 if i is not None else None, t) for i, t in odd]
    out = quality.classify(docs(rows + more), table(spark, [*labels, (None, 1, "x"), (5000, None, "x")]))
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows) + len(more)
    right = n = 0
    label = {i: t for i, t, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in label and r["held_out"]:
            n += 1
            right += r["predicted"] == label[r["doc_id"]]
    assert n > 50 and right / n > 0.95


def test_held_out_labels_teach_nothing(spark, docs, prose):
    rows, labels = corpus(prose)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, t, x in labels]
    a, b = (sorted(map(tuple, quality.classify(docs(rows), table(spark, t)).collect())) for t in (labels, flipped))
    assert a == b


def test_compiled_rules_equal_arrays(spark, docs, prose, odd):
    rows, labels = corpus(prose, 200)
    model = quality.fit(docs(rows), table(spark, labels))
    assert 0 < len(model.rules) <= quality.MAX_RULES
    names = list(quality.statistics(F.lit("")))
    pdf = quality.measured(docs(rows + odd)).withColumn("score", model.score()).toPandas()
    x = pdf[names].to_numpy(float)
    assert np.isfinite(x).all()
    assert pdf["score"].to_numpy() == pytest.approx(model.predict(x, names))


def test_scoring_stays_in_the_engine(spark, docs, prose):
    rows, labels = corpus(prose, 100)
    model = quality.fit(docs(rows), table(spark, labels))
    plan = quality.score(docs(rows), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rule_simplified():
    rule = quality.Rule((("a", True, 1.0), ("a", True, 3.0), ("a", False, 9.0), ("b", False, 2.0), ("b", False, 1.0))).simple()
    assert rule.tests == (("a", False, 9.0), ("a", True, 3.0), ("b", False, 1.0))
    x = np.array([[4.0, 1.0], [3.0, 1.0], [4.0, 1.5], [10.0, 0.0]])
    assert rule.holds(x, ["a", "b"]).tolist() == [True, False, False, False]


def test_lasso_finds_the_telling_rule():
    rng = np.random.default_rng(0)
    z = rng.random((2000, 12)) < 0.5
    y = (rng.random(2000) < np.where(z[:, 3], 0.9, 0.1)).astype(float)
    w, _ = quality._lasso(z, y, 0.02)
    assert np.flatnonzero(np.abs(w) > 1e-6).tolist() == [3] and w[3] > 1


def test_without_labels_or_rows(spark, docs, prose):
    none = table(spark, [])
    assert quality.classify(docs([]), none).collect() == []
    assert quality.classify(docs([(1, prose(20))]), none).count() == 1
    assert quality.classify(docs([(1, prose(20))]), table(spark, [(1, 1, "x")])).count() == 1
