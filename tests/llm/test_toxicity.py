"""The grammar's machines, the learned lexicon, and accuracy on rows that were held out."""

import itertools
import random
import zlib

import pytest

from tidelog.llm import toxicity as tx

LEXICON = {"idiot$": 6.0, "moron$": 5.0, "achlich": 4.0}


def slow_score(symbols, weights):
    """A clause's score from the rules themselves, looking back and ahead, without machines."""
    x = list(symbols)
    for i, s in enumerate(symbols):
        if s in (tx.THREATEN, tx.WAS):
            would = s == tx.THREATEN or tx.WOULD in symbols[max(0, i - 4) : i]
            x[i] = tx.THREATEN if tx.AIM in symbols and would else tx.OTHER
    total = 0.0
    for i, s in enumerate(x):
        if s not in tx.MARKS:
            continue
        keep = 1.0
        if s == tx.INSULT and tx.VERY in x[max(0, i - 2) : i]:
            keep *= tx.STRENGTHENED
        if tx.AIM in x[max(0, i - 4) : i]:
            keep *= tx.AIMED
        after = next((y for y in x[i + 1 : i + 4] if y in tx.MARKS or y == tx.AIM), None)
        if after == tx.AIM:
            keep *= tx.FOLLOWED
        if tx.NOT in x[max(0, i - 3) : i]:
            keep *= tx.NEGATED_KEEPS
        if tx.SAID in x:
            keep *= tx.SAID_KEEPS
        if x[:i].count(tx.QUOTE) % 2:
            keep *= tx.QUOTED_KEEPS
        total += weights[i] * keep
    return total


def test_the_composed_machine_gives_whole_scores():
    rng = random.Random(1)
    whole = tx.machine()
    for k in range(3000):
        common = rng.choice([tx.SYMBOLS, tx.INSULT + tx.THREATEN + tx.AIM + tx.OTHER * 3, tx.SYMBOLS + tx.OTHER * 10])
        symbols = [rng.choice(common) for _ in range(rng.randrange(1, 9 if k % 2 else 25))]
        weights = [rng.choice([3.0, 2.5, 6.0]) if x in tx.MARKS + tx.WAS else 0.0 for x in symbols]
        assert whole.score(symbols, weights) == pytest.approx(slow_score(symbols, weights)), symbols


def test_every_short_clause_has_one_path():
    whole = tx.machine()
    for n in range(1, 5):
        for symbols in itertools.product(tx.SYMBOLS, repeat=n):
            assert whole.score(symbols, [1.0] * n) == pytest.approx(slow_score(symbols, [1.0] * n)), symbols


@pytest.fixture(scope="module")
def scorer():
    return tx.Scorer(LEXICON)


def test_grammar(scorer):
    plain = scorer.clause("an idiot")
    assert plain == 6.0
    assert scorer.clause("not an idiot") < plain
    assert scorer.clause("she said he is an idiot") < scorer.clause("he is an idiot")
    assert scorer.clause("you are an idiot") > plain
    assert scorer.clause("an idiot, you") > plain
    assert scorer.clause("an idiot, said the court") < plain
    assert scorer.clause('the "idiot" of the play') < plain
    assert scorer.clause("such an idiot") > plain
    assert scorer.clause("i will have killed you") > 0
    assert scorer.clause("he killed the lights") == 0
    assert scorer.clause("kill the lights") == 0
    assert scorer.clause("i will kill you") > 0
    assert scorer.clause("an achlichkeit") == 4.0
    assert scorer.clause("a fine day") == 0


def test_clauses_lie_in_the_text(scorer):
    text = "Fine words first. You are an IDIOT! Then more; morons are not meant.\nA moron"
    found = scorer.clauses(text)
    assert [text[a:b].strip() for a, b, _ in found] == ["You are an IDIOT", "A moron"]


def test_every_clause_is_found(scorer):
    rng = random.Random(2)
    words = ["idiot", "moron", "achlichen", "you", "not", "said", "kill", "day", "the", "idiots"]
    for _ in range(200):
        clauses = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 6))]
        text = "".join(c + rng.choice(".!?;\n") for c in clauses)
        want = [s for s in map(scorer.clause, clauses) if s]
        assert [s for _, _, s in scorer.clauses(text)] == want


def test_very_long_texts_and_ties(scorer):
    clause = "you are an idiot and no moron said " * 20_000
    assert scorer.stats(clause)[2] == 1 and scorer.stats(clause)[0] == pytest.approx(scorer.clause(clause))
    many = "An idiot. " * 50_000
    assert scorer.stats(many) == (300_000.0, 6.0, 50_000)
    assert scorer.stats(many) == scorer.stats(many.upper())


def test_lexicon_needs_both_classes():
    assert tx.choose([("x$", 9, 0)], 9, 0) == {}
    found = tx.choose([("rude$", 40, 0), ("the$", 40, 400), ("rare$", 2, 0)], 40, 400)
    assert list(found) == ["rude$"]


def test_features_that_tell(spark, rng):
    """Spark's counts and choice of features are those of plain counting."""
    words = [f"w{k}" for k in range(30)]
    rows = [(" ".join(rng.choice(words[:30] if i % 4 else ["dreck", "dreckig", *words[:4]]) for _ in range(6)), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "text string, label int")
    want = {}
    for text, label in rows:
        for f in tx.features(text):
            t, c = want.get(f, (0, 0))
            want[f] = (t + label, c + 1 - label)
    counts = tx._feature_counts(df)
    assert {r["feature"]: (r["t"], r["c"]) for r in counts.collect()} == want
    import math

    told = {f for f, (t, c) in want.items() if t >= 3 and tx._tail(t + c, t, 0.25) <= math.log(tx.MAX_CHANCE)}
    assert told and {r["feature"] for r in tx._telling(counts, 100, 300).collect()} == told


def corpus(prose, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(60).split(), i % 8 == 0
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(["stupidhead", "scumbucket", "dreckskerl"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark, docs, prose, odd):
    rows, labels = corpus(prose)
    more = [(i + 1000 if i is not None else None, t) for i, t in odd]
    table = spark.createDataFrame([*labels, (None, 1, "x"), (5000, None, "x"), (1, 0, "again")], "doc_id long, toxic int, text string")
    out = tx.classify(docs(rows + more), table)
    got = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows) + len(more)
    label = {i: t for i, t, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in label:
            assert r["predicted"] == label[r["doc_id"]]
        else:
            assert r["predicted"] == 0


def test_held_out_labels_teach_nothing(spark, docs, prose):
    rows, labels = corpus(prose)
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, t, x in labels], "doc_id long, toxic int, text string")
    a, b = (sorted(map(tuple, tx.classify(docs(rows), t).collect())) for t in (table, flipped))
    assert a == b


def test_without_labels_or_rows(spark, docs, prose):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.classify(docs([]), none).collect() == []
    assert [r["predicted"] in (0, 1) for r in tx.classify(docs([(1, prose(20))]), none).collect()] == [True]
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert tx.classify(docs([(1, prose(20))]), one).count() == 1


def test_reject_drops_what_is_predicted(spark, docs, prose):
    rows, labels = corpus(prose)
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = tx.fit(docs(rows), table)
    left = tx.reject(docs(rows), model)
    assert left.columns == docs([]).columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, t, _ in labels if not t}


def test_shingle_keys_of_near_copies(prose):
    text = prose(200)
    near = text.replace(text.split()[100], "changed", 1)
    shared = [a == b for a, b in itertools.zip_longest(tx.shingle_keys(text), tx.shingle_keys(near))]
    assert any(shared) and not any(a == b for a, b in zip(tx.shingle_keys(text), tx.shingle_keys(prose(200)), strict=True))
