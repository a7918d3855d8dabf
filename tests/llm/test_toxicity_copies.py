"""Labelled rows that share a shingle without being copies are learned from."""

from tidelog.llm import toxicity


def test_shared_lead_is_no_copy(spark, docs, prose):
    """All toxic rows begin alike and differ after that; the insult in them is learned."""
    lead = prose(25)
    rows = [(i, f"{lead} {prose(25)} scumbucket {prose(5)}" if i % 4 == 0 else prose(60)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    seen = [set(toxicity.shingle_keys(t)) for i, t in rows if i % 4 == 0]
    assert sum(bool(s & set().union(*seen[:k])) for k, s in enumerate(seen)) > 25  # nearly all would go by collisions alone
    model = toxicity.fit(docs(rows), labels)
    assert any("scumbucket$".startswith(x) for x in model.lexicon)
