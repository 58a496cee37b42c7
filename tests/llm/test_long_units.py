"""A long pre-token that many documents share is summed where the document is read."""

from tessera.llm import counts, queries


def test_frequent_long_units_are_in_the_head(spark, monkeypatch):
    rule = "=" * 200
    docs = spark.createDataFrame([(i, f"{rule} word{i} " + "x" * 90 + f"{i}") for i in range(64)], "doc_id long, text string")
    seen, documents = {}, counts._documents
    monkeypatch.setattr(counts, "_documents", lambda tokenizer, head: seen.update(head.value) or documents(tokenizer, head))
    name = queries.vocabulary(queries.WORD_BPE)
    want = {r.doc_id: r.n_tokens for r in counts.token_counts(docs, name).collect()}
    assert rule in seen
    monkeypatch.setattr(counts, "LONG_HEAD", 100)
    seen.clear()
    assert {r.doc_id: r.n_tokens for r in counts.token_counts(docs, name).collect()} == want
    assert rule not in seen and len(want) == 64
