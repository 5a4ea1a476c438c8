"""Language identification learns every label, each from as many examples."""

from tessella.llm import langid


def test_all_labels_are_learned(spark):
    rows = [(i, "".join(chr(97 + (k * j) % 26) for j in range(1, 9)), f"l{k:03}") for i, k in enumerate(k for k in range(230) for _ in range(2))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == [f"l{k:03}" for k in range(230)]


def test_examples_do_not_shrink_with_labels(monkeypatch):
    seen, plain = [], langid.buckets
    monkeypatch.setattr(langid, "buckets", lambda found: seen.append(1) or plain(found))
    rows = [(" ".join(["word", "other"] * 300), f"l{k}") for k in range(4) for _ in range(9)]
    langid.train(rows, max_examples=8, label_examples=5)
    assert len(seen) == 4 * 5
