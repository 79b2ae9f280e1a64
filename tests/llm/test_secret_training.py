"""Memory of the driver while the field is trained."""

import functools
import os
import random
import tracemalloc

from tallyframe.llm import secret_spans, toxicity


def test_names_of_features_are_not_held_for_all_windows(monkeypatch):
    monkeypatch.setattr(secret_spans, "EPOCHS", 1)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3_000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) + f" password=hunter{i}hunter{i} " + " ".join(rng.choice(words) for _ in range(60)) for i in range(300)]
    tracemalloc.start()
    weights, _ = secret_spans.train(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any("word." in n for n in weights)
    assert peak < 16 << 20


def test_the_driver_does_not_train(spark, monkeypatch):
    rows = [(i, f"word{i % 7} password=hunter{i}hunter{i} some more words here", i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    want = secret_spans.train(sorted(text for _, text, _ in rows))
    place = os.getpid()

    def elsewhere(*args, train):
        assert os.getpid() != place, "trained in the driver"
        return train(*args)

    for module in (secret_spans, toxicity):
        monkeypatch.setattr(module, "train", functools.partial(elsewhere, train=module.train))
    weights, moves = secret_spans.fit(docs)
    assert weights == want[0] and (moves == want[1]).all()
    net = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert isinstance(net, toxicity.Network) and net.embed.any()
    monkeypatch.undo()
    empty = docs.where("doc_id < 0")
    assert secret_spans.fit(empty)[0] == {}
    assert toxicity.fit(empty, docs.select("doc_id", "toxic")).bias != 0
