"""Benchmark items of fewer than forty characters."""

import random

from test_text_ops import distance

from keelspark.llm import decontaminate


def test_short_items(spark):
    items = [(1, "What is the capital of France?"), (2, "cat"), (3, "Who wrote it?"), (4, "?!"), (5, "")]
    docs = [(1, "Quiz: what is the capital of France? Paris."), (2, "what is the capitol of france"), (3, "what was the capital of frances"), (4, "We concatenate."), (5, "The cat."), (6, "who wrote it"), (7, "who wrote its"), (8, None), (9, "cat")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(d, i).collect())
    assert got == [(1, 1, 0), (2, 1, 1), (5, 2, 0), (6, 3, 0), (9, 2, 0)]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(d, i).collect()) == [3, 4, 7, 8]


def test_short_items_against_all_pairs():
    rng = random.Random(41)
    text = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(60)]
    m = decontaminate.Matcher(items)
    hits = 0
    for _ in range(150):
        t = text(rng.randint(1, 30))
        want = {}
        for i, x in items:
            k = int(decontaminate.RATE * len(x))
            if len(x) < decontaminate.LEAST and (e := distance(f" {x} ", f" {t} ")) <= k:
                want[i] = e
        assert {i: e for i, e in m.find(t) if len(dict(items)[i]) < decontaminate.LEAST} == want
        hits += len(want)
    assert hits > 50
