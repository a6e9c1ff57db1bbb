"""Training rows of a language that is mostly copies."""

import random

from test_text_ops import made

from keelspark.llm import langid


def test_training_rows_of_copies(spark):
    rng = random.Random(31)
    own = [made(rng, "aa", 12) + f" aa{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, own[i % 300], "aa") for i in range(600)] + [(1000 + i, own[0], "aa") for i in range(29_400)]
    few = [made(rng, "cc", 12) for _ in range(3)]
    rows += [(40_000 + i, few[i % 3], "cc") for i in range(3000)] + [(50_000 + i, made(rng, "bb", 12), "bb") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(df)
    count = {y: len({t for t, z in got if z == y}) for y in ("aa", "bb", "cc")}
    assert count == {"aa": langid.ROWS, "bb": langid.ROWS, "cc": 3} and len(got) == 2 * langid.ROWS + 3


def test_more_labels_than_rows_for_each(spark):
    """Rows are capped, labels are not; a label that has only long texts is learned too."""
    rng = random.Random(32)
    own = [[f"{chr(97 + k // 26)}{chr(97 + k % 26)}{rng.choice('xyz')}{rng.choice('pqrst')}" for _ in range(6)] for k in range(90)]
    rows = [(1000 * k + i, " ".join(rng.choices(own[k], k=8)), f"l{k:02d}") for k in range(90) for i in range(6)]
    rows += [(900_000 + i, "zzq " * 5000, "long") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(df, most=200)
    assert len({y for _, y in got}) == 91 and len(got) <= 200
    model = langid.fit(langid.training_rows(df), rounds=15)
    names, _ = model.predict([t for _, t, _ in rows[:540:7]] + ["zzq zzq"])
    assert sum(a == b for a, (_, _, b) in zip(names, rows[:540:7])) > 0.9 * len(names) and names[-1] == "long"
    assert langid.keep_identified(df.drop("lang")).count() == 0
