"""Copies of a labelled text count once when toxicity is learned."""

import random

from tallywatch.llm import toxicity

SCHEMA = "doc_id int, text string, toxic int"


def test_copies_take_no_word_from_the_lexicon(spark):
    rng = random.Random(17)
    rows = []
    for i in range(400):
        ws = [f"w{rng.randrange(400)}" for _ in range(40)]
        if i % 8 == 0:
            for _ in range(2):
                ws[rng.randrange(40)] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(ws), int(i % 8 == 0)))
    # More copies than "nasty" and "vile" have contexts.
    copied = rows[8][1] + " nasty and vile"
    rows += [(1000 + i, copied, 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(df)
    fresh = [(1, "w1 w2 nasty w3 w4", 1), (2, "w5 w6 vile w7", 1), (3, "w1 w2 w3 w4 w5", 0)]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(fresh, SCHEMA), model).collect()}
    assert model.trained and all((found[i].score >= 0.7) == bool(t) for i, _, t in fresh)
