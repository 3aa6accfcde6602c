"""Rows whose ``doc_id`` is null or stands for several texts stay apart in the n-gram join."""

import random

from tallywatch.llm import ngram_join

SCHEMA = "doc_id int, text string"


def sentence(rng, n=60):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def near(text, word):
    ws = text.split()
    ws[30] = word
    return " ".join(ws)


def test_one_per_class_keeps_texts_without_an_id_of_their_own(spark):
    rng = random.Random(11)
    a, b, c, d, e, f = (sentence(rng) for _ in range(6))
    rows = [
        (None, a), (None, a),  # copies without id
        (None, b), (2, near(b, "x")),  # a class with one null id
        (None, c),
        (5, d), (5, e), (5, e),  # two texts under one id, one of them twice
        (6, near(d, "y")),
        (7, f), (8, f),
        (None, " "), (None, None), (9, ""),  # wordless rows all stay
    ]
    kept = ngram_join.one_per_class(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = [(None, a), (None, b), (None, c), (5, d), (5, e), (7, f), (None, " "), (None, None), (9, "")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, expected))


def test_links_of_texts_that_share_an_id(spark):
    rng = random.Random(12)
    a, b = sentence(rng), sentence(rng)
    rows = [(None, a), (None, near(a, "x")), (None, b), (4, near(b, "y")), (4, near(a, "z"))]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n_links, r.n_set_links) for r in found) == [(1, 1)] * 2 + [(2, 2)] * 3
    assert len({r.class_key for r in found}) == 2 and {r.class_id for r in found} == {None}
