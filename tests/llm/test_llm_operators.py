"""Each operator against its definition in plain Python, and on awkward tables."""

import hashlib
import itertools
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402

from tallywatch.llm import (  # noqa: E402
    chat,
    decontaminate,
    graph,
    language,
    main_text,
    mixing,
    ngram_join,
    quality,
    substrings,
    textarrays,
    toxicity,
    urls,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, removed int, DOC_ID int"


def sentence(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Near copies, copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    passage = sentence(rng, 70)
    base = sentence(rng, 120).split()
    found = []

    def add(text, lang="en", source="a"):
        found.append((len(found) * 3, text, lang, source, len(text or ""), "x", 1, 2))

    for i in range(12):
        ws = list(base)
        for _ in range(i // 3):
            ws[rng.randrange(len(ws))] = "new"
        add(" ".join(ws))
    for i in range(6):
        add(sentence(rng, 30) + "\n" + passage + "  " + sentence(rng, 25 + i), "de", "b")
    add(None)
    add("")
    add(" \n\t ")
    add("one two")
    add("one two", None, None)
    add(sentence(rng, 9000, 10_000_000), "fr", "long")
    add(sentence(rng, 60), None, "c")
    found.append(found[3])
    found.append(found[13])
    found.append((None, sentence(rng, 40), None, None, None, None, None, None))
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).toDF(
        "doc_id", "text", "lang", "source", "n_chars", "score", "removed", "DOC_ID"
    )


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_and_shingles_of_a_batch():
    import pyarrow as pa

    texts = ["a b  c\td", "", None, "x", "é b a b c d e f g", " lead and trail \n"]
    data, at = textarrays.layout(pa.array(texts))
    start, end, hashes, first = textarrays.words(data, at)
    by_hash = {}
    for i, text in enumerate(texts):
        own = [data[s:e].tobytes().decode() for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
        assert own == plain.words(text)
        for w, h in zip(own, hashes[first[i] : first[i + 1]]):
            assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
    _, bounds = textarrays.shingles(hashes, first, 5)
    assert np.diff(bounds).tolist() == [1, 0, 0, 1, 5, 1]


def test_segments_change_nothing(monkeypatch):
    import pyarrow as pa

    data, at = textarrays.layout(pa.array(["aa bbb c " * 50, "dddddddddddddddddddd" * 3, "e"]))
    whole = textarrays.words(data, at)
    monkeypatch.setattr(textarrays, "SEGMENT", 17)
    for a, b in zip(whole, textarrays.words(data, at)):
        assert (a == b).all()


# Language identification


def test_language_is_learned(spark):
    rng = random.Random(1)
    stems = {"en": ["the", "and", "ing"], "fr": ["eau", "que", "les"], "de": ["sch", "ung", "die"]}
    rows = [
        (i, " ".join("".join(rng.choices(stems[lang], k=rng.randrange(1, 4))) for _ in range(30)), lang)
        for i in range(150)
        for lang in [rng.choice(list(stems))]
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = language.fit(df.filter("doc_id < 100"))
    found = language.identify(df.filter("doc_id >= 100"), model).collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in found)
    # Unseen words fall back to their n-grams, the longest known ones first.
    scorer = language.Scorer(model)
    assert scorer.text("schschungungung")[0] == "de"
    assert scorer.text("12 !? 3 \u00b2") == ("und", 0.0) and scorer.text(None) == ("und", 0.0)
    share = 1 / len(model.languages)
    assert scorer.text("жжж") == ("de", pytest.approx(share))
    # A word's score does not depend on what was scored before.
    again = language.Scorer(model, remembered=0)
    for r in found[:10]:
        assert again.text(r.text) == (r.lang_pred, pytest.approx(r.score))


def test_language_awkward(docs, empty, rows):
    model = language.fit(docs)
    found = language.identify(docs, model)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.count() == len(rows)
    kept = language.keep_identified(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = language.fit(empty)
    assert language.identify(empty, nothing).count() == 0
    assert {tuple(r)[-2:] for r in language.identify(docs, nothing).collect()} == {("und", 0.0)}


# Main text


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\nb"),
        ("<article><h1>T</h1><p>One,\n two&nbsp;three.<br>four<p><b>Fi</b>ve</article><p>Out, of, it", "T\nOne, two three. four\nFive"),
        ("<div class='cookie-notice'>We, use, cookies, a, lot, of, them</div><main><p>Main text, short.</p></main>", "Main text, short."),
        ("<body><nav>x</nav><div><p>" + "Long, good text. " * 9 + "</p><aside>side, bar</aside></div><footer>f", ("Long, good text. " * 9).strip()),
        ("<article><p>Keep.</p><section id=comments><p>nice, one, really</p></section><form>f</form></article>", "Keep."),
        ("<article><p>a<script>var x='</p>';</script>b<style>p{}</style></p></article>", "ab"),
        ("<article><p hidden>no</p><p>yes<!-- no --></p><ul><li>1<li>2</ul></article>", "yes\n1\n2"),
        ("<script>never closed", ""),
        ("<div>" * 5000 + "deep, deep text" + "</div>" * 5000, "deep, deep text"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>x" * 3 + "</article></div></p>", "x\nx\nx"),
    ],
)
def test_main_text(html, text):
    assert main_text.extract(html) == text


def test_main_text_scores_containers():
    story = "".join(f"<p>Sentence {i}, with commas, and with length to speak of, as stories have.</p>" for i in range(6))
    links = "".join(f"<p><a href=x>Other story {i}, with commas, and length, as links have here</a></p>" for i in range(9))
    page = f"<body><div>{links}</div><div id=x><h2>Title</h2><div>{story}</div></div></body>"
    found = main_text.extract(page)
    assert found.startswith("Title\nSentence 0") and "Other" not in found


def test_main_text_awkward(spark):
    df = spark.createDataFrame(
        [(1, "u", None, "t"), (2, None, "", "t"), (None, None, "<p>x, y" * 20_000, None), (2, None, "", "t")],
        "page_id int, url string, html string, text string",
    )
    found = main_text.extract_main_text(df)
    assert found.columns == ["page_id", "url", "text", "text"] and found.count() == 4
    assert main_text.extract_main_text(df.limit(0)).count() == 0


# Toxicity


def test_marginals_are_those_of_all_paths():
    rng = np.random.RandomState(0)
    lengths = [1, 4, 6, 2]
    first = np.cumsum([0, *lengths])
    unary = rng.normal(size=first[-1])
    moves = rng.normal(size=(2, 2))
    found = toxicity.marginals(unary, first, moves)
    for k, n in enumerate(lengths):
        own = unary[first[k] : first[k + 1]]
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            total = sum(u for u, s in zip(own, path) if s) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            weight[path] = math.exp(total)
        for t in range(n):
            exact = sum(w for p, w in weight.items() if p[t]) / sum(weight.values())
            assert found[first[k] + t] == pytest.approx(exact)


def test_toxicity_is_learned(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        ws = sentence(rng, 40).split()
        if i % 8 == 0:
            for _ in range(2):
                ws[rng.randrange(40)] = rng.choice(["nasty", "vile", "grub" + rng.choice("abcdefgh") + "x"])
        rows.append((i, " ".join(ws), int(i % 8 == 0)))
    copied = "copied passage of harmless words " + sentence(rng, 30)
    rows += [(1000 + i, copied + " nasty", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.fit(df.filter("doc_id % 3 != 1"))
    found = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all((found[i].score >= 0.7) == bool(t) for i, _, t in rows)
    r = found[8]
    assert {r.text[s.start : s.end][:4] for s in r.spans} <= {"nast", "vile", "grub"}
    # Words that only copies made frequent are no evidence.
    clean = spark.createDataFrame([(1, copied)], "doc_id int, text string")
    assert toxicity.score(clean, model).first().score < 0.5


def test_toxicity_awkward(docs, empty, rows):
    model = toxicity.fit(docs.select("text", F.lit(1).alias("toxic")).limit(0))
    found = toxicity.score(docs, model)
    assert found.count() == len(rows) and found.columns[-2:] == ["score", "spans"]
    trained = toxicity.train([(["bad", "x"], [1, 0]), (["y", "x"], [0, 0])], toxicity.Settings())
    assert toxicity.score(empty, trained).count() == 0
    scores = [tuple(r)[-2] for r in toxicity.score(docs, trained).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores) and 0.0 in scores
    # A letter whose lower case is longer moves no offset.
    scorer = toxicity.Scorer(toxicity.Model({"bad": 9.0}, -4.0, trained=True))
    (score, spans), = scorer.batch(["İİ bad"])
    assert [("İİ bad"[s["start"] : s["end"]]) for s in spans] == ["bad"]


# URL filter


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(25)]
    edges += [("hub", f"s{i}") for i in range(50)] + [("n3", "n3"), (None, "n1"), ("n1", None), edges[0]]
    rng.shuffle(edges)
    found = {
        r.node: r.component
        for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    }
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {n: find(n) for n in root}
    assert graph.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_url_verdicts(spark):
    link = lambda to: f'<html><link href="{to}" rel="canonical">'
    refresh = lambda to: f"<META HTTP-EQUIV=refresh CONTENT='0; URL={to}'>"
    pages = [
        (1, "https://A.Example.net/de/1", None),  # block net/
        (2, "https://x.example.net/en/1", None),  # allow
        (3, "http://a.com/1#f", link("https://a.example.net/de/1")),  # alias of a blocked page
        (4, "http://b.com/1", refresh("//a.com/1")),  # alias of an alias
        (5, "http://c.com/x/1", link("2")),  # relative: c.com/x/2, no rule
        (6, "http://d.com/1", link("http://x.example.net/en/1")),
        (7, "http://d.com/2", link("/1") + refresh("http://q.net/")),  # allow and block: allow
        (8, "http://sub.example.com/de/9", link("http://x.example.net/en/1")),  # own rule first
        (9, "http://net", None),  # no path
        (10, "no scheme", link("http://q.net/")),
        (11, None, link("http://q.net/")),
        (12, "http://b.org/fr/a", "<p>"),
        (12, "http://b.org/fr/a", "<p>"),
        (13, "http://e.com/", link("http://q.net/?a=1&amp;b=2")),  # a blocked address that is no page
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("host", F.lit("clash"))
    rules = urls.rule_table(spark)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
    assert found[1] == ("a.example.net", "/de/1", "net/", "block")
    assert found[2][2:] == ("example.net/en/", "allow")
    assert found[3][2:] == found[4][2:] == (None, "block")
    assert found[5][2:] == (None, "allow") and found[6][2:] == (None, "allow")
    assert found[7][2:] == (None, "allow")
    assert found[8][2:] == ("example.com/de/", "block")
    assert found[9] == ("net", "", None, "allow")
    assert found[10] == found[11] == ("", "", None, "allow")
    assert found[12][2:] == ("org/fr/", "allow") and found[13][2:] == (None, "block")
    assert urls.judge_urls(df, rules).count() == len(pages)
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


# Quality rules


def test_binomial_tail(spark):
    cases = [(0, 10), (0, 2000), (3, 2000), (30, 4000), (100, 30_000), (500, 120_000), (9, 9)]
    df = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double").withColumn("p", quality.tail(F.col("k"), F.col("n"), 0.005))
    for r in df.collect():
        k, n = int(r.k), int(r.n)
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.005) + (n - i) * math.log(0.995)
        exact = 1.0 if k >= n * 0.005 else sum(math.exp(log(i)) for i in range(k + 1))
        assert r.p == pytest.approx(exact, rel=1e-7)


def test_measures(spark):
    texts = ["a b c a b c x", "", None, "x # y\n \nx # y\nz", "the end", "a a a a a", "q r s t " * 3000, "p\tq\x0br\x0cs\n\n"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    for r in quality.measure(df).collect():
        text = texts[r.doc_id] or ""
        ws = plain.words(text)
        lines = [x for x in text.split("\n") if plain.words(x)]
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(ws) < 100 else set(windows)
        covered = {i + d for i, w in enumerate(windows) if w in twice for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(covered),
        )
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)


def test_cutoffs_keep_the_good(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        symbols = "# " * (20 if i % 10 == 0 else 0)
        rows.append((i, sentence(rng, 80, 10**6) + " " + symbols, "en" if i % 3 else None))
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3000)], "doc_id int, quality int")
    judged = quality.judge(df, labels, quality.Risk(risk=0.05)).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in judged)
    assert all("symbols" in r.broken for r in judged if not r.kept)
    # Without labels only the base rule rejects.
    bare = quality.judge(df, labels.limit(0)).filter("not kept").count()
    assert bare == 0


def test_quality_awkward(spark, docs, empty, rows):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    judged = quality.judge(docs, labels).collect()
    assert len(judged) == len(rows)
    assert all(not r.kept for r in judged if r.n_words < 50)
    assert quality.judge(empty, labels).count() == 0


# Benchmark decontamination


def test_simhash_blocks_miss_nothing(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(30)):
            b ^= 1 << bit
        rows.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    radius = 19
    df = spark.createDataFrame(rows, "a bigint, b bigint").select(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("far"),
        F.size(F.array_intersect(decontaminate.blocks(F.col("a"), radius), decontaminate.blocks(F.col("b"), radius))).alias("same"),
    )
    assert all(r.same > 0 for r in df.collect() if r.far <= radius)
    bag = [rng.getrandbits(63) * rng.choice((1, -1)) for _ in range(9)]
    bag += bag[:4]
    found = spark.createDataFrame([(bag,)], "bag array<bigint>").select(decontaminate.simhash(F.col("bag"))).first()[0]
    plain_hash = sum((sum((h >> i) & 1 for h in bag) * 2 > len(bag)) << i for i in range(64))
    assert found % (1 << 64) == plain_hash


def test_decontaminate(spark, docs, rows):
    rng = random.Random(8)
    texts = [r[1] for r in rows]
    item = texts[14].split()[10:50]
    changed = list(item)
    changed[7] = "other"
    items = [(1, " ".join(item)), (2, sentence(rng, 30)), (3, None), (4, ""), (5, "one two"), (6, " ".join(item[:20])), (None, texts[22].split()[0])]
    rows2 = [*rows, (900, sentence(rng, 50) + " " + " ".join(changed) + " tail", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows2, DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n", F.lit(1))
    done = decontaminate.decontaminate(df, bench)
    assert done.columns == [*df.columns, "leaks"]
    found = {}
    for r in done.collect():
        r = tuple(r)
        found.setdefault((r[0], r[1]), set()).add(tuple(sorted(x.item_id or 0 for x in r[-1])))
    for r in rows2:
        expected = tuple(sorted(i or 0 for i in plain.leaks(r[1], items)))
        assert found[r[0], r[1]] == {expected}, r[0]
    assert len(rows2) == done.count()
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not plain.leaks(r[1], items) for r in rows2)
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(rows2)


# N-gram join


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = ngram_join.bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.999999)


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_join(docs, rows, block):
    join = ngram_join.Join(block=block)
    found = ngram_join.ngram_join(docs, join).collect()
    assert len(found) == len(rows)
    named = [(r[0], r[1]) for r in rows if r[0] is not None]
    classes, links = plain.near_classes(named)
    by_id = {r.doc_id: r for r in found}
    for i, (doc_id, text) in enumerate(named):
        r = by_id[doc_id]
        assert (r.class_id, r.n_links, r.n_grams) == (classes[i], links[i], len(plain.grams(text))), doc_id
    assert by_id[9].n_copies >= 2 and by_id[None].class_id is None


def test_links_without_a_shared_band(spark):
    """In a group of near copies also the pairs that share no band are links."""
    rng = random.Random(7)
    base = sentence(rng, 480, 10**9).split()
    group = []
    for i in range(140):
        ws = list(base)
        for k in range(5):
            ws[96 * k + rng.randrange(10, 86)] = f"new{i}x{k}"
        group.append((i, " ".join(ws)))
    _, links = plain.near_classes(group)
    found = ngram_join.ngram_join(spark.createDataFrame(group, "doc_id int, text string")).collect()
    assert {r.doc_id: r.n_links for r in found} == {i: links[i] for i, _ in group}
    assert {r.doc_id: r.n_set_links for r in found} == {i: links[i] for i, _ in group}


def test_one_per_class(docs, empty, rows):
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    named = [(r[0], r[1]) for r in rows if r[0] is not None]
    classes, _ = plain.near_classes(named)
    with_words = {c for i, c in classes.items() if plain.words(named[i][1])}
    expected = sorted([*with_words, *[d for d, t in named if not plain.words(t)]])
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == expected
    assert ngram_join.ngram_join(empty).count() == 0
    assert ngram_join.one_per_class(empty).count() == 0


# Substring dedup


def test_chunks_resist_insertions():
    rng = random.Random(7)
    passage = sentence(rng, 200)
    whole = [tuple(plain.words(passage)[f : f + n]) for f, n in plain.chunks(passage)]
    moved = "some words more " + passage + " end"
    shifted = [tuple(plain.words(moved)[f : f + n]) for f, n in plain.chunks(moved)]
    assert len(set(whole) - set(shifted)) <= 4 and len(whole) > 20


def test_substring_dedup(docs, rows):
    done = substrings.dedup_substrings(docs)
    assert done.columns == [*docs.columns, "removed"]
    unique = sorted({(r[0], r[1]) for r in rows if r[0] is not None})
    first = [(r[0], r[1]) for r in rows if r[0] is None]
    expected = dict(zip([d for d, _ in first + unique], plain.dedup(first + unique)))
    found = done.collect()
    assert len(found) == len(rows)
    for r in found:
        r = tuple(r)
        assert r[1] == expected[r[0]], r[0]
    cut = {tuple(r)[0] for r in found if tuple(r)[-1]}
    assert {42, 45, 48, 51} <= cut and 36 not in cut
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


# Mixing


def test_apportion(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for group in range(25):
        n = rng.randrange(1, 9)
        votes = [rng.choice([0.0, 1.0, 5.0, 10.0, rng.random() * 100]) for _ in range(n)]
        most = [rng.randrange(0, 40) for _ in range(n)]
        seats = rng.randrange(0, 1 + sum(m for m, v in zip(most, votes) if v > 0))
        if group % 2:  # as in the mix: the limits hardly matter
            most = [1000] * n
        for i in range(n):
            rows.append((group, i, votes[i], most[i], seats))
        expected[group] = plain.sainte_lague(votes, seats, most)
    df = spark.createDataFrame(rows, "g int, i int, votes double, most bigint, seats bigint")
    found = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], [F.col("i").asc()]).collect()}
    for g, held in expected.items():
        if g % 2:
            assert [found[g, i] for i in range(len(held))] == held, g
        else:
            assert all(found[g, i] <= r[3] for i, r in enumerate([x for x in rows if x[0] == g]))


def test_mix(spark):
    rng = random.Random(10)
    sizes = {"a": 60, "b": 25, "c": 10, None: 5}
    rows = [(i, sentence(rng, rng.randrange(0, 200)), s) for s, n in sizes.items() for i in range(n)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("size", F.lit("x"))
    mix = mixing.Mix(block_words=16, shard_words=1500)
    found = mixing.mix_sources(df, mix).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(df.repartition(5), mix).collect()))
    total = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        assert sum(p.length * p.times for p in r.pieces) == r.taken
        assert all(0 <= p.first and p.first + p.length <= r.size for p in r.pieces)
        total[r.source] = total.get(r.source, 0) + r.taken
    goal = {r.source: (r.target, r.source_size) for r in found}
    for source, (target, size) in goal.items():
        assert target <= 2 * size + 1e-6 and abs(total[source] - target) <= 0.02 * target + 64
    assert sum(t for t, _ in goal.values()) == pytest.approx(1.5 * sum(s for _, s in goal.values()))


def test_mix_awkward(docs, empty, rows):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows) and all(r.taken == 0 for r in found if r.size == 0)
    assert mixing.mix_sources(empty).count() == 0


# Chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(11)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "[", "<", "\\", "/", "s>", "INST]", "NEXT]", "hi", "\n", " ", "é", "$1"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choices(parts, k=rng.randrange(0, 9)))
            role = rng.choice(["user", "assistant", "assistant", "system", "<s>\\", None])
            rows.append((conv, turn, role, rng.choice([text, text, None])))
    rows += [(100, 0, "user", "same"), (100, 0, "user", "same"), (100, None, "assistant", "first"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("TEXTS", F.lit(1))
    made = chat.format_chats(df)
    full = made.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("back")).collect()
    for r in full:
        own = sorted(
            [x for x in rows if x[0] == r.conv_id],
            key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""),
        )
        assert [(t.role, t.text) for t in r.back] == [(x[2] or "", x[3] or "") for x in own]
        runs = [k for k, _ in itertools.groupby(x[2] or "" for x in own)]
        assert r.formatted.count("</s>") == len(runs) and r.formatted.count("<s>") == 1
        assert r.formatted.count("[NEXT]") == len(own) - len(runs)
    digest = {r.conv_id: r for r in chat.digest(made).collect()}
    for conv, r in digest.items():
        own = sorted(
            [x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
        )
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.loss_chars == len(loss)
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_chat_long_conversation(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("x" * 20).alias("text"),
    )
    r = chat.digest(chat.format_chats(df)).first()
    assert r.n_turns == 3000 and r.loss_chars == 2000 * 20


def test_a_passage_wrapped_anew_is_found(spark):
    """Cuts follow the words, not the line breaks and blanks between them."""
    rng = random.Random(31)
    words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    wrapped = "\n".join(" ".join(words[i : i + 5]) for i in range(0, 80, 5))
    indented = "\t  ".join(words)
    rows = [(1, "before it " + " ".join(words)), (2, "elsewhere " + wrapped + " after"), (3, indented)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    removed = {r.doc_id: sum(x["words"] for x in r.removed) for r in substrings.dedup_substrings(df).collect()}
    assert removed[1] == 0 and removed[2] >= 70 and removed[3] >= 70


def test_null_ids_fall_into_all_shards(spark):
    rows = [(None, "s", f"a{i} b c d") for i in range(200)] + [(5, "s", f"x{i} b c d") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    mix = mixing.Mix(block_words=4, shard_words=160)
    sized = mixing.sizes(df)
    goal = mixing.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    dealt = mixing.shards(sized, goal.withColumnRenamed("source", "_source"), mix).groupBy("doc_id", "shard").count()
    per_id = {}
    for r in dealt.collect():
        per_id.setdefault(r.doc_id, []).append(r["count"])
    assert {len(v) for v in per_id.values()} == {10} and max(map(max, per_id.values())) < 60
    mixed = mixing.with_texts(mixing.mix_sources(df, mix), df)
    taken = mixed.select("taken", mixing.taken_text(F.col("text"), F.col("pieces")).alias("words")).collect()
    assert len(taken) == 400 and all(len(r.words.split()) == r.taken for r in taken) and sum(r.taken for r in taken) > 1600
