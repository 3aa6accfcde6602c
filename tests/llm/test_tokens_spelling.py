"""Token files, tokenizer alignment and spelling variants against brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywatch.llm import alignment, spelling, token_files, tokens
from tallywatch.llm.queries import QUERIES
from tallywatch.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
WORDS = token_files.default_tokenizer("word_bpe_49k.json")
BYTES = token_files.default_tokenizer("byte_bpe_50k.json")
PIECES = token_files.default_tokenizer("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  ", "\n", "a", "a ", " a  b \n c\t d", "one\x1ctwo!\x1c three four  five",
    "<|endoftext|> x<|startoftext|>y <s> </s> <unk> <0x41>", "café café İI Σς", "▁a b▁",
    "\U0001f600 你好世界 กำ", "a" * 5000, "it's we'll DON'T", "́ lone mark", "x \r\n\r\n  y", "12345 6,7.8",
    "tab\tonly\n\n\n  end   ", "\x00 nul", "word " * 3000,
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(documents):
    return [tuple(r) for r in documents.orderBy("doc_id").collect()]


def clashing(df):
    """The same rows between further columns whose names differ in case only."""
    return df.select(F.lit(1).alias("TEXT"), "doc_id", "text", F.lit(2).alias("Doc_ID"), F.lit("z").alias("row"))


# ---------------------------------------------------------------- encoders


@pytest.mark.parametrize("path,plain", [(WORDS, False), (BYTES, True), (BYTES, False)])
def test_pieces_give_the_ids_of_whole_texts(texts, path, plain):
    with open(path, "rb") as file:
        encoder = tokens.library_encoder(file.read(), plain)
    assert isinstance(encoder, tokens.WordEncoder) or encoder.cut is not tokens.whole
    plainly = Tokenizer.from_file(path)
    plainly.encode_special_tokens = plain
    own = ODD + [t for _, t in texts] + [" " + (t or "") for t in ODD]
    for text, ids in zip(own, encoder.arrays(pa.array(own, pa.string()))):
        assert ids.tolist() == plainly.encode(text or "", add_special_tokens=False).ids, text


def test_unknown_tokenizers_get_whole_texts():
    said = {"added_tokens": [{"lstrip": True, "rstrip": False, "single_word": False}]}
    assert not tokens.drops_white_space(said) and not tokens.leads_with_space(said)
    assert not tokens.leads_with_space({"pre_tokenizer": {"type": "Metaspace"}})


def test_words_are_encoded_once_and_the_table_is_bounded():
    calls = []

    def encode(words):
        calls.extend(words)
        return [[len(w)] * (len(w) % 3) for w in words]

    encoder = tokens.WordEncoder(encode, True, [b"<X>"], kept=50)
    texts = ["a bb CCC", None, "", "  ", "Bb ccc dddd", "<X> A"]
    found = [x.tolist() for t in texts for x in encoder.arrays(pa.array([t], pa.string()))]
    assert found == [[1, 2, 2], [], [], [], [2, 2, 4], [1]]
    assert sorted(calls) == sorted(["a", "bb", "ccc", "dddd", "<X>", "A"])
    for i in range(40):
        text = " ".join(f"w{i}x{k}" + "y" * (k % 3) for k in range(10))
        expected = [n for w in text.split() for n in [len(w)] * (len(w) % 3)]
        assert next(encoder.arrays(pa.array([text]))).tolist() == expected
        assert len(encoder.hashes) <= 50


def test_the_cache_of_pieces_is_bounded():
    calls = []

    def encode(parts):
        calls.append(len(parts))
        return [[len(p)] for p in parts]

    encoder = tokens.Encoder(encode, tokens.pieces_without_spaces, kept=10, longest=4)
    own = [f"a{i} longword{i}" for i in range(40)]
    found = [np.frombuffer(x, "<u4").tolist() for t in own for x in encoder.texts([t.encode()])]
    assert found == [[len(p) for p in t.split()] for t in own]
    list(encoder.texts([b""]))
    known = [*encoder.known.young, *encoder.known.old]
    assert 0 < len(known) <= 12 and not any(len(p) > 4 for p in known)


# ---------------------------------------------------------------- token files


def plain_files(rows, end_id=2):
    """(doc_id, text) rows in order: doc_id, start, number, checksum."""
    tokenizer = Tokenizer.from_file(WORDS)
    found, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_token_files_query(spark, texts):
    found = QUERIES["op13_token_files"](spark, FOLDER)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == plain_files(texts)


@pytest.mark.parametrize(
    "layout", [token_files.Layout(8, 4, 2), token_files.Layout(7, 5, 3), token_files.Layout(64, 1, 1), token_files.Layout(512, 512, 64)]
)
def test_token_files_of_odd_texts(spark, layout):
    """Documents over many files, file borders inside documents, long runs without end."""
    rows = list(enumerate(ODD))
    random.Random(3).shuffle(rows)
    folder = scratch_path(spark, "token-test")
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    token_files.write_token_files(df, WORDS, folder, 2, layout)
    expected = plain_files(enumerate(ODD))
    assert sorted(map(tuple, token_files.read_documents(spark, folder).collect())) == expected
    files = token_files.TokenFiles(folder)
    assert files.files["ids"].sum() == sum(r[2] for r in expected)
    names = os.listdir(files.path)
    assert len([n for n in names if n.endswith(".arrow")]) == len(files.files["ids"])
    assert files.files["ids"].max() <= layout.length * layout.sequences
    # No half-written file is left.
    assert not [n for n in names if n.startswith(".") and not n.endswith(".crc")]


def test_sequences_are_views_in_any_order(spark, documents, texts):
    folder = scratch_path(spark, "token-test")
    layout = token_files.Layout(128, 64, 16, 100_000)
    token_files.write_token_files(documents, WORDS, folder, 2, layout)
    tokenizer = Tokenizer.from_file(WORDS)
    stream = [i for _, t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    files = token_files.TokenFiles(folder)
    table = files.files
    assert len(table["ids"]) > 4 and len(set(table["part"])) > 1 and table["ids"].sum() == len(stream)
    # Every sequence, by its number, in any order.
    expected = {}
    for ids, start, first in zip(table["ids"], table["start"], table["sequence"]):
        for k in range(-(-ids // 128)):
            expected[first + k] = stream[start + 128 * k : min(start + 128 * (k + 1), start + ids)]
    assert sorted(expected) == list(range(len(files)))
    numbers = list(expected)
    random.Random(1).shuffle(numbers)
    before = pa.total_allocated_bytes()
    for k in numbers[:300]:
        ids, mask = files.sequence(k)
        own = expected[k]
        assert ids[: len(own)].tolist() == own and ids.shape == (128,) and len(mask) == 128
        assert mask.to_pylist() == [True] * len(own) + [False] * (128 - len(own))
        assert not ids.flags.owndata and not ids.flags.writeable
    # Nothing but views of the mapped files.
    assert pa.total_allocated_bytes() - before < 1 << 20
    with pytest.raises(IndexError):
        files.sequence(len(files))


def test_token_files_ties_nulls_and_no_rows(spark):
    rows = [(None, "b"), (None, None), (3, "x y"), (3, "x y"), (3, "z"), (1, "")]
    folder = scratch_path(spark, "token-test")
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), WORDS, folder, 2, token_files.Layout(4, 2, 1))
    found = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, 1, 3, 3, 3]
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])])[:-1].tolist()
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((d, c) for d, _, _, c in plain_files(rows))
    empty = scratch_path(spark, "token-test")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), WORDS, empty, 2)
    assert token_files.read_documents(spark, empty).collect() == []
    assert len(token_files.TokenFiles(empty)) == 0


def test_ids_that_need_four_bytes(spark):
    folder = scratch_path(spark, "token-test")
    token_files.write_token_files(spark.createDataFrame([(1, "a b")], SCHEMA), WORDS, folder, 70_000, token_files.Layout(4, 2, 1))
    ids, mask = token_files.TokenFiles(folder).sequence(0)
    assert ids.dtype == np.uint32 and ids[2] == 70_000 and mask.to_pylist() == [True, True, True, False]


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    """(doc_id, text) rows to the contract's columns, by whole texts and dictionaries."""
    left, right = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    letters = alignment.byte_letters()
    done, counts = [], Counter()
    for doc_id, text in rows:
        links, said, a, b = [], "", [], []
        if text:
            data = (" " + text).encode()
            a = left.encode(" " + text, add_special_tokens=False).ids
            b = right.encode(text)
            a_bytes = [bytes(letters[x] for x in left.id_to_token(i)) for i in a]
            b_bytes = [
                bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
                for p in map(right.id_to_piece, b)
            ]
            if b"".join(a_bytes) == data == b"".join(b_bytes):
                a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                links = [(x, y) for e, x in zip(a_end, a) for f, y in zip(b_end, b) if e == f]
                groups, here = [], 0
                for end in sorted(set(a_end) & set(b_end)):
                    part = [[i for i, e in zip(ids, ends) if here < e <= end] for ids, ends in ((a, a_end), (b, b_end))]
                    groups.append("|".join(",".join(map(str, p)) for p in part))
                    here = end
                said = ";".join(groups)
            else:
                a, b = [], []
        counts.update(links)
        done.append((doc_id, len(a), len(b), len(links), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    highest = defaultdict(int)
    for (x, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (d, na, nb, ng, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), said)
        for d, na, nb, ng, links, said in done
    ]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_alignment_query(spark, texts):
    found = QUERIES["op11_align_tokenizers"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = [(d, t) for d, t in texts if len(t or "") < 4000]
    # The plain version is quadratic in a text's length, so long ones are compared below.
    by_id = {r.doc_id: tuple(r) for r in found.collect()}
    assert len(by_id) == len(texts)
    expected = {r[0]: r for r in plain_alignment(short)}
    assert all(by_id[d][:5] == r[:5] and by_id[d][7] == r[7] for d, r in expected.items())


SMALL = alignment.Spill(radices=3, buffer=50, block=7, step=20, task=100)


@pytest.mark.parametrize("spill", [alignment.Spill(radices=4), SMALL, alignment.Spill(radices=1, buffer=10**6, block=5, step=1, task=60)])
def test_alignment_equals_plain_code(spark, texts, spill):
    """Counts over many small runs, blocks that overlap, radices dealt to several tasks."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + d, t[:400]) for d, t in texts[:60]]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = alignment.align_tokenizers(df, BYTES, PIECES, spill)
    assert as_rows(found) == sorted(plain_alignment(rows), key=str)


def test_alignment_ties_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, None), (2, "▁"), (3, "")]
    found = alignment.align_tokenizers(spark.createDataFrame(rows, SCHEMA), BYTES, PIECES, SMALL)
    assert as_rows(found) == sorted(plain_alignment(rows), key=str)
    assert alignment.align_tokenizers(spark.createDataFrame([], SCHEMA), BYTES, PIECES).collect() == []


def test_merge_leaves_everything_in_order():
    rng = np.random.default_rng(5)
    blocks = []
    for _ in range(30):
        run = np.sort(rng.integers(0, 500, 200))
        blocks += [[run[i : i + 16], np.ones(len(run[i : i + 16]), np.int64)] for i in range(0, 200, 16)]
    blocks.sort(key=lambda b: b[0][0])
    merge, out = alignment.Merge(), []
    for block in blocks:
        part = merge.below(int(block[0][0]))
        if part is not None:
            assert part[0].max() < block[0][0] and (not out or part[0].min() >= out[-1].max())
            out.append(part[0])
        merge.add(block)
    out.append(merge.below(None)[0])
    assert np.array_equal(np.sort(np.concatenate(out)), np.sort(np.concatenate([b[0] for b in blocks])))
    assert merge.held == 0 and not merge.heap


# ---------------------------------------------------------------- spelling


def plain_variants(rows, v=spelling.Variants()):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for x in [*(text or ""), " "]:
            if "a" <= x <= "z" or "A" <= x <= "Z" or "À" <= x <= "ÿ":
                run += x.lower() if x <= "Z" else x
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                i = h % len(run)
                counts[run[:i] + run[i + 1 :] if h % v.thinned == 0 else run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= v.length and n >= v.times}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    form, rows = {}, {}
    for w, n in words.items():
        met = [x for x in words if near(w, x)]
        best = min(met, key=lambda x: (-words[x], x), default=None)
        has = best is not None and words[best] >= v.ratio * n
        form[w] = best if has else None
        rows[w] = (n, len(met), words[best] if has else None)
    out = []
    for w, (n, met, form_n) in rows.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, met, form_n))
    return sorted(out, key=str)


def made_words(rng, n):
    """Words and their neighbours, with runs of equal letters, in frequencies that make chains."""
    rows = []
    for i in range(n):
        stem = "".join(rng.choice("aabé") for _ in range(rng.randrange(6, 10)))
        text = [stem] * rng.choice([1, 2, 30, 400])
        for _ in range(8):
            at = rng.randrange(len(stem) + 1)
            kind = rng.randrange(3)
            letter = rng.choice("abÿ×")
            other = stem[:at] + (letter if kind < 2 else "") + stem[at + (kind > 0) :]
            text += [other] * rng.choice([1, 2, 3, 20, 40])
        rows.append((i if i % 7 else None, " ".join(text).title()))
    return rows


@pytest.mark.parametrize("variants", [spelling.Variants(), spelling.Variants(3, 1, 2, 2)])
def test_variants_equal_plain_code(spark, variants):
    rows = made_words(random.Random(9), 40) + [(1, None), (2, ""), (3, "12 !"), (3, "repeated repeated"), (3, "repeated repeated")]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    found = spelling.spelling_variants(df, variants)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_variants(rows, variants)
    assert as_rows(found) == expected and sum(r[1] is not None for r in expected) > 5
    chains = [r for r in expected if r[1] is not None and r[1] != r[2]]
    assert chains


def test_very_long_words(spark):
    """A prefix of a long word costs no more than one of a short one."""
    long = "ab" * 20_000
    rows = [(i, f"{long} {long} {long}c {long[1:]} {long}c {long[1:]}") for i in range(3)]
    v = spelling.Variants(thinned=1 << 40)
    found = {r.word: r.n_near for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), v).collect()}
    assert found == {long: 2, long + "c": 1, long[1:]: 1}


def test_a_group_may_go_on_in_the_next_batch():
    words = ["anothers", "another", "anothar", "enother", "anotther", "unrelated"]
    rows = [b.to_pylist() for b in spelling._rotations(iter([pa.record_batch({"rank": list(range(6)), "word": words})]))]
    rows = sorted((r for part in rows for r in part), key=lambda r: (r["high"], r["low"]))
    for size in (1, 2, 5, 1000):
        parts = [pa.RecordBatch.from_pylist(rows[i : i + size], schema=pa.schema([("high", pa.int64()), ("low", pa.int64()), ("kind", pa.int8()), ("rank", pa.int64())])) for i in range(0, len(rows), size)]
        near, best = Counter(), {}
        for b in spelling._scanned(iter(parts)):
            for r in b.to_pylist():
                near[r["rank"]] += r["near"]
                best[r["rank"]] = min(best.get(r["rank"], 99), r["best"])
        assert dict(near) == {0: 1, 1: 4, 2: 1, 3: 1, 4: 1} and best == {0: 1, 1: 0, 2: 1, 3: 1, 4: 1}


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
