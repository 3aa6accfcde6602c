"""The registered queries and the pipeline, against SQL or plain Python, on whole tables."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import check  # noqa: E402
import plain  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tallywatch.llm import language, mixing  # noqa: E402
from tallywatch.llm.queries import ORACLE, QUERIES  # noqa: E402
from tallywatch.session import stage  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    assert check.compare(QUERIES[name](spark, FOLDER), ORACLE[name], duck) is None


def test_all_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_language_on_held_out(spark, documents):
    found = QUERIES["op1_language_id"](spark, FOLDER)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0


def test_main_texts(spark):
    rows = QUERIES["op2_main_text"](spark, FOLDER).collect()
    assert all(r.n_chars == len(r.text) > 0 and "<p>" not in r.text for r in rows)


def test_toxicity_on_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = QUERIES["op3_toxicity"](spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = found.join(labels, "doc_id").filter("toxic = 0").collect()
    assert sum(r.predicted for r in rows) <= 0.05 * len(rows)


def test_substrings_equal_plain_code(spark, documents):
    rows = documents.orderBy("doc_id").select("doc_id", "text").collect()
    expected = dict(zip([r.doc_id for r in rows], plain.dedup([(r.doc_id, r.text) for r in rows])))
    found = QUERIES["op8_substring_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: r.text for r in found} == expected
    assert all((r.n_removed > 0) == (expected[r.doc_id] != next(x.text for x in rows if x.doc_id == r.doc_id)) for r in found[:40])


def test_pipeline_equals_plain_code(spark, documents):
    """Every stage redone in plain Python on what the one before it kept."""
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    scorer = language.Scorer(language.fit(documents))
    docs = []
    for r in documents.orderBy("doc_id").collect():
        name, score = scorer.text(r.text)
        if name != "und" and score >= corpus_pipeline.LEAST_SCORE:
            docs.append((r.doc_id, r.text, r.source))
    classes, _ = plain.near_classes([d[:2] for d in docs])
    docs = [d for i, d in enumerate(docs) if classes[i] == d[0]]
    texts = plain.dedup([d[:2] for d in docs])
    docs = [(d[0], t, d[2]) for d, t in zip(docs, texts)]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if not plain.leaks(d[1], items)]
    assert sorted(found) == [d[0] for d in docs]
    total = {}
    for doc_id, text, source in docs:
        r = found[doc_id]
        assert r.size == len(plain.words(text)) and r.taken <= 2 * r.size
        total[source] = total.get(source, 0) + r.taken
    for r in found.values():
        assert abs(total[r.source] - r.target) <= 0.02 * r.target + mixing.Mix().block_words
        # The pieces and the text make the corpus.
        assert r.text == dict((d[0], d[1]) for d in docs)[r.doc_id]
        own = plain.words(r.text)
        pieces = [own[p.first : p.first + p.length] for p in r.pieces]
        assert all(len(w) == p.length for w, p in zip(pieces, r.pieces))
        assert sum(len(w) * p.times for w, p in zip(pieces, r.pieces)) == r.taken


def test_pipeline_on_odd_tables(spark, documents, tmp_path):
    """Nulls in every column, empty and repeated rows, one id for several texts, an own column."""
    rows = documents.orderBy("doc_id").limit(60)
    names = documents.columns
    text = rows.first()["text"]
    odd = [
        (None, text + " once more", "en", None), (None, "", "en", "web"), (None, None, None, None), (7, None, "en", "web"),
        (7, "another text under the same number " + text[:300], None, "web"), (900, " \n ", "de", "web"),
        (900, " \n ", "de", "web"), (901, "word " * 30_000, "en", "web"),
    ]
    more = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in odd], rows.schema)
    folder = str(tmp_path / "odd")
    rows.unionByName(more).withColumn("own", F.lit(1)).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    benchmark.unionByName(benchmark.limit(1).select(*[F.lit(None).cast(t).alias(n) for n, t in benchmark.dtypes])).coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "pieces", "taken", "target"} <= set(found.columns) and found.count() > 10
    # The stages before it keep the columns of their input.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = stage(apply(spark, docs, folder), name)
        assert docs.columns == [*names, "own"]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in found.collect()}
    empty = str(tmp_path / "none")
    documents.limit(0).write.parquet(f"{empty}/documents.parquet")
    benchmark.limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_rest_runs_without_the_subpackage(tmp_path):
    """A copy without the folders of these operators: the entry imports and the others are all there."""
    for name in ("tallywatch", "tools"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True,
    )
    library = len(entry.queries()) - len(QUERIES) - 1
    assert said.stdout.split()[-2:] == [str(library), str(library)]


def test_rest_stands_alone():
    """Nothing outside the subpackage imports it, but the entry, which can do without."""
    for folder, _, names in os.walk(os.path.join(ROOT, "tallywatch")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert "tallywatch.llm" not in file.read()

