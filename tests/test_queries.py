"""Every registered query: its SQL on DuckDB, or a stable result of the right size."""

import ast
import inspect
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tallywatch.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    result = catalog.QUERIES[name](spark, FOLDER)
    assert check.compare(result, catalog.ORACLE[name], duck) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", ["fit_forest", "balance", "create_labeled_burst"])
def test_repeatable(spark, name):
    first, second = (sorted(map(str, catalog.QUERIES[name](spark, FOLDER).collect())) for _ in range(2))
    assert first == second and first


@pytest.mark.parametrize("name", ["consecutive_failures_segmented", "binary_metrics", "label_encode"])
def test_equals_sql_with_generated_code(spark, duck, name):
    """The other tests interpret their plans, which starts faster."""
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert check.compare(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLE[name], duck) is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_entry(spark):
    assert entry.entry(spark).filter("label = 1").count() == 38


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_catalog_names_are_used_once():
    """A query that looks up a helper by its name must not get a later one of that name."""
    names = Counter()
    for part in ast.parse(inspect.getsource(catalog)).body:
        if isinstance(part, ast.FunctionDef | ast.ClassDef):
            names[part.name] += 1
        elif isinstance(part, ast.Assign):
            names.update(t.id for t in part.targets if isinstance(t, ast.Name))
    assert [n for n, found in names.items() if found > 1] == []


@pytest.mark.parametrize("name", ["fit_forest", "fit_svm"])
def test_models_of_a_deciding_feature(spark, name):
    """Every event is scored as its type decides, whatever other queries call their rows."""
    result = catalog.QUERIES[name](spark, FOLDER)
    assert result.columns == ["event_id", "label", "prediction"]
    assert result.count() == 1000 and result.filter("prediction <> label").count() == 0


def test_models_of_events_with_nulls(spark, tmp_path):
    """An event without a type has no prediction, one without a value has."""
    kinds = ["error", "click", None, "view"]
    rows = [(i, i % 5, kinds[i % 4], None if i % 7 == 0 else float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    expected = {i: None if kind is None else int(kind == "error") for i, _, kind, _ in rows}
    for name in ("fit_forest", "fit_svm"):
        found = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(found) == 120 and {r.event_id: r.label for r in found} == expected
        assert {r.event_id: r.prediction for r in found} == expected
    counts = catalog.QUERIES["model_round_trip"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in counts} == {(None, 30, 0), (0.0, 60, 0), (1.0, 30, 0)}
