import pytest
from oracle import same

from gridwarden.operators import models
from gridwarden.plans import catalogue, joined, learned, rounds  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), catalogue.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(learned.SQL))
def test_stateful_same_as_sql(spark, sf, name):
    same(learned.QUERIES[name](spark, sf), learned.SQL[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_classifiers_are_validated(spark, sf, monkeypatch):
    asked = {}
    monkeypatch.setattr(models, "cross_validate", lambda rows, columns, names, folds: asked.update(names=names, folds=folds, dealt=rows.select("fold").distinct().count()))
    monkeypatch.setattr(learned.M, "fold_average", lambda counts, *by: counts)
    learned.classifier_cv(spark, sf)
    assert asked == {"names": models.REGISTRY, "folds": 5, "dealt": 5}
    assert all(models.classifier(n).getMaxDepth() == 30 for n in ("random_tree", "j48", "rep_tree", "random_forest"))
