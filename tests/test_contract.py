import __spark_entry__ as entry
from quillon.operators import features as X
from quillon.plans import catalog


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["e", "src", "r", "p", "k"] and df.count() > 0


def test_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_embedding_features(spark):
    p = spark.createDataFrame([(1, 2, 3, [1.0, 0.0], [0.6, 0.8], [1.0], None)], "e long, src int, r long, name_vec_1 array<double>, name_vec_2 array<double>, addr_vec_1 array<double>, addr_vec_2 array<double>")
    got = X.embedding_features(p).first()
    assert got.e_name_cos == 0.6 and got.e_addr_cos is None
