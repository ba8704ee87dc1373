import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_package(monkeypatch):
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda name: None)
    assert not any(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries())
