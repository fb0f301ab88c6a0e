"""The driver's contract, on the smallest tables."""

import importlib
import os

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def contract():
    return importlib.import_module("__spark_entry__")


def test_names(contract):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


@needs_data
def test_entry(spark, contract):
    rows = contract.entry(spark)
    assert rows.columns == ["info_id", "field_name", "pos", "val"] and rows.count() > 0


@needs_data
@pytest.mark.parametrize("prefix", ["ref_", "host_"])
def test_against_duckdb(spark, contract, prefix):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    queries, wrong = contract.queries(), []

    def plain(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(str(r[i]) for i in order) for r in rows)

    for name, sql in contract.oracle_sql().items():
        if name.startswith(prefix):
            df, want = queries[name](spark, DATA), con.sql(sql)
            if sorted(df.columns) != sorted(want.columns) or plain(df.collect(), df.columns) != plain(want.fetchall(), want.columns):
                wrong.append(name)
    assert not wrong


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "quirefold")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for file in files:
                if file.endswith(".py"):
                    with open(os.path.join(folder, file), encoding="utf-8") as source:
                        assert "quirefold.llm" not in source.read(), file
