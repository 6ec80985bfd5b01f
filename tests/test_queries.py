"""Queries against their SQL on the smallest tables, and the entry's promises."""

import ast
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql_says_the_same(spark, duck, name):
    df = core.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    spark.catalog.clearCache()
    done = duck.execute(core.oracle_sql()[name])
    want = normal([d[0] for d in done.description], done.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(core.queries().keys() - core.oracle_sql().keys()))
def test_other_queries_run(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["n", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "avg_first_rank"] and df.count() == 1
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_nothing_else_imports_the_training_data_operators():
    root = Path(core.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), p
