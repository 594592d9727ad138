import ast
import pathlib

import duckdb
import pytest

import __spark_entry__
from docloom.plans.queries import QUERIES
from docloom.plans.sql import SQL

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in ("documents", "pages", "conversations", "events"):
        c.execute(f"create view {table} as select * from '{TINY}/{table}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    out = QUERIES[name](spark, TINY)
    columns = sorted(out.columns)
    got = sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)
    found = con.execute(SQL[name])
    place = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(r[k] for k in place) for r in found.fetchall()), key=repr)
    assert got and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_network_and_no_import_of_the_corpus_package():
    for path in pathlib.Path(__spark_entry__.__file__).parent.joinpath("docloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.split(".")[0] in ("socket", "http", "requests", "ftplib", "smtplib") or n.startswith(("urllib.request", "docloom.llm")) for n in names)
