"""Operators against DuckDB over the smallest tables, and loaders on small fixtures."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import catalog, control, docs, indexes, more, oracle, rules, rules_sql, texts, views
from sparkloom.sources import loaders as L

DATA = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | more.QUERIES | rules.QUERIES | texts.QUERIES | indexes.QUERIES | control.QUERIES | docs.QUERIES | views.QUERIES
SQL = oracle.ORACLE_SQL | more.ORACLE_SQL | rules_sql.ORACLE_SQL | texts.ORACLE_SQL | indexes.ORACLE_SQL | control.ORACLE_SQL | docs.ORACLE_SQL | views.ORACLE_SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    """Comparable however pandas holds a column with nulls."""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, numbers.Number) and not pd.isna(x):
        return round(float(x), 6)
    return str(x) if isinstance(x, str) or not pd.isna(x) else "null"


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(map(cell, r))) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_html():
    page = "<title>T</title><nav>no</nav><main>lead<h1>One</h1><p>a  b</p><ul><li>x<li>y</ul><table><tr><th>h<td>1</table><h2>Two</h2><pre> k </pre></main>"
    assert L.html_sections(page) == [[("Text", "lead")], [("Section-header", "One"), ("Text", "a b"), ("List-item", "x"), ("List-item", "y"), ("Table", "h | 1")], [("Section-header", "Two"), ("Table", "k")]]


def test_markdown():
    text = "intro line\n1. first\n2) second\n\n| k | v |\n| :-: | --- |\n| x | y |\nafter the table\n### Three\n~~~ py\na = 1\n\n# no heading\n~~~\n##### small #####\nlast\n```\nopen"
    assert L.markdown_sections(text) == [
        [("Text", "intro line"), ("List-item", "first"), ("List-item", "second"), ("Table", "| k | v |\n| x | y |"), ("Text", "after the table")],
        [("Section-header", "Three"), ("Table", "a = 1\n\n# no heading"), ("Section-header", "small"), ("Text", "last"), ("Table", "open")],
    ]
    assert L.markdown_sections(None) == [[]] == L.markdown_sections("")


def test_deeply_nested_html():
    assert L.html_sections("<div>" * 20_000 + "deep" + "</div>" * 20_000) == [[("Text", "deep")]]
    assert L.html_sections(None) == [[]]


def test_packing():
    text = "\n\n".join(f"paragraph number {i} " + "word " * 30 for i in range(20))
    packed = L.pack(text, 100, 40)
    assert all(n <= 100 for _, n in packed) and "paragraph number 19" in packed[-1][0]
    assert L.pack("", 100, 10) == [] and all(n <= 20 for _, n in L.pack("x" * 1000, 20, 5))
