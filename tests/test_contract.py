"""Every query with SQL equals it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


CORE = sorted(n for n in entry.core.SQL)


@pytest.fixture(scope="module", autouse=True)
def trees_once():
    """The stored trees are built once for all queries on them."""
    from functools import cache

    from sylvan.queries import exports, trees

    built, places = cache(trees.built), cache(exports.places)
    old = trees.built, exports.built, exports.places
    trees.built = exports.built = built
    exports.places = places
    yield
    trees.built, exports.built, exports.places = old


@pytest.mark.parametrize("name", CORE)
def test_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted((tuple(norm(r[k]) for k in order) for r in cur.fetchall()), key=str)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "index", "chars", "start_char_idx", "end_char_idx"] and df.count() > 0


def test_nothing_imports_the_training_data_subpackage():
    for f in glob.glob(os.path.join(os.path.dirname(entry.__file__), "sylvan", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            with open(f, encoding="utf-8") as text:
                assert "sylvan.llm" not in text.read(), f
