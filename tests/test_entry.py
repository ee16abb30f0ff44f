"""The driver contract, the catalogue and the independence of the core."""

import ast
import os
import pathlib
import re

import pytest

import __spark_entry__ as entry
from clausemill import __main__ as cli
from clausemill.plans import catalogue

ROOT = pathlib.Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_core_does_not_import_the_training_package():
    for path in (ROOT / "clausemill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.oracle_sql()) >= 50


@has_data
def test_entry_has_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["family_id", "kind", "blocks"] and found.count() > 0


@has_data
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    frame = catalogue.queries()[name](spark, DATA)
    rows = frame.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for path in pathlib.Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    show = lambda v: repr(round(float(v), 6)) if isinstance(v, float) else re.sub(r"\+00:00$", "", str(v))
    want = sorted(tuple(show(v) for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall())
    got = sorted(tuple(show(r[c]) for c in sorted(frame.columns)) for r in rows)
    assert got == want


def test_command_line_lists_and_refuses(capsys):
    assert cli.main(["list"]) == 0 and "segment_blocks" in capsys.readouterr().out
    assert cli.main(["query", "nope", "x"]) == 1
