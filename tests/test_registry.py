"""The driver's contract: names, importability without the text subpackage, and SQL that agrees."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from strandline.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(entry.queries())


def test_imports_without_session_and_without_text_subpackage():
    code = "import sys; sys.modules['strandline.llm'] = None; import __spark_entry__ as e; print(sum(n.startswith('p4') for n in e.queries()), len(e.queries()) > 40)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["0", "True"], done.stderr


def test_core_never_imports_the_text_subpackage():
    for path in glob.glob(f"{ROOT}/strandline/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path, encoding="utf-8") as text:
                assert "strandline.llm" not in text.read(), path


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p5_found", "catalog_columns_by_name", "import_commit", "parse_status", "source_tables", "structure_edges_of_statements", "graph_table_view", "analysis_diagnostics", "corpus_analysis_summary", "corpus_lineage_columns", "corpus_selected"])
def test_queries_agree_with_their_sql(spark, name, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    registry.queries()[name](spark, DATA).write.parquet(str(tmp_path / "got"))
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    con.execute(f"CREATE TABLE want AS {registry.oracle_sql()[name]}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM read_parquet('{tmp_path}/got/*.parquet')")
    columns = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE want").fetchall()))
    assert columns == ", ".join(sorted(r[0] for r in con.execute("DESCRIBE got").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
