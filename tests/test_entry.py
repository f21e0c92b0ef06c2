import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [("__spark_entry__.py", "sparkquiver"), ("__spark_entry__.py", "sparkquiver", "corpus_pipeline.py")])
def test_entry_works_without_the_llm_subpackage(tmp_path, parts):
    for p in parts:
        if (ROOT / p).exists():
            (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sparkquiver/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "sparkquiver").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sparkquiver.llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["cypher_edge", "cypher_optional_where", "cypher_union", "blast_both", "arch_structure", "arch_boundaries", "search_bm25", "cross_service", "resolve_references", "enclosing_node", "code_search_snippets", "trace_relations", "cypher_strict_distinct", "cypher_mixed_ge_null", "tokenize_identifier", "content_hash_fnv"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_filters_reach_the_scan(spark):
    plan = __spark_entry__.queries()["cypher_where_starts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(file_path,asia/)" in plan and "PartitionFilters: [isnotnull(kind" in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_the_stored_graph_is_the_tables_graph_written_without_a_sort_by_kind(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from sparkquiver.plans import adapter

    monkeypatch.setattr(adapter, "_WRITTEN", {})
    monkeypatch.delattr(DataFrameWriter, "partitionBy")
    got, want = adapter.stored_graph(spark, DATA), adapter.table_graph(spark, DATA)
    for name in ("nodes", "edges", "files"):
        a, b = (getattr(g, name).selectExpr("to_json(struct(*)) AS j") for g in (got, want))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_lines_are_not_sorted_for_the_trade_edges(spark):
    from sparkquiver.plans import adapter

    plan = adapter.graph_parts(spark, DATA)[1]["imports"]._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
