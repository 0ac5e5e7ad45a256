"""Every registered query runs; those with DuckDB SQL give the same rows."""

from __future__ import annotations

import pytest

from narrata import plans  # noqa: F401
from narrata.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    n, m, mine, theirs = compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert n == m and not mine and not theirs, (mine, theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    assert len(set(frame.columns)) == len(frame.columns)
    frame.count()


def test_rest_imports_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name in ('corpus_pipeline', 'narrata.llm'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'v1_cosine' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True)


def test_created_nodes_whose_ids_are_taken(spark, tmp_path):
    """Over a million nodes: the copy of node 5 has the id of another node, and both stay."""
    import pyarrow.parquet as pq

    from tests.oracle import TABLES

    part = spark.read.parquet(f"{SF}/part.parquet")
    table = part.unionByName(part.withColumn("p_partkey", part.p_partkey + 1000000)).toArrow()
    for name in TABLES:
        if name != "part":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    pq.write_table(table, tmp_path / "part.parquet")
    n, m, mine, theirs = compare(spark, registry.QUERIES["g1_node_crud"], registry.ORACLES["g1_node_crud"], str(tmp_path))
    assert n == m and n > table.num_rows * 0.9 and not mine and not theirs, (mine, theirs)
