"""Every registered query of the library against its SQL, on sf0.01."""

import pytest

from compare import DATA, assert_same
from tideline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, oracle, name):
    assert_same(registry.QUERIES[name](spark, f"{DATA}/sf0.01"), oracle.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_feature_digests(spark):
    import hashlib

    import numpy as np

    d = f"{DATA}/sf0.001"
    want = {r["vec_id"]: hashlib.sha256(f"normalization:n1\ndate:2024-01-01\nrow:{r['vec_id']}\n".encode() + np.array(r["embedding"], np.float32).tobytes()).hexdigest() for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    assert {r["vec_id"]: r["digest"] for r in registry.QUERIES["c36_feature_digests"](spark, d).collect()} == want


def test_queries_side_by_side_keep_their_tables(spark):
    """Threads settle their own intermediate tables only."""
    from concurrent.futures import ThreadPoolExecutor

    d = f"{DATA}/sf0.001"
    names = ["k01_components", "f38_replay_binding", "k02_k03_component_ids", "a01_b01_json_lines"]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: sorted(map(tuple, registry.QUERIES[n](spark, d).collect())), names))
    assert got == [sorted(map(tuple, registry.QUERIES[n](spark, d).collect())) for n in names]
