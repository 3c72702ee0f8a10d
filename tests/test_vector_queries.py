"""The queries of the vector searches grow with the vectors."""

import pytest

from lexigraph.catalogue import QUERIES


@pytest.mark.parametrize("name", ["ret4_vector_top_k", "fil3_vector_floor"])
def test_each_hundredth_vector_asks(spark, sf_dir, name):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    assert {r.qid for r in QUERIES[name](spark, sf_dir).collect()} == {str(i) for i in ids if i % 100 == 0}
