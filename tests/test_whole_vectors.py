"""Vector queries without a cut: every pair, in bounded slices."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigraph.catalogue import QUERIES
from lexigraph.operators import vectors


def test_every_stated_query_meets_every_vector(spark, sf_dir):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    got = [(r.qid, r.doc) for r in QUERIES["jn18_queries_by_vectors"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((str(q), d) for q in ids if q % 100 == 0 for d in ids)


def test_every_source_is_a_candidate_of_every_vector(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.countDistinct("source")).first()[0]
    assert QUERIES["trm8_nearness_of_lemmas"](spark, sf_dir).select("note_id", "lemma").distinct().count() == n * sources


def test_scores_without_a_cut_are_passed_on_slice_by_slice(monkeypatch):
    monkeypatch.setattr(vectors, "EMITTED", 12)
    q, rows = np.eye(3), np.arange(60.0).reshape(20, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["id", "vec"])
    out = list(vectors._all(["a", "b", "c"], q, None)(iter([batch])))
    assert len(out) == 5 and all(b.num_rows == 12 for b in out)
    assert sorted((r["qid"], r["doc"], r["score"]) for b in out for r in b.to_pylist()) == sorted((x, d, rows[d, i]) for i, x in enumerate("abc") for d in range(20))
