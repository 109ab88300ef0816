"""Fused retrieval over all documents and the whole query set."""

import os

from palisade import plans
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_reaches_every_document(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = {r[0] for r in e.where("vec_id % 20 = 0").select("vec_id").collect()}
    got = plans.QUERIES["hybrid_rrf"](spark, SF).collect()
    assert len(asked) > 1 and {r.query_id for r in got} == asked and len(got) == 10 * len(asked)
    # the best text of all documents is among the results of each query
    best = plans.QUERIES["fulltext_rank"](spark, SF).orderBy(F.desc("score"), "doc_id").first().doc_id
    assert all(any(r.query_id == q and r.key == best for r in got) for q in asked - {best})
