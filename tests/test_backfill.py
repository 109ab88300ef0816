"""Backfills with names that very many rows share."""

from palisade.operators import ingest
from pyspark.sql import functions as F


def test_rows_meet_a_shared_name_once(spark):
    existing = spark.range(6000).select(F.col("id").alias("ext_id"), F.lit("one").alias("name"))
    odd = spark.createDataFrame([(None, "one"), (None, "two"), (None, None)], "ext_id bigint, name string")
    incoming = spark.range(3000).select((F.col("id") + 5000).alias("ext_id"), F.lit("one").alias("name")).unionByName(odd)
    sizes = []

    def by_name(e, n):
        sizes.append(e.count())
        return F.col("n.ext_id").isNull() & (F.col("n.name") == F.col("e.name"))

    got = ingest.insert_missing(existing, incoming, [(["ext_id"], lambda e, n: F.col("n.ext_id") == F.col("e.ext_id")), (["name"], by_name)])
    new = got.exceptAll(existing).collect()
    assert sizes == [1]  # not 6,000
    assert len(new) == 2000 + 2 and {(r.ext_id, r.name) for r in new if r.ext_id is None} == {(None, "two"), (None, None)}
