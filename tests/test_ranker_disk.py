"""What the ranker's rows take in shuffles and scratch tables."""

import os

from palisade.operators import boosting
from palisade.sources.shared import written
from pyspark.sql import functions as F


def shuffled_bytes(spark, work) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def count():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = count()
    work()
    return count() - before


def rows(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        (1990 + i % 3).cast("int").alias("year"), F.floor(i / 8).cast("int").alias("slot"), i, (i % 8 == 0).cast("int").alias("picked"), F.lit(1.0).alias("weight"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("x")
    )


def test_hashes_are_not_shuffled(spark):
    df = rows(spark, 40_000)
    edges = boosting.bin_edges(df, ["x"])
    n = shuffled_bytes(spark, lambda: boosting.pack(df, ["x"], edges, ["slot"], "year", "picked", "weight", "id"))
    assert n < 22 * 40_000, n / 40_000


def test_blocks_are_written_once(spark, monkeypatch):
    df = rows(spark, 800)
    edges = boosting.bin_edges(df, ["x"])
    blocks = boosting.pack(df, ["x"], edges, ["slot"], "year", "picked", "weight", "id")
    again = []
    monkeypatch.setattr(boosting, "_advanced", lambda *a, old=boosting._advanced: again.append(1) or old(*a))
    model = boosting.fit(blocks, ["x"], edges, [boosting.Params(1990, 1992, 1992, 1992, max_depth=1, min_child_weight=0.1)], 14)[0]
    assert len(model.trees) == 14 and not again  # as many rounds as the ranker's queries take


def test_scratch_tables_are_small(spark):
    table = written(rows(spark, 100), "small")
    assert all(os.path.basename(f).endswith(".zstd.parquet") for f in table.inputFiles())
