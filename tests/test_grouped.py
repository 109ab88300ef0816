"""The linear ranker on blocks of whole groups against pairs in a table, and what its folds write."""

import numpy as np
from palisade.operators import evaluate
from palisade.plans import training as plans_of_training
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_blocks_give_the_models_of_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(2000 + g % 3, g, i, int(i == 0 and g != 7), float(1 + g % 2), *map(float, rng.normal(size=2) + (i == 0)), float(i % 3)) for g in range(150) for i in range(int(rng.integers(1, 9)))]
    rows += [(2000, 900, 1, 1, 2.0, 0.5, 0.5, 1.0), (2000, 900, 2, 1, 3.0, 0.1, 0.0, 2.0), (2000, 900, 3, 0, 1.0, 0.1, 0.0, 2.0), (2002, 901, 1, 1, 1.0, 0.5, 0.0, 2.0), (2002, 901, 2, 0, 1.0, 0.5, 0.0, 2.0)]
    x = spark.createDataFrame(rows, "year int, slot int, id bigint, picked int, w double, a double, b double, c double").repartition(5)
    names, keys = ["a", "b", "c"], ["year", "slot"]
    own = x.where("picked = 1").select(*keys, "w", *[F.col(c).alias(f"own_{c}") for c in names])
    pairs = own.join(x.where("picked = 0"), keys).select("year", own.w.alias("w"), *[(F.col(f"own_{c}") - F.col(c)).alias(c) for c in names])
    want = evaluate.pairwise_rankers(pairs, names, "w", "year", [1999, 2000, 2002])
    for near in (None, F.floor(F.col("slot") / 20)):
        monkeypatch.setattr(evaluate, "GROUPED", 40)
        blocks = evaluate.grouped(x, names, keys, "picked", "w", "year", "id", near)
        assert blocks.agg(F.sum("n")).collect()[0][0] == len(rows)
        got = evaluate.grouped_rankers(blocks, names, [1999, 2000, 2002])
        assert np.allclose([[m[c] for c in names] for m in got], [[m[c] for c in names] for m in want], atol=1e-9)
        hits = evaluate.grouped_hits(blocks, names, {2000: want[1], 2002: want[2]})
        for year, model in ((2000, want[1]), (2002, want[2])):
            scored = x.where(F.col("year") == year).withColumn("score", F.round(sum((F.lit(model[c]) * F.col(c) for c in names), F.lit(0.0)), 12))
            r = evaluate.group_hit_rate(scored, "slot", "picked", "score", "id").agg(F.count("*"), F.avg("hit"), F.avg(1 / F.col("n"))).collect()[0]
            assert hits[year][0] == r[0] and np.allclose(hits[year][1:], r[1:])


def test_folds_hold_no_pairs(spark, monkeypatch):
    held = []
    for module in (evaluate, plans_of_training):
        monkeypatch.setattr(module, "written", lambda df, name, old=module.written: held.append(name) or old(df, name))
    found = plans_of_training.pairwise_ranker_cv(spark, SF)
    assert found.count() == 6 and "training-pairs" not in held and "training-set" not in held
