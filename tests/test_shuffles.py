"""How many rows steps shuffle, by Spark's own count, and odd inputs of the steps that were rebuilt to shuffle less."""

import random

import numpy as np
from palisade.operators import features, profiles, text_index, training
from palisade.plans import profiles as plans_of_profiles
from palisade.plans import training as plans_of_training
from palisade.sources import star
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shuffled_rows(spark, work) -> int:
    """Rows that ``work`` writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def count():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = count()
    work()
    return count() - before


def test_profiles_shuffle_a_pick_once(spark):
    rows = [(i % 300, 1990 + i % 7, i % 5, f"p{i % 11}", f"l{i % 13}", f"n{i % 17}") for i in range(30_000)]
    picks = spark.createDataFrame(rows, "gm bigint, year int, round int, position string, league string, nationality string")
    sums = lambda: profiles.profile_sums(picks)
    assert shuffled_rows(spark, sums) <= 1.1 * len(rows)


def test_lines_meet_their_words_last(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines, orders = (star.table(spark, SF, t).count() for t in ("lineitem", "orders"))
        n = shuffled_rows(spark, lambda: star.line_picks(spark, SF).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n <= 2 * lines + 3 * orders


def test_profiles_of_odd_years(spark):
    rows = [(1, 9999, 1, "a", "x", "u"), (1, 1, 2, "b", "x", None), (2, 9999, None, "a", None, "u"), (2, 9998, 1, "b", "y", "u"), (None, 2000, 1, "c", "y", "u"), (3, None, 1, "a", "x", "u")]
    picks = spark.createDataFrame(rows, "gm bigint, year int, round int, position string, league string, nationality string")
    got = {(r.gm, r.dimension, r.category): r.share for r in profiles.raw_profile(picks).collect()}
    assert got[1, "position", "a"] == 1.0 and abs(got[2, "position", "a"] - 1 / (1 + 7 * 0.85)) < 1e-12 and (None, "position", "c") not in got
    weights = {(r.gm, r.dimension, r.category): r.weight for r in profiles.shrunk_profile(picks).collect()}
    assert weights[2, "position", "c"] == round(30 / (30 + 1 + 7 * 0.85) * 7 / 34, 6)  # the prior counts picks of no maker too


def test_rules_need_one_reading_of_the_lines(spark):
    one = shuffled_rows(spark, lambda: profiles.profile_sums(star.line_picks(spark, SF)))
    lines = star.table(spark, SF, "lineitem").count()
    assert shuffled_rows(spark, lambda: plans_of_profiles.archetype_rules(spark, SF).collect()) < one + lines


def test_training_rows_are_not_shuffled(spark):
    made = []
    n = shuffled_rows(spark, lambda: made.append(plans_of_training.QUERIES["training_set"](spark, SF)))
    assert n < made[0].count()
    made.clear()
    n = shuffled_rows(spark, lambda: made.append(features.stratified_negatives(star.order_picks(spark, SF), ["year"]).count()))
    assert n < made[0]


def test_candidates_across_blocks(spark):
    rng = random.Random(5)
    rows = [(1, i + 1, rng.choice(["a", "b", "c", None]), rng.randrange(40) / 40, 7 * i) for i in range(4300)] + [(2, i + 1, "a", 0.5, i) for i in range(9)]
    picks = spark.createDataFrame(rows, "year int, overall_pick int, position string, quality double, id bigint")
    board = picks.join(features.draws(picks, ["year"], 12, quality="quality"), ["year", "overall_pick"], "left")
    got = training._candidates(board, ["year"], ["overall_pick"], ["position", "quality", "id"], 31, 12).collect()
    at = {(y, p): (position, quality, i) for y, p, position, quality, i in rows}
    want = {(r.year, r.overall_pick, r.negative, r.stratum) for r in features.stratified_negatives(picks, ["year"]).collect()} | {(y, p, p, "picked") for y, p in at}
    want = {k for k in want if at[k[0], k[2]][0] is not None}
    assert {(r.year, r.overall_pick, r.candidate, r.stratum) for r in got} == want and len(got) == len(want)
    pick, quality = np.array([r[1] for r in rows if r[0] == 1]), np.array([r[3] for r in rows if r[0] == 1])
    position = np.array([r[2] or "" for r in rows if r[0] == 1])
    for r in rng.sample([r for r in got if r.year == 1], 3000):
        assert at[1, r.candidate] == (r.position, r.quality, r.id)
        assert r.better == ((position == r.position) & (pick >= r.overall_pick) & (quality > r.quality)).sum()


def test_postings_are_shuffled_once(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.concat(F.lit("w"), (x * F.col("id") % 997).cast("string")))).alias("text"))
    made = []
    n = shuffled_rows(spark, lambda: made.append(text_index.build(docs)))
    assert n <= made[0].postings().count() + 10 * 200
