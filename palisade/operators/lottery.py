"""The seeding lottery: combinations, draws under constraints, exact and simulated odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.shared import written
from .relational import number_rows

# Odds in percent by final standing, worst first.
ODDS = (18.5, 13.5, 11.5, 9.5, 8.5, 7.5, 6.5, 6.0, 5.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.0, 0.5)
#: Balls, balls a draw, the most places a team may climb.
BALLS, DRAWN, CLIMB = 14, 4, 10


def odds_table(spark: SparkSession, odds: tuple[float, ...] = ODDS) -> DataFrame:
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(odds)], "standing int, odds double")


def combinations(spark: SparkSession, balls: int = BALLS) -> DataFrame:
    """combo, index: all draws of four balls in lexicographic order but the last, from 0."""
    r = lambda name: spark.range(1, balls + 1).select(F.col("id").cast("int").alias(name))
    four = r("a").join(F.broadcast(r("b")), F.col("a") < F.col("b")).join(F.broadcast(r("c")), F.col("b") < F.col("c")).join(F.broadcast(r("d")), F.col("c") < F.col("d"))
    numbered = four.select(F.array("a", "b", "c", "d").alias("combo"), (F.row_number().over(W.orderBy("a", "b", "c", "d")) - 1).alias("index"))
    return numbered.where(~((F.col("combo")[0] == balls - 3)))


def assignment(odds: DataFrame, total: int = 1000) -> DataFrame:
    """standing, first, stop: the range of combinations of each team, ten per percent, cut at ``total``."""
    n = F.round(F.col("odds") * 10).cast("int")
    upto = F.sum(n).over(W.orderBy("standing").rowsBetween(W.unboundedPreceding, 0))
    out = odds.select("standing", upto.alias("_upto"), n.alias("_n"))
    return out.select("standing", F.least(F.col("_upto") - F.col("_n"), F.lit(total)).cast("int").alias("first"), F.least("_upto", F.lit(total)).cast("int").alias("stop"))


def counts(odds: tuple[float, ...] = ODDS, total: int = 1000) -> list[int]:
    """Combinations of each standing after the cut at ``total``."""
    out, used = [], 0
    for x in odds:
        out.append(min(round(x * 10), total - used))
        used += out[-1]
    return out


def exact_probabilities(odds: DataFrame) -> DataFrame:
    """standing, p_first, p_second: odds of the two draws.

    Redrawing what is not allowed is the same as drawing among what is: standings up to 11 for the
    first pick, up to 12 but the winner for the second.
    """
    c = assignment(odds).select("standing", (F.col("stop") - F.col("first")).alias("c"))
    first = c.where(F.col("standing") - 1 <= CLIMB)
    second = c.where(F.col("standing") - 2 <= CLIMB).select(F.col("standing").alias("s2"), F.col("c").alias("c2"))
    sums = first.agg(F.sum("c").alias("n1")).crossJoin(second.agg(F.sum("c2").alias("n2")))
    pairs = first.crossJoin(F.broadcast(sums)).join(F.broadcast(second), F.col("standing") != F.col("s2"))
    joint = pairs.select("standing", "s2", (F.col("c") / F.col("n1") * F.col("c2") / (F.col("n2") - F.col("c"))).alias("p"))
    p1 = joint.groupBy("standing").agg(F.sum("p").alias("p_first"))
    p2 = joint.groupBy(F.col("s2").alias("standing")).agg(F.sum("p").alias("p_second"))
    value = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return odds.select("standing").join(p1, "standing", "left").join(p2, "standing", "left").select("standing", value("p_first").alias("p_first"), value("p_second").alias("p_second"))


def draws(spark: SparkSession, n: int, seed: int = 42, odds: tuple[float, ...] = ODDS, keys: DataFrame | None = None) -> DataFrame:
    """sim, w1, w2: winners of both draws of n lotteries (for each row of ``keys``), from hashed uniforms; parallel over simulations."""
    c = counts(odds)
    starts = [sum(c[:i]) for i in range(len(c))]
    ends = [a + b for a, b in zip(starts, c, strict=True)]
    lit = lambda xs: F.array(*map(F.lit, xs))
    at = lambda x, n_teams: (F.size(F.filter(lit(ends[:n_teams]), lambda e: e <= x)) + 1).cast("int")
    first_n, second_n = ends[CLIMB], ends[CLIMB + 1]
    sims, of = spark.range(n).select(F.col("id").alias("sim")), [*(keys.columns if keys is not None else []), "sim"]
    sims = sims if keys is None else keys.crossJoin(F.broadcast(sims))  # n numbers
    seeds = [F.lit(seed), *map(F.col, of)]
    one = sims.select(*of, at(F.floor(X.uniform(*seeds, F.lit(1)) * first_n), CLIMB + 1).alias("w1"))
    won, before = F.get(lit(c), F.col("w1") - 1), F.get(lit(starts), F.col("w1") - 1)
    x2 = F.floor(X.uniform(*seeds, F.lit(2)) * (second_n - won))
    return one.select(*of, "w1", at(x2 + F.when(x2 >= before, won).otherwise(0), CLIMB + 2).alias("w2"))


def finishes(drawn: DataFrame, teams: int = len(ODDS), keys: list[str] | None = None) -> DataFrame:
    """(keys,) team, slot, n over all simulations: winners first, the others in order of standing."""
    rows = drawn.select(*(keys or []), "w1", "w2", F.explode(F.sequence(F.lit(1), F.lit(teams))).alias("team"))
    ahead = (F.col("w1") < F.col("team")).cast("int") + (F.col("w2") < F.col("team")).cast("int")
    slot = F.when(F.col("team") == F.col("w1"), 1).when(F.col("team") == F.col("w2"), 2).otherwise(F.col("team") + 2 - ahead)
    return rows.groupBy(*(keys or []), "team", slot.alias("slot")).agg(F.count("*").alias("n"))


def standings(teams: DataFrame, division: str, conference: str, points: str, team: str) -> DataFrame:
    """Adds playoff, overall rank and, for teams outside the playoffs, the lottery slot (worst first).

    The three best of a division and the two best others of a conference are in the playoffs.
    """
    best = [F.desc(points), F.col(team)]
    seq = teams.withColumn("division_seq", F.row_number().over(W.partitionBy(division).orderBy(*best)))
    out = F.col("division_seq") > 3
    seq = seq.withColumn("wildcard_seq", F.when(out, F.row_number().over(W.partitionBy(conference, out).orderBy(*best))))
    flagged = seq.withColumn("playoff", X.playoff(F.col("division_seq"), F.col("wildcard_seq")))
    block = F.floor(F.col(points) / 10)  # numbered by blocks of points, so no task holds all teams
    flagged = written(number_rows(flagged, [], block, best, "overall", descending=True), "standings")
    slots = number_rows(flagged.where(~F.col("playoff")), [], block, [F.col(points), F.desc(team)], "lottery_slot")
    return slots.unionByName(flagged.where("playoff").withColumn("lottery_slot", F.lit(None).cast("int")))


def custom_teams(rows: DataFrame) -> DataFrame:
    """The lottery teams of a table that a user gives (slot, in_playoffs, standing, odds; any may be missing), in order of their standing."""
    in_lottery = F.col("slot").isNotNull() | F.coalesce(~F.col("in_playoffs"), F.lit(False))
    out = rows.where(in_lottery).withColumns({"standing": F.coalesce("standing", "slot"), "odds": F.coalesce("odds", F.lit(0.0))})
    return out.where("standing IS NOT NULL").orderBy("standing")


def round_order(order: DataFrame, rounds: int, keys: list[str]) -> DataFrame:
    """keys, pick, round, team, n (teams): each key's order (keys, place, team) of round one repeated."""
    n = order.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = order.join(F.broadcast(n), keys).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))  # a row a key
    return rows.select(*keys, (F.col("place") + (F.col("round") - 1) * F.col("n")).alias("pick"), "round", "team", "n")
