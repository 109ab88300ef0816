"""Scoring blends, sampling and whole drafts.

A draft is a fold over its picks: each step sees what was taken before, so it cannot be a
join. The fold is a higher-order aggregate over the candidates of one simulation, in the
JVM; simulations run side by side.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


def candidate_window(pool: DataFrame, keys: list[str], size: int = 40) -> DataFrame:
    """The best ranked of each key, then the unranked, up to ``size``."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("css_ranking").asc_nulls_last(), "id"))
    return pool.withColumn("place", place).where(F.col("place") <= size)


def blend(rows: DataFrame, keys: list[str], score: str, css_weight: float) -> DataFrame:
    """Adds ml_norm (min-max of the score in its window), css_prior (linear in the rank) and ``blend``."""
    by = W.partitionBy(*keys)
    low, high = F.min(score).over(by), F.max(score).over(by)
    norm = (F.col(score) - low) / F.when(high > low, high - low).otherwise(1.0)
    most = F.max(F.coalesce("css_ranking", F.lit(9999))).over(by)
    prior = F.when(F.col("css_ranking").isNotNull(), 1.0 - (F.col("css_ranking") - 1) / most).otherwise(0.0)
    out = rows.withColumns({"ml_norm": norm, "css_prior": prior})
    return out.withColumn("blend", F.round((1 - css_weight) * F.col("ml_norm") + css_weight * F.col("css_prior"), 6))


def temperature(base: float, gap: Column, n: Column) -> Column:
    """Lower where the best is clearly ahead; with one candidate a hundredth of the base."""
    g = X.clip(gap, 0.0, 1.0)
    return F.when(n <= 1, base * 0.01).otherwise(base * F.greatest(F.lit(0.01), F.pow(1 - g, F.lit(2.0))))


def top_gap(rows: DataFrame, keys: list[str], score: str, base: float) -> DataFrame:
    """keys, n, gap between the two best scores, temperature."""
    best = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2)
    out = rows.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("n"))
    gap = F.coalesce(F.get("best", F.lit(0)) - F.get("best", F.lit(1)), F.lit(0.0))
    return out.select(*keys, "n", F.round(gap, 6).alias("gap"), F.round(temperature(base, gap, F.col("n")), 6).alias("temperature"))


def gumbel(*parts: Column) -> Column:
    u = X.uniform(*parts) + 0.5 / 4294967296.0
    return -F.log(-F.log(u))


def softmax_sample(rows: DataFrame, keys: list[str], score: str, t: float, seed: int) -> DataFrame:
    """keys, id: one draw per group with odds exp(score / t); the argmax at t = 0.

    Adding Gumbel noise to score / t and taking the maximum draws from the softmax; one aggregate, no sort.
    """
    value = F.col(score) / t + gumbel(F.lit(seed), *[F.col(k) for k in keys], F.col("id")) if t > 0 else F.col(score)
    return rows.groupBy(*keys).agg(F.max_by("id", F.struct(F.round(value, 9), -F.col("id"))).alias("id"))


def draft(pools: DataFrame, keys: list[str], order: list[int], need_weight: float = 0.15) -> DataFrame:
    """keys, pick, team, id: whole drafts without chance, one per key, teams choosing in ``order``.

    ``pools`` has id, rank, base and need (a team number modulo 6) per candidate. A team values a candidate
    at base plus ``need_weight`` where its number modulo 6 is the candidate's need; ties go to the better
    rank. A pool is bounded by its window, so one row holds it.
    """
    board = pools.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "base", "need"))).alias("board"))
    teams = F.array(*map(F.lit, order))

    def step(taken: Column, pick: Column) -> Column:
        team = F.get(teams, pick - 1)
        left = F.filter("board", lambda c: ~F.array_contains(taken, c["id"]))
        value = lambda c: F.round(c["base"] + F.when(c["need"] == team % 6, need_weight).otherwise(0.0), 6)
        scored = F.transform(left, lambda c: F.struct(value(c).alias("v"), (-c["rank"]).alias("r"), c["id"].alias("id")))
        return F.concat(taken, F.array(F.array_max(scored)["id"]))

    chosen = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(len(order)), F.size("board"))), F.array().cast("array<bigint>"), step)
    picks = board.select(*keys, F.posexplode(chosen).alias("i", "id"))
    return picks.select(*keys, (F.col("i") + 1).alias("pick"), F.get(teams, F.col("i")).alias("team"), "id")


def sampled_drafts(pool: DataFrame, n: int, order: list[int], t: float = 0.25, need_weight: float = 0.15, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """(keys,) sim, pick, team, id: n drafts (of each key's board) by softmax at the adaptive temperature of the board.

    Simulations are dealt to tasks and share no state; each draws from a generator seeded by ``seed`` and
    its number, so reruns agree. The pool is bounded by its window and goes to every simulation.
    """
    import numpy as np
    import pandas as pd

    keys = keys or []
    board = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "base", "need"))).alias("board"))
    if keys:  # boards stay where they are, and each runs its own simulations
        sims = board.select(*keys, "board", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("sim"))
    else:
        sims = pool.sparkSession.range(0, n, 1, max(1, min(n, 64))).withColumnRenamed("id", "sim").crossJoin(F.broadcast(board))

    def run(frames):
        for frame in frames:
            out = []
            for sim, rows, *key in zip(frame["sim"], frame["board"], *(frame[k] for k in keys), strict=True):
                rng = np.random.default_rng([seed, int(sim), *(zlib.crc32(str(k).encode()) for k in key)])
                ids = np.array([r["id"] for r in rows])
                base, need = np.array([r["base"] for r in rows]), np.array([r["need"] for r in rows])
                left = np.ones(len(ids), bool)
                for pick, team in enumerate(order, 1):
                    if not left.any():
                        break
                    at = np.flatnonzero(left)
                    value = base[at] + need_weight * (need[at] == team % 6)
                    best = np.sort(value)[::-1]
                    gap = min(max(best[0] - best[1], 0.0), 1.0) if len(at) > 1 else 1.0
                    weights = np.exp((value - best[0]) / (t * max(0.01, (1 - gap) ** 2)))
                    chosen = at[rng.choice(len(at), p=weights / weights.sum())]
                    left[chosen] = False
                    out.append((*key, sim, pick, team, ids[chosen]))
            yield pd.DataFrame(out, columns=[*keys, "sim", "pick", "team", "id"])

    kinds = "".join(f"`{k}` {pool.schema[k].dataType.simpleString()}, " for k in keys)
    return sims.mapInPandas(run, f"{kinds}sim bigint, pick int, team int, id bigint")


def alternatives(pool: DataFrame, picks: DataFrame, n: int, keys: list[str], need_weight: float = 0.15) -> DataFrame:
    """keys, pick, place, id, value, bar: the n candidates left that the team valued most at its pick, the chosen apart; bar is the share of the highest value.

    Candidates meet the picks of their own draft; both are bounded by the board.
    """
    gone = picks.select(*keys, "id", F.col("pick").alias("_gone"))
    board = pool.join(gone, [*keys, "id"], "left")
    at = picks.select(*keys, "pick", "team", F.col("id").alias("_chosen"))
    left = at.join(board, keys).where(F.col("_gone").isNull() | (F.col("_gone") >= F.col("pick")))
    value = F.round(F.col("base") + F.when(F.col("need") == F.col("team") % 6, need_weight).otherwise(0.0), 6)
    by = W.partitionBy(*keys, "pick")
    rows = left.withColumn("value", value).withColumn("_top", F.max("value").over(by))
    place = F.row_number().over(by.orderBy(F.desc("value"), "rank"))
    out = rows.where(F.col("id") != F.col("_chosen")).withColumn("place", place).where(F.col("place") <= n)
    return out.select(*keys, "pick", "place", "id", "value", F.round(F.col("value") / F.greatest("_top", F.lit(0.001)), 6).alias("bar"))


def divergence(baseline: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Picks at which two drafts differ."""
    b, o = baseline.withColumnRenamed("id", "baseline_id"), other.select(*keys, "pick", F.col("id").alias("other_id"))
    return b.join(o, [*keys, "pick"]).where(~F.col("baseline_id").eqNullSafe(F.col("other_id")))
