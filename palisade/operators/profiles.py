"""Preference profiles of decision makers: weighted shares, shrinkage, archetypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.shared import written

DIMENSIONS = ("position", "league", "nationality")


def long_format(picks: DataFrame, keys: list[str], weight: Column, dimensions=DIMENSIONS) -> DataFrame:
    """keys, dimension, category, w: one row per pick and dimension; null categories are left out."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dimensions])
    out = picks.select(*keys, weight.alias("w"), F.explode(cells).alias("cell"))
    return out.select(*keys, "w", "cell.dimension", "cell.category").where("category IS NOT NULL")


def distribution(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dimension, category, w, share: weights summed per category and as a share of the dimension."""
    sums = long.groupBy(*keys, "dimension", "category").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(W.partitionBy(*keys, "dimension"))
    return sums.withColumn("share", F.try_divide("w", total))


def population_prior(picks: DataFrame, weight: Column | None = None) -> DataFrame:
    """dimension, category, share over all picks; weighted by round unless a weight is given."""
    weight = X.round_weight(F.coalesce("round", F.lit(4))) if weight is None else weight
    return distribution(long_format(picks, [], weight), []).select("dimension", "category", "share")


def profile_sums(picks: DataFrame, decay: float = 0.85) -> DataFrame:
    """gm, dimension, category, w, k, rw, n, share: the sums that all profiles come from, written once.

    w: round weight times decay per year before the maker's last year; k: picks; rw: round weights alone; n: the maker's sum of w; share: w in
    its dimension. The empty dimension stands for the picks themselves. Picks are shuffled once, as they are, and taken apart into
    dimensions and summed behind that shuffle: a task holds its makers' sums, a few for each category, never their picks.
    """
    rows = picks.select("gm", "year", X.round_weight(F.coalesce("round", F.lit(4))).alias("rw"), *DIMENSIONS).repartition("gm")
    cells = F.array(F.struct(F.lit("").alias("dimension"), F.lit("").alias("category")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in DIMENSIONS])
    # a weight decays alike for all categories as the last year moves, so it is summed as of the start of its century, far from the limits of doubles
    century = F.floor(F.col("year") / 100) * 100
    long = rows.select("gm", "year", "rw", century.alias("_from"), F.explode(cells).alias("cell")).where("cell.category IS NOT NULL")
    value = F.col("rw") * F.pow(F.lit(decay), F.col("_from") - F.col("year"))
    sums = long.groupBy("gm", "cell.dimension", "cell.category", "_from").agg(F.sum(value).alias("v"), F.count("*").alias("k"), F.sum("rw").alias("rw"), F.max("year").alias("_last"))
    of_gm = W.partitionBy("gm")
    sums = sums.withColumn("w", F.col("v") * F.pow(F.lit(decay), F.max("_last").over(of_gm) - F.col("_from")))
    sums = sums.groupBy("gm", "dimension", "category").agg(F.sum("w").alias("w"), F.sum("k").alias("k"), F.sum("rw").alias("rw"))
    n = F.max(F.when(F.col("dimension") == "", F.col("w"))).over(of_gm)
    share = F.try_divide("w", F.sum("w").over(W.partitionBy("gm", "dimension")))
    return written(sums.select("gm", "dimension", "category", "w", "k", "rw", n.alias("n"), share.alias("share")), "profile-sums")


def raw_profile(picks: DataFrame, decay: float = 0.85) -> DataFrame:
    """gm, dimension, category, w, share."""
    return profile_sums(picks, decay).where("dimension <> '' AND gm IS NOT NULL").select("gm", "dimension", "category", "w", "share")


def shrunk_profile(picks: DataFrame, k: float = 30.0, decay: float = 0.85) -> DataFrame:
    """gm, dimension, category, weight: shares drawn to the population prior by k / (n + k).

    n is the sum of a maker's weights. Every category of the prior appears for every maker.
    """
    return shrunk(profile_sums(picks, decay), k)


def shrunk(sums: DataFrame, k: float = 30.0) -> DataFrame:
    """``shrunk_profile`` from the sums of ``profile_sums``."""
    makers = sums.where("dimension = '' AND gm IS NOT NULL").select("gm", "n")
    own = sums.where("dimension <> ''").select("gm", "dimension", "category", "share")
    prior = distribution(sums.where("dimension <> ''").select(F.col("rw").alias("w"), "dimension", "category"), []).select("dimension", "category", F.col("share").alias("prior"))
    grid = makers.crossJoin(prior)  # makers x vocabulary: the size of the result itself
    alpha = F.col("n") / (F.col("n") + k)
    joined = grid.join(own, ["gm", "dimension", "category"], "left")
    weight = alpha * F.coalesce("share", F.lit(0.0)) + (1 - alpha) * F.col("prior")
    return joined.select("gm", "dimension", "category", F.round(weight, 6).alias("weight"))


def history_weight(picks: DataFrame, decay: float = 0.85) -> DataFrame:
    """team, year, category, weight over the picks of earlier years, with shrinkage that eases with their number.

    Running sums over a maker's years stand in for pairs of picks: a weight decays by the same
    factor for every category as the reference year moves, so sums of w / decay**year suffice.
    """
    base = picks.withColumn("v", X.round_weight(F.col("round")) * F.pow(F.lit(decay), -(F.col("year") - 1990)))
    years = base.groupBy("team", "year").agg(F.sum("v").alias("v"), F.count("*").alias("k"))
    before = W.partitionBy("team").orderBy("year").rangeBetween(W.unboundedPreceding, -1)
    totals = years.select("team", "year", F.sum("v").over(before).alias("total_v"), F.sum("k").over(before).alias("n_picks"))
    cats = base.groupBy("team", "position", "year").agg(F.sum("v").alias("cv"))
    vocabulary = base.select("position").distinct()
    grid = totals.select("team", "year").crossJoin(F.broadcast(vocabulary))
    filled = grid.join(cats, ["team", "position", "year"], "left")
    upto = W.partitionBy("team", "position").orderBy("year").rangeBetween(W.unboundedPreceding, -1)
    filled = filled.withColumn("cat_v", F.coalesce(F.sum("cv").over(upto), F.lit(0.0)))
    prior = population_prior(picks, F.lit(1.0)).where("dimension = 'position'").select(F.col("category").alias("position"), F.col("share").alias("prior"))
    out = filled.join(totals, ["team", "year"]).join(F.broadcast(prior), "position")
    total_w = F.col("total_v") * F.pow(F.lit(decay), F.col("year") - 1990)
    k = F.when(F.col("n_picks") < 20, 30.0).when(F.col("n_picks") <= 60, 15.0).otherwise(5.0)
    alpha = total_w / (total_w + k)
    weight = F.when(F.col("n_picks").isNull(), 0.2).otherwise(alpha * F.col("cat_v") / F.col("total_v") + (1 - alpha) * F.col("prior"))
    return out.select("team", "year", "position", F.coalesce("n_picks", F.lit(0)).alias("n_picks"), F.round(weight, 6).alias("weight"))


def archetype_vector(profile: DataFrame, european: list[str]) -> DataFrame:
    """gm, eur_share, top2: share of European categories, sum of the two largest position weights."""
    return profile.groupBy("gm").agg(
        F.round(F.sum(F.when((F.col("dimension") == "nationality") & F.col("category").isin(european), F.col("weight")).otherwise(0.0)), 6).alias("eur_share"),
        F.round(F.aggregate(F.slice(F.sort_array(F.collect_list(F.when(F.col("dimension") == "position", F.col("weight"))), asc=False), 1, 2), F.lit(0.0), lambda a, x: a + x), 6).alias("top2"),
    )


def archetype(total: Column, eur_share: Column, top2: Column) -> Column:
    """Name of a drafting style by ordered thresholds; under 15 picks the neutral one."""
    return (
        F.when(total < 15, "BPA").when(top2 > 0.65, "need-based").when(eur_share < 0.20, "safe").when(eur_share > 0.47, "euro-scout")
        .when((top2 < 0.55) & (eur_share > 0.30), "analytics").otherwise("BPA")
    )


# Style -> (eur_share, top2) that names a cluster.
CENTROIDS = {"BPA": (0.33, 0.50), "need-based": (0.33, 0.72), "safe": (0.12, 0.52), "euro-scout": (0.58, 0.50), "analytics": (0.38, 0.43)}


def archetype_clusters(vectors: DataFrame, n: int = 5, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """gm, cluster, archetype by a Gaussian mixture, best of several seeds; clusters are named by the nearest centroid.

    Names that two clusters share get the cluster's number appended.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    # read again for every step of every seed, so a table of its own; one row for each maker
    rows = written(VectorAssembler(inputCols=["eur_share", "top2"], outputCol="features").transform(vectors), "archetypes")
    models = [GaussianMixture(k=n, seed=s, maxIter=50).fit(rows) for s in seeds]
    best = max(models, key=lambda m: m.summary.logLikelihood)
    taken, names = set(), []
    for i, g in enumerate(best.gaussians):
        mean = g.mean.toArray()
        name = min(CENTROIDS, key=lambda c: (sum((a - b) ** 2 for a, b in zip(mean, CENTROIDS[c], strict=True)), c))
        names.append((i, name if name not in taken else f"{name}_{i}"))
        taken.add(name)
    labels = vectors.sparkSession.createDataFrame(names, "cluster int, archetype string")
    return best.transform(rows).select("gm", F.col("prediction").alias("cluster")).join(F.broadcast(labels), "cluster")


def archetype_matches(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Makers whose name holds a key of the truth table, with both styles and whether they agree."""
    t = F.broadcast(truth.select(F.lower("key").alias("key"), F.col("archetype").alias("expected")))
    return found.join(t, F.lower("name").contains(F.col("key"))).select("name", "archetype", "expected", (F.col("archetype") == F.col("expected")).alias("agrees"))


def rank_deviation(picks: DataFrame, per_round: int = 32) -> DataFrame:
    """gm, deviation: mean of pick number less the middle of its round, rounds 1 to 4."""
    middle = (F.col("round") - 1) * per_round + per_round / 2
    return picks.where("round <= 4").groupBy(F.col("team").alias("gm")).agg(F.round(F.avg(F.col("overall_pick") - middle), 4).alias("deviation"), F.count("*").alias("n"))
