"""Queries of the boosted ranker: folds, stages, scores, attributions, importances and what is reported of them.

SQL cannot fit the model; tests hold it against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, evaluate, monitor, profiles, scoring, search
from ..sources.shared import written
from ..sources.star import line_picks
from .profiles import matrix, with_physique
from .training import SLOT, _linear, _matrix, pool

#: Growth of the trees, the most trees of a fold, trees without gain before it stops, and the least trees of the last fit after an early stop.
HOW = {"learning_rate": 0.15, "max_depth": 4, "min_child_weight": 5.0}
ROUNDS, PATIENCE, FLOOR = 14, 4, 8

_FITTED: dict = {}


def _fitted(spark: SparkSession, sf_dir: str) -> dict:
    """Fold models, the final split's, the model of all rows and the matrix; made once for each table and application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _FITTED:
        names, x = _matrix(spark, sf_dir)
        years = [r[0] for r in x.select("year").distinct().orderBy("year").collect()]
        edges = boosting.bin_edges(x, names)
        blocks = boosting.pack(x, names, edges, ["year", "overall_pick"], "year", "was_picked", "sample_weight", "id")
        folds = evaluate.walk_forward(years, years[1])
        specs = [boosting.Params(years[0], last, test, test, **HOW) for last, test in folds]
        specs.append(boosting.Params(years[0], years[-3], years[-2], years[-1], **HOW))
        specs.append(boosting.Params(years[0], years[-1], years[-2], years[-1], **HOW))
        chosen = lambda found: boosting.chosen_rounds(found[-1].best_round(), [m.best_round() for m in found[:-1]], FLOOR)
        *of_folds, final, model = boosting.fit(blocks, names, edges, specs, ROUNDS, PATIENCE, chosen)
        _FITTED[at] = {"x": x, "names": names, "edges": edges, "blocks": blocks, "years": years, "folds": of_folds, "final": final, "model": model}
    return _FITTED[at]


def ranker_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward folds: trees kept, NDCG@1 of the boosted ranker and of the linear one on the same test year, and of chance."""
    got = _fitted(spark, sf_dir)
    _, hits = _linear(got["x"], got["names"], [(m.params.last, m.params.test_first) for m in got["folds"]])
    rows = []
    for m in got["folds"]:
        n, linear, chance = hits[m.params.test_first]
        rows.append((m.params.last, m.params.test_first, n, len(m.trees), m.best_round(), m.staged[m.best_round()], linear, chance))
    return spark.createDataFrame(rows, "last_year int, test_year int, n_groups bigint, n_trees int, best_round int, ndcg1 double, ndcg1_linear double, ndcg1_chance double")


def ranker_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@1 on the test years after each tree, of every fold and of the final split."""
    got = _fitted(spark, sf_dir)
    rows = [
        (m.params.last, m.params.test_first, m.params.test_last, k, v, k == m.best_round()) for m in [*got["folds"], got["final"]] for k, v in enumerate(m.staged)
    ]
    return spark.createDataFrame(rows, "last_year int, test_first int, test_last int, n_trees int, ndcg1 double, is_best boolean")


def ranker_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and reciprocal ranks of the held-out years' slots by the final split's model, by year and together."""
    got = _fitted(spark, sf_dir)
    m = got["final"]
    scored = boosting.score(got["x"].where(F.col("year") >= m.params.test_first), m.cut_to(max(1, m.best_round())))
    own = scored.where("was_picked = 1").select("year", "overall_pick", F.col("score").alias("_own"), F.col("id").alias("_id"))
    ahead = (F.col("score") > F.col("_own")) | (F.col("score") == F.col("_own")) & (F.col("id") < F.col("_id"))  # ties go as in the stages
    ranks = scored.join(own, ["year", "overall_pick"]).groupBy("year", "overall_pick").agg((F.count_if(ahead) + 1).alias("rank"))
    return evaluate.breakdown(ranks.withColumn("year", F.col("year").cast("string")), "rank", ["year"])


def ranker_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the gain by feature in the model of all rows and in that of the final split, with their places."""
    got = _fitted(spark, sf_dir)
    now, before = got["model"].importances(), got["final"].cut_to(max(1, got["final"].best_round())).importances()
    place = lambda x: {f: k + 1 for k, f in enumerate(sorted(x, key=lambda f: (-x[f], f)))}
    a, b = place(now), place(before)
    return spark.createDataFrame([(f, now[f], before[f], a[f], b[f]) for f in got["names"]], "feature string, importance double, before double, place int, place_before int")


def ranker_importance_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.importance_record(ranker_importances(spark, sf_dir), "feature", "importance")


def ranker_importance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.rank_drift(ranker_importances(spark, sf_dir), "feature", "before", "importance")


def ranker_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality gate on the measured mean of the folds."""
    got = _fitted(spark, sf_dir)
    mean = sum(m.staged[m.best_round()] for m in got["folds"]) / len(got["folds"])
    return monitor.model_gate(ranker_importances(spark, sf_dir), mean)


def _pool_matrix(spark: SparkSession, sf_dir: str, window: int | None, slot: int, profile: DataFrame | None) -> DataFrame:
    """gm, id and the 48 features of the candidates of a slot."""
    p = pool(spark, sf_dir)
    rows = scoring.at_slot(scoring.candidate_pool(p, window), slot).withColumns({"overall_pick": F.lit(slot), "draft_round": F.lit(1)})
    medians = p.groupBy("league").agg(F.median(F.when(~F.col("is_goalie"), F.col("ppg"))).alias("_m"))
    rows = with_physique(rows.join(F.broadcast(medians), "league", "left"))  # a row a league
    rows = rows.withColumn("ppg_league_norm", F.when(F.col("is_goalie") | F.coalesce(F.col("_m") <= 0, F.lit(True)), 1.0).otherwise(F.col("ppg") / F.col("_m")))
    rows = rows.withColumn("css_rank_within_pos", F.col("pos_quality_rank_norm")).drop("_m")
    return matrix(scoring.with_profile(rows, profile).withColumn("gm", F.col("gm") if profile is not None else F.lit(None).cast("bigint")), ["gm", "id"])


def ranker_pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 candidates of slot 15 scored by the model of all rows for every decision maker, with the place of each."""
    rows = _pool_matrix(spark, sf_dir, scoring.WINDOW, SLOT, profiles.shrunk_profile(line_picks(spark, sf_dir)))
    scored = boosting.score(rows, _fitted(spark, sf_dir)["model"]).select("gm", "id", "score")
    return scored.withColumn("place", F.expr("row_number() over (partition by gm order by score desc, id)"))  # 40 rows a gm


def ranker_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prospect by its score at the first slot without a profile."""
    rows = _pool_matrix(spark, sf_dir, None, 1, None)
    return boosting.score(rows, _fitted(spark, sf_dir)["model"]).select("id", "score")


def ranker_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features that move the score of each prospect at slot 15 most; expected + total is the score of every row."""
    rows = _pool_matrix(spark, sf_dir, None, SLOT, None)
    return boosting.attributions(rows, _fitted(spark, sf_dir)["model"], ["id"], top=10)


def ranker_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows of the training set: how far contributions and expectation miss the score at most, and how many rows by over 0.05."""
    got = _fitted(spark, sf_dir)
    rows = boosting.attributions(got["x"], got["model"], ["year"], top=1)
    error = F.abs(F.col("expected") + F.col("total") - F.col("score"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.count_if(error > 0.05).alias("n_off"), F.round(F.max(error), 6).alias("largest"))


def ranker_feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store serves for slot 15: all features of every prospect as stored for the first slot, the slot's own in place of the neutral ones, scored."""
    rows = written(_pool_matrix(spark, sf_dir, None, 1, None).drop("gm"), "ranker-features")
    names = [c for c in rows.columns if c != "id"]
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    at = now - F.make_dt_interval(hours=F.when(F.col("id") % 50 == 3, 30).otherwise(F.col("id") % 24).cast("int"))
    store = written(scoring.stored(rows, "id", names, at, F.lit(scoring.VERSION)), "ranker-store")
    requests = rows.select((F.col("id") % 50).alias("batch"), "id")
    served = scoring.served(store, requests, scoring.read_batches(store, requests, "batch", "id", now), "batch", "id", names, SLOT)
    return boosting.score(served, _fitted(spark, sf_dir)["model"]).select("batch", "id", "score")


def ranker_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of the conformal sets from the held-out slots as the final split's model scores them."""
    got = _fitted(spark, sf_dir)
    m = got["final"]
    scored = boosting.score(got["x"].where(F.col("year") >= m.params.test_first), m.cut_to(max(1, m.best_round())))
    scored = written(scored.select(F.concat_ws("-", "year", "overall_pick").alias("slot"), "was_picked", "score"), "ranker-scores")
    return evaluate.conformal_quantiles(scored, "slot", "was_picked", "score")


#: What the query searches: few and small trees, two batches of trials, the last two years.
TRIALS, BATCH, STARTUP, FOLDS = 8, 4, 4, 2
SEARCHED = search.SPACE | {"n_estimators": search.Span(2, 6, whole=True), "max_depth": search.Span(2, 4, whole=True), "learning_rate": search.Span(0.05, 0.4, log=True)}


def ranker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of the search in order, with their mean NDCG@1 over the last years, and which is the best."""
    got = _fitted(spark, sf_dir)
    folds = [(got["years"][0], last, test) for last, test in evaluate.walk_forward(got["years"], got["years"][-FOLDS])]
    objective = search.rank_objective(got["blocks"], got["names"], got["edges"], folds)
    trials = search.search(objective, SEARCHED, TRIALS, BATCH, startup=STARTUP)
    best = max(range(len(trials)), key=lambda i: (trials[i][1], -i))
    rows = [(i + 1, float(v), i == best, *[float(t[k]) for k in SEARCHED]) for i, (t, v) in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, ndcg1 double, is_best boolean, " + ", ".join(f"{k} double" for k in SEARCHED))


QUERIES = {f.__name__: f for f in (
    ranker_search, ranker_folds, ranker_stages, ranker_backtest, ranker_importances, ranker_importance_record, ranker_importance_drift, ranker_gate,
    ranker_pool_scores, ranker_leaderboard, ranker_feature_store, ranker_attributions, ranker_additivity, ranker_conformal,
)}
SQL: dict[str, str] = {}
