"""Queries of preference profiles and point-in-time features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import features, profiles, tools, training
from ..sources.shared import written
from ..sources.star import LINE_PICKS, ORDER_PICKS, PROSPECTS, line_picks, order_picks, prospects

EUROPE = ["EUROPE", "MIDDLE EAST"]


def population_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.population_prior(line_picks(spark, sf_dir)).select("dimension", "category", F.round("share", 6).alias("share"))


def gm_weighted_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.raw_profile(line_picks(spark, sf_dir)).select("gm", "dimension", "category", F.round("share", 6).alias("share"))


def gm_shrunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.shrunk_profile(line_picks(spark, sf_dir))


def gm_shrunk_profile_1995(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.shrunk_profile(line_picks(spark, sf_dir).where("year = 1995"))


def gm_adaptive_history_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.history_weight(order_picks(spark, sf_dir))


def rank_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.rank_deviation(order_picks(spark, sf_dir))


def archetype_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = profiles.profile_sums(line_picks(spark, sf_dir))
    n = sums.where("dimension = ''").select("gm", F.col("k").alias("total"))
    vectors = profiles.archetype_vector(profiles.shrunk(sums), EUROPE)
    return vectors.join(n, "gm").select("gm", "eur_share", "top2", profiles.archetype(F.col("total"), F.col("eur_share"), F.col("top2")).alias("archetype"))


def archetype_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.archetype_clusters(profiles.archetype_vector(profiles.shrunk_profile(line_picks(spark, sf_dir)), EUROPE), n=5)


def team_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = order_picks(spark, sf_dir)
    words = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
    return tools.team_needs(picks.where("year = 1995").select("team", "position"), picks.where("year = 1996").select("position"), "team", words)


def draft_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.draft_history(order_picks(spark, sf_dir), since=1999, team=5).select("year", "overall_pick", "round", "position", "league")


def draft_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of a team's picks per league, and its distinct years."""
    p = order_picks(spark, sf_dir)
    years = p.groupBy("team").agg(F.countDistinct("year").alias("years"), F.count("*").alias("total"))
    return p.groupBy("team", "league").agg(F.count("*").alias("n")).join(years, "team").select("team", "league", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"), "years")


def cohort_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.cohort_medians(order_picks(spark, sf_dir), ["year", "league"], goalie="5-LOW")


def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("position").contains("STEEL"), "goalie").otherwise("skater")
    return features.empirical_cdf(prospects(spark, sf_dir), group, "ppg").select("id", "grp", "cdf")


def ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ordinal_quality(order_picks(spark, sf_dir), ["year"]).select("id", "ordinal", "quality")


def list_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prospects(spark, sf_dir).withColumnRenamed("css_ranking", "css_rank")
    return features.ordinal_quality(p, ["position"]).select("id", "position", "ordinal", "quality")


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.board_state(features.ordinal_quality(order_picks(spark, sf_dir), ["year"]), ["year"])


def draft_state_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select("id", "taken_share", "remaining_share", "team_taken", "round_index", "round_size", "rank_gap")


def slot_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select("id", "slot_pressure")


def position_competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.competition_rank(features.ordinal_quality(order_picks(spark, sf_dir), ["year"]), ["year"])


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_picks(spark, sf_dir)
    last = p.agg(F.max("year").alias("last"))
    return p.crossJoin(F.broadcast(last)).select("id", F.round(X.sample_weight(F.col("year"), F.col("last"), F.col("round")), 6).alias("w"))


POSITIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GOALIE = "5-LOW"


def with_physique(rows: DataFrame) -> DataFrame:
    """Sizes and the season before, which the orders lack, from the id."""
    return rows.withColumns(
        {
            "ppg_prev_season": F.when(F.col("id") % 3 != 0, F.col("ppg") * 0.9), "height_cm": F.col("id") % 40 + 160,
            "weight_kg": F.when(F.col("id") % 5 != 0, F.col("id") % 60 + 60), "gp_pre_draft": F.when(F.col("id") % 7 != 0, F.col("id") % 82),
        }
    )


#: Columns of the training set that are rounded there, are whole, or lie halfway between two whole numbers: they stay as they are.
ROUNDED = frozenset((
    "height_norm", "weight_norm", "ppg_league_norm", "age_league_norm", "css_rank_norm", "rank_gap_norm", "gm_pos_weight", "gm_league_weight", "gm_nat_weight", "gm_n_picks_norm",
    "pos_taken_before_norm", "pos_remaining_norm", "team_drafted_this_pos", "pos_quality_rank_norm", "css_rank_within_pos", "gp_pre_draft", "slot_pressure",
))


def matrix(rows: DataFrame, keys: list[str], physique_by: list[str] | None = None, rounded: frozenset[str] = frozenset(), centred: bool = True) -> DataFrame:
    """The 48 features of rows of the training set or of a board, rounded but for products (which can lie halfway between two roundings).

    ``rounded``: those that come with at most six places, which another rounding, the costliest step of a row, would not change.
    """
    rows = rows.withColumns({"draft_league": F.col("league"), "points_per_game": F.col("ppg")})
    out = features.feature_matrix(
        rows, keys, positions=tuple(POSITIONS), leagues=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), nations=("ASIA", "EUROPE"),
        league=F.col("draft_league"), nation=F.col("nationality"), physique_by=physique_by, centred=centred,
    )
    floats = [n for n, t in out.dtypes if t == "double" and not n.endswith("_affinity") and n not in keys and n not in rounded]
    return out.select(*[F.round(n, 6).alias(n) if n in floats else F.col(f"`{n}`") for n in out.columns])


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pick at its own slot, with its profile, competition and median features."""
    board = written(_board(spark, sf_dir).withColumn("gm", F.col("team")), "board")
    ranks = features.competition_rank(board, ["year"])
    medians = features.cohort_medians(board, ["year", "league"], GOALIE).select("year", "league", "ppg_median")
    weights, counts = training.history_weights(board)
    rows = board.join(ranks, "id").join(medians, ["year", "league"], "left").join(counts, ["gm", "year"], "left")
    for name, column in (("pos", "position"), ("league", "league"), ("nat", "nationality")):
        w = weights.where(F.col("dimension") == column).select("gm", "year", F.col("category").alias(column), F.col("weight").alias(f"gm_{name}_weight"))
        rows = rows.join(w, ["gm", "year", column], "left")
    norm = F.when((F.col("position") == GOALIE) | (F.col("ppg_median") <= 0), 1.0).otherwise(F.round(F.col("ppg") / F.col("ppg_median"), 4))
    rows = with_physique(rows).withColumns(
        {
            "draft_round": F.col("round"), "css_rank_norm": F.col("quality"), "rank_gap_norm": F.col("rank_gap"), "pos_taken_before_norm": F.col("taken_share"),
            "pos_remaining_norm": F.col("remaining_share"), "team_drafted_this_pos": F.col("team_taken"), "pos_quality_rank_norm": F.col("pos_quality_rank"),
            "css_rank_within_pos": F.col("pos_quality_rank"), "ppg_league_norm": norm, "gm_n_picks_norm": F.least(F.coalesce("n_picks", F.lit(0)) / 200, F.lit(1.0)),
        }
    )
    return matrix(rows, ["id"], physique_by=["year"])


def stratified_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every pick of rounds 1 to 4, those of its position from the whole rest of the year."""
    rows = features.stratified_negatives(order_picks(spark, sf_dir).where("round <= 4"), ["year"])
    return rows.groupBy("year", "overall_pick", "stratum").agg(F.count("*").alias("n"), F.sum("negative").alias("s"))


QUERIES = {f.__name__: f for f in (
    population_prior, gm_weighted_profile, gm_shrunk_profile, gm_shrunk_profile_1995, gm_adaptive_history_weight, rank_deviation, archetype_rules,
    archetype_gmm, team_needs, draft_history, draft_breakdown, cohort_medians, empirical_cdf, ordinal_quality, list_ordinal_quality, draft_state_windows,
    slot_pressure, position_competition_rank, sample_weights, feature_matrix, stratified_negatives,
)}

_RW = "CASE round WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 1 END"
_LONG = "SELECT {keys} {w} AS w, unnest(['position', 'league', 'nationality']) AS dimension, unnest([position, league, nationality]) AS category FROM {rows}"


def _profile_sql(where: str) -> str:
    return f"""{LINE_PICKS}, sel AS (SELECT * FROM lines WHERE {where}),
  wp AS (SELECT *, {_RW} * pow(0.85, max(year) OVER (PARTITION BY gm) - year) AS w FROM sel),
  n AS (SELECT gm, sum(w) AS n FROM wp GROUP BY gm),
  own0 AS ({_LONG.format(keys="gm,", w="w", rows="wp")}),
  own AS (SELECT gm, dimension, category, sum(w) / sum(sum(w)) OVER (PARTITION BY gm, dimension) AS share FROM own0 GROUP BY 1, 2, 3),
  pr0 AS ({_LONG.format(keys="", w=_RW, rows="sel")}),
  prior AS (SELECT dimension, category, sum(w) / sum(sum(w)) OVER (PARTITION BY dimension) AS prior FROM pr0 GROUP BY 1, 2),
  profile AS (SELECT n.gm, p.dimension, p.category, round(n.n / (n.n + 30) * coalesce(o.share, 0) + (1 - n.n / (n.n + 30)) * p.prior, 6) AS weight
    FROM n CROSS JOIN prior p LEFT JOIN own o ON o.gm = n.gm AND o.dimension = p.dimension AND o.category = p.category)"""


_QUALITY = """q AS (SELECT *, CASE WHEN css_rank IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY year, css_rank IS NULL ORDER BY css_rank, id) AS INT) END AS ordinal,
    count(css_rank) OVER (PARTITION BY year) AS nr FROM picks),
  quality AS (SELECT *, round(CASE WHEN ordinal IS NULL THEN 0.15 ELSE greatest(0.0, 1.0 - sqrt((ordinal - 1) / greatest(nr, 1)::DOUBLE)) END, 6) AS quality FROM q)"""
_BOARD = f"""{ORDER_PICKS}, {_QUALITY},
  st AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY overall_pick) AS seq, count(*) OVER (PARTITION BY year) AS nc,
    count(*) OVER (PARTITION BY year, position ORDER BY overall_pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken,
    count(*) OVER (PARTITION BY year, position ORDER BY overall_pick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
    count(*) OVER (PARTITION BY year, team, position ORDER BY overall_pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS team_taken,
    CAST(row_number() OVER (PARTITION BY year, round ORDER BY overall_pick) AS INT) AS round_index, count(*) OVER (PARTITION BY year, round) AS round_size,
    max(quality) OVER (PARTITION BY year, round) AS round_best FROM quality),
  board AS (SELECT *, round(coalesce(taken / nullif(seq - 1, 0)::DOUBLE, 0)::DECIMAL(18, 12), 4)::DOUBLE AS taken_share, round((remaining / (nc - seq + 1)::DOUBLE)::DECIMAL(18, 12), 4)::DOUBLE AS remaining_share,
    round(greatest(0, round_best - quality), 6) AS rank_gap, round(greatest(0.0, 1.0 - (round_index - 1) / greatest(round_size - 1, 1)::DOUBLE), 6) AS slot_pressure FROM st)"""

#: hw (gm, year, dimension, category, weight) and hcount (gm, year, n_picks) of the picks ``hp``, from earlier years.
_HISTORY = f"""
        hl AS (SELECT gm, year, {_RW} AS rw, unnest(['position', 'league', 'nationality']) AS dimension, unnest([position, league, nationality]) AS category FROM hp),
        hg AS (SELECT DISTINCT gm, year FROM hp), hy AS (SELECT gm, year, sum({_RW}) AS w, count(*) AS k FROM hp GROUP BY 1, 2),
        hc AS (SELECT gm, year, dimension, category, sum(rw) AS w FROM hl GROUP BY 1, 2, 3, 4),
        hprior AS (SELECT dimension, category, count(*) / sum(count(*)) OVER (PARTITION BY dimension)::DOUBLE AS prior FROM hl GROUP BY 1, 2),
        htot AS (SELECT a.gm, a.year, sum(b.k) AS n, sum(b.w * pow(0.85, a.year - b.year)) AS tw FROM hg a LEFT JOIN hy b ON a.gm = b.gm AND b.year < a.year GROUP BY 1, 2),
        hcat AS (SELECT a.gm, a.year, b.dimension, b.category, sum(b.w * pow(0.85, a.year - b.year)) AS cw FROM hg a JOIN hc b ON a.gm = b.gm AND b.year < a.year GROUP BY 1, 2, 3, 4),
        hj AS (SELECT t.gm, t.year, p.dimension, p.category, n, tw, coalesce(cw, 0) AS cw, prior, tw / (tw + CASE WHEN n < 20 THEN 30 WHEN n <= 60 THEN 15 ELSE 5 END) AS alpha
          FROM htot t CROSS JOIN hprior p LEFT JOIN hcat c ON c.gm = t.gm AND c.year = t.year AND c.dimension = p.dimension AND c.category = p.category WHERE n > 0),
        hw AS (SELECT gm, year, dimension, category, round(alpha * cw / sum(cw) OVER (PARTITION BY gm, year, dimension) + (1 - alpha) * prior, 6) AS weight FROM hj),
        hcount AS (SELECT gm, year, CAST(coalesce(n, 0) AS BIGINT) AS n_picks FROM htot)"""

# Floyd's sampling of 12 places, one step after another
_STEP = "('0x' || substr(md5(concat_ws('|', 42, year, overall_pick, {k})), 1, 8))::BIGINT % (pool - 11 + {k})"
_FLOYD = "f0 AS (SELECT *, CAST([] AS BIGINT[]) AS s FROM sq WHERE pool >= 12)" + "".join(
    f""",
  f{k + 1} AS (SELECT * EXCLUDE (s, h), list_append(s, CASE WHEN list_contains(s, h) THEN pool - 12 + {k} ELSE h END) AS s FROM (SELECT *, {_STEP.format(k=k)} AS h FROM f{k}))""" for k in range(12)
)

_NEGATIVES = f"""
        sq AS (SELECT year, position, overall_pick, row_number() OVER (PARTITION BY year ORDER BY overall_pick) AS place, row_number() OVER (PARTITION BY year, position ORDER BY overall_pick) AS seq,
          count(*) OVER (PARTITION BY year, position) - row_number() OVER (PARTITION BY year, position ORDER BY overall_pick) AS pool FROM p),
        {_FLOYD}, asked AS (SELECT year, position, overall_pick, seq + 1 + unnest(s) AS target FROM f12),
        drawn AS (SELECT a.year, a.overall_pick, b.overall_pick AS negative FROM asked a JOIN sq b ON a.year = b.year AND a.position = b.position AND a.target = b.seq),
        near AS (SELECT a.year, a.overall_pick, a.pool, b.overall_pick AS negative FROM sq a JOIN sq b ON a.year = b.year AND b.place BETWEEN a.place + 1 AND a.place + 31),
        rest AS (SELECT n.*, row_number() OVER (PARTITION BY year, overall_pick ORDER BY negative) AS nth FROM near n ANTI JOIN drawn USING (year, overall_pick, negative)),
        al AS (SELECT *, 'position' AS stratum FROM drawn UNION ALL SELECT year, overall_pick, negative, 'window' FROM rest WHERE pool < 12 OR nth <= 19)"""

_HOT = lambda col, words, prefix: ", ".join(f"CAST({col} = '{w}' AS INT) AS \"{prefix}_{w}\"" for w in words)

SQL = {
    "population_prior": f"""WITH {LINE_PICKS}, l AS ({_LONG.format(keys="", w=_RW, rows="lines")})
        SELECT dimension, category, round(sum(w) / sum(sum(w)) OVER (PARTITION BY dimension), 6) AS share FROM l GROUP BY 1, 2""",
    "gm_weighted_profile": f"WITH {_profile_sql('true')} SELECT gm, dimension, category, round(share, 6) AS share FROM own",
    "gm_shrunk_profile": f"WITH {_profile_sql('true')} SELECT * FROM profile",
    "gm_shrunk_profile_1995": f"WITH {_profile_sql('year = 1995')} SELECT * FROM profile",
    "gm_adaptive_history_weight": f"""WITH {ORDER_PICKS}, ty AS (SELECT DISTINCT team, year FROM picks), vocab AS (SELECT DISTINCT position FROM picks),
        prior AS (SELECT position, count(*) / (SELECT count(*) FROM picks)::DOUBLE AS prior FROM picks GROUP BY 1),
        per AS (SELECT team, position, year, sum({_RW}) AS w, count(*) AS k FROM picks GROUP BY 1, 2, 3),
        tot AS (SELECT a.team, a.year, sum(b.k) AS n, sum(b.w * pow(0.85, a.year - b.year)) AS tw FROM ty a LEFT JOIN per b ON a.team = b.team AND b.year < a.year GROUP BY 1, 2),
        cat AS (SELECT a.team, a.year, b.position, sum(b.w * pow(0.85, a.year - b.year)) AS cw FROM ty a JOIN per b ON a.team = b.team AND b.year < a.year GROUP BY 1, 2, 3),
        j AS (SELECT t.team, t.year, v.position, n, tw, coalesce(cw, 0) AS cw, prior, tw / (tw + CASE WHEN n < 20 THEN 30 WHEN n <= 60 THEN 15 ELSE 5 END) AS alpha
          FROM tot t CROSS JOIN vocab v JOIN prior USING (position) LEFT JOIN cat c ON c.team = t.team AND c.year = t.year AND c.position = v.position)
        SELECT team, year, position, CAST(coalesce(n, 0) AS BIGINT) AS n_picks, round(CASE WHEN n IS NULL THEN 0.2 ELSE alpha * cw / tw + (1 - alpha) * prior END, 6) AS weight FROM j""",
    "rank_deviation": f"WITH {ORDER_PICKS} SELECT team AS gm, round(avg(overall_pick - ((round - 1) * 32 + 16)), 4) AS deviation, count(*) AS n FROM picks WHERE round <= 4 GROUP BY 1",
    "archetype_rules": f"""WITH {_profile_sql('true')}, c AS (SELECT gm, count(*) AS total FROM lines GROUP BY 1),
        v AS (SELECT gm, round(sum(CASE WHEN dimension = 'nationality' AND category IN ('EUROPE', 'MIDDLE EAST') THEN weight ELSE 0 END), 6) AS eur_share,
          round(list_sum(list_sort(list(weight) FILTER (dimension = 'position'), 'DESC')[1:2]), 6) AS top2 FROM profile GROUP BY gm)
        SELECT gm, eur_share, top2, CASE WHEN total < 15 THEN 'BPA' WHEN top2 > 0.65 THEN 'need-based' WHEN eur_share < 0.20 THEN 'safe' WHEN eur_share > 0.47 THEN 'euro-scout'
          WHEN top2 < 0.55 AND eur_share > 0.30 THEN 'analytics' ELSE 'BPA' END AS archetype FROM v JOIN c USING (gm)""",
    "team_needs": f"""WITH {ORDER_PICKS}, v AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS position),
        t AS (SELECT team, count(*) AS total FROM picks WHERE year = 1995 GROUP BY 1), d AS (SELECT team, position, count(*) AS k FROM picks WHERE year = 1995 GROUP BY 1, 2),
        s AS (SELECT position, count(*) / (SELECT count(*) FROM picks WHERE year = 1996)::DOUBLE AS supply FROM picks WHERE year = 1996 GROUP BY 1),
        j AS (SELECT t.team, v.position, coalesce(k / total::DOUBLE, 0) AS d, coalesce(supply, 0) AS s FROM t CROSS JOIN v LEFT JOIN d ON d.team = t.team AND d.position = v.position LEFT JOIN s ON s.position = v.position),
        r AS (SELECT *, round(CASE WHEN s > 0 THEN d / s WHEN d > 0 THEN 1.5 ELSE 1.0 END, 6) AS ratio FROM j)
        SELECT team, position, round(d, 6) AS demand, round(s, 6) AS supply, ratio, CASE WHEN ratio >= 1.3 THEN 'high' WHEN ratio >= 0.9 THEN 'medium' ELSE 'low' END AS need FROM r""",
    "draft_history": f"WITH {ORDER_PICKS} SELECT year, overall_pick, round, position, league FROM picks WHERE team = 5 AND year >= 1999",
    "draft_breakdown": f"""WITH {ORDER_PICKS}, y AS (SELECT team, count(DISTINCT year) AS years, count(*) AS total FROM picks GROUP BY 1)
        SELECT team, league, count(*) AS n, round(100.0 * count(*) / any_value(total), 4) AS pct, any_value(years) AS years FROM picks JOIN y USING (team) GROUP BY 1, 2""",
    "cohort_medians": f"""WITH {ORDER_PICKS} SELECT year, league, round(median(ppg) FILTER (position <> '5-LOW'), 8) AS ppg_median, round(median(age), 8) AS age_median, round(median(overall_pick), 8) AS pick_median FROM picks GROUP BY 1, 2""",
    "empirical_cdf": f"""WITH {PROSPECTS}, g AS (SELECT id, ppg, CASE WHEN position LIKE '%STEEL%' THEN 'goalie' ELSE 'skater' END AS grp FROM prospects)
        SELECT id, grp, round(cume_dist() OVER (PARTITION BY grp ORDER BY ppg), 6) AS cdf FROM g""",
    "ordinal_quality": f"WITH {ORDER_PICKS}, {_QUALITY} SELECT id, ordinal, quality FROM quality",
    "list_ordinal_quality": f"""WITH {PROSPECTS}, picks AS (SELECT id, position AS year, css_ranking AS css_rank FROM prospects), {_QUALITY} SELECT id, year AS position, ordinal, quality FROM quality""",
    "draft_state_windows": f"WITH {_BOARD} SELECT id, taken_share, remaining_share, team_taken, round_index, round_size, rank_gap FROM board",
    "slot_pressure": f"WITH {_BOARD} SELECT id, slot_pressure FROM board",
    "sample_weights": f"""WITH {ORDER_PICKS} SELECT id, round(pow(0.92, (SELECT max(year) FROM picks) - year) * (1 + CASE round WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.4 WHEN 4 THEN 0.1 ELSE 0 END), 6) AS w FROM picks""",
    "position_competition_rank": f"""WITH {ORDER_PICKS}, {_QUALITY},
        c AS (SELECT a.id, count(*) AS n, count(*) FILTER (b.quality > a.quality) AS better FROM quality a JOIN quality b ON a.year = b.year AND a.position = b.position AND b.overall_pick >= a.overall_pick GROUP BY 1)
        SELECT id, CASE WHEN n > 1 THEN round(((n - better) / n::DOUBLE)::DECIMAL(18, 12), 4)::DOUBLE ELSE 1.0 END AS pos_quality_rank FROM c""",
    "feature_matrix": f"""WITH {_BOARD}, hp AS (SELECT *, team AS gm FROM picks), {_HISTORY},
        cr AS (SELECT a.id, count(*) AS nn, count(*) FILTER (b.quality > a.quality) AS better FROM quality a JOIN quality b ON a.year = b.year AND a.position = b.position AND b.overall_pick >= a.overall_pick GROUP BY 1),
        md AS (SELECT year, league, round(median(ppg) FILTER (position <> '5-LOW'), 8) AS pm FROM picks GROUP BY 1, 2),
        r AS (SELECT b.*, ppg * 0.9 AS pp, (b.id % 40 + 160)::DOUBLE AS h, coalesce(CASE WHEN b.id % 5 <> 0 THEN (b.id % 60 + 60)::DOUBLE END, 85.0) AS wt,
          least(greatest(1.0 - (overall_pick - 1) / 224.0, 0.0), 1.0) AS slot, b.id % 3 <> 0 AS has, CASE WHEN nn > 1 THEN round(((nn - better) / nn::DOUBLE)::DECIMAL(18, 12), 4)::DOUBLE ELSE 1.0 END AS comp,
          CASE WHEN b.position = '5-LOW' OR pm <= 0 THEN 1.0 ELSE round(ppg / pm, 4) END AS pn, coalesce(w1.weight, 0.2) AS gp, coalesce(w2.weight, 0.2) AS gl, coalesce(w3.weight, 0.33) AS gn,
          least(coalesce(hc.n_picks, 0) / 200.0::DOUBLE, 1.0) AS np
          FROM board b JOIN cr ON cr.id = b.id JOIN md ON md.year = b.year AND md.league = b.league LEFT JOIN hcount hc ON hc.gm = b.team AND hc.year = b.year
          LEFT JOIN hw w1 ON w1.gm = b.team AND w1.year = b.year AND w1.dimension = 'position' AND w1.category = b.position
          LEFT JOIN hw w2 ON w2.gm = b.team AND w2.year = b.year AND w2.dimension = 'league' AND w2.category = b.league
          LEFT JOIN hw w3 ON w3.gm = b.team AND w3.year = b.year AND w3.dimension = 'nationality' AND w3.category = b.nationality)
        SELECT id, {_HOT('position', ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), 'pos')}, {_HOT('nationality', ('ASIA', 'EUROPE'), 'nat')},
          {_HOT('league', ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), 'league')},
          round(h - median(h) OVER (PARTITION BY year, position), 6) AS height_norm, round(wt - median(wt) OVER (PARTITION BY year, position), 6) AS weight_norm, round(pn, 6) AS ppg_league_norm, 0.0::DOUBLE AS age_league_norm,
          quality AS css_rank_norm, round(slot, 6) AS pick_slot_norm, round(quality - slot, 6) AS rank_vs_slot, rank_gap AS rank_gap_norm, gp AS gm_pos_weight, gl AS gm_league_weight, gn AS gm_nat_weight,
          round(np, 6) AS gm_n_picks_norm, gp * quality AS gm_pos_affinity, gl * quality AS gm_league_affinity, gn * quality AS gm_nat_affinity, taken_share AS pos_taken_before_norm,
          remaining_share AS pos_remaining_norm, team_taken::DOUBLE AS team_drafted_this_pos, comp AS pos_quality_rank_norm, comp AS css_rank_within_pos,
          CASE WHEN id % 7 <> 0 THEN (id % 82)::DOUBLE ELSE 30.0 END AS gp_pre_draft,
          round(CASE WHEN has THEN pp ELSE 0.0 END, 6) AS ppg_prev_season, CAST(has AS INT) AS has_prev_season, round(CASE WHEN has THEN least(greatest((ppg - pp) / greatest(pn, 0.01), -3.0), 3.0) ELSE 0.0 END, 6) AS ppg_delta, slot_pressure,
          CAST(round = 1 AS INT) AS round_1, CAST(round = 2 AS INT) AS round_2, CAST(round = 3 AS INT) AS round_3, CAST(round = 4 AS INT) AS round_4 FROM r""",
    "stratified_negatives": f"""WITH {ORDER_PICKS}, p AS (SELECT * FROM picks WHERE round <= 4), {_NEGATIVES}
        SELECT year, overall_pick, stratum, count(*) AS n, CAST(sum(negative) AS BIGINT) AS s FROM al GROUP BY 1, 2, 3""",
}
