"""Queries of the lottery, sampling and drafts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import lottery, simulate
from ..sources.star import PROSPECTS, prospects, table

#: Candidates on the board of a draft.
BOARD = 72
ORDER = [i % 32 + 1 for i in range(32)]
SWAPPED = [10 if t == 3 else 3 if t == 10 else t for t in ORDER]


def standings_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = lottery.standings(s, "n_nationkey", "n_regionkey", "s_acctbal", "s_suppkey")
    return out.select("s_suppkey", "division_seq", "wildcard_seq", "playoff", "overall", "lottery_slot")


def _lottery_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, standing (1 the worst, up to 16), team: the teams of each region that are not in the playoffs."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = lottery.standings(s, "n_nationkey", "n_regionkey", "s_acctbal", "s_suppkey").where("NOT playoff")
    placed = out.withColumn("standing", F.expr("row_number() over (partition by n_regionkey order by s_acctbal, s_suppkey desc)"))
    return placed.where(F.col("standing") <= len(lottery.ODDS)).select(F.col("n_regionkey").alias("region"), "standing", F.col("s_suppkey").alias("team"))


def lottery_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinations of balls that each team of each region's lottery holds."""
    spans, combos = lottery.assignment(lottery.odds_table(spark)), lottery.combinations(spark)
    held = combos.join(F.broadcast(spans), (F.col("index") >= F.col("first")) & (F.col("index") < F.col("stop")))
    held = held.groupBy("standing").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.count("*").alias("n"), F.array_join(F.min("combo"), "-").alias("first_combo"))
    return _lottery_teams(spark, sf_dir).join(F.broadcast(held), "standing").select("region", "team", "standing", "first", "last", "n", "first_combo")  # 16 rows


def lottery_exact_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odds of the first two picks of each team; a region with fewer teams than odds leaves the rest of them to nobody."""
    odds = F.broadcast(lottery.exact_probabilities(lottery.odds_table(spark)))
    return _lottery_teams(spark, sf_dir).join(odds, "standing").select("region", "team", "standing", "p_first", "p_second")


def lottery_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the teams of each region's lottery finish in 2,000 of its own draws."""
    teams = _lottery_teams(spark, sf_dir)
    drawn = lottery.draws(spark, 2_000, seed=42, keys=teams.select("region").distinct())
    found = lottery.finishes(drawn, keys=["region"]).withColumnRenamed("team", "standing")
    return found.join(teams, ["region", "standing"]).select("region", "team", "slot", "n")


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.blend(simulate.candidate_window(prospects(spark, sf_dir), ["league"], 40), ["league"], "ppg", 0.6)


def blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, sf_dir).select("league", "id", "blend")


def blend_and_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.top_gap(_window(spark, sf_dir), ["league"], "blend", 0.25)


def softmax_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.softmax_sample(_window(spark, sf_dir), ["league"], "blend", 0.25, 42)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of each league: its ``BOARD`` best ranked prospects by their place in it."""
    words = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    need = F.coalesce(F.array_position(F.array(*map(F.lit, words)), F.split_part("position", F.lit(" "), F.lit(1))).cast("int"), F.lit(0)) % 6
    ranked = prospects(spark, sf_dir).where("css_ranking IS NOT NULL").withColumn("place", F.expr("row_number() over (partition by league order by css_ranking)"))
    top = ranked.where(F.col("place") <= BOARD)
    return top.select("league", "id", F.col("place").alias("rank"), F.round(1 - (F.col("place") - 1) / BOARD, 6).alias("base"), need.alias("need"), "position")


def greedy_draft_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole draft of each league, side by side."""
    return simulate.draft(_pool(spark, sf_dir), ["league"], ORDER)


def counterfactual_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return simulate.divergence(simulate.draft(pool, ["league"], ORDER), simulate.draft(pool, ["league"], SWAPPED), ["league"])


def draft_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pick against its rank (steal or reach) and the share of its position in its draft."""
    pool = _pool(spark, sf_dir)
    picks = simulate.draft(pool, ["league"], ORDER).join(pool.select("id", "rank", "position"), "id")
    share = picks.groupBy("league", "position").agg(F.round(F.count("*") / 32, 6).alias("position_share"))
    return picks.join(share, ["league", "position"]).select("league", "pick", "id", (F.col("pick") - F.col("rank")).alias("deviation"), X.value_gap(F.col("pick"), F.col("rank")).alias("value"), "position_share")


def draft_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each candidate of a league goes at each pick in 50 sampled drafts of it."""
    return simulate.sampled_drafts(_pool(spark, sf_dir), 50, ORDER, keys=["league"]).groupBy("league", "pick", "id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    standings_seed, lottery_assignment, lottery_exact_probabilities, lottery_monte_carlo, blend_scores, blend_and_gap, softmax_sample,
    greedy_draft_fold, counterfactual_divergence, draft_facts, draft_monte_carlo,
)}

_ODDS = f"odds AS (SELECT unnest(range(1, 17)) AS standing, unnest({list(lottery.ODDS)}) AS odds)"
_SPANS = f"""{_ODDS}, n AS (SELECT standing, CAST(round(odds * 10) AS INT) AS n FROM odds), u AS (SELECT standing, n, CAST(sum(n) OVER (ORDER BY standing) AS INT) AS upto FROM n),
  spans AS (SELECT standing, least(upto - n, 1000) AS first, least(upto, 1000) AS stop FROM u)"""
_TEAMS = """t0 AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS ds FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  t1 AS (SELECT *, CASE WHEN ds > 3 THEN row_number() OVER (PARTITION BY n_regionkey, ds > 3 ORDER BY s_acctbal DESC, s_suppkey) END AS ws FROM t0),
  teams AS (SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal, s_suppkey DESC) AS INT) AS standing, s_suppkey AS team FROM t1 WHERE NOT (ds <= 3 OR coalesce(ws <= 2, false)) QUALIFY standing <= 16)"""
_WINDOW = f"""{PROSPECTS}, w AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY css_ranking NULLS LAST, id) AS place FROM prospects),
  c AS (SELECT *, min(ppg) OVER (PARTITION BY league) AS lo, max(ppg) OVER (PARTITION BY league) AS hi, max(coalesce(css_ranking, 9999)) OVER (PARTITION BY league) AS mx FROM w WHERE place <= 40),
  b AS (SELECT league, id, round(0.4 * (ppg - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END + 0.6 * CASE WHEN css_ranking IS NULL THEN 0 ELSE 1.0 - (css_ranking - 1) / mx::DOUBLE END, 6) AS blend FROM c)"""
_U = "('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0"
_POOL = f"""{PROSPECTS}, pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY league ORDER BY css_ranking) AS INT) AS place FROM prospects WHERE css_ranking IS NOT NULL),
  pool AS (SELECT league, id, place AS rank, round(1 - (place - 1) / {BOARD}.0::DOUBLE, 6) AS base, position,
    coalesce(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], split_part(position, ' ', 1)), 0) % 6 AS need FROM pl WHERE place <= {BOARD})"""


def _fold(name: str, order: list[int]) -> str:
    return f"""{name}s AS (SELECT league, least(32, count(*)) AS n FROM pool GROUP BY 1), {name}0 AS (SELECT league, n, 0 AS t, CAST([] AS BIGINT[]) AS taken FROM {name}s UNION ALL
    SELECT league, n, t + 1, list_append(taken, (SELECT max({{'v': round(base + CASE WHEN need = ({order})[t + 1] % 6 THEN 0.15 ELSE 0 END, 6), 'r': -rank, 'id': id}}).id FROM pool WHERE pool.league = {name}0.league AND NOT list_contains(taken, id))) FROM {name}0 WHERE t < n),
  {name}1 AS (SELECT league, CAST(unnest(range(1, n + 1)) AS INT) AS pick, unnest(taken) AS id FROM {name}0 WHERE t = n), {name} AS (SELECT league, pick, ({order})[pick] AS team, id FROM {name}1)"""


SQL = {
    "standings_seed": """WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS division_seq FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        w AS (SELECT *, CASE WHEN division_seq > 3 THEN CAST(row_number() OVER (PARTITION BY n_regionkey, division_seq > 3 ORDER BY s_acctbal DESC, s_suppkey) AS INT) END AS wildcard_seq FROM s),
        p AS (SELECT *, division_seq <= 3 OR coalesce(wildcard_seq <= 2, false) AS playoff, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS overall FROM w)
        SELECT s_suppkey, division_seq, wildcard_seq, playoff, overall, CASE WHEN NOT playoff THEN CAST(row_number() OVER (PARTITION BY playoff ORDER BY s_acctbal, s_suppkey DESC) AS INT) END AS lottery_slot FROM p""",
    "lottery_assignment": f"""WITH {_SPANS}, {_TEAMS}, r AS (SELECT unnest(range(1, 15)) AS x),
        f AS (SELECT a.x AS a, b.x AS b, c.x AS c, d.x AS d, row_number() OVER (ORDER BY a.x, b.x, c.x, d.x) - 1 AS idx FROM r a JOIN r b ON a.x < b.x JOIN r c ON b.x < c.x JOIN r d ON c.x < d.x),
        held AS (SELECT standing, CAST(min(idx) AS INT) AS first, CAST(max(idx) AS INT) AS last, count(*) AS n, arg_min(concat_ws('-', a, b, c, d), idx) AS first_combo FROM f JOIN spans ON idx >= first AND idx < stop WHERE a <> 11 GROUP BY 1)
        SELECT region, team, standing, first, last, n, first_combo FROM teams JOIN held USING (standing)""",
    "lottery_exact_probabilities": f"""WITH {_SPANS}, {_TEAMS}, c AS (SELECT standing, stop - first AS c FROM spans),
        j AS (SELECT a.standing AS s1, b.standing AS s2, a.c / 930.0::DOUBLE * b.c / (955 - a.c) AS p FROM c a JOIN c b ON a.standing <> b.standing WHERE a.standing <= 11 AND b.standing <= 12)
        SELECT region, team, standing, round(coalesce((SELECT sum(p) FROM j WHERE s1 = standing), 0), 6) AS p_first, round(coalesce((SELECT sum(p) FROM j WHERE s2 = standing), 0), 6) AS p_second FROM teams""",
    "lottery_monte_carlo": f"""WITH {_SPANS}, {_TEAMS}, s AS (SELECT region, unnest(range(0, 2000)) AS sim FROM (SELECT DISTINCT region FROM teams)), d1 AS (SELECT region, sim, floor({_U.format(k="concat_ws('|', 42, region, sim, 1)")} * 930) AS x FROM s),
        w1 AS (SELECT region, sim, standing AS w1, first, stop - first AS c FROM d1 JOIN spans ON x >= first AND x < stop),
        d2 AS (SELECT region, sim, w1, first, c, floor({_U.format(k="concat_ws('|', 42, region, sim, 2)")} * (955 - c)) AS x FROM w1),
        w2 AS (SELECT region, sim, w1, standing AS w2 FROM d2 JOIN spans s ON CASE WHEN x >= d2.first THEN x + c ELSE x END >= s.first AND CASE WHEN x >= d2.first THEN x + c ELSE x END < s.stop),
        f AS (SELECT region, standing, CASE WHEN standing = w1 THEN 1 WHEN standing = w2 THEN 2 ELSE standing + 2 - CAST(w1 < standing AS INT) - CAST(w2 < standing AS INT) END AS slot FROM w2, odds)
        SELECT region, team, CAST(slot AS INT) AS slot, count(*) AS n FROM f JOIN teams USING (region, standing) GROUP BY 1, 2, 3""",
    "blend_scores": f"WITH {_WINDOW} SELECT * FROM b",
    "blend_and_gap": f"""WITH {_WINDOW}, l AS (SELECT league, list_sort(list(blend), 'DESC') AS best, count(*) AS n FROM b GROUP BY 1), g AS (SELECT league, n, coalesce(best[1] - best[2], 0) AS gap FROM l)
        SELECT league, n, round(gap, 6) AS gap, round(CASE WHEN n <= 1 THEN 0.0025 ELSE 0.25 * greatest(0.01, pow(1 - least(greatest(gap, 0), 1), 2)) END, 6) AS temperature FROM g""",
    "softmax_sample": f"""WITH {_WINDOW}, v AS (SELECT league, id, round(blend / 0.25 - ln(-ln({_U.format(k="concat_ws('|', 42, league, id)")} + 0.5 / 4294967296.0)), 9) AS v FROM b)
        SELECT league, arg_max(id, {{'v': v, 'i': -id}}) AS id FROM v GROUP BY 1""",
    "greedy_draft_fold": f"WITH RECURSIVE {_POOL}, {_fold('g', ORDER)} SELECT * FROM g",
    "counterfactual_divergence": f"WITH RECURSIVE {_POOL}, {_fold('g', ORDER)}, {_fold('h', SWAPPED)} SELECT g.league, g.pick, g.team, g.id AS baseline_id, h.id AS other_id FROM g JOIN h USING (league, pick) WHERE g.id <> h.id",
    "draft_facts": f"""WITH RECURSIVE {_POOL}, {_fold('g', ORDER)}, p AS (SELECT g.league, pick, g.id, rank, position FROM g JOIN pool USING (id)), s AS (SELECT league, position, round(count(*) / 32.0::DOUBLE, 6) AS position_share FROM p GROUP BY 1, 2)
        SELECT league, pick, id, pick - rank AS deviation, CASE WHEN pick - rank >= 10 THEN 'surplus' WHEN pick - rank <= -10 THEN 'reach' ELSE 'fair' END AS value, position_share FROM p JOIN s USING (league, position)""",
}
