"""Queries of evaluation and monitoring, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, features, monitor
from ..sources.shared import written
from ..sources.star import ORDER_PICKS, line_picks, order_picks, table
from .profiles import _QUALITY

BLEND, LAST_ROUND = 0.6, 4


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features.ordinal_quality(order_picks(spark, sf_dir), ["year"]).where(F.col("round") <= LAST_ROUND)
    p = evaluate.with_candidates(p, ["year"], 31, ["quality", "ppg"])
    model = lambda q, g: F.round(BLEND * q + (1 - BLEND) * g / 5, 6)
    return p.withColumns(
        {
            "rank": evaluate.rank_of_actual(model(F.col("quality"), F.col("ppg")), lambda c: model(c["quality"], c["ppg"])),
            "css": evaluate.rank_of_actual(F.col("quality"), lambda c: c["quality"]),
            "prod": evaluate.rank_of_actual(F.col("ppg"), lambda c: c["ppg"]),
            "pool": F.size("candidates"),
        }
    )


def topk_mrr_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.breakdown(_ranked(spark, sf_dir).withColumn("round", F.col("round").cast("string")), "rank", ["round", "league"])


def baseline_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    model = r.agg(*evaluate.hit_metrics(F.col("rank")))
    rows = [("consensus", evaluate.hit_metrics(F.col("css"))), ("production", evaluate.hit_metrics(F.col("prod"))), ("random", evaluate.random_baseline(F.col("pool")))]
    out = None
    for name, metrics in rows:
        part = r.agg(*metrics).withColumn("baseline", F.lit(name))
        out = part if out is None else out.unionByName(part)
    m = F.broadcast(model.select(*[F.col(c).alias(f"m_{c}") for c in ("top1", "top3", "top5", "mrr")]))
    return out.crossJoin(m).select("baseline", *[c for c in ("top1", "top3", "top5", "mrr")], *[F.round(F.col(f"m_{c}") - F.col(c), 6).alias(f"lift_{c}") for c in ("top1", "top3", "top5", "mrr")])


def cross_year_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _ranked(spark, sf_dir).groupBy("year").agg(*evaluate.hit_metrics(F.col("rank")))
    long = years.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("top1", "top3", "mrr")])))
    r = lambda f: F.round(f("v"), 6)
    return long.groupBy("metric").agg(r(F.avg).alias("mean"), r(F.stddev_pop).alias("std"), r(F.min).alias("low"), r(F.max).alias("high"), F.count("*").alias("n"))


def blend_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of eleven blends of rank and production; the first by top-1 is the best. A pick's candidates are taken apart once and counted for all blends."""
    p = features.ordinal_quality(order_picks(spark, sf_dir), ["year"]).where(F.col("round") <= LAST_ROUND)
    p = evaluate.with_candidates(p, ["year"], 31, ["quality", "ppg"])
    rows = p.select("id", "quality", "ppg", F.explode("candidates").alias("c"))
    shares = [i / 10 for i in range(11)]
    score = lambda w, q, g: F.round(w * q + (1 - w) * g / 5, 6)
    ahead = [F.count_if(score(w, F.col("c.quality"), F.col("c.ppg")) > score(w, F.col("quality"), F.col("ppg"))).alias(f"n{i}") for i, w in enumerate(shares)]
    ranks = rows.groupBy("id").agg(*ahead)
    each = F.array(*[F.struct(F.lit(w).alias("w"), (F.col(f"n{i}") + 1).alias("rank")) for i, w in enumerate(shares)])
    return ranks.select(F.inline(each)).groupBy("w").agg(*evaluate.hit_metrics(F.col("rank")))


def _scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per slot of rounds 1 to 4 and candidate: the blended score, and whether the candidate was the pick. Written once, as its readers take it more than once."""
    p = features.ordinal_quality(order_picks(spark, sf_dir), ["year"]).where(F.col("round") <= LAST_ROUND)
    p = evaluate.with_candidates(p, ["year"], 31, ["id", "quality", "ppg", "css_rank", "league"])
    rows = p.select(F.col("id").alias("slot"), "year", F.inline("candidates"))
    score = F.round(BLEND * F.col("quality") + (1 - BLEND) * F.col("ppg") / 5, 6)
    return written(rows.select("slot", "year", "id", "css_rank", "league", score.alias("score"), (F.col("id") == F.col("slot")).cast("int").alias("was_picked")), "scored-candidates")


def ndcg_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_hit_rate(_scored_candidates(spark, sf_dir), "slot", "was_picked", "score", "id")


def conformal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.conformal_quantiles(_scored_candidates(spark, sf_dir), "slot", "was_picked", "score")


def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_candidates(spark, sf_dir)
    return evaluate.conformal_sets(rows, "slot", "score", evaluate.conformal_quantiles(rows, "slot", "was_picked", "score"), 0.10).select("slot", "id", "nc", "in_set")


def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features.ordinal_quality(order_picks(spark, sf_dir), ["year"]).where(F.col("round") <= LAST_ROUND).select("id", "quality", "ppg", F.col("overall_pick").cast("double").alias("slot"))
    means = p.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("quality", "ppg", "slot")])
    return evaluate.linear_attribution(p, "id", {"quality": 1.5, "ppg": 0.4, "slot": -0.001}, means, top=2)


LATE = "year >= 1999"


def js_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.categorical_drift(order_picks(spark, sf_dir), F.expr(LATE), ["position", "league", "nationality"])


def js_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.numeric_drift(order_picks(spark, sf_dir), F.expr(LATE), ["ppg", "css_rank"])


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five dimensions and the worst of their states."""
    both = js_categorical(spark, sf_dir).unionByName(js_numeric(spark, sf_dir))
    severity = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = both.agg(F.max(severity).alias("_w"))
    overall = F.when(F.col("_w") == 2, "fail").when(F.col("_w") == 1, "warn").otherwise("pass")
    return both.crossJoin(F.broadcast(worst)).select("dimension", "js", "status", overall.alias("overall"))


def rank_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = line_picks(spark, sf_dir).groupBy("league").agg(F.count_if(F.expr("year = 1995")).alias("before"), F.count_if(F.expr("year = 1998")).alias("after"))
    return monitor.rank_drift(p, "league", "before", "after")


def dq_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.count("*")
    null_rate = F.avg(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0))
    base = monitor.report(o, [
        monitor.check("row_count", n, failed=n < 150, warned=n > 400), monitor.check("status_null_rate", null_rate, warned=null_rate > 0.20),
        monitor.check("recent_rows", F.count_if(F.expr("year(o_orderdate) = 2001")), warned=F.count_if(F.expr("year(o_orderdate) = 2001")) < 200),
    ])
    return base.unionByName(monitor.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_lines"))


def dq_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.training_checks(_scored_candidates(spark, sf_dir), "year", "was_picked", ["css_rank", "league"])


def dq_model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = line_picks(spark, sf_dir).groupBy(F.col("position").alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    return monitor.model_gate(shares, 0.1361)


def dq_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.passed(dq_ingestion(spark, sf_dir).unionByName(dq_training(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    topk_mrr_breakdown, baseline_lift, cross_year_summary, blend_sweep, ndcg_at_1, conformal_quantiles, conformal_sets, linear_attribution,
    js_categorical, js_numeric, drift_report, rank_drift, dq_ingestion, dq_training, dq_model_gate, dq_rollup,
)}

_PAIRS = f"""{ORDER_PICKS}, {_QUALITY}, e AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY overall_pick) AS s FROM quality WHERE round <= 4),
  pr AS (SELECT a.id, a.year, a.round, a.league, a.quality, a.ppg, b.id AS cid, b.css_rank AS c_css, b.league AS c_league, b.quality AS cq, b.ppg AS cg, round(0.6 * a.quality + 0.4 * a.ppg / 5, 6) AS m, round(0.6 * b.quality + 0.4 * b.ppg / 5, 6) AS cm
    FROM e a JOIN e b ON a.year = b.year AND b.s BETWEEN a.s AND a.s + 31),
  ranked AS (SELECT id, year, round, league, 1 + count(*) FILTER (cm > m) AS rank, 1 + count(*) FILTER (cq > quality) AS css, 1 + count(*) FILTER (cg > ppg) AS prod, count(*) AS pool FROM pr GROUP BY 1, 2, 3, 4)"""
_HITS = "count(*) AS n, round(avg(CAST({r} <= 1 AS DOUBLE)), 6) AS top1, round(avg(CAST({r} <= 3 AS DOUBLE)), 6) AS top3, round(avg(CAST({r} <= 5 AS DOUBLE)), 6) AS top5, round(avg(1.0::DOUBLE / {r}), 6) AS mrr"
_H = _HITS.format(r="rank")
_SCORED = f"{_PAIRS}, sd AS (SELECT id AS slot, cid AS id, cm AS score, CAST(cid = id AS INT) AS was_picked FROM pr)"
_SHARES = f"{_SCORED}, sh AS (SELECT *, exp(score - max(score) OVER (PARTITION BY slot)) / sum(exp(score)) OVER (PARTITION BY slot) * exp(max(score) OVER (PARTITION BY slot)) AS share FROM sd)"
_CONF = f"""{_SHARES}, nc AS (SELECT slot, 1 - max(share) AS nc FROM sh WHERE was_picked = 1 GROUP BY 1), pl AS (SELECT nc, row_number() OVER (ORDER BY nc) AS place FROM nc),
  st AS (SELECT count(*) AS n, round(avg(nc), 6) AS nc_mean, round(stddev_pop(nc), 6) AS nc_std FROM pl), al AS (SELECT unnest([0.10, 0.15, 0.20])::DOUBLE AS alpha),
  cq AS (SELECT alpha, round(nc, 6) AS threshold, n, nc_mean, nc_std FROM st, al JOIN pl ON place = greatest(1, least((SELECT n FROM st), ceil(round(((SELECT n FROM st) + 1) * (1 - alpha), 9)))))"""
_JS = "round(sum((p * ln((p + 1e-10) / ((p + q) / 2 + 1e-10)) + q * ln((q + 1e-10) / ((p + q) / 2 + 1e-10))) / 2), 6)"
_STATUS = "CASE WHEN js >= 0.30 THEN 'fail' WHEN js >= 0.10 THEN 'warn' ELSE 'pass' END"
_METRICS = ("top1", "top3", "top5", "mrr")
_DQ_IN = """SELECT 'row_count' AS "check", count(*)::DOUBLE AS value, CASE WHEN count(*) < 150 THEN 'FAIL' WHEN count(*) > 400 THEN 'WARN' ELSE 'PASS' END AS status FROM orders
  UNION ALL SELECT 'status_null_rate', round(avg(CAST(o_orderstatus = 'P' AS DOUBLE)), 4), CASE WHEN avg(CAST(o_orderstatus = 'P' AS DOUBLE)) > 0.20 THEN 'WARN' ELSE 'PASS' END FROM orders
  UNION ALL SELECT 'recent_rows', count(*) FILTER (year(o_orderdate) = 2001)::DOUBLE, CASE WHEN count(*) FILTER (year(o_orderdate) = 2001) < 200 THEN 'WARN' ELSE 'PASS' END FROM orders
  UNION ALL SELECT 'duplicate_lines', count(*)::DOUBLE, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"""
_DQ_TR = """SELECT 'training_row_count' AS "check", count(*)::DOUBLE AS value, CASE WHEN count(*) < 3000 THEN 'FAIL' ELSE 'PASS' END AS status FROM t
  UNION ALL SELECT 'positive_rate', round(avg(wp), 4), CASE WHEN avg(wp) NOT BETWEEN 0.02 AND 0.12 THEN 'WARN' ELSE 'PASS' END FROM t
  UNION ALL SELECT 'year_coverage', count(DISTINCT year)::DOUBLE, CASE WHEN count(DISTINCT year) < 10 THEN 'WARN' ELSE 'PASS' END FROM t
  UNION ALL SELECT 'null_rate_css_rank', round(avg(CAST(css_rank IS NULL AS DOUBLE)), 4), CASE WHEN avg(CAST(css_rank IS NULL AS DOUBLE)) > 0.5 THEN 'WARN' ELSE 'PASS' END FROM t
  UNION ALL SELECT 'null_rate_league', 0.0, 'PASS'
  UNION ALL SELECT 'per_year_positive_rate', count(*)::DOUBLE, CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END FROM (SELECT avg(wp) AS r FROM t GROUP BY year) WHERE r NOT BETWEEN 0.01 AND 0.20"""
_T = f"{_PAIRS}, t AS (SELECT year, c_css AS css_rank, c_league AS league, CAST(cid = id AS INT) AS wp FROM pr)"

SQL = {
    "topk_mrr_breakdown": f"""WITH {_PAIRS} SELECT 'all' AS dimension, '' AS value, {_H} FROM ranked
        UNION ALL SELECT 'round', CAST(round AS VARCHAR), {_H} FROM ranked GROUP BY 2 UNION ALL SELECT 'league', league, {_H} FROM ranked GROUP BY 2""",
    "baseline_lift": f"""WITH {_PAIRS}, m AS (SELECT {_H} FROM ranked), b AS (SELECT 'consensus' AS baseline, {_HITS.format(r='css')} FROM ranked UNION ALL SELECT 'production', {_HITS.format(r='prod')} FROM ranked
          UNION ALL SELECT 'random', count(*), round(avg(1.0::DOUBLE / pool), 6), round(avg(least(3, pool) / pool::DOUBLE), 6), round(avg(least(5, pool) / pool::DOUBLE), 6),
            round(avg(list_sum(list_transform(range(1, pool + 1), lambda i: 1.0::DOUBLE / i)) / pool), 6) FROM ranked)
        SELECT baseline, {', '.join(f'b.{c}' for c in _METRICS)}, {', '.join(f'round(m.{c} - b.{c}, 6) AS lift_{c}' for c in _METRICS)} FROM b, m""",
    "cross_year_summary": f"""WITH {_PAIRS}, y AS (SELECT year, {_H} FROM ranked GROUP BY 1), l AS (SELECT 'top1' AS metric, top1 AS v FROM y UNION ALL SELECT 'top3', top3 FROM y UNION ALL SELECT 'mrr', mrr FROM y)
        SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS n FROM l GROUP BY 1""",
    "blend_sweep": f"""WITH {_PAIRS}, w AS (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS w),
        r AS (SELECT w, id, 1 + count(*) FILTER (round(w * cq + (1 - w) * cg / 5, 6) > round(w * quality + (1 - w) * ppg / 5, 6)) AS rank FROM pr, w GROUP BY 1, 2)
        SELECT w, {_H} FROM r GROUP BY 1""",
    "ndcg_at_1": f"WITH {_SCORED} SELECT slot, count(*) AS n, arg_max(was_picked, {{'s': score, 'd': id}}) AS hit FROM sd GROUP BY 1 HAVING max(was_picked) = 1",
    "conformal_quantiles": f"WITH {_CONF} SELECT * FROM cq",
    "conformal_sets": f"WITH {_CONF} SELECT slot, id, round(1 - share, 6) AS nc, round(1 - share, 6) <= (SELECT threshold FROM cq WHERE alpha = 0.10) AS in_set FROM sh",
    "linear_attribution": f"""WITH {ORDER_PICKS}, {_QUALITY}, p AS (SELECT id, quality, ppg, overall_pick::DOUBLE AS slot FROM quality WHERE round <= 4), m AS (SELECT avg(quality) AS mq, avg(ppg) AS mg, avg(slot) AS ms FROM p),
        c AS (SELECT id, 'quality' AS feature, round(1.5 * (quality - mq), 6) AS contribution FROM p, m UNION ALL SELECT id, 'ppg', round(0.4 * (ppg - mg), 6) FROM p, m UNION ALL SELECT id, 'slot', round(-0.001 * (slot - ms), 6) FROM p, m),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS INT) AS place FROM c) SELECT * FROM r WHERE place <= 2""",
    "js_categorical": f"""WITH {ORDER_PICKS}, l AS (SELECT year >= 1999 AS late, unnest(['position', 'league', 'nationality']) AS dimension, unnest([position, league, nationality]) AS category FROM picks),
        c AS (SELECT dimension, category, count(*) FILTER (NOT late) AS b, count(*) FILTER (late) AS a FROM l GROUP BY 1, 2), s AS (SELECT dimension, b / sum(b) OVER (PARTITION BY dimension) AS p, a / sum(a) OVER (PARTITION BY dimension) AS q FROM c),
        j AS (SELECT dimension, {_JS} AS js FROM s GROUP BY 1) SELECT dimension, js, {_STATUS} AS status FROM j""",
    "js_numeric": f"""WITH {ORDER_PICKS}, l AS (SELECT year >= 1999 AS late, 'ppg' AS dimension, ppg::DOUBLE AS v FROM picks UNION ALL SELECT year >= 1999, 'css_rank', css_rank::DOUBLE FROM picks WHERE css_rank IS NOT NULL),
        e AS (SELECT dimension, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1), b AS (SELECT late, dimension, least(floor((v - lo) / (hi - lo) * 5), 4) AS bin FROM l JOIN e USING (dimension)),
        c AS (SELECT dimension, bin, count(*) FILTER (NOT late) AS b, count(*) FILTER (late) AS a FROM b GROUP BY 1, 2), s AS (SELECT dimension, b / sum(b) OVER (PARTITION BY dimension) AS p, a / sum(a) OVER (PARTITION BY dimension) AS q FROM c),
        j AS (SELECT dimension, {_JS} AS js FROM s GROUP BY 1) SELECT dimension, js, {_STATUS} AS status FROM j""",
    "rank_drift": """WITH l AS (SELECT p_brand AS feature, count(*) FILTER (year(l_shipdate) = 1995) AS b, count(*) FILTER (year(l_shipdate) = 1998) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        r AS (SELECT feature, CAST(row_number() OVER (ORDER BY b DESC, feature) AS INT) AS prev_rank, CAST(row_number() OVER (ORDER BY a DESC, feature) AS INT) AS curr_rank FROM l),
        h AS (SELECT round(1 - 6 * sum((prev_rank - curr_rank) ** 2) / (count(*) * (count(*)::DOUBLE * count(*) - 1)), 4) AS rho FROM r)
        SELECT feature, prev_rank, curr_rank, abs(prev_rank - curr_rank) AS rank_shift, rho, rho < 0.7 AS drifted FROM r, h WHERE abs(prev_rank - curr_rank) >= 5""",
    "dq_ingestion": _DQ_IN,
    "dq_training": f"WITH {_T} {_DQ_TR}",
    "dq_model_gate": """WITH s AS (SELECT p_type AS f, count(*)::DOUBLE AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT 'model_metric_gate' AS "check", 0.1361::DOUBLE AS value, 'PASS' AS status UNION ALL SELECT 'feature_dominance', round(max(k) / sum(k), 4), CASE WHEN max(k) / sum(k) > 0.60 THEN 'WARN' ELSE 'PASS' END FROM s""",
    "dq_rollup": f"""WITH {_T}, r AS ({_DQ_TR} UNION ALL {_DQ_IN}) SELECT count(*) FILTER (status = 'FAIL') = 0 AS passed, count(*) AS n_checks, count(*) FILTER (status = 'WARN') AS n_warn, count(*) FILTER (status = 'FAIL') AS n_fail FROM r""",
}
SQL["drift_report"] = f"""WITH d AS (SELECT * FROM ({SQL['js_categorical']}) UNION ALL SELECT * FROM ({SQL['js_numeric']}))
    SELECT *, (SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END FROM d) AS overall FROM d"""
