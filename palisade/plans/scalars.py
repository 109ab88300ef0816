"""Queries of scalar rules, filters, listings and joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import evaluate, tools
from ..operators.relational import first_per_key, interval_join, missing_from, number_rows, page
from ..sources.star import ORDER_PICKS, PROSPECTS, order_picks, prospects, table


def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_shipdate >= '1995-01-01' AND l_shipdate < '1997-01-01' AND l_linenumber <= 4 AND l_quantity > 0")
    return line.select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_extendedprice", "l_quantity"), 8).alias("per_unit"))


def league_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Ontario OHL", "WHL East", "LHJMQ", "NTDP - USHL", "NCAA I", "Sweden-Jr.", "Liiga", "Russia-2", "Extraliga", "Mestis", "AJHL", "BCHL")
    pick = F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % (len(names) + 1)).cast("int"))
    name = F.concat_ws(" / ", pick, "p_brand")
    tier, region = X.league_tier(name)
    return table(spark, sf_dir, "part").select("p_partkey", X.league_key(name).alias("league"), tier.alias("tier"), region.alias("region"))


def nat_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ("CAN", "US", "SWE", "FIN", "RUS", "CZE", "SUI", "DEU", "CA", "USA", "LVA", "NOR", "JPN")
    code = F.get(F.array(*map(F.lit, codes)), (F.col("n_nationkey") % (len(codes) + 1)).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.nationality_group(code).alias("grp"), X.ranking_list(F.when(F.col("n_regionkey") == 0, "G").otherwise("C"), code, F.lit("OHL")).alias("list"), X.list_category(F.lit("G"), code).alias("category"))


def unit_convert_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    birth = F.date_sub(F.to_date("o_orderdate"), (F.col("o_custkey") % 900 + 6500).cast("int"))
    code = X.season_code(year)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.inches_to_cm(F.col("o_custkey") % 80).alias("cm"), X.pounds_to_kg(F.col("o_custkey") % 250).alias("kg"),
        X.age_at_draft(birth, year).alias("age"), code.alias("season"), X.season_end(code).alias("season_end"),
    )


def name_split_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", " "), F.lit(" Jr "))
    return table(spark, sf_dir, "customer").select("c_custkey", X.first_name(name).alias("first"), X.rest_of_name(name).alias("rest"), X.name_key(name).alias("key"))


def localized_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit('{"name": "'), "event_type", F.lit('"}'))
    nested = F.concat(F.lit('{"name": {"default": "'), "event_type", F.lit('", "fr": "x"}}'))
    payload = F.when(F.col("event_id") % 2 == 0, plain).otherwise(nested)
    return table(spark, sf_dir, "events").select("event_id", X.localized(payload, "name").alias("name"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 50 == 0, "x").otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 7 == 0, "Q").otherwise("C").alias("position"), (F.col("c_acctbal") / 1000).alias("points_per_game"),
        (F.col("c_custkey") % 20 + 10).cast("double").alias("age_at_draft"), (F.col("c_custkey") % 2500).cast("int").alias("css_ranking"),
    )
    checked = tools.validate_prospects(c)
    return checked.select("c_custkey", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"l_quantity": (1.0, 45.0), "l_discount": (0.0, 0.05), "l_tax": (0.0, 0.1), "l_extendedprice": (0.0, 100000.0)}
    return tools.range_report(table(spark, sf_dir, "lineitem"), bounds)


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_prospects(prospects(spark, sf_dir), "1", 10).select("id", "name", "league", "css_ranking")


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prospects(spark, sf_dir).select("id", "css_ranking", "league")
    return page(rows, [F.col("css_ranking").asc_nulls_last(), F.col("id")], offset=40, size=20)


def top_prospects_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prospects(spark, sf_dir)
    top = W.partitionBy("position").orderBy(F.col("css_ranking").asc_nulls_last(), "id")
    return p.select("position", "id", "css_ranking", F.row_number().over(top).alias("place")).where("place <= 25")


def compare_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.compare(prospects(spark, sf_dir), 7, 11)


def dim_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return (
        customer.join(nation, (customer.c_nationkey == nation.n_nationkey) & (nation.n_regionkey < 4), "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
        .select("c_custkey", "n_name", F.coalesce("r_name", F.lit("unknown")).alias("region"))
    )


def tenure_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("team"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_custkey")
    picks = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("id", "year", "team", F.make_date("year", F.lit(7), F.lit(1)).alias("day"))
    picks = picks.unionByName(picks.where("id % 50 = 0"))  # a feed that repeats some rows
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"))
    tenures = teams.select(
        "team", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    ).select(
        "team", (F.col("team") * 10 + F.col("k")).alias("gm"), F.make_date(F.col("k") * 3 + 1994 + F.col("team") % 2, F.lit(3), F.lit(1)).alias("start_date"),
        F.when(F.col("k") < 2, F.make_date(F.col("k") * 3 + 1997 + F.col("team") % 2, F.lit(2), F.lit(28))).alias("end_date"),
    )
    return interval_join(picks, tenures, "team", "day", "start_date", "end_date", "gm").select("id", "year", "gm")


def name_rank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lists end to end in a fixed order with a running number; names joined to their last rank."""
    supplier = table(spark, sf_dir, "supplier").select(
        F.lower(F.trim(F.concat(F.lit(" Key "), (F.col("s_suppkey") % 80).cast("string")))).alias("key"), (F.col("s_suppkey") % 4).alias("category"), F.col("s_suppkey").alias("rank"))
    block = F.struct("category", F.floor(F.col("rank") / 4096).alias("range"))
    combined = number_rows(supplier, [], block, [F.col("rank")], "combined")
    last = combined.groupBy("key").agg(F.max("combined").alias("css_rank"))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("key "), (F.col("c_custkey") % 200).cast("string")).alias("key"))
    return people.join(last, "key").select("c_custkey", "css_rank")


def anti_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order early in 1995 under their number or under the one 1000 below."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1995-04-01'").select("o_custkey")
    return missing_from(customer, [(orders, customer.c_custkey == orders.o_custkey), (orders.select((F.col("o_custkey") + 1000).alias("other")), F.col("c_custkey") == F.col("other"))])


def playoff_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    ranked = number_rows(s, [], F.floor(F.col("s_acctbal") / 10), [F.col("s_acctbal"), F.col("s_suppkey")], "place").select("s_suppkey", "place")
    lottery = ranked.where("place <= 16")
    rest = ranked.join(lottery, "s_suppkey", "left_anti")
    return lottery.select("s_suppkey", "place", F.lit(0).alias("segment")).unionByName(rest.select("s_suppkey", "place", F.lit(1).alias("segment")))


def candidate_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pick with the 31 that follow in its year, by windows over blocks: linear in the picks."""
    p = evaluate.with_candidates(order_picks(spark, sf_dir), ["year"], 31, ["overall_pick", "ppg"])
    pairs = p.select("year", "overall_pick", F.posexplode("candidates").alias("k", "c")).where("k > 0")
    return pairs.groupBy("year", "overall_pick").agg(F.count("*").alias("n"), F.max("c.overall_pick").alias("last"), F.round(F.max("c.ppg"), 7).alias("best_ppg"))


def point_in_time_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks a team made in earlier years, as sums over years: no pair of picks is formed."""
    per_year = order_picks(spark, sf_dir).groupBy("team", "year").agg(F.count("*").alias("k"))
    before = W.partitionBy("team").orderBy("year").rangeBetween(W.unboundedPreceding, -1)
    return per_year.select("team", "year", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("n_before"), "k")


def latest_season_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the statistic of the target season, else of the one before, else of the latest."""
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("season"), "event_id", "value")
    order = [F.when(F.col("season") == 20, 0).when(F.col("season") == 19, 1).otherwise(2), F.desc("season"), F.desc("event_id")]
    return first_per_key(e, ["user_id"], order).select("user_id", "season", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (
    scan_filter_project, league_canonicalize, nat_grouping, unit_convert_age, name_split_key, localized_json_extract, record_validation,
    range_violations, keyword_search, paged_listing, top_prospects_by_position, compare_two, dim_left_chain, tenure_interval_join,
    name_rank_join, anti_seed, playoff_anti_join, candidate_window_pairs, point_in_time_history, latest_season_pick,
)}

_NAMES = "['Ontario OHL','WHL East','LHJMQ','NTDP - USHL','NCAA I','Sweden-Jr.','Liiga','Russia-2','Extraliga','Mestis','AJHL','BCHL']"
_CODES = "['CAN','US','SWE','FIN','RUS','CZE','SUI','DEU','CA','USA','LVA','NOR','JPN']"

SQL = {
    "scan_filter_project": """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 8) AS per_unit FROM lineitem
        WHERE year(l_shipdate) IN (1995, 1996) AND l_linenumber <= 4 AND l_quantity > 0""",
    "league_canonicalize": f"""WITH n AS (SELECT p_partkey, concat_ws(' / ', ({_NAMES})[(p_partkey % 13) + 1], p_brand) AS name FROM part)
        SELECT p_partkey,
          CASE WHEN upper(name) LIKE '%OHL%' THEN 'OHL' WHEN upper(name) LIKE '%WHL%' THEN 'WHL' WHEN upper(name) LIKE '%QMJHL%' OR upper(name) LIKE '%LHJMQ%' THEN 'QMJHL'
               WHEN upper(name) LIKE '%NTDP%' THEN 'NTDP' WHEN regexp_matches(upper(name), 'USHL|NCAA|HIGH-|BIG10|H-EAST') THEN 'USHL'
               WHEN regexp_matches(upper(name), 'SHL|SWEDEN|SWEDISH') THEN 'SHL' WHEN regexp_matches(upper(name), 'LIIGA|FINLAND|MESTIS') THEN 'Liiga'
               WHEN regexp_matches(upper(name), 'KHL|RUSSIA|MHL') THEN 'KHL' ELSE 'other' END AS league,
          CASE WHEN regexp_matches(lower(name), 'ohl|whl|qmjhl|ncaa|ushl|shl|liiga|khl|nla|extraliga') THEN 1
               WHEN regexp_matches(lower(name), 'allsvenskan|mestis|ahl|bchl') THEN 2 WHEN regexp_matches(lower(name), 'echl|nahl|ajhl') THEN 3 END AS tier,
          CASE WHEN regexp_matches(lower(name), 'ohl|whl|qmjhl') THEN 'CAN' WHEN regexp_matches(lower(name), 'ncaa|ushl') THEN 'USA'
               WHEN regexp_matches(lower(name), 'shl|liiga|khl|nla|extraliga|allsvenskan|mestis') THEN 'EUR' WHEN lower(name) LIKE '%ahl%' THEN 'USA'
               WHEN lower(name) LIKE '%bchl%' THEN 'CAN' WHEN regexp_matches(lower(name), 'echl|nahl') THEN 'USA' WHEN lower(name) LIKE '%ajhl%' THEN 'CAN' END AS region
        FROM n""",
    "nat_grouping": f"""WITH n AS (SELECT n_nationkey, n_regionkey, ({_CODES})[(n_nationkey % 14) + 1] AS code FROM nation),
        g AS (SELECT *, CASE coalesce(code, '') WHEN 'CA' THEN 'CAN' WHEN 'US' THEN 'USA' WHEN 'SUI' THEN 'CHE' ELSE coalesce(code, '') END AS c FROM n)
        SELECT n_nationkey, CASE WHEN c IN ('CAN', 'USA') THEN c WHEN c IN ('SWE', 'FIN', 'NOR', 'DNK') THEN 'NORDIC'
               WHEN c IN ('RUS', 'CZE', 'SVK', 'UKR', 'BLR', 'LVA') THEN 'SLAVIC' ELSE 'EUR_OTHER' END AS grp,
          CASE WHEN n_regionkey = 0 THEN 'goalie' WHEN coalesce(code, '') IN ('SWE', 'FIN', 'RUS', 'CZE', 'DEU', 'LVA', 'NOR') THEN 'eur_skater' ELSE 'na_skater' END AS list,
          CASE WHEN code IN ('CAN', 'USA') THEN 'na_goalie' ELSE 'eur_goalie' END AS category FROM g""",
    "unit_convert_age": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderdate AS DATE) - CAST(o_custkey % 900 + 6500 AS INT) AS birth FROM orders)
        SELECT o_orderkey, CASE WHEN o_custkey % 80 > 0 THEN CAST(round_even((o_custkey % 80) * 2.54::DOUBLE, 0) AS INT) END AS cm,
          CASE WHEN o_custkey % 250 > 0 THEN CAST(round_even((o_custkey % 250) * 0.453592::DOUBLE, 0) AS INT) END AS kg,
          round((make_date(y, 6, 28) - birth) / 365.25, 2) AS age, (y - 1) * 10000 + y AS season, y AS season_end FROM o""",
    "name_split_key": """WITH c AS (SELECT c_custkey, trim('  ' || replace(c_name, '#', ' ') || ' Jr ') AS name FROM customer)
        SELECT c_custkey, split_part(name, ' ', 1) AS first, CASE WHEN instr(name, ' ') > 0 THEN trim(substr(name, instr(name, ' ') + 1)) ELSE '' END AS rest, lower(name) AS key FROM c""",
    "localized_json_extract": "SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "record_validation": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Q' ELSE 'C' END AS position,
          c_acctbal / 1000 AS ppg, c_custkey % 20 + 10.0 AS age, c_custkey % 2500 AS rank FROM customer),
        e AS (SELECT c_custkey, concat_ws(',', CASE WHEN length(name) NOT BETWEEN 2 AND 100 THEN 'name' END, CASE WHEN position NOT IN ('C', 'LW', 'RW', 'D', 'G', 'F', 'W') THEN 'position' END,
          CASE WHEN ppg NOT BETWEEN 0 AND 10 THEN 'points_per_game' END, CASE WHEN age NOT BETWEEN 14 AND 25 THEN 'age_at_draft' END, CASE WHEN rank NOT BETWEEN 1 AND 2000 THEN 'css_ranking' END) AS errors FROM c)
        SELECT c_custkey, errors, errors = '' AS valid FROM e""",
    "range_violations": "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c}) AS low, max({c}) AS high, count(*) FILTER ({c} < {a} OR {c} > {b}) AS n_outside, coalesce(min({c}) < {a} OR max({c}) > {b}, false) AS flagged FROM lineitem"
        for c, (a, b) in {"l_quantity": (1.0, 45.0), "l_discount": (0.0, 0.05), "l_tax": (0.0, 0.1), "l_extendedprice": (0.0, 100000.0)}.items()
    ),
    "keyword_search": f"WITH {PROSPECTS} SELECT id, name, league, css_ranking FROM prospects WHERE name ILIKE '%1%' OR league ILIKE '%1%' OR position ILIKE '%1%' ORDER BY css_ranking NULLS LAST, id LIMIT 10",
    "paged_listing": f"WITH {PROSPECTS} SELECT id, css_ranking, league, (SELECT count(*) FROM prospects) AS total FROM prospects ORDER BY css_ranking NULLS LAST, id LIMIT 20 OFFSET 40",
    "top_prospects_by_position": f"""WITH {PROSPECTS}, r AS (SELECT position, id, css_ranking, row_number() OVER (PARTITION BY position ORDER BY css_ranking NULLS LAST, id) AS place FROM prospects)
        SELECT * FROM r WHERE place <= 25""",
    "compare_two": f"""WITH {PROSPECTS}, a AS (SELECT * FROM prospects WHERE id = 7), b AS (SELECT * FROM prospects WHERE id = 11), m AS (
          SELECT 'ppg' AS metric, a.ppg AS first, b.ppg AS second, a.ppg > b.ppg AS wins FROM a, b
          UNION ALL SELECT 'css_ranking', a.css_ranking, b.css_ranking, a.css_ranking < b.css_ranking FROM a, b
          UNION ALL SELECT 'size', a.size, b.size, a.size > b.size FROM a, b)
        SELECT metric, CAST(first AS DOUBLE) AS first, CAST(second AS DOUBLE) AS second, CASE WHEN wins THEN 'first' ELSE 'second' END AS edge FROM m""",
    "dim_left_chain": """SELECT c_custkey, n_name, coalesce(r_name, 'unknown') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 4
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "tenure_interval_join": """WITH t AS (SELECT n_nationkey AS team, n_nationkey * 10 + k AS gm, make_date(1994 + 3 * k + n_nationkey % 2, 3, 1) AS s,
          CASE WHEN k < 2 THEN make_date(1997 + 3 * k + n_nationkey % 2, 2, 28) END AS e FROM nation, (VALUES (0), (1), (2)) v(k)),
        p AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, c_nationkey AS team FROM orders JOIN customer ON o_custkey = c_custkey), q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE id % 50 = 0)
        SELECT id, year, (SELECT min(gm) FROM t WHERE q.team = t.team AND make_date(year, 7, 1) >= s AND (e IS NULL OR make_date(year, 7, 1) <= e)) AS gm FROM q""",
    "name_rank_join": """WITH s AS (SELECT 'key ' || CAST(s_suppkey % 80 AS VARCHAR) AS key, row_number() OVER (ORDER BY s_suppkey % 4, s_suppkey) AS combined FROM supplier),
        l AS (SELECT key, max(combined) AS css_rank FROM s GROUP BY key)
        SELECT c_custkey, CAST(css_rank AS INT) AS css_rank FROM customer JOIN l ON key = 'key ' || CAST(c_custkey % 200 AS VARCHAR)""",
    "anti_seed": """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) <= 3 AND (o_custkey = c_custkey OR o_custkey + 1000 = c_custkey))""",
    "playoff_anti_join": """WITH r AS (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS INT) AS place FROM supplier)
        SELECT s_suppkey, place, CASE WHEN place <= 16 THEN 0 ELSE 1 END AS segment FROM r""",
    "candidate_window_pairs": f"""WITH {ORDER_PICKS}, f AS (SELECT * FROM picks)
        SELECT a.year, a.overall_pick, count(*) AS n, max(b.overall_pick) AS last, round(max(b.ppg), 7) AS best_ppg
        FROM f a JOIN f b ON a.year = b.year AND b.overall_pick BETWEEN a.overall_pick + 1 AND a.overall_pick + 31 GROUP BY 1, 2""",
    "point_in_time_history": f"""WITH {ORDER_PICKS}, k AS (SELECT team, year, count(*) AS k FROM picks GROUP BY 1, 2)
        SELECT a.team, a.year, CAST(coalesce((SELECT sum(b.k) FROM k b WHERE b.team = a.team AND b.year < a.year), 0) AS BIGINT) AS n_before, a.k FROM k a""",
    "latest_season_pick": """WITH e AS (SELECT user_id, CAST(day(ts) AS INT) AS season, event_id, value FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE season WHEN 20 THEN 0 WHEN 19 THEN 1 ELSE 2 END, season DESC, event_id DESC) AS k FROM e)
        SELECT user_id, season, round(value, 6) AS value FROM r WHERE k = 1""",
}
