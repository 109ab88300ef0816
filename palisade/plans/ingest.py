"""Queries of ingestion, agent tools, texts and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import ingest, lottery, profiles, retrieval, simulate, tools
from ..operators.relational import first_per_key, last_per_key, number_rows, page, replace_keys, upsert
from ..sources.shared import scratch
from ..sources.star import LINE_PICKS, PROSPECTS, line_picks, prospects, table
from ..streaming import streams
from .drafts import _POOL, _fold, _pool
from .drafts import ORDER as DRAFT_ORDER
from .profiles import _profile_sql
from .retrieval import _COS, _TOK


# -- sources and upserts


def teams_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams from a feed of JSON entries over those there are: keys stay, the rest is replaced."""
    n = table(spark, sf_dir, "nation")
    feed = n.where("n_nationkey >= 10").select(F.to_json(F.struct(
        F.struct(F.concat(F.lit("T"), "n_nationkey").alias("default")).alias("teamAbbrev"), (F.col("n_nationkey") + 1000).alias("teamId"),
        F.struct(F.col("n_name").alias("default")).alias("teamName"), F.concat(F.lit("DIV"), F.col("n_regionkey")).alias("divisionName"),
    )).alias("entry"))
    incoming = feed.select(
        X.localized(F.col("entry"), "teamAbbrev").alias("abbreviation"), F.get_json_object("entry", "$.teamId").cast("bigint").alias("nhl_id"),
        X.localized(F.col("entry"), "teamName").alias("full_name"), F.get_json_object("entry", "$.divisionName").alias("division"),
    )
    current = n.where("n_nationkey < 18").select(F.concat(F.lit("T"), "n_nationkey").alias("abbreviation"), F.col("n_nationkey").cast("bigint").alias("nhl_id"), F.lit("old").alias("full_name"), F.lit(None).cast("string").alias("division"))
    return upsert(current, incoming, ["abbreviation"], {"nhl_id": "keep"})


def players_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field policies: attributes keep the first value, names are replaced, production is replaced where there is a new one."""
    c = table(spark, sf_dir, "customer").withColumn("even", F.col("c_custkey") % 2 == 0)
    current = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("old "), "c_name").alias("name"), F.when(F.col("even"), F.col("c_nationkey")).alias("nation"), F.lit(1.0).alias("ppg"))
    incoming = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).alias("nation"), F.when(~F.col("even"), F.col("c_acctbal") / 1000).alias("ppg"))
    out = upsert(current, incoming, ["id"], {"name": "replace", "nation": "keep", "ppg": "replace_if_not_null"})
    return out.withColumn("ppg", F.round("ppg", 6))


def class_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of JSON records seeded into an empty table, into a full one, and into a full one by force; rows and ranks of each."""
    part = table(spark, sf_dir, "part")
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("draft_league"), F.col("p_size").alias("css_ranking"), F.col("p_partkey").alias("key")))
    schema = "name string, draft_league string, css_ranking int, key bigint, position string"
    new = part.select(F.from_json(record, schema).alias("r")).select("r.*").withColumn("position", F.coalesce("position", F.lit("F")))
    old = part.where("p_partkey < 7").select(F.col("p_name").alias("name"), "p_brand", (F.col("p_size") + 1000).alias("css_ranking"), F.col("p_partkey").alias("key"), F.lit("G").alias("position")).withColumnRenamed("p_brand", "draft_league")
    out = None
    for mode, existing, force in (("empty", old.where("false"), False), ("full", old, False), ("forced", old, True)):
        got = ingest.seeded(existing, new, force).agg(F.count("*").alias("n"), F.sum("css_ranking").alias("ranks"), F.max("position").alias("position")).withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return out


def class_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospects from records of picks: names, units, production, age from days, list from position and country; nameless ones go."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    code = F.get(F.array(*map(F.lit, ("CAN", "USA", "SWE", "FIN"))), (k % 4).cast("int"))
    raw = c.select("c_custkey", F.when(k % 11 != 0, F.col("c_mktsegment")).alias("first"), F.when(k % 11 != 0, F.concat(F.lit("N"), k.cast("string"))).alias("last"), (k % 80).alias("inches"), (k % 250).alias("pounds"),
                   F.when(k % 3 != 0, k % 40).alias("goals"), (k % 50).alias("assists"), (k % 60).alias("games"), F.when(k % 5 == 0, "G").when(k % 5 == 1, "D").alias("position"), code.alias("country"), F.when(k % 7 != 0, k % 900 + 6300).alias("days"))
    name = F.trim(F.concat_ws(" ", "first", "last"))
    position = F.coalesce("position", F.lit("F"))
    return raw.select("c_custkey", name.alias("name"), position.alias("position"), X.inches_to_cm(F.col("inches")).alias("height_cm"), X.pounds_to_kg(F.col("pounds")).alias("weight_kg"),
                      X.points_per_game(F.col("goals"), F.col("assists"), F.col("games")).alias("ppg"), F.round(F.col("days") / 365.25, 2).alias("age"), X.list_category(position, F.col("country")).alias("category")).where("name <> ''")


def stat_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production of picks that lack it, from the season of the draft or the latest before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 100).alias("player"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderkey") % 4 != 0, F.round(F.col("o_totalprice") / 100000, 2)).alias("ppg"), F.when(F.col("o_orderkey") % 4 != 0, F.lit(50).cast("bigint")).alias("games"))
    o = o.unionByName(o.where("id % 40 = 0"))  # a feed that repeats some rows
    e = F.col("event_id") % 11 + 1992
    seasons = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("player"), (e * 10000 + e + 1).alias("season")).agg(F.count("*").alias("games"), F.sum(F.col("event_id") % 7).alias("points"))
    return ingest.fill_missing(o, seasons, "player", "year", "ppg", "games").select("id", "year", "player", "ppg", "games")


def history_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks from a feed with repeats: units, tier, age; the first of each year and pick stays unless it is there already."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw = o.select((F.year("o_orderdate")).alias("year"), (F.col("o_custkey") % 200).alias("overall_pick"), k.alias("seq"), (k % 80).alias("inches"), F.when(k % 3 == 0, "OHL").when(k % 3 == 1, "Allsvenskan").alias("league"))
    new = first_per_key(raw, ["year", "overall_pick"], [F.col("seq")])
    there = o.where("o_orderkey % 10 = 0").select(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 200).alias("overall_pick")).distinct()
    tier, region = X.league_tier(F.col("league"))
    return new.join(there, ["year", "overall_pick"], "left_anti").select("year", "overall_pick", "seq", X.inches_to_cm(F.col("inches")).alias("height_cm"), tier.alias("tier"), region.alias("region"))


def first_seen_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders of four lists, each player from the first list that has them."""
    e = table(spark, sf_dir, "events")
    parts = []
    for kind, n in (("purchase", 200), ("click", 75), ("view", 75), ("error", 50)):
        top = e.where(F.col("event_type") == kind).orderBy(F.desc("value"), "event_id").limit(n)
        parts.append(top.select("user_id", F.lit(kind).alias("category"), "event_id", "value"))
    return ingest.first_seen(parts, "user_id", [F.desc("value"), F.col("event_id")]).select("user_id", "category", "event_id")


def draft_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players that picks name but the table lacks, by id or else by name; then the class of each, set only where it is missing."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("P"), (F.col("c_custkey") % 120).cast("string"))
    existing = c.where("c_custkey % 4 = 0").select(F.when(F.col("c_custkey") % 8 == 0, F.col("c_custkey")).alias("ext_id"), name.alias("name"), F.when(F.col("c_custkey") % 16 == 0, F.lit(1)).alias("class_id"))
    incoming = c.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("ext_id"), name.alias("name"), F.lit(None).cast("int").alias("class_id"))
    by_id = lambda e, n: F.col("n.ext_id") == F.col("e.ext_id")
    by_name = lambda e, n: F.col("n.ext_id").isNull() & (F.col("n.name") == F.col("e.name"))
    rows = ingest.insert_missing(existing, incoming, [(["ext_id"], by_id), (["name"], by_name)])
    classes = c.select(name.alias("name")).distinct().withColumn("class_id", (F.substring("name", 2, 9).cast("int") % 5))
    out = ingest.set_where_null(rows, classes, ["name"], "class_id")
    return out.groupBy("name", "class_id").agg(F.count("*").alias("n"), F.count("ext_id").alias("n_ids"))


def jsonl_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest records of a log of JSON lines, some of them broken."""
    c = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 17 == 3, F.format_string('{"seq": %d, "auc": 1.0} trailing', "c_custkey")).when(F.col("c_custkey") % 17 == 4, F.lit("")).when(F.col("c_custkey") % 17 == 5, F.format_string('{"seq": %d, "auc": "x"}', "c_custkey"))
    line = line.otherwise(F.to_json(F.struct(F.col("c_custkey").alias("seq"), (F.col("c_acctbal") / 10000).alias("auc"))))
    path = scratch(spark, "history")
    c.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("auc", T.DoubleType())])
    return ingest.read_lines(spark, path, schema, 20, "seq").select("seq", F.round("auc", 6).alias("auc"))


def conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after all but the last six turns of each session gave way to one summary."""
    log = table(spark, sf_dir, "conversations")
    summaries = streams.overflow(log, "conv_id", "turn", "text")
    folded = ingest.fold_log(log, "conv_id", "turn", "text", summaries, streams.KEEP_TURNS)
    return folded.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max(F.when(F.col("role") == "system", F.length("text"))).alias("summary_length"))


def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("prospects_loaded"))
    teams = table(spark, sf_dir, "nation").agg(F.count("*").alias("teams_loaded"))
    return parts.crossJoin(teams).select("*", F.when((F.col("prospects_loaded") > 0) & (F.col("teams_loaded") > 0), "ok").otherwise("degraded").alias("status"))


# -- managers and tools


def _managers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("abbreviation"), F.col("n_name").alias("full_name"))
    managers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("team_id"), (F.col("s_suppkey") % 3 != 0).alias("is_active"))
    p = profiles.shrunk_profile(line_picks(spark, sf_dir))
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("dimension") == d, F.struct("category", "weight")))).alias(d) for d in profiles.DIMENSIONS]
    wide = p.groupBy(F.col("gm").alias("gm_id")).agg(*maps).withColumn("computed_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("gm_id") % 28).cast("int")))
    return teams, managers, wide


_TOPS = (("position", 4, "top_positions"), ("league", 4, "top_leagues"), ("nationality", 3, "top_nationalities"))


def _shown(k: int, column: str):
    return F.array_join(F.transform(X.top_entries(F.col(column), k), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ", ")


def gm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every team with its active manager's newest profile and the entries that weigh most."""
    got = tools.gm_profile(*_managers(spark, sf_dir))
    return got.select("team_id", "abbreviation", "gm_id", "gm_name", *[_shown(k, d).alias(n) for d, k, n in _TOPS])


def team_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team that a name or an abbreviation means, and its manager."""
    teams, managers, profiles_ = _managers(spark, sf_dir)
    found = tools.find_teams(teams, "t7").unionByName(tools.find_teams(teams, "ION_1")).dropDuplicates(["id"])
    return tools.gm_profile(found, managers, profiles_).select("team_id", "full_name", "gm_id")


def gm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tools.gm_profile(*_managers(spark, sf_dir)).where("gm_id IS NOT NULL")
    text = X.profile_document(F.col("gm_name"), F.col("full_name"), F.lit(None).cast("string"), F.col("position"), F.col("league"), F.col("nationality"))
    return got.select("team_id", text.alias("document"))


def career_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of each manager over all stints of one name, beside those of the stint alone."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gm"), (F.col("s_suppkey") % 37).alias("name"))
    own = line_picks(spark, sf_dir).groupBy("gm").agg(F.count("*").alias("k"))
    per_name = s.join(own, "gm", "left").groupBy("name").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_career"), F.count("*").alias("stints"))
    return s.join(own, "gm", "left").join(per_name, "name").select("gm", "stints", "n_career", F.coalesce("k", F.lit(0)).alias("n_own"))


def archetype_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managers whose name holds a key of the known styles, and whether the rules agree."""
    from .profiles import archetype_rules

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gm"), F.col("s_name").alias("name"))
    truth = spark.createDataFrame([("0001", "BPA"), ("0007", "euro-scout")], "key string, archetype string")
    return profiles.archetype_matches(archetype_rules(spark, sf_dir).join(s, "gm"), truth)


def unweighted_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by plain counts, as the training set's prior takes them; a missing position counts as F."""
    p = line_picks(spark, sf_dir).withColumn("position", F.coalesce(F.when(F.col("gm") % 5 != 0, F.col("position")), F.lit("F")))
    return profiles.population_prior(p, F.lit(1.0)).select("dimension", "category", F.round("share", 6).alias("share"))


def prospect_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ranked prospect of a name with its ten latest statistics."""
    p = prospects(spark, sf_dir).where(F.col("name").ilike("%wid%")).orderBy(F.col("css_ranking").asc_nulls_last(), "id").limit(1)
    e = table(spark, sf_dir, "events").join(F.broadcast(p.select("id")), F.col("user_id") == F.col("id") % 15)
    stats = last_per_key(e, ["id"], [F.desc("ts"), F.desc("event_id")], 10).select("id", "place", "event_id", "event_type", F.round("value", 4).alias("value"))
    return p.select("id", "name", "position", "league", "css_ranking").join(stats, "id", "left")


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by vector and text for every vector whose id is divisible by 20 (``query``); by text alone where there is no vector (-1); by keyword where the text finds nothing (-2)."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = e.where("vec_id % 20 = 0")
    near = retrieval.cosine_topk(asked, e, 15).select("query_id", F.col("id").alias("key"), F.col("place").alias("rank"))

    def by_text(query: str) -> DataFrame:
        found = retrieval.fulltext_rank(d, "doc_id", "text", retrieval.query_terms(query), 15)
        return retrieval.ranked(found, [F.desc("score"), F.asc("doc_id")])

    text = by_text("the that of")
    both = asked.select(F.col("vec_id").alias("query_id")).crossJoin(F.broadcast(text.select(F.col("doc_id").alias("key"), "rank")))  # at most 15 rows
    hybrid = retrieval.reciprocal_fusion_by([near, both], "query_id", "key", 5)
    out = hybrid.select(F.col("query_id").alias("query"), F.lit("hybrid_rrf").alias("method"), "key", "score")
    out = out.unionByName(retrieval.first_that_finds([("text", text.select(F.col("doc_id").alias("key"), "score").limit(5))], -1))
    keyword = retrieval.keyword_hits(d, "doc_id", "text", "tion", 5)
    return out.unionByName(retrieval.first_that_finds([("text", by_text("zzzznothing").select(F.col("doc_id").alias("key"), "score").limit(5)), ("keyword", keyword)], -2)).select("query", "method", "key", F.round("score", 6).alias("score"))


def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the documents of the 200 best ranked prospects were put in place of theirs."""
    p = prospects(spark, sf_dir).where("css_ranking <= 200").select(F.lit("prospect").alias("doc_type"), F.col("id").alias("ref_id"), F.col("name").alias("content"))
    old = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.when(F.col("p_partkey") % 2 == 0, "prospect").otherwise("nhl_player").alias("doc_type"), F.col("p_partkey").alias("ref_id"), F.lit("old").alias("content"))
    return replace_keys(old, p, ["doc_type", "ref_id"])


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.evidence(F.col("text")).alias("evidence"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    q = F.concat(F.lit(" Find a "), F.col("c_mktsegment"), F.lit("-type D-man! "), F.col("c_name"), F.lit("  now "))
    return c.select("c_custkey", F.array_join(X.query_terms(q), " & ").alias("query"))


def pro_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    code = F.get(F.array(*map(F.lit, ("L", "R", "C", "D", "G"))), (k % 6).cast("int"))
    position = F.when(code.isin("C", "D", "G"), code).otherwise(X.position_code(code))
    games, goals, assists, pm = (k % 83).cast("int"), (k % 41).cast("int"), (k % 67).cast("int"), (k % 50 - 25).cast("int")
    ppg = F.when(games > 0, F.round((goals + assists) / games, 2)).otherwise(0.0)
    rows = c.select("c_custkey", "c_name", position.alias("position"), games.alias("gp"), goals.alias("g"), assists.alias("a"), pm.alias("pm"), ppg.alias("ppg"), F.when(k % 4 != 0, F.col("c_mktsegment")).otherwise("").alias("team"))
    style = X.pro_style(F.col("position"), F.col("ppg"), F.col("g"), F.col("a"), F.col("pm"))
    text = X.pro_document(F.col("c_name"), F.col("position"), F.col("team"), F.lit("CAN"), F.col("gp"), F.col("g"), F.col("a"), F.col("ppg"), F.col("pm"), style)
    return rows.select("c_custkey", style.alias("style"), text.alias("document"))


# -- lottery and drafts


def standings_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams with the odds of their slot; nulls outside the lottery."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = lottery.standings(s, "n_nationkey", "n_regionkey", "s_acctbal", "s_suppkey")
    odds = F.broadcast(lottery.odds_table(spark).withColumnRenamed("standing", "lottery_slot"))
    return out.select("s_suppkey", "lottery_slot").join(odds, "lottery_slot", "left").select("s_suppkey", "lottery_slot", "odds")


def custom_lottery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams that a user gives: those in the lottery by slot or for want of the playoffs, standing by slot where missing, odds 0 where missing."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select("s_suppkey", F.when(k % 3 == 0, k % 16 + 1).alias("slot"), F.when(k % 5 != 0, k % 2 == 0).alias("in_playoffs"), F.when(k % 4 == 1, k % 16 + 1).alias("standing"), F.when(k % 7 != 0, F.col("s_acctbal") / 1000).alias("odds"))
    return lottery.custom_teams(rows).select("s_suppkey", "standing", F.round("odds", 6).alias("odds"))


def multi_round_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds of each region's order, the worst team first: pick, round, place in the round."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    order = number_rows(s, ["n_regionkey"], F.floor(F.col("s_acctbal") / 10), [F.col("s_acctbal"), F.col("s_suppkey")], "place").select(F.col("n_regionkey").alias("region"), "place", F.col("s_suppkey").alias("team"))
    out = lottery.round_order(order, 4, ["region"])
    in_round = (F.col("pick") - 1) % F.col("n") + 1
    return out.select("region", "pick", "round", "team", (F.floor((F.col("pick") - 1) / F.col("n")) + 1).cast("int").alias("round_of_pick"), in_round.alias("pick_in_round"), X.strategy_band(F.col("pick")).alias("band"))


def draft_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three candidates that a team valued most at its pick but for the chosen, with the length of their bar on the board."""
    pool = _pool(spark, sf_dir)
    return simulate.alternatives(pool, simulate.draft(pool, ["league"], DRAFT_ORDER), 3, ["league"])


def linear_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear rank norm, beside the square-root one that the model learns from."""
    p = prospects(spark, sf_dir)
    n = p.agg(F.count("css_ranking").alias("n"))
    norm = lambda f: F.round(f(F.col("css_ranking"), F.col("n")), 6)
    return p.where("css_ranking IS NOT NULL").crossJoin(F.broadcast(n)).select("id", norm(X.linear_rank_norm).alias("linear"), norm(X.sqrt_rank_norm).alias("root"))


def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prospects(spark, sf_dir)
    score = F.round(F.col("size") / 50, 6)
    return p.select("id", score.alias("score"), X.confidence_label(score, F.when(F.col("id") % 9 != 0, F.col("id") % 4 != 0)).alias("label"))


# -- listings


def prospects_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the prospects of other leagues, missing ranks as 9999."""
    other = ~F.col("league").rlike("Brand#1|Brand#2")
    rows = prospects(spark, sf_dir).where(other).select("id", "league", F.coalesce("css_ranking", F.lit(9999)).alias("rank"))
    return page(rows, [F.asc("rank"), F.asc("id")], offset=10, size=25)


def standings_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each team in the three orders of the table: odds, division by conference, points."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    conference = F.when(F.col("n_regionkey") == 1, 0).when(F.col("n_regionkey") == 0, 1).otherwise(2)
    rows = s.select("s_suppkey", conference.alias("conf"), F.col("n_name").alias("division"), F.col("s_acctbal").alias("points"), (F.col("s_suppkey") % 16).cast("int").alias("odds"))
    points = F.floor(F.col("points") / 10)
    rows = number_rows(rows, [], F.struct(-F.col("odds")), [F.desc("points"), F.col("s_suppkey")], "by_odds")
    rows = number_rows(rows, [], F.struct("conf", "division"), [F.desc("points"), F.col("s_suppkey")], "by_division")
    return number_rows(rows, [], points, [F.col("points"), F.col("s_suppkey")], "by_points").select("s_suppkey", "by_odds", "by_division", "by_points")


def board_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of each league's draft by round of eight, in order, with the best value of each."""
    pool = _pool(spark, sf_dir)
    picks = simulate.draft(pool, ["league"], DRAFT_ORDER).join(pool.select("id", "base"), "id")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pick", "id"))), lambda x: x["id"].cast("string"))
    return picks.groupBy("league", X.round_of(F.col("pick"), 8).alias("round")).agg(F.array_join(rows, ",").alias("ids"), F.max("base").alias("best"))


def attribution_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six largest contributions of each pick as bars: percent of the largest, and the sign."""
    from .evaluation import linear_attribution

    c = linear_attribution(spark, sf_dir).where("place <= 6")
    most = F.greatest(F.max(F.abs("contribution")).over(W.partitionBy("id")), F.lit(0.000001))
    return c.select("id", "feature", F.round(100 * F.abs("contribution") / most, 4).alias("pct"), (F.col("contribution") > 0).alias("positive"))


def version_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest versions of a store, newest first."""
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("models/model_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"))
    return o.select(key.alias("version"), F.col("o_totalprice").alias("size")).orderBy(F.desc("version")).limit(10)


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of past runs, the newest first, at most 100, with errors cut at 500 characters."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = e.select("event_id", F.left(F.repeat(F.col("props"), F.lit(100)), F.lit(500)).alias("error"))
    return rows.orderBy(F.desc("event_id")).limit(100)


QUERIES = {f.__name__: f for f in (
    teams_upsert, players_upsert, class_seeds, class_records, stat_backfill, history_records, first_seen_players, draft_backfill, jsonl_history, conversation_fold,
    health_snapshot, gm_profile, team_lookup, gm_documents, career_portability, archetype_truth, unweighted_prior, prospect_detail,
    semantic_search, index_replace, evidence_lines, query_terms, pro_documents, standings_enrichment, custom_lottery, multi_round_order,
    draft_alternatives, linear_rank, confidence_labels, prospects_table, standings_sorts, board_by_round, attribution_bars, version_listing, run_history,
)}

_TOP = "array_to_string(list_transform(list(category || '=' || printf('%.6f', weight) ORDER BY weight DESC, category)[1:{k}], lambda x: x), ', ')"
_GM = f"""{_profile_sql('true')}, act AS (SELECT n_nationkey AS team_id, s_suppkey AS gm_id, s_name AS gm_name, n_name AS full_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey % 28 DESC, s_suppkey) AS k
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 <> 0), tm AS (SELECT * FROM act WHERE k = 1)"""
_TOPS_SQL = ", ".join(f"(SELECT {_TOP.format(k=k)} FROM profile p WHERE p.gm = gm_id AND dimension = '{d}') AS {n}" for d, k, n in _TOPS)
_PCT = "(SELECT array_to_string(list(category || '(' || printf('%.0f%%', weight * 100) || ')' ORDER BY weight DESC, category)[1:{k}], ', ') FROM profile p WHERE p.gm = gm_id AND dimension = '{d}')"
_STANDINGS = """s AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS division_seq FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        w AS (SELECT *, CASE WHEN division_seq > 3 THEN row_number() OVER (PARTITION BY n_regionkey, division_seq > 3 ORDER BY s_acctbal DESC, s_suppkey) END AS wildcard_seq FROM s),
        p AS (SELECT *, division_seq <= 3 OR coalesce(wildcard_seq <= 2, false) AS playoff FROM w),
        st AS (SELECT s_suppkey, CASE WHEN NOT playoff THEN CAST(row_number() OVER (PARTITION BY playoff ORDER BY s_acctbal, s_suppkey DESC) AS INT) END AS lottery_slot FROM p)"""
_EVIDENCE = "array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], lambda x: trim(x)), ' | ')[1:500]"

SQL = {
    "teams_upsert": """WITH c AS (SELECT 'T' || n_nationkey AS abbreviation, n_nationkey::BIGINT AS nhl_id, 'old' AS full_name FROM nation WHERE n_nationkey < 18),
        i AS (SELECT 'T' || n_nationkey AS abbreviation, n_nationkey::BIGINT + 1000 AS nhl_id, n_name AS full_name, 'DIV' || n_regionkey AS division FROM nation WHERE n_nationkey >= 10)
        SELECT coalesce(i.abbreviation, c.abbreviation) AS abbreviation, coalesce(c.nhl_id, i.nhl_id) AS nhl_id, coalesce(i.full_name, c.full_name) AS full_name, division FROM c FULL JOIN i USING (abbreviation)""",
    "players_upsert": """WITH c AS (SELECT c_custkey AS id, 'old ' || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nation, 1.0::DOUBLE AS ppg FROM customer WHERE c_custkey % 3 <> 0),
        n AS (SELECT c_custkey AS id, c_name AS name, c_nationkey + 100 AS nation, CASE WHEN c_custkey % 2 <> 0 THEN c_acctbal / 1000 END AS ppg FROM customer WHERE c_custkey % 5 <> 0)
        SELECT coalesce(n.id, c.id) AS id, coalesce(n.name, c.name) AS name, coalesce(c.nation, n.nation) AS nation, round(coalesce(n.ppg, c.ppg), 6) AS ppg FROM c FULL JOIN n ON c.id = n.id""",
    "class_seeds": """SELECT 'empty' AS mode, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS ranks, 'F' AS position FROM part UNION ALL SELECT 'full', count(*), CAST(sum(p_size + 1000) AS BIGINT), 'G' FROM part WHERE p_partkey < 7
        UNION ALL SELECT 'forced', count(*), CAST(sum(p_size) AS BIGINT), 'F' FROM part""",
    "class_records": """WITH r AS (SELECT *, c_custkey % 80 AS inches, c_custkey % 250 AS pounds, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 END, 0) + c_custkey % 50 AS points, c_custkey % 60 AS games,
          CASE c_custkey % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'D' ELSE 'F' END AS position, c_custkey % 4 < 2 AS home FROM customer WHERE c_custkey % 11 <> 0)
        SELECT c_custkey, c_mktsegment || ' N' || c_custkey AS name, position, CASE WHEN inches > 0 THEN CAST(round_even(inches * 2.54::DOUBLE, 0) AS INT) END AS height_cm, CASE WHEN pounds > 0 THEN CAST(round_even(pounds * 0.453592::DOUBLE, 0) AS INT) END AS weight_kg,
          CASE WHEN games > 0 THEN round((points / games::DOUBLE)::DECIMAL(18, 12), 2)::DOUBLE END AS ppg, CASE WHEN c_custkey % 7 <> 0 THEN round((c_custkey % 900 + 6300) / 365.25::DOUBLE, 2) END AS age,
          CASE WHEN position = 'G' THEN CASE WHEN home THEN 'na_goalie' ELSE 'eur_goalie' END WHEN home THEN 'na_skater' ELSE 'eur_skater' END AS category FROM r""",
    "stat_backfill": """WITH s AS (SELECT user_id AS player, (event_id % 11 + 1992) * 10000 + event_id % 11 + 1993 AS season, count(*) AS games, sum(event_id % 7) AS points FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
        f AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 100 END AS player, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 4 <> 0 THEN round((o_totalprice / 100000)::DECIMAL(18, 12), 2)::DOUBLE END AS own FROM orders),
        o AS (SELECT *, row_number() OVER () AS rid FROM (SELECT * FROM f UNION ALL SELECT * FROM f WHERE id % 40 = 0)),
        j AS (SELECT o.*, season, games, points, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN season = (year - 1) * 10000 + year THEN 0 ELSE 1 END, season DESC NULLS LAST) AS k FROM o LEFT JOIN s ON s.player = o.player AND season % 10000 <= year)
        SELECT id, year, player, CASE WHEN own IS NOT NULL THEN own WHEN player IS NULL THEN NULL WHEN season IS NULL THEN 0.0 WHEN games > 0 THEN round((points / games::DOUBLE)::DECIMAL(18, 12), 2)::DOUBLE END AS ppg,
          CASE WHEN own IS NOT NULL THEN 50 WHEN player IS NOT NULL THEN coalesce(games, 0) END AS games FROM j WHERE k = 1""",
    "first_seen_players": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, list_position(['purchase', 'click', 'view', 'error'], event_type) AS pr FROM events WHERE event_type <> 'signup'),
        t AS (SELECT * FROM l WHERE k <= ([200, 75, 75, 50])[pr]), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pr, value DESC, event_id) AS q FROM t) SELECT user_id, event_type AS category, event_id FROM f WHERE q = 1""",
    "draft_backfill": """WITH e AS (SELECT CASE WHEN c_custkey % 8 = 0 THEN c_custkey END AS ext_id, 'P' || c_custkey % 120 AS name, CASE WHEN c_custkey % 16 = 0 THEN 1 END AS class_id FROM customer WHERE c_custkey % 4 = 0),
        i AS (SELECT DISTINCT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS ext_id, 'P' || c_custkey % 120 AS name FROM customer),
        n AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE i.ext_id = e.ext_id OR (i.ext_id IS NULL AND i.name = e.name))), u AS (SELECT * FROM e UNION ALL SELECT ext_id, name, NULL FROM n)
        SELECT name, CAST(coalesce(class_id, CAST(substr(name, 2) AS INT) % 5) AS INT) AS class_id, count(*) AS n, count(ext_id) AS n_ids FROM u GROUP BY 1, 2""",
    "jsonl_history": "SELECT c_custkey AS seq, round(c_acctbal / 10000, 6) AS auc FROM customer WHERE c_custkey % 17 NOT IN (3, 4, 5) ORDER BY c_custkey DESC LIMIT 20",
    "conversation_fold": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), l AS (SELECT conv_id, count(*) AS n, min(turn) AS t, max(CASE WHEN role = 'system' THEN length(text) END) AS own FROM b WHERE back <= 6 GROUP BY 1),
        o AS (SELECT conv_id, length(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS k FROM b WHERE back > 6 GROUP BY 1)
        SELECT conv_id, n + CAST(k IS NOT NULL AS BIGINT) AS n, CASE WHEN k IS NULL THEN t ELSE -1 END AS first_turn, CAST(greatest(k, own) AS INT) AS summary_length FROM l LEFT JOIN o USING (conv_id)""",
    "health_snapshot": "SELECT (SELECT count(*) FROM part) AS prospects_loaded, (SELECT count(*) FROM nation) AS teams_loaded, 'ok' AS status",
    "gm_profile": f"WITH {_GM} SELECT team_id, 'T' || team_id AS abbreviation, gm_id, gm_name, {_TOPS_SQL} FROM tm",
    "team_lookup": f"WITH {_GM} SELECT team_id, full_name, gm_id FROM tm WHERE full_name ILIKE '%ION!_1%' ESCAPE '!' OR team_id = 7 OR full_name ILIKE '%t7%'",
    "gm_documents": f"""WITH {_GM} SELECT team_id, concat_ws(chr(10), 'GM: ' || gm_name || ' | Team: ' || full_name, 'Archetype: unknown', 'Top positions drafted: ' || {_PCT.format(k=3, d='position')},
        'Preferred leagues: ' || {_PCT.format(k=3, d='league')}, 'Nationality tendencies: ' || {_PCT.format(k=2, d='nationality')}) AS document FROM tm WHERE gm_id IS NOT NULL""",
    "career_portability": """WITH k AS (SELECT s_suppkey AS gm, s_suppkey % 37 AS name, count(l_suppkey) AS n_own FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
        SELECT gm, count(*) OVER (PARTITION BY name) AS stints, CAST(sum(n_own) OVER (PARTITION BY name) AS BIGINT) AS n_career, n_own FROM k""",
    "archetype_truth": f"""WITH {_profile_sql('true')}, c AS (SELECT gm, count(*) AS total FROM lines GROUP BY 1), v AS (SELECT gm, round(sum(CASE WHEN dimension = 'nationality' AND category IN ('EUROPE', 'MIDDLE EAST') THEN weight ELSE 0 END), 6) AS eur_share,
          round(list_sum(list_sort(list(weight) FILTER (dimension = 'position'), 'DESC')[1:2]), 6) AS top2 FROM profile GROUP BY gm),
        a AS (SELECT s_name AS name, CASE WHEN total < 15 THEN 'BPA' WHEN top2 > 0.65 THEN 'need-based' WHEN eur_share < 0.20 THEN 'safe' WHEN eur_share > 0.47 THEN 'euro-scout' WHEN top2 < 0.55 AND eur_share > 0.30 THEN 'analytics' ELSE 'BPA' END AS archetype
          FROM v JOIN c USING (gm) JOIN supplier ON s_suppkey = gm), t AS (SELECT unnest(['0001', '0007']) AS key, unnest(['BPA', 'euro-scout']) AS expected)
        SELECT name, archetype, expected, archetype = expected AS agrees FROM a JOIN t ON contains(lower(name), key)""",
    "unweighted_prior": f"""WITH {LINE_PICKS}, l AS (SELECT unnest(['position', 'league', 'nationality']) AS dimension, unnest([CASE WHEN gm % 5 <> 0 THEN position ELSE 'F' END, league, nationality]) AS category FROM lines)
        SELECT dimension, category, round(count(*) / sum(count(*)) OVER (PARTITION BY dimension)::DOUBLE, 6) AS share FROM l GROUP BY 1, 2""",
    "prospect_detail": f"""WITH {PROSPECTS}, p AS (SELECT * FROM prospects WHERE name ILIKE '%wid%' ORDER BY css_ranking NULLS LAST, id LIMIT 1),
        e AS (SELECT p.id, CAST(row_number() OVER (PARTITION BY p.id ORDER BY ts DESC, event_id DESC) AS INT) AS place, event_id, event_type, round(value, 4) AS value FROM events JOIN p ON user_id = p.id % 15)
        SELECT p.id, name, position, league, css_ranking, place, event_id, event_type, value FROM p LEFT JOIN e ON e.id = p.id AND place <= 10""",
    "semantic_search": f"""WITH {_TOK}, cn AS (SELECT doc_id, len(w) AS length, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf_{i}" for i, t in enumerate(('the', 'that', 'of')))} FROM t),
        x AS (SELECT doc_id, round((tf_0 + tf_1 + tf_2) / (1 + ln(length::DOUBLE)), 6) AS score FROM cn WHERE tf_0 > 0 AND tf_1 > 0 AND tf_2 > 0), y AS (SELECT doc_id AS key, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x),
        v AS (SELECT a.vec_id AS query, b.vec_id AS key, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        u AS (SELECT query, key, rank FROM v WHERE rank <= 15 UNION ALL SELECT vec_id, key, rank FROM y, embeddings WHERE rank <= 15 AND vec_id % 20 = 0), f AS (SELECT query, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2),
        g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM f)
        SELECT query, 'hybrid_rrf' AS method, key, round(score, 6) AS score FROM g WHERE place <= 5 UNION ALL SELECT -1, 'text', key, round(score, 6) FROM y WHERE rank <= 5
        UNION ALL SELECT -2, 'keyword', doc_id, 1.0 FROM (SELECT doc_id FROM documents WHERE text ILIKE '%tion%' ORDER BY doc_id LIMIT 5)""",
    "index_replace": f"""WITH {PROSPECTS}, n AS (SELECT 'prospect' AS doc_type, id AS ref_id, name AS content FROM prospects WHERE css_ranking <= 200),
        o AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'prospect' ELSE 'nhl_player' END AS doc_type, p_partkey AS ref_id, 'old' AS content FROM part WHERE p_partkey % 3 = 0)
        SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (doc_type, ref_id)""",
    "evidence_lines": f"SELECT doc_id, {_EVIDENCE} AS evidence FROM documents",
    "query_terms": r"""SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(lower(trim(' Find a ' || c_mktsegment || '-type D-man! ' || c_name || '  now ')), '\s+'), lambda x: regexp_full_match(x, '[a-z0-9-]+')), ' & ') AS query FROM customer""",
    "pro_documents": """WITH r AS (SELECT c_custkey, c_name, coalesce((['LW', 'RW', 'C', 'D', 'G'])[c_custkey % 6 + 1], 'F') AS p, c_custkey % 83 AS gp, c_custkey % 41 AS g, c_custkey % 67 AS a, c_custkey % 50 - 25 AS pm, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE '' END AS team FROM customer),
        q AS (SELECT *, CASE WHEN gp > 0 THEN round(((g + a) / gp::DOUBLE)::DECIMAL(18, 12), 2)::DOUBLE ELSE 0.0 END AS r, a / nullif(g + a, 0)::DOUBLE AS sa, g / nullif(g + a, 0)::DOUBLE AS sg FROM r),
        s AS (SELECT *, CASE WHEN p = 'G' THEN 'NHL goaltender' ELSE concat_ws(', ', CASE WHEN p = 'D' THEN CASE WHEN r >= 0.80 THEN 'elite offensive defenseman' WHEN r >= 0.55 THEN 'offensive defenseman' WHEN r >= 0.35 THEN 'two-way defenseman' ELSE 'defensive defenseman' END
            WHEN r >= 1.20 THEN 'elite scorer' WHEN r >= 0.85 THEN 'top-six scorer' WHEN r >= 0.55 THEN 'middle-six forward' ELSE 'bottom-six forward' END,
          CASE WHEN p = 'D' THEN CASE WHEN sa >= 0.70 THEN 'playmaking from the blue line' WHEN sa <= 0.35 THEN 'goal-scoring defenseman' END WHEN sg >= 0.48 THEN 'goal scorer' WHEN sg <= 0.28 THEN 'pure playmaker' WHEN sg IS NOT NULL THEN 'two-way producer' END,
          CASE WHEN pm >= 20 THEN 'positive possession driver' WHEN pm <= -15 THEN 'negative differential player' END) END AS style FROM q)
        SELECT c_custkey, style, concat_ws(chr(10), 'NHL Player: ' || c_name, 'Position: ' || p || CASE WHEN team <> '' THEN ' | Team: ' || team ELSE '' END || ' | Nationality: CAN',
          CASE WHEN gp > 0 THEN printf('Season: %d GP, %dG, %dA, %dP (%.2f PPG), %+d +/-', gp, g, a, g + a, r, pm) END, 'Style: ' || style) AS document FROM s""",
    "standings_enrichment": f"WITH {_STANDINGS}, o AS (SELECT unnest(range(1, 17)) AS lottery_slot, unnest({list(lottery.ODDS)})::DOUBLE AS odds) SELECT s_suppkey, st.lottery_slot, odds FROM st LEFT JOIN o ON o.lottery_slot = st.lottery_slot",
    "custom_lottery": """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 16 + 1 END AS slot, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 END AS po, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 16 + 1 END AS st, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 1000 END AS odds FROM supplier)
        SELECT s_suppkey, coalesce(st, slot) AS standing, round(coalesce(odds, 0), 6) AS odds FROM r WHERE (slot IS NOT NULL OR po = false) AND coalesce(st, slot) IS NOT NULL""",
    "multi_round_order": """WITH o AS (SELECT n_regionkey AS region, s_suppkey AS team, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal, s_suppkey) AS place, count(*) OVER (PARTITION BY n_regionkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        p AS (SELECT region, team, place + (r - 1) * n AS pick, r AS round, n FROM o, (SELECT unnest(range(1, 5)) AS r))
        SELECT region, pick, CAST(round AS INT) AS round, team, CAST((pick - 1) // n + 1 AS INT) AS round_of_pick, (pick - 1) % n + 1 AS pick_in_round,
        CASE WHEN pick <= 5 THEN 'top five' WHEN pick <= 15 THEN 'lottery' WHEN pick <= 32 THEN 'late first round' WHEN pick <= 64 THEN 'second round' WHEN pick <= 96 THEN 'third round' ELSE 'late round' END AS band FROM p""",
    "draft_alternatives": f"""WITH RECURSIVE {_POOL}, {_fold('g', DRAFT_ORDER)}, o AS (SELECT g.league, g.pick, p.id, p.id = g.id AS chosen, round(base + CASE WHEN need = g.team % 6 THEN 0.15 ELSE 0 END, 6) AS value, p.rank FROM g JOIN pool p ON p.league = g.league LEFT JOIN g t ON t.id = p.id WHERE t.pick IS NULL OR t.pick >= g.pick),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY league, pick, chosen ORDER BY value DESC, rank) AS INT) AS place, max(value) OVER (PARTITION BY league, pick) AS top FROM o) SELECT league, pick, place, id, value, round(value / greatest(top, 0.001), 6) AS bar FROM r WHERE NOT chosen AND place <= 3""",
    "linear_rank": f"""WITH {PROSPECTS}, n AS (SELECT count(css_ranking) AS n FROM prospects) SELECT id, round(greatest(0.0, 1.0 - (css_ranking - 1) / n::DOUBLE), 6) AS linear, round(greatest(0.0, 1.0 - sqrt((css_ranking - 1) / n::DOUBLE)), 6) AS root
        FROM prospects, n WHERE css_ranking IS NOT NULL""",
    "history_records": """WITH r AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_custkey % 200 AS overall_pick, o_orderkey AS seq, row_number() OVER (PARTITION BY year(o_orderdate), o_custkey % 200 ORDER BY o_orderkey) AS k FROM orders),
        t AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, o_custkey % 200 AS overall_pick FROM orders WHERE o_orderkey % 10 = 0)
        SELECT year, overall_pick, seq, CASE WHEN seq % 80 > 0 THEN CAST(round_even((seq % 80) * 2.54::DOUBLE, 0) AS INT) END AS height_cm, CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS tier, CASE seq % 3 WHEN 0 THEN 'CAN' WHEN 1 THEN 'EUR' END AS region
        FROM r ANTI JOIN t USING (year, overall_pick) WHERE k = 1""",
    "confidence_labels": f"WITH {PROSPECTS} SELECT id, round(size / 50.0::DOUBLE, 6) AS score, CASE WHEN id % 9 = 0 OR id % 4 = 0 THEN 'volatile' WHEN round(size / 50.0::DOUBLE, 6) >= 0.9 THEN 'high' ELSE 'in range' END AS label FROM prospects",
    "prospects_table": f"WITH {PROSPECTS}, o AS (SELECT id, league, coalesce(css_ranking, 9999) AS rank FROM prospects WHERE NOT regexp_matches(league, 'Brand#1|Brand#2')) SELECT *, (SELECT count(*) FROM o) AS total FROM o ORDER BY rank, id LIMIT 25 OFFSET 10",
    "standings_sorts": """WITH s AS (SELECT s_suppkey, CASE n_regionkey WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS conf, n_name AS division, s_acctbal AS points, s_suppkey % 16 AS odds FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT s_suppkey, CAST(row_number() OVER (ORDER BY odds DESC, points DESC, s_suppkey) AS INT) AS by_odds, CAST(row_number() OVER (ORDER BY conf, division, points DESC, s_suppkey) AS INT) AS by_division, CAST(row_number() OVER (ORDER BY points, s_suppkey) AS INT) AS by_points FROM s""",
    "board_by_round": f"WITH RECURSIVE {_POOL}, {_fold('g', DRAFT_ORDER)} SELECT g.league, CAST((pick - 1) // 8 + 1 AS INT) AS round, string_agg(CAST(g.id AS VARCHAR), ',' ORDER BY pick) AS ids, max(base) AS best FROM g JOIN pool USING (id) GROUP BY 1, 2",
    "version_listing": "SELECT 'models/model_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey AS version, o_totalprice AS size FROM orders ORDER BY version DESC LIMIT 10",
    "run_history": "SELECT event_id, left(repeat(props, 100), 500) AS error FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100",
}


def _bars_sql() -> str:
    from .evaluation import SQL as EVALUATION

    return f"WITH c AS ({EVALUATION['linear_attribution']}) SELECT id, feature, round(100 * abs(contribution) / greatest(max(abs(contribution)) OVER (PARTITION BY id), 0.000001), 4) AS pct, contribution > 0 AS positive FROM c WHERE place <= 6"


SQL["attribution_bars"] = _bars_sql()
