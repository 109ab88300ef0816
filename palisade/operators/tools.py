"""Read-only analytical tools over prospects, picks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a valid record.
VALID_POSITIONS = ("C", "LW", "RW", "D", "G", "F", "W")
BOUNDS = {
    "points_per_game": (0.0, 10.0), "age_at_draft": (14.0, 25.0), "css_ranking": (1, 2000), "height_cm": (150.0, 220.0), "weight_kg": (55.0, 130.0),
}
LENGTHS = {"name": (2, 100), "nationality": (0, 3), "draft_league": (0, 100)}


def validate_prospects(df: DataFrame) -> DataFrame:
    """Adds ``errors``: names of the fields that break a rule; a null name is an error, other nulls are not."""
    tests: list[Column] = []
    have = set(df.columns)
    for name, (low, high) in LENGTHS.items():
        if name in have:
            bad = ~F.length(name).between(low, high)
            tests.append(F.when(F.coalesce(bad, F.lit(name == "name")), F.lit(name)))
    if "position" in have:
        tests.append(F.when(~F.upper("position").isin(*VALID_POSITIONS), F.lit("position")))
    for name, (low, high) in BOUNDS.items():
        if name in have:
            tests.append(F.when(~F.col(name).between(low, high), F.lit(name)))
    return df.withColumn("errors", F.array_compact(F.array(*tests)))


def range_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """feature, low, high, n_outside, flagged: one pass over all features."""
    aggs = []
    for name, (low, high) in bounds.items():
        c = F.col(name)
        aggs.append(F.struct(F.lit(name).alias("feature"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count_if((c < low) | (c > high)).alias("n_outside"), F.coalesce((F.min(c) < low) | (F.max(c) > high), F.lit(False)).alias("flagged")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def search_prospects(df: DataFrame, query: str, limit: int) -> DataFrame:
    """Prospects whose name, league or position holds the query, best ranked first."""
    escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = F.col("name").ilike(f"%{escaped}%") | F.col("league").ilike(f"%{escaped}%") | F.col("position").ilike(f"%{escaped}%")
    return df.where(hit).orderBy(F.col("css_ranking").asc_nulls_last(), "id").limit(limit)


def compare(df: DataFrame, first: int, second: int, metrics: tuple[tuple[str, bool], ...] = (("ppg", True), ("css_ranking", False), ("size", True))) -> DataFrame:
    """metric, first, second, edge of two prospects; ties and nulls go to the second."""
    a, b = df.where(F.col("id") == first).alias("a"), df.where(F.col("id") == second).alias("b")
    rows = []
    for name, high_wins in metrics:
        x, y = F.col(f"a.{name}").cast("double"), F.col(f"b.{name}").cast("double")
        rows.append(F.struct(F.lit(name).alias("metric"), x.alias("first"), y.alias("second"), F.when(x > y if high_wins else x < y, "first").otherwise("second").alias("edge")))
    return a.crossJoin(F.broadcast(b)).select(F.inline(F.array(*rows)))


def find_teams(teams: DataFrame, query: str) -> DataFrame:
    """Teams whose full name holds the query or whose abbreviation is it, in any case, in order of their id."""
    q = query.strip()
    escaped = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return teams.where(F.col("full_name").ilike(f"%{escaped}%") | (F.lower("abbreviation") == q.lower())).orderBy("id")


def gm_profile(teams: DataFrame, managers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every team with an active manager and that one's profile: of several the newest profile, then the smaller id; nulls where there is none."""
    active = managers.where("is_active").select(F.col("id").alias("gm_id"), F.col("name").alias("gm_name"), "team_id")
    own = [c for c in profiles.columns if c != "gm_id"]
    joined = teams.select(F.col("id").alias("team_id"), "abbreviation", "full_name").join(active, "team_id", "left").join(profiles, "gm_id", "left")
    first = F.struct(F.col("computed_at"), -F.col("gm_id"))
    best = joined.groupBy("team_id").agg(F.max_by(F.struct(*[c for c in joined.columns if c != "team_id"]), first).alias("x"))
    return best.select("team_id", "x.abbreviation", "x.full_name", "x.gm_id", "x.gm_name", *[f"x.{c}" for c in own])


def team_needs(drafted: DataFrame, pool: DataFrame, group: str, vocabulary: list[str]) -> DataFrame:
    """Share of picks per position against its share of the pool, for each team.

    ratio is demand over supply (1.5 where only demand exists, 1 where neither); need is
    high from 1.3, low under 0.9.
    """
    spark = drafted.sparkSession
    words = spark.createDataFrame([(x,) for x in vocabulary], "position string")
    share = lambda df, keys: df.groupBy(*keys, "position").agg(F.count("*").alias("k"))
    demand = share(drafted, [group])
    totals = drafted.groupBy(group).agg(F.count("*").alias("all"))
    supply = share(pool, []).crossJoin(F.broadcast(pool.agg(F.count("*").alias("pool_all")))).select("position", (F.col("k") / F.col("pool_all")).alias("supply"))
    grid = totals.crossJoin(F.broadcast(words))
    out = grid.join(demand, [group, "position"], "left").join(F.broadcast(supply), "position", "left")
    d, s = F.coalesce(F.col("k") / F.col("all"), F.lit(0.0)), F.coalesce("supply", F.lit(0.0))
    ratio = F.round(F.when(s > 0, d / s).when(d > 0, 1.5).otherwise(1.0), 6)
    return out.select(group, "position", F.round(d, 6).alias("demand"), F.round(s, 6).alias("supply"), ratio.alias("ratio"), F.when(ratio >= 1.3, "high").when(ratio >= 0.9, "medium").otherwise("low").alias("need"))


def draft_history(picks: DataFrame, since: int = 2022, team: int | None = None, year: int | None = None) -> DataFrame:
    """Picks of a team and year; without a year, of ``since`` and later."""
    rows = picks if team is None else picks.where(F.col("team") == team)
    return rows.where(F.col("year") == year if year is not None else F.col("year") >= since)
