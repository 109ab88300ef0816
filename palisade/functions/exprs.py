"""Scalar rules of the draft domain as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies.
POSITIONS = ("C", "LW", "RW", "D", "G")
NATIONALITY_GROUPS = ("CAN", "USA", "NORDIC", "SLAVIC", "EUR_OTHER")
LEAGUES = ("OHL", "WHL", "QMJHL", "USHL", "NTDP", "SHL", "Liiga", "KHL", "other")
NORDIC = ("SWE", "FIN", "NOR", "DNK")
SLAVIC = ("RUS", "CZE", "SVK", "UKR", "BLR", "LVA")
NATIONALITY_ALIASES = {"CA": "CAN", "US": "USA", "SUI": "CHE"}
# League key -> fragments of the upper-cased name, asked in this order.
LEAGUE_FRAGMENTS = (
    ("OHL", ("OHL",)),
    ("WHL", ("WHL",)),
    ("QMJHL", ("QMJHL", "LHJMQ")),
    ("NTDP", ("NTDP",)),
    ("USHL", ("USHL", "NCAA", "HIGH-", "BIG10", "H-EAST")),
    ("SHL", ("SHL", "SWEDEN", "SWEDISH")),
    ("Liiga", ("LIIGA", "FINLAND", "MESTIS")),
    ("KHL", ("KHL", "RUSSIA", "MHL")),
)
# League fragment -> (tier, region), asked in this order.
LEAGUE_TIERS = (
    ("OHL", 1, "CAN"), ("WHL", 1, "CAN"), ("QMJHL", 1, "CAN"), ("NCAA", 1, "USA"), ("USHL", 1, "USA"), ("SHL", 1, "EUR"),
    ("Liiga", 1, "EUR"), ("KHL", 1, "EUR"), ("NLA", 1, "EUR"), ("Extraliga", 1, "EUR"), ("Allsvenskan", 2, "EUR"),
    ("Mestis", 2, "EUR"), ("AHL", 2, "USA"), ("BCHL", 2, "CAN"), ("ECHL", 3, "USA"), ("NAHL", 3, "USA"), ("AJHL", 3, "CAN"),
)
# Who is on the European list of skaters.
EUROPEAN = ("SWE", "FIN", "RUS", "CZE", "SVK", "CHE", "DEU", "NOR", "DNK", "AUT", "LVA", "UKR", "BLR", "FRA", "SLO", "SVN", "BEL", "GBR")
EUROPEAN_LEAGUES = (
    "SWEDEN", "FINLAND", "RUSSIA", "KHL", "SHL", "LIIGA", "EXTRALIGA", "NLA", "CZECH", "SLOVAK", "NORWAY", "DENMARK", "AUSTRIA",
    "SWISS", "DEL", "MESTIS", "ALLSVENSKAN",
)
ROUND_WEIGHTS = {1: 7, 2: 5, 3: 3}
POOL = 224


def contains_any(text: Column, fragments: Iterable[str]) -> Column:
    out = F.lit(False)
    for x in fragments:
        out = out | text.contains(x)
    return out


def first_match(rules: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first rule that holds."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def league_key(league: Column) -> Column:
    name = F.upper(F.coalesce(league, F.lit("")))
    return first_match(((contains_any(name, parts), F.lit(key)) for key, parts in LEAGUE_FRAGMENTS), F.lit("other"))


def league_tier(league: Column) -> tuple[Column, Column]:
    """(tier, region) of the first fragment found, nulls where none is."""
    name = F.lower(F.coalesce(league, F.lit("")))
    tier = first_match(((name.contains(k.lower()), F.lit(t)) for k, t, _ in LEAGUE_TIERS), F.lit(None).cast("int"))
    region = first_match(((name.contains(k.lower()), F.lit(r)) for k, _, r in LEAGUE_TIERS), F.lit(None).cast("string"))
    return tier, region


def nationality_group(nationality: Column) -> Column:
    code = first_match(((nationality == k, F.lit(v)) for k, v in NATIONALITY_ALIASES.items()), F.coalesce(nationality, F.lit("")))
    return first_match(
        ((code.isin("CAN", "USA"), code), (code.isin(*NORDIC), F.lit("NORDIC")), (code.isin(*SLAVIC), F.lit("SLAVIC"))), F.lit("EUR_OTHER")
    )


def ranking_list(position: Column, nationality: Column, league: Column) -> Column:
    """goalie, eur_skater or na_skater."""
    pos = F.split_part(F.upper(F.coalesce(position, F.lit(""))), F.lit("/"), F.lit(1))
    european = F.upper(F.coalesce(nationality, F.lit(""))).isin(*EUROPEAN) | contains_any(F.upper(F.coalesce(league, F.lit(""))), EUROPEAN_LEAGUES)
    return F.when(pos == "G", "goalie").when(european, "eur_skater").otherwise("na_skater")


def list_category(position: Column, country: Column) -> Column:
    """Ranking category of a prospect of this position from this country."""
    home = country.isin("CAN", "USA")
    return F.when(position == "G", F.when(home, "na_goalie").otherwise("eur_goalie")).otherwise(F.when(home, "na_skater").otherwise("eur_skater"))


def inches_to_cm(x: Column) -> Column:
    return F.when(x > 0, F.bround(x * 2.54).cast("int"))


def pounds_to_kg(x: Column) -> Column:
    return F.when(x > 0, F.bround(x * 0.453592).cast("int"))


def points_per_game(goals: Column, assists: Column, games: Column, digits: int = 2) -> Column:
    points = F.coalesce(goals, F.lit(0)) + F.coalesce(assists, F.lit(0))
    return F.when(games > 0, F.round(points / games, digits))


def age_at_draft(birth: Column, year: Column) -> Column:
    """Years from birth to June 28 of the draft year."""
    return F.round(F.datediff(F.make_date(year, F.lit(6), F.lit(28)), birth) / 365.25, 2)


def season_code(year: Column) -> Column:
    return (year - 1) * 10000 + year


def season_end(code: Column) -> Column:
    return code % 10000


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def first_name(name: Column) -> Column:
    return F.split_part(F.trim(name), F.lit(" "), F.lit(1))


def rest_of_name(name: Column) -> Column:
    at = F.instr(F.trim(name), " ")
    return F.when(at > 0, F.trim(F.substr(F.trim(name), at + 1))).otherwise(F.lit(""))


def localized(payload: Column, path: str) -> Column:
    """A string field, or its ``default`` where the field is an object."""
    return F.coalesce(F.get_json_object(payload, f"$.{path}.default"), F.get_json_object(payload, f"$.{path}"))


def position_code(code: Column) -> Column:
    return F.when(code == "L", "LW").when(code == "R", "RW").otherwise(F.coalesce(code, F.lit("F")))


def primary_position(position: Column) -> Column:
    return F.upper(F.split_part(F.coalesce(position, F.lit("")), F.lit("/"), F.lit(1)))


def one_hot(column: Column, vocabulary: Iterable, prefix: str) -> list[Column]:
    return [F.coalesce((column == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in vocabulary]


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def slot_norm(slot: Column, pool: int = POOL) -> Column:
    return clip(F.lit(1.0) - (slot - 1) / F.lit(float(pool)), 0.0, 1.0)


def sqrt_rank_norm(ordinal: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt((ordinal - 1) / F.greatest(n, F.lit(1))))


def linear_rank_norm(rank: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - (rank - 1) / F.greatest(n, F.lit(1)))


def production_delta(current: Column, previous: Column, norm: Column) -> Column:
    return F.when(previous.isNull(), 0.0).otherwise(clip((F.coalesce(current, F.lit(0.0)) - previous) / F.greatest(norm, F.lit(0.01)), -3.0, 3.0))


def slot_pressure(index_in_round: Column, round_size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - (index_in_round - 1) / F.greatest(round_size - 1, F.lit(1)))


def round_weight(round_number: Column, weights: dict[int, float] | None = None, default: float = 1) -> Column:
    table = ROUND_WEIGHTS if weights is None else weights
    return first_match(((round_number == k, F.lit(float(v))) for k, v in table.items()), F.lit(float(default)))


def sample_weight(year: Column, last_year: Column, round_number: Column, decay: float = 0.92) -> Column:
    bonus = round_weight(round_number, {1: 3.0, 2: 1.0, 3: 0.4, 4: 0.1}, 0.0)
    return F.pow(F.lit(decay), last_year - year) * (bonus + 1.0)


def round_of(pick: Column, teams: int = 32) -> Column:
    return F.ceil(pick / F.lit(teams)).cast("int")


# Bounds and wording of the bands of picks, values, trends and styles; the first bound that a value reaches counts.
PICK_BANDS = ((5, "top five"), (15, "lottery"), (32, "late first round"), (64, "second round"), (96, "third round"))
LAST_BAND = "late round"
VALUE_GAP, SURPLUS, REACH, FAIR = 10, "surplus", "reach", "fair"
TREND_UP = ((0.20, "clear upward development trend"), (0.08, "modest year-over-year improvement"))
TREND_DOWN = ((-0.20, "meaningful production drop from prior season"), (-0.08, "slight production regression"))
TREND_STEADY = "stable production year over year"
PROSPECT_GOALIE, PROSPECT_DEFENSE_REST, PROSPECT_FORWARD_REST = "goaltending prospect", "defensive defenseman", "depth forward"
PROSPECT_DEFENSE = ((0.75, "offensive defenseman"), (0.45, "two-way defenseman"))
PROSPECT_FORWARD = ((1.30, "high-end scoring forward"), (0.95, "top-six scoring forward"), (0.65, "middle-six forward"))
PROSPECT_GOALS, PROSPECT_ASSISTS, PROSPECT_BALANCED = (0.48, "goal-driven production"), (0.28, "playmaking / assist-heavy"), "balanced scorer"
COMPETITION = {1: "elite competition", 2: "strong junior or college competition"}
PRO_GOALIE, PRO_DEFENSE_REST, PRO_FORWARD_REST = "NHL goaltender", "defensive defenseman", "bottom-six forward"
PRO_DEFENSE = ((0.80, "elite offensive defenseman"), (0.55, "offensive defenseman"), (0.35, "two-way defenseman"))
PRO_FORWARD = ((1.20, "elite scorer"), (0.85, "top-six scorer"), (0.55, "middle-six forward"))
PRO_DEFENSE_ASSISTS, PRO_DEFENSE_GOALS = (0.70, "playmaking from the blue line"), (0.35, "goal-scoring defenseman")
PRO_GOALS, PRO_ASSISTS, PRO_BALANCED = (0.48, "goal scorer"), (0.28, "pure playmaker"), "two-way producer"
PLUS, MINUS = (20, "positive possession driver"), (-15, "negative differential player")


def at_least(value: Column, bands, rest: str | None = None) -> Column:
    """The name of the first band whose bound the value reaches from above."""
    return F.coalesce(*[F.when(value >= bound, name) for bound, name in bands], F.lit(rest))


def at_most(value: Column, bands, rest: str | None = None) -> Column:
    return F.coalesce(*[F.when(value <= bound, name) for bound, name in bands], F.lit(rest))


def strategy_band(pick: Column) -> Column:
    return at_most(pick, PICK_BANDS, LAST_BAND)


def value_gap(pick: Column, rank: Column) -> Column:
    gap = pick - rank
    return F.when(gap >= VALUE_GAP, SURPLUS).when(gap <= -VALUE_GAP, REACH).otherwise(FAIR)


def trend(current: Column, previous: Column) -> Column:
    change = current - previous
    return F.coalesce(at_least(change, TREND_UP), at_most(change, TREND_DOWN), F.when(change.isNotNull(), TREND_STEADY))


def prospect_style(position: Column, ppg: Column, goals: Column, assists: Column, tier: Column) -> Column:
    """Comma-separated tags by position, production, share of goals and league tier."""
    rate, share = F.coalesce(ppg, F.lit(0.0)), F.try_divide(goals, goals + assists)
    skater = F.when(position == "D", at_least(rate, PROSPECT_DEFENSE, PROSPECT_DEFENSE_REST)).otherwise(at_least(rate, PROSPECT_FORWARD, PROSPECT_FORWARD_REST))
    role = F.when(position == "G", PROSPECT_GOALIE).otherwise(skater)
    scoring = F.coalesce(at_least(share, [PROSPECT_GOALS]), at_most(share, [PROSPECT_ASSISTS]), F.when(share.isNotNull(), PROSPECT_BALANCED))
    level = F.coalesce(*[F.when(tier == k, name) for k, name in COMPETITION.items()])
    return F.array_join(F.array_compact(F.array(role, scoring, level)), ", ")


def pro_style(position: Column, ppg: Column, goals: Column, assists: Column, plus_minus: Column) -> Column:
    """Tags of a professional by position, production, shares and plus-minus."""
    total, is_d = goals + assists, position == "D"
    a, g = F.try_divide(assists, total), F.try_divide(goals, total)
    role = F.when(is_d, at_least(ppg, PRO_DEFENSE, PRO_DEFENSE_REST)).otherwise(at_least(ppg, PRO_FORWARD, PRO_FORWARD_REST))
    of_forward = F.coalesce(at_least(g, [PRO_GOALS]), at_most(g, [PRO_ASSISTS]), F.when(g.isNotNull(), PRO_BALANCED))
    kind = F.when(is_d, F.coalesce(at_least(a, [PRO_DEFENSE_ASSISTS]), at_most(a, [PRO_DEFENSE_GOALS]))).otherwise(of_forward)
    balance = F.coalesce(at_least(plus_minus, [PLUS]), at_most(plus_minus, [MINUS]))
    return F.when(position == "G", PRO_GOALIE).otherwise(F.array_join(F.array_compact(F.array(role, kind, balance)), ", "))


def pro_document(name: Column, position: Column, team: Column, nationality: Column, gp: Column, goals: Column, assists: Column, ppg: Column, plus_minus: Column, style: Column) -> Column:
    """Text of a professional: name, position line, season line, tags."""
    place = F.concat(
        F.lit("Position: "), position, F.when(team != "", F.concat(F.lit(" | Team: "), team)).otherwise(""),
        F.when(nationality != "", F.concat(F.lit(" | Nationality: "), nationality)).otherwise(""),
    )
    season = F.when(gp > 0, F.format_string("Season: %d GP, %dG, %dA, %dP (%.2f PPG), %+d +/-", gp, goals, assists, goals + assists, F.round(ppg, 2), plus_minus))
    return F.concat_ws("\n", F.concat(F.lit("NHL Player: "), name), place, season, F.when(style != "", F.concat(F.lit("Style: "), style)))


def top_entries(weights: Column, k: int) -> Column:
    """The k entries of a map with the largest values, as structs (key, value), ties by key."""
    order = lambda a, b: (
        F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.slice(F.array_sort(F.map_entries(weights), order), 1, k)


def profile_document(gm: Column, team: Column, archetype: Column, positions: Column, leagues: Column, nations: Column) -> Column:
    """Text of a decision maker's profile from three weight maps."""
    shares = lambda m, k: F.array_join(F.transform(top_entries(m, k), lambda e: F.format_string("%s(%.0f%%)", e["key"], e["value"] * 100)), ", ")
    return F.concat_ws(
        "\n", F.format_string("GM: %s | Team: %s", gm, team), F.concat(F.lit("Archetype: "), F.coalesce(archetype, F.lit("unknown"))),
        F.concat(F.lit("Top positions drafted: "), shares(positions, 3)), F.concat(F.lit("Preferred leagues: "), shares(leagues, 3)),
        F.concat(F.lit("Nationality tendencies: "), shares(nations, 2)),
    )


def evidence(content: Column, lines: int = 3, chars: int = 500) -> Column:
    """First non-blank lines of a document in one line, bars between them."""
    kept = F.slice(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""), 1, lines)
    return F.left(F.array_join(F.transform(kept, lambda x: F.trim(x)), " | "), F.lit(chars))


def query_terms(query: Column) -> Column:
    """Terms of a query that hold only letters, digits and hyphens, lower-cased."""
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda x: x.rlike("^[a-z0-9-]+$"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where a norm is 0."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def playoff(division_seq: Column, wildcard_seq: Column) -> Column:
    return F.coalesce(division_seq <= 3, F.lit(False)) | F.coalesce(wildcard_seq.isin(1, 2), F.lit(False))


def confidence_label(score: Column, in_set: Column) -> Column:
    return F.when(~F.coalesce(in_set, F.lit(False)), "volatile").when(score >= 0.9, "high").otherwise("in range")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the parts: 32 bits of their md5."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
