"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression over one text that is true where the rule
rejects. ``plan_cascade`` times each rule and counts its rejections on a small
sample; rules that reject most per second come first, as for independent
predicates that order costs least. The order only decides how soon a bad text is
dropped, never whether: the verdict is the disjunction of all rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written


@dataclass(frozen=True)
class Limits:
    """Integer bounds, so that every engine decides alike."""

    least_words: int = 10
    repeat_words_pct: int = 20
    symbols_pct: int = 20
    dup_lines_pct: int = 50
    distinct_words_pct: int = 30
    distinct_words_of: int = 1000
    word_chars: tuple[int, int] = (2, 15)


#: Features in the order they can be made: name -> (features it reads, expression over them).
#: {x} stands for the column of feature x. Texts with no two equal window hashes never build ``windows``.
_STARTS = "sequence(0, size({words}) - 5)"
_FEATURES: dict[str, tuple[tuple[str, ...], str]] = {
    "words": (("text",), "CASE WHEN btrim({text}, {space}) = '' THEN CAST(array() AS array<string>) ELSE split(btrim({text}, {space}), '[\\\\x20\\\\x09-\\\\x0D]+') END"),
    "lines": (("text",), "filter(split({text}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
    "pairs": (("words",), "CASE WHEN size({words}) >= 6 THEN zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (x, y) -> xxhash64(x, y)) END"),
    "fours": (("pairs",), "zip_with(slice({pairs}, 1, size({pairs}) - 2), slice({pairs}, 3, size({pairs}) - 2), (x, y) -> xxhash64(x, y))"),
    "hashes": (("words", "fours"), "zip_with(slice({fours}, 1, size({fours}) - 1), slice({words}, 5, size({words}) - 4), (x, y) -> xxhash64(x, y))"),
    "windows": (("words", "hashes"), "CASE WHEN size(array_distinct({hashes})) < size({hashes}) THEN sort_array(transform(" + _STARTS + ", i -> named_struct('g', concat_ws(' ', {words}[i], {words}[i+1], {words}[i+2], {words}[i+3], {words}[i+4]), 'i', i))) END"),
    "starts": (("windows",), "CASE WHEN {windows} IS NOT NULL THEN sort_array(transform(filter({windows}, (x, k) -> x.g <=> get({windows}, k - 1).g OR x.g <=> get({windows}, k + 1).g), x -> x.i)) END"),
    "n_words": (("words",), "CAST(size({words}) AS bigint)"),
    "word_chars": (("text",), "CAST(length(regexp_replace({text}, '[\\\\x20\\\\x09-\\\\x0D]+', '')) AS bigint)"),
    "n_symbols": (("text",), "CAST(length(regexp_replace({text}, '[^#*$%&|<>]+', '')) AS bigint)"),
    "n_lines": (("lines",), "CAST(size({lines}) AS bigint)"),
    "n_dup_lines": (("lines",), "CAST(size({lines}) - size(array_distinct({lines})) AS bigint)"),
    "n_distinct_words": (("words",), "CAST(size(array_distinct({words})) AS bigint)"),
    "n_repeat_words": (("starts",), "CASE WHEN {starts} IS NULL THEN 0L ELSE aggregate(transform({starts}, (x, k) -> least(5, coalesce(get({starts}, k + 1) - x, 5))), 0L, (a, x) -> a + x) END"),
}
COUNTS = tuple(x for x in _FEATURES if x.startswith("n_") or x == "word_chars")


def with_features(df: DataFrame, wanted: tuple[str, ...] = COUNTS, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the wanted features, and those they read, under ``prefix``; columns already there are kept.

    Null texts count as empty. ``n_repeat_words`` first hashes the five-word windows;
    only texts with two equal hashes compare the windows themselves, so a clash of
    hashes costs time and never changes a count. All work stays within its row.
    Each feature that others read more than once is a projection of its own.
    """
    needed: set[str] = set()

    def need(name: str) -> None:
        if name not in needed and name != "text":
            needed.add(name)
            for x in _FEATURES[name][0]:
                need(x)

    for name in wanted:
        need(name)
    names = {x: f"`{prefix}{x}`" for x in _FEATURES} | {"text": f"`{prefix}clean_text`", "space": "' \\t\\n\\u000b\\f\\r'"}
    out = df if f"{prefix}clean_text" in df.columns else df.withColumn(f"{prefix}clean_text", text_or_empty(text))
    for name, (_, sql) in _FEATURES.items():
        if name in needed and prefix + name not in out.columns:
            out = out.withColumn(prefix + name, F.expr(sql.format(**names)))
    return out


def rules_on_features(limits: Limits = Limits(), prefix: str = "", late: tuple[str, ...] = ()) -> dict[str, Column]:
    """Each rule as a test of columns that ``with_features`` made; features named ``late`` are made within the rule itself."""
    names = {x: f"`{prefix}{x}`" for x in _FEATURES}
    c = lambda name: F.expr(_FEATURES[name][1].format(**names)) if name in late else F.col(prefix + name)
    low, high = limits.word_chars
    return {
        "few_words": c("n_words") < limits.least_words,
        "repeats": c("n_repeat_words") * 100 > c("n_words") * limits.repeat_words_pct,
        "symbols": c("n_symbols") * 100 > c("n_words") * limits.symbols_pct,
        "dup_lines": c("n_dup_lines") * 100 > c("n_lines") * limits.dup_lines_pct,
        "monotony": c("n_distinct_words") * 100 < F.least(c("n_words"), F.lit(limits.distinct_words_of)) * limits.distinct_words_pct,
        "word_length": (c("word_chars") < c("n_words") * low) | (c("word_chars") > c("n_words") * high),
    }


#: The features that each rule asks for.
READS = {
    "few_words": ("n_words",),
    "repeats": ("n_words", "n_repeat_words"),
    "symbols": ("n_words", "n_symbols"),
    "dup_lines": ("n_lines", "n_dup_lines"),
    "monotony": ("n_words", "n_distinct_words"),
    "word_length": ("n_words", "word_chars"),
}


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule, in ``order``, that rejects; null where none does. Rules after that one are not evaluated."""
    out = None
    for name in order:
        out = F.when(rules[name], F.lit(name)) if out is None else out.when(rules[name], F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def _best_time(job: Callable[[], object], runs: int = 3) -> float:
    """Seconds of the fastest run; one before them is not timed."""
    job()
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        job()
        times.append(time.perf_counter() - began)
    return min(times)


def plan_cascade(
    df: DataFrame, limits: Limits = Limits(), sample_rows: int = 1000, text: str = "text"
) -> tuple[list[str], dict[str, tuple[float, float]]]:
    """Order of the rules by rejections per second on a sample, and (seconds, share rejected) of each.

    Every row is drawn with the same chance, so that about ``sample_rows`` are, at any number of
    partitions; the sample is a small table of its own. Each rule runs once before it is timed, or the first would
    pay for what all compile; its cost is the best of three times, less that of a job that only reads the texts,
    so that starting a job does not hide what rules cost. An empty sample keeps the rules as declared.
    """
    rows = df.count()
    names = list(rules_on_features(limits))
    if not rows:
        return names, {}
    texts = df.select(F.col(text).cast("string").alias("text"))
    sample = written(texts.sample(min(1.0, sample_rows / rows), 42).repartition(8), "quality-sample")
    rules = rules_on_features(limits)
    counted = with_features(sample).agg(F.count("*").alias("rows"), *[F.count_if(rules[x]).alias(x) for x in names]).collect()[0]
    total = counted["rows"]
    if not total:
        return names, {}
    measured = {}
    idle = _best_time(lambda: sample.agg(F.max(F.octet_length("text"))).collect())
    for name in names:
        took = _best_time(lambda: with_features(sample, READS[name]).agg(F.count_if(rules[name])).collect())
        measured[name] = (max(took - idle, 1e-3), counted[name] / total)
    # a rule that rejected nothing still ranks by cost, below those that did
    order = sorted(names, key=lambda x: (-(measured[x][1] + 0.5 / total) / measured[x][0], x))
    return order, measured


#: The counts that ``judge`` returns; what else a rule reads is made only where the rules before it let a text pass.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, order: list[str], limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """One row per row of ``df``: its counts, base_failed, kept.

    Columns out: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. Null and empty texts have no words and fail the base; repeated rows are
    judged each; other columns of ``df`` are not read. ``kept`` is the cascade's verdict: the rules are asked in
    ``order`` and stop at the first that rejects.
    """
    rows = with_features(df.select("doc_id", F.col(text).alias("text")), REPORTED)
    rules = rules_on_features(limits, late=tuple(x for x in COUNTS if x not in REPORTED))
    return rows.select("doc_id", *REPORTED, (rules["few_words"] | rules["repeats"]).alias("base_failed"), cascade(rules, order).isNull().alias("kept"))


def keep_good(df: DataFrame, order: list[str], limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, columns as they were.

    Rules run as successive filters; what a rule reads is made just before it, so later
    (dearer) rules see only what earlier ones left. Extra columns of any name pass through.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("palisade_row"), F.col(text).alias("palisade_text"))
    out = packed
    for name in order:
        # a filter on a row number stays where it is put: else the optimizer would move
        # it below, and copy what it reads into every step of a lambda
        out = with_features(out, READS[name], "palisade_text").withColumn("palisade_seen", F.monotonically_increasing_id())
        out = out.where((F.col("palisade_seen") >= 0) & ~rules_on_features(limits)[name])
    return out.select("palisade_row.*")
