"""Retrieval: cosine neighbours, text rank, fusion of ranked lists, documents of prospects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from .vectors import exact_top_k

def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, place: the k most similar other vectors of each query, exact, by matrix products in blocks of queries."""
    return exact_top_k(queries, vectors, k, id_col, vector)


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def term_counts(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """doc_id, length and one count per query term, within each row."""
    t = docs.select(doc_id, tokens(F.col(text)).alias("_t"))
    same = lambda word: lambda x: x == F.lit(word)
    counts = [F.size(F.filter("_t", same(w))).alias(f"tf_{i}") for i, w in enumerate(terms)]
    return t.select(doc_id, F.size("_t").alias("length"), *counts)


def fulltext_rank(docs: DataFrame, doc_id: str, text: str, terms: list[str], k: int) -> DataFrame:
    """The k documents that hold all terms, by term frequency over log length."""
    rows = term_counts(docs, doc_id, text, terms)
    tf = [F.col(f"tf_{i}") for i in range(len(terms))]
    all_terms, total = tf[0] > 0, tf[0]
    for x in tf[1:]:
        all_terms, total = all_terms & (x > 0), total + x
    score = F.round(total / (1 + F.log(F.col("length").cast("double"))), 6)
    return rows.where(all_terms).select(doc_id, score.alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def bm25_rank(docs: DataFrame, doc_id: str, text: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k documents of highest BM25 for the terms; document frequencies are one aggregate of the same pass."""
    rows = term_counts(docs, doc_id, text, terms)
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
        tf = F.col(f"tf_{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return joined.select(doc_id, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), doc_id).limit(k)


def reciprocal_fusion(lists: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """key, score: sum of 1 / (constant + rank) over the lists (key, rank); a key's best rank in a list counts once."""
    parts = [x.groupBy(key).agg(F.min("rank").alias("rank")) for x in lists]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    fused = union.groupBy(key).agg(F.round(F.sum(1 / (F.col("rank") + constant)), 9).alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(k)


def reciprocal_fusion_by(lists: list[DataFrame], by: str, key: str, k: int, constant: int = 60) -> DataFrame:
    """by, key, score: as ``reciprocal_fusion`` over lists (by, key, rank), the k best keys of each ``by``."""
    union = None
    for x in lists:
        part = x.groupBy(by, key).agg(F.min("rank").alias("rank"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy(by, key).agg(F.round(F.sum(1 / (F.col("rank") + constant)), 9).alias("score"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), key))
    return fused.withColumn("place", place).where(F.col("place") <= k).drop("place")


def query_terms(query: str) -> list[str]:
    """The terms of a query as the text rank takes them, in the order they stand, each once."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))


def keyword_hits(docs: DataFrame, doc_id: str, text: str, word: str, k: int) -> DataFrame:
    """key, score: documents that hold the word anywhere, in any case; all score 1."""
    escaped = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return docs.where(F.col(text).ilike(f"%{escaped}%")).select(F.col(doc_id).alias("key"), F.lit(1.0).alias("score")).orderBy("key").limit(k)


def first_that_finds(methods: list[tuple[str, DataFrame]], query: int) -> DataFrame:
    """query, method, key, score: the rows of the first method that has any. Each is a short list, of at most k rows."""
    out = None
    for name, found in methods:
        rows = found.select(F.lit(query).alias("query"), F.lit(name).alias("method"), "key", "score")
        if out is None:
            out = rows
            continue
        none = out.agg((F.count("*") == 0).alias("_none"))
        out = out.unionByName(rows.crossJoin(F.broadcast(none)).where("_none").drop("_none"))
    return out


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank`` to a short list."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def prospect_document(p: DataFrame, history: DataFrame, latest: int = 4) -> DataFrame:
    """id, document: text of a prospect from its own columns and its ``latest`` statistics (id, at, league, games, goals, assists, ppg)."""
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("at")))
    line = F.concat(
        F.lit("  "), F.coalesce("league", F.lit("unknown")), F.lit(": "), F.coalesce(F.col("games").cast("string"), F.lit("?")), F.lit(" GP"),
        F.coalesce(F.format_string("  %dG %dA", "goals", "assists"), F.lit("")), F.coalesce(F.format_string("  %.2f PPG", "ppg"), F.lit("")),
    )
    recent = history.withColumn("place", place).where(F.col("place") <= latest).select("id", "place", line.alias("line"))
    lines = recent.groupBy("id").agg(F.concat_ws("\n", F.lit("Season history:"), F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])).alias("season"))
    money = lambda c: F.format_string("%.2f", c)
    head = F.concat(F.col("name"), F.lit(" - "), F.coalesce("position", F.lit("F")), F.lit(", CSS #"), F.coalesce(F.col("css_ranking").cast("string"), F.lit("unranked")))
    made = F.when(F.col("ppg").isNotNull(), F.concat(F.lit("Production: "), money(F.col("ppg")), F.lit(" PPG")))
    trend = F.when(F.col("prev").isNotNull(), F.concat(F.lit("Trend: "), X.trend(F.col("ppg"), F.col("prev")), F.lit(" ("), money(F.col("prev")), F.lit(" to "), money(F.col("ppg")), F.lit(")"))).when(
        F.col("ppg").isNotNull(), "Trend: single-season snapshot, no prior season data"
    )
    h = F.col("height")
    frame = F.when(h >= 191, "pro-size frame").when(h <= 178, "undersized").otherwise("average frame")
    size = F.when(h.isNotNull(), F.concat(F.lit("Size: "), h.cast("string"), F.lit("cm ("), frame, F.lit(")")))
    style = F.concat(F.lit("Style: "), X.prospect_style(F.col("pos"), F.col("ppg"), F.col("goals"), F.col("assists"), F.col("tier")))
    body = p.join(lines, "id", "left")
    return body.select("id", F.concat_ws("\n", head, F.concat(F.lit("League: "), F.coalesce("league", F.lit("unknown"))), made, trend, size, style, "season").alias("document"))
