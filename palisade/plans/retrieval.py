"""Queries of retrieval, conversations and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedder, retrieval, text_index, vectors
from ..sources.shared import written
from ..sources.star import PROSPECTS, prospects, table
from ..streaming import streams

TERMS = ["the", "that", "of"]


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(e.where("vec_id % 20 = 0"), e, 5).select("query_id", "id", "score", "place")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, vectors.InvertedFile, int]:
    """All vectors, those asked, the index of all and the lists that a query probes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vectors.build_index(e)
    return e, e.where("vec_id % 20 = 0"), index, vectors.probes_for(index, e, 5)


def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against the probed lists of the inverted file."""
    _, queries, index, probes = _index(spark, sf_dir)
    return index.search(queries, 5, probes).select("query_id", "id", "score", "place")


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against the exact search, and the share of the vectors that a query was compared with."""
    e, queries, index, probes = _index(spark, sf_dir)
    found = vectors.recall(index.search(queries, 5, probes), written(vectors.exact_top_k(queries, e, 5), "vector-exact"))
    shares = (F.lit(len(index.centroids)).alias("lists"), F.lit(probes).alias("probes"), F.lit(round(index.probed_share(queries, probes), 6)).alias("probed_share"))
    return found.select("n_wanted", "n_found", F.round("recall", 6).alias("recall"), *shares)


def fulltext_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fulltext_rank(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS, 20)


def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_rank(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS, 20)


def _text_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return text_index.build(table(spark, sf_dir, "documents").select("doc_id", "text"))


def text_index_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fulltext_rank``, from postings."""
    return _text_index(spark, sf_dir).rank(TERMS, 20)


def text_index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_index(spark, sf_dir).bm25(TERMS, 20)


def text_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one word right after another, how often and where first."""
    return _text_index(spark, sf_dir).phrase(["of", "the"])


def text_index_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text rank after a tenth of the documents was removed and a tenth replaced by the text of their source and language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", F.lit("the that of"), "source", "lang").alias("other"))
    index = text_index.build(d).add(d.where("doc_id % 10 = 1"), text="other").remove(d.where("doc_id % 10 = 0").select("doc_id"))
    return index.rank(TERMS, 200)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten fused documents for every vector whose id is divisible by 20: lists of max(3k, 15), text ranks over all documents."""
    e, k = table(spark, sf_dir, "embeddings"), 10
    fetch = max(3 * k, 15)
    queries = e.where("vec_id % 20 = 0")
    near = retrieval.cosine_topk(queries, e, fetch).select("query_id", F.col("id").alias("key"), F.col("place").alias("rank"))
    text = retrieval.fulltext_rank(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS, fetch)
    text = retrieval.ranked(text, [F.desc("score"), F.asc("doc_id")]).select(F.col("doc_id").alias("key"), "rank")
    text = queries.select(F.col("vec_id").alias("query_id")).crossJoin(F.broadcast(text))  # at most 30 rows
    return retrieval.reciprocal_fusion_by([near, text], "query_id", "key", k)


def pro_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 0 with their three nearest among label 1."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(e.where("label = 0 AND vec_id % 20 = 0"), e.where("label = 1"), 3).select("query_id", "id", "score")


def prospect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prospects(spark, sf_dir)
    rows = p.select(
        "id", "name", "position", "league", "css_ranking", "ppg", F.when(F.col("id") % 3 != 0, F.col("ppg") - (F.col("id") % 7 - 3) / 10).alias("prev"),
        (F.col("id") % 40 + 165).cast("int").alias("height"), F.when(F.col("id") % 5 == 0, "G").when(F.col("id") % 5 == 1, "D").otherwise("C").alias("pos"),
        (F.col("id") % 30).cast("int").alias("goals"), (F.col("id") % 41).cast("int").alias("assists"), (F.col("id") % 4).cast("int").alias("tier"),
    )
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("league"), (F.col("event_id") % 82).cast("int").alias("games"), (F.col("event_id") % 20).cast("int").alias("goals"), (F.col("event_id") % 25).cast("int").alias("assists"), (F.col("event_id") % 8 / 4).alias("ppg"))
    return retrieval.prospect_document(rows, e)


def prospect_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most like that of every prospect whose id is divisible by 20, by an embedder of all prospects' documents; the
    documents of every third are put into the index anew, in place of those that it has."""
    docs = written(prospect_documents(spark, sf_dir), "prospect-documents")
    model = embedder.fit(docs, "document", rank=32)
    e = written(embedder.embed(docs, model, "document").select("id", "embedding"), "prospect-embeddings")
    index = vectors.build_index(e, id_col="id").add(e.where("id % 3 = 0"), id_col="id")
    return index.search(e.where("id % 20 = 0"), 5, vectors.probes_for(index, e, 5, id_col="id"), id_col="id").select("query_id", "id", "score", "place")


def session_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "turn_no")


def session_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.overflow(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.expr("role = 'user'")).alias("n_user"))


def repeat_call_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that call for the same thing with the same arguments as their user's event before."""
    signature = F.concat_ws(" ", "event_type", "props")
    return streams.repeated_calls(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], signature).select("user_id", "event_id", "signature")


def breaker_sliding_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return streams.failure_windows(e, ["user_id"], "ts", "event_id", seconds=86_400, threshold=2).select("event_id", "n_recent", "opened")


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a call of its user: errors fail, all others succeed."""
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    out = streams.breaker_states(e, "user_id", "ts", "event_id", "failed", seconds=5 * 86_400, threshold=2, reset=2 * 86_400)
    return out.select("user_id", "event_id", "state")


def _windows(spark: SparkSession, sf_dir: str, name: str, window, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    events, end = streams.read_events(spark, f"{sf_dir}/events.parquet")
    return streams.run_to_table(spark, streams.windowed(events, window, keys), name, end)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "tumbling", F.window("at", "6 hours"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "sliding", F.window("at", "12 hours", "6 hours"))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user: events less than half an hour apart."""
    return _windows(spark, sf_dir, "session", F.session_window("at", "30 minutes"), ("user_id",))


def stat_history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = streams.read_events(spark, f"{sf_dir}/events.parquet")
    _, current = streams.upsert_history(spark, events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")
    return current.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def game_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games, sum, share and season type (playoff if any game is of that type) per user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("games"), F.round(F.sum("value"), 4).alias("total"), F.when(F.max((F.col("event_type") == "purchase").cast("int")) == 1, "playoff").otherwise("regular").alias("season_type"), F.max("event_type").alias("last_type"))


QUERIES = {f.__name__: f for f in (
    cosine_topk, vector_index_search, vector_index_recall, text_index_rank, text_index_bm25, text_index_phrase, text_index_updated, prospect_neighbours, fulltext_rank, bm25_rank, hybrid_rrf, pro_comparison, prospect_documents, session_last_n, session_overflow, session_counts,
    repeat_call_detection, breaker_sliding_failures, breaker_states, stream_tumbling, stream_sliding, stream_session, stat_history_upsert, game_log_totals,
)}

_COS = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"
_TOK = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf_{i}" for i, t in enumerate(TERMS))
_CNT = f"{_TOK}, c AS (SELECT doc_id, len(w) AS length, {_TF} FROM t)"
_TEXT = "SELECT doc_id, round((tf_0 + tf_1 + tf_2) / (1 + ln(length::DOUBLE)), 6) AS score FROM c WHERE tf_0 > 0 AND tf_1 > 0 AND tf_2 > 0"
_W = "event_type, count(*) AS n, round(sum(value), 4) AS total"

_BREAKER = """WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        b AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS state, CAST([] AS BIGINT[]) AS f, NULL::BIGINT AS o FROM (SELECT DISTINCT user_id FROM c)
          UNION ALL SELECT c.user_id, c.k, c.event_id,
            CASE WHEN o IS NOT NULL AND t - o < 172800000000 THEN 'refused' WHEN NOT bad AND o IS NULL THEN 'passed' WHEN NOT bad THEN 'closed' WHEN o IS NOT NULL THEN 'reopened'
              WHEN len(list_filter(f, lambda x: x >= t - 432000000000)) >= 1 THEN 'opened' ELSE 'failed' END,
            CASE WHEN o IS NOT NULL AND t - o < 172800000000 THEN f WHEN NOT bad AND o IS NOT NULL THEN CAST([] AS BIGINT[]) WHEN bad THEN list_append(list_filter(f, lambda x: x >= t - 432000000000), t) ELSE f END,
            CASE WHEN o IS NOT NULL AND t - o < 172800000000 THEN o WHEN NOT bad THEN NULL WHEN o IS NOT NULL OR len(list_filter(f, lambda x: x >= t - 432000000000)) >= 1 THEN t END
          FROM b JOIN c ON c.user_id = b.user_id AND c.k = b.k + 1)
        SELECT user_id, event_id, state FROM b WHERE k > 0"""

SQL = {
    "breaker_states": _BREAKER,
    "cosine_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place FROM s) SELECT * FROM r WHERE place <= 5""",
    "fulltext_rank": f"WITH {_CNT} {_TEXT} ORDER BY score DESC, doc_id LIMIT 20",
    "bm25_rank": f"""WITH {_CNT}, s AS (SELECT count(*) AS nd, avg(length) AS al, {', '.join(f'count(*) FILTER (tf_{i} > 0) AS df_{i}' for i in range(3))} FROM c)
        SELECT doc_id, round({' + '.join(f'ln(1 + (nd - df_{i} + 0.5) / (df_{i} + 0.5)) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / al))' for i in range(3))}, 6) AS score FROM c, s
        WHERE tf_0 + tf_1 + tf_2 > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "hybrid_rrf": f"""WITH {_CNT}, v AS (SELECT a.vec_id AS query_id, b.vec_id AS key, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        x AS ({_TEXT}), y AS (SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x),
        u AS (SELECT * FROM v WHERE rank <= 30 UNION ALL SELECT vec_id, y.key, y.rank FROM embeddings, y WHERE vec_id % 20 = 0 AND y.rank <= 30),
        f AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS place FROM f) SELECT query_id, key, score FROM p WHERE place <= 10""",
    "pro_comparison": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND a.label = 0 AND b.label = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) SELECT query_id, id, score FROM r WHERE place <= 3""",
    "prospect_documents": f"""WITH {PROSPECTS}, p AS (SELECT *, CASE WHEN id % 3 <> 0 THEN ppg - (id % 7 - 3) / 10.0::DOUBLE END AS prev, id % 40 + 165 AS height,
            CASE id % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'D' ELSE 'C' END AS pos, id % 30 AS goals, id % 41 AS assists, id % 4 AS tier FROM prospects),
        h AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place,
            '  ' || event_type || ': ' || event_id % 82 || ' GP' || printf('  %dG %dA', event_id % 20, event_id % 25) || printf('  %.2f PPG', (event_id % 8) / 4.0) AS line FROM events),
        s AS (SELECT id, 'Season history:' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS season FROM h WHERE place <= 4 GROUP BY 1), q AS (SELECT p.*, season, goals / nullif(goals + assists, 0)::DOUBLE AS sh, ppg - prev AS d FROM p LEFT JOIN s USING (id))
        SELECT id, concat_ws(chr(10), name || ' - ' || position || ', CSS #' || coalesce(CAST(css_ranking AS VARCHAR), 'unranked'), 'League: ' || league, 'Production: ' || printf('%.2f', ppg::DOUBLE) || ' PPG',
          CASE WHEN prev IS NULL THEN 'Trend: single-season snapshot, no prior season data' ELSE 'Trend: ' || CASE WHEN d >= 0.20::DOUBLE THEN 'clear upward development trend' WHEN d >= 0.08::DOUBLE THEN 'modest year-over-year improvement'
            WHEN d <= -0.20::DOUBLE THEN 'meaningful production drop from prior season' WHEN d <= -0.08::DOUBLE THEN 'slight production regression' ELSE 'stable production year over year' END || ' (' || printf('%.2f', prev) || ' to ' || printf('%.2f', ppg::DOUBLE) || ')' END,
          'Size: ' || height || 'cm (' || CASE WHEN height >= 191 THEN 'pro-size frame' WHEN height <= 178 THEN 'undersized' ELSE 'average frame' END || ')',
          'Style: ' || concat_ws(', ', CASE WHEN pos = 'G' THEN 'goaltending prospect' WHEN pos = 'D' AND ppg >= 0.75 THEN 'offensive defenseman' WHEN pos = 'D' AND ppg >= 0.45 THEN 'two-way defenseman' WHEN pos = 'D' THEN 'defensive defenseman'
            WHEN ppg >= 1.30 THEN 'high-end scoring forward' WHEN ppg >= 0.95 THEN 'top-six scoring forward' WHEN ppg >= 0.65 THEN 'middle-six forward' ELSE 'depth forward' END,
            CASE WHEN sh >= 0.48 THEN 'goal-driven production' WHEN sh <= 0.28 THEN 'playmaking / assist-heavy' WHEN sh IS NOT NULL THEN 'balanced scorer' END,
            CASE tier WHEN 1 THEN 'elite competition' WHEN 2 THEN 'strong junior or college competition' END), season) AS document FROM q""",
    "session_last_n": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
        SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn_no FROM r WHERE back <= 6""",
    "session_overflow": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
        SELECT conv_id, count(*) AS n_folded, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS summary FROM r WHERE back > 6 GROUP BY 1""",
    "session_counts": "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY 1",
    "repeat_call_detection": """WITH s AS (SELECT *, concat_ws(' ', event_type, props) AS signature FROM events),
        r AS (SELECT user_id, event_id, signature, lag(signature) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
        SELECT user_id, event_id, signature FROM r WHERE signature = before""",
    "breaker_sliding_failures": """WITH e AS (SELECT * FROM events WHERE event_type = 'error')
        SELECT a.event_id, count(*) AS n_recent, count(*) >= 2 AS opened FROM e a JOIN e b ON a.user_id = b.user_id AND epoch_us(b.ts) > epoch_us(a.ts) - 86400000000 AND b.ts <= a.ts GROUP BY 1""",
    "stream_tumbling": f"SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS stop, {_W} FROM events GROUP BY 1, 2, event_type",
    "stream_sliding": f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL (6 * k) HOURS AS start, * FROM events, (VALUES (0), (1)) v(k))
        SELECT start, start + INTERVAL 12 HOURS AS stop, {_W} FROM w GROUP BY 1, 2, event_type""",
    "stream_session": """WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY g, user_id""",
    "stat_history_upsert": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, round(value, 6) AS value FROM r WHERE k = 1""",
    "game_log_totals": """SELECT user_id, count(*) AS games, round(sum(value), 4) AS total, CASE WHEN max(CAST(event_type = 'purchase' AS INT)) = 1 THEN 'playoff' ELSE 'regular' END AS season_type, max(event_type) AS last_type FROM events GROUP BY 1""",
}
SQL["text_index_rank"], SQL["text_index_bm25"] = SQL["fulltext_rank"], SQL["bm25_rank"]
SQL["text_index_phrase"] = f"""WITH {_TOK}, p AS (SELECT doc_id, list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the') AS ps FROM t)
    SELECT doc_id, CAST(len(ps) AS INT) AS n, CAST(ps[1] - 1 AS INT) AS first FROM p WHERE len(ps) > 0"""
SQL["text_index_updated"] = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN concat_ws(' ', 'the that of', source, lang) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0),
    {_CNT.replace('FROM documents', 'FROM d')} {_TEXT} ORDER BY score DESC, doc_id LIMIT 200"""
