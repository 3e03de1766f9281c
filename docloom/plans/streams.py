"""Streaming and pluggable-model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import evaluation as E
from docloom.operators import models as M
from docloom.operators import retrieval as R
from docloom.session import table as t
from docloom.streaming import ingest as S


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    made = S.drain(S.windowed(S.watch(s, f"{d}/events.parque*", t(s, d, "events").schema, "ts"), "ts", "event_type", "value", "1 day"))
    return made.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    return S.drain(S.sessions(S.watch(s, f"{d}/events.parque*", t(s, d, "events").schema, "ts"), "ts", "user_id", "6 hours")).select("user_id", "session_start", "n")


def embed_documents(s: SparkSession, d: str) -> DataFrame:
    """The likeness of each document to the one of the next id."""
    made = M.embed(t(s, d, "documents", "doc_id", "text"), "doc_id", "text", 32)
    after = made.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("other"))
    return made.join(after, "doc_id").select("doc_id", F.round(R.cosine(F.col("vector"), F.col("other")), 3).alias("similarity"))


def best_reading(s: SparkSession, d: str) -> DataFrame:
    return M.best_reading(t(s, d, "page_vietocr_results").dropDuplicates(["line_key"]).withColumn("model", F.coalesce("model", F.lit(""))), ["document_id", "page_number"])


def length_by_type(s: SparkSession, d: str) -> DataFrame:
    rows = E.length_statistics(t(s, d, "documents", "doc_type", "n_chars"), ["doc_type"], "n_chars")
    return rows.select("doc_type", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "p50", "p90", "p99")))


QUERIES = {"q_stream_windows": stream_windows, "q_stream_sessions": stream_sessions, "q_embed_documents": embed_documents, "q_best_reading": best_reading, "q_length_by_type": length_by_type}
_HEX = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
SQL = {
    "q_stream_windows": "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q_stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END b FROM events), x AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM x GROUP BY user_id, k""",
    "q_embed_documents": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) w FROM documents), h AS (SELECT doc_id, md5(w) h FROM w), p AS (SELECT doc_id, ({_HEX.format(7)} * 16 + {_HEX.format(8)}) % 32 AS i, sum(CASE WHEN {_HEX.format(9)} > 7 THEN 1.0 ELSE -1.0 END) v FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) n FROM p GROUP BY 1),
        x AS (SELECT a.doc_id, sum(a.v * b.v) s FROM p a JOIN p b ON b.doc_id = a.doc_id + 1 AND b.i = a.i GROUP BY 1) SELECT d.doc_id, round(coalesce(x.s / nullif(n1.n * n2.n, 0), 0), 3) AS similarity FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN n n1 ON n1.doc_id = d.doc_id LEFT JOIN n n2 ON n2.doc_id = e.doc_id""",
    "q_best_reading": "SELECT document_id, page_number, text, model, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(score, -1) DESC, model DESC, encode(text) DESC NULLS LAST) r FROM (SELECT DISTINCT ON (line_key) document_id, page_number, text, coalesce(model, '') AS model, score FROM page_vietocr_results)) WHERE r = 1",
    "q_length_by_type": "SELECT doc_type, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.99), 4) AS p99 FROM documents GROUP BY 1",
}
