"""Streaming queries, run over all that their source has now."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.plans.states import status_events
from pactum.sources import adapters as a
from pactum.sources.shared import materialize, shared_dir
from pactum.streaming import status


def status_stream(spark, sf_dir):
    """The latest status of each document by a stateful stream over the status events."""
    source = shared_dir(spark, "status-events")
    status_events(spark, sf_dir).write.parquet(source)
    events = spark.readStream.schema("doc_id long, event_id long, ts timestamp, status string, error string").parquet(source)
    return status.run_available(status.latest_status_stream(events, "60 days"), "latest", "complete", shared_dir(spark, "status-stream"))


def ingest_stream(spark, sf_dir):
    """Web pages as arriving objects: normalised length and checksum of each, by micro-batches."""
    source = shared_dir(spark, "arriving")
    a.table(spark, sf_dir, "pages").select("page_id", "html").write.parquet(source)
    pages = spark.readStream.schema("page_id long, html string").parquet(source)
    parsed = pages.select("page_id", F.sha2("html", 256).alias("checksum"), F.length(F.trim(F.regexp_replace("html", "<[^>]*>", ""))).alias("n_chars"))
    return status.run_available(parsed, "parsed", "append", shared_dir(spark, "ingest-stream"))


def events_tumbling(spark, sf_dir):
    found = status.tumbling(a.table(spark, sf_dir, "events"))
    return found.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def token_flush_groups(spark, sf_dir):
    words = a.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("session_id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return status.token_groups(materialize(words, "tokens"))


def fan_out(spark, sf_dir):
    """Status events of three documents, each sent to a sink of its own."""
    source, sinks = shared_dir(spark, "status-events"), shared_dir(spark, "subscribers")
    status_events(spark, sf_dir).write.parquet(source)
    for doc in (1, 2, 3):
        events = spark.readStream.schema("doc_id long, event_id long, ts timestamp, status string, error string").parquet(source)
        status.fan_out(events, "doc_id", doc, f"{sinks}/doc={doc}", shared_dir(spark, "fan-out")).awaitTermination()
    rows = spark.read.schema("doc_id long, event_id long, ts timestamp, status string, error string, doc int").parquet(sinks)
    return rows.select("doc", "doc_id", "event_id", "status")


QUERIES = {f.__name__: f for f in (status_stream, ingest_stream, events_tumbling, token_flush_groups, fan_out)}
from pactum.plans.states import _STATUS  # noqa: E402
from pactum.plans.states import SQL as _STATES  # noqa: E402

SQL = {
    "status_stream": _STATES["status_latest"],
    "ingest_stream": "SELECT page_id, sha256(html) AS checksum, CAST(length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS INTEGER) AS n_chars FROM pages",
    "fan_out": f"""SELECT CAST(user_id AS INTEGER) AS doc, user_id AS doc_id, event_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE ({_STATUS})[least(n, 9)] END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE user_id IN (1, 2, 3)""",
    "events_tumbling": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "token_flush_groups": """WITH w AS (SELECT conv_id || '-' || turn AS session_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations WHERE role = 'assistant')),
        g AS (SELECT session_id, CAST(pos // 4 AS INTEGER) AS flush, string_agg(token, '' ORDER BY pos) AS token, FALSE AS final FROM w GROUP BY ALL) SELECT * FROM g UNION ALL SELECT session_id, CAST(max(flush) + 1 AS INTEGER), '', TRUE FROM g GROUP BY session_id""",
}
