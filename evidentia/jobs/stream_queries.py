"""The streaming operators over finished tables, where a stream's result is that of the batch, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate
from ..streaming import live
from .queries import _query
from .views import VIEWS

VIEWS |= {
    "v_sessions": "SELECT concat(CAST(user_id AS STRING), '/', CAST(event_id % 8 AS STRING)) AS session_id, event_id, ts, MICROS(ts) AS at, event_type = 'click' AS hit, CASE WHEN event_type = 'click' AND event_id % 7 > 0 THEN array(CAST(event_id % 3 AS INTEGER), 1) END AS positions, CASE WHEN event_id % 41 = 0 THEN 'argument_limit' WHEN event_id % 43 = 0 THEN 'mailbox_limit' END AS failure, event_type IN ('signup', 'error') AS last FROM {events}",
    "v_moments": "SELECT event_id AS id, user_id AS session_id, event_type AS origin, ts FROM {events}",
    "v_sent": "SELECT event_id AS id, ts FROM {events} WHERE event_type IN ('click', 'view')",
    "v_got": "SELECT event_id + 3 AS id, ts FROM {events} WHERE event_type IN ('purchase', 'signup', 'error')",
}


@_query("stream_dedupe", "SELECT DISTINCT origin AS id FROM v_moments", "v_moments")
def _(moments):  # noqa: ANN001, ANN202
    return live.stream_dedupe(moments.select(F.col("origin").alias("id"), "ts"), "10 minutes").select("id")


@_query("stream_rate", "SELECT origin, epoch_us(ts) // 60000000 * 60000000 AS start, count(*) AS n FROM v_moments GROUP BY 1, 2", "v_moments")
def _(moments):  # noqa: ANN001, ANN202
    return live.stream_rate(moments, "1 minute")


@_query("stream_rate_sliding", "SELECT origin, (epoch_us(ts) // 30000000 - k) * 30000000 AS start, count(*) AS n FROM v_moments, (VALUES (0), (1)) t(k) GROUP BY 1, 2", "v_moments")
def _(moments):  # noqa: ANN001, ANN202
    return live.stream_rate(moments, "1 minute", "30 seconds")


@_query("stream_session_window", "WITH o AS (SELECT session_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts) AS before FROM v_moments), s AS (SELECT session_id, t, sum(CASE WHEN before IS NULL OR t - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t) AS k FROM o) SELECT session_id, min(t) AS start, count(*) AS n FROM s GROUP BY session_id, k", "v_moments")
def _(moments):  # noqa: ANN001, ANN202
    return live.stream_session_window(moments, "1 hour")


@_query("stream_pairs", "SELECT s.id, CASE WHEN r.id IS NULL THEN 'incomplete' ELSE 'joined' END AS state FROM v_sent s LEFT JOIN v_got r ON s.id = r.id AND r.ts >= s.ts AND r.ts <= s.ts + INTERVAL 10 DAY", "v_sent", "v_got")
def _(sent, got):  # noqa: ANN001, ANN202
    return live.stream_pairs(sent, got, "10 DAYS")


@_query("stream_spans", "SELECT s.id AS context, epoch_us(r.ts) - epoch_us(s.ts) AS micros, CASE WHEN r.id IS NULL THEN 'incomplete' WHEN r.id % 5 = 0 THEN 'exception' ELSE 'stop' END AS outcome FROM v_sent s LEFT JOIN v_got r ON s.id = r.id AND r.ts >= s.ts AND r.ts <= s.ts + INTERVAL 10 DAY", "v_sent", "v_got")
def _(sent, got):  # noqa: ANN001, ANN202
    stops = got.select(F.col("id").alias("context"), "ts", F.when(F.col("id") % 5 == 0, "exception").otherwise("stop").alias("outcome"))
    return live.stream_spans(sent.withColumnRenamed("id", "context"), stops, "10 DAYS").select("context", "micros", "outcome")


#: A session is looked at up to its first failure or the event behind the limit.
SESSIONS = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at, event_id) AS place FROM v_sessions),
c AS (SELECT session_id, bool_or(last) AS ended, count(*) AS n, min(place) FILTER (failure IS NOT NULL AND place <= 8) AS failed FROM p GROUP BY 1),
s AS (SELECT *, coalesce(failed, CASE WHEN n > 8 THEN 9 END) AS stop FROM c),
h AS (SELECT s.session_id, count(*) AS hits FROM s JOIN p ON p.session_id = s.session_id AND hit AND (stop IS NULL OR place < stop) GROUP BY 1),
a AS (SELECT session_id, array_to_string(list_sort(list_distinct(list(position))), ',') AS positions FROM (SELECT s.session_id, unnest(positions) AS position FROM s JOIN p ON p.session_id = s.session_id AND hit AND (stop IS NULL OR place < stop)) GROUP BY 1)
SELECT s.session_id, coalesce(stop, n)::BIGINT AS events, coalesce(hits, 0)::BIGINT AS hits, coalesce(a.positions, '') AS positions, CASE WHEN stop IS NULL THEN '' ELSE coalesce(p.failure, 'event_limit') END AS failures, CASE WHEN ended AND stop IS NULL THEN 'intact' ELSE 'incomplete' END AS envelope,
 CASE WHEN NOT (ended AND stop IS NULL) THEN 'inconclusive' WHEN hits > 0 THEN 'confirmed' ELSE 'refuted' END AS verdict
FROM s LEFT JOIN h ON h.session_id = s.session_id LEFT JOIN a ON a.session_id = s.session_id LEFT JOIN p ON p.session_id = s.session_id AND p.place = s.failed"""


@_query("trace_sessions", SESSIONS, "v_sessions")
def _(sessions):  # noqa: ANN001, ANN202
    return correlate.trace_sessions(sessions, 8).withColumns({c: F.array_join(c, ",") for c in ("positions", "failures")})


@_query("stream_sessions", SESSIONS, "v_sessions")
def _(sessions):  # noqa: ANN001, ANN202
    return live.stream_sessions(sessions, 8, 3_600_000).withColumns({c: F.array_join(c, ",") for c in ("positions", "failures")})
