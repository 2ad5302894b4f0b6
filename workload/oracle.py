"""SQL side of the registered queries, over the plain test tables.

Nothing here goes through messages: the SQL states from `events` alone what
must come out.
"""

from __future__ import annotations

# JSON text of a message and of a payload, from the plain columns.
STAMP = (
    "(CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00')"
)
FIELDS = f"""
    '"event_type":"' || CASE event_type WHEN 'view' THEN 'page_view' ELSE event_type END
    || '","user_id":"user_' || user_id || '","timestamp":"' || {STAMP} || '"'
    || CASE WHEN event_type = 'purchase' THEN ',"amount_usd":' || value ELSE '' END
    || CASE WHEN event_type = 'error' THEN ',"error_code":' || json_extract_string(props, '$.k') ELSE '' END
    || '}}'
"""
# In a payload a whole number has no fraction.
PAYLOAD = f"""
    '{{' || CASE WHEN event_type = 'purchase'
                 THEN '"amount_usd":' || regexp_replace(value::VARCHAR, '\\.0$', '') || ',' ELSE '' END
    || CASE WHEN event_type = 'error' THEN '"error_code":' || k || ',' ELSE '' END
    || '"timestamp":"' || {STAMP} || '"}}'
"""

# Rows that survive parsing and validation.
BASE = """
WITH base AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE event_type WHEN 'view' THEN 'page_view' ELSE event_type END AS event_type,
         'user_' || user_id AS user_id, ts, CAST(ts AS DATE) AS d, value,
         json_extract_string(props, '$.k') AS k
  FROM events
  WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0
    AND event_type <> 'signup'
)
"""

# Rows that do not, with the first reason that applies.
REJECTS = f"""
WITH rejects AS (
  SELECT ts, CASE WHEN event_id % 97 = 0 THEN '{{"event_id": "x'
                  WHEN event_id % 89 = 0 THEN '{{' || {FIELDS}
                  ELSE '{{"event_id":"' || CASE WHEN event_id % 83 = 0 THEN '' ELSE event_id::VARCHAR END
                       || '",' || {FIELDS} END AS raw,
         CASE WHEN event_id % 97 = 0 THEN 'malformed'
                  WHEN event_id % 89 = 0 THEN 'missing_required'
                  WHEN event_type = 'signup' THEN 'unknown_event_type'
                  ELSE 'bad_event_id' END AS reason, event_type, event_id
  FROM events
  WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0
     OR event_type = 'signup'
)
"""

def floor_to(ts: str, seconds: int) -> str:
    width = seconds * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {width}) * {width})"


SLIDING = f"""
windows AS (
  SELECT {floor_to('ts', 900)} - to_minutes(15 * CAST(i AS INTEGER)) AS window_start, event_type
  FROM base, range(4) AS shifts(i)
),
sliding AS (
  SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type,
         count(*) AS event_count
  FROM windows GROUP BY 1, 2, 3
)
"""


def sessions_sql(key: str, gap: str, rows: str = "base") -> str:
    """CTEs ending in `sessions`: merged intervals [ts, ts + gap) per key."""
    return f"""
    ends AS (SELECT {key}, ts, ts + {gap} AS e FROM {rows}),
    marked AS (
      SELECT *, CASE WHEN reach IS NULL OR reach < ts THEN 1 ELSE 0 END AS opens
      FROM (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY ts, e
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM ends)
    ),
    numbered AS (
      SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ts, e
                                 ROWS UNBOUNDED PRECEDING) AS session_no
      FROM marked
    ),
    sessions AS (
      SELECT min(ts) AS window_start, max(e) AS window_end, {key}, count(*) AS event_count
      FROM numbered GROUP BY {key}, session_no
    )
    """


PLAIN_GAP = "INTERVAL 30 MINUTE"
TYPE_GAP = (
    "CASE event_type WHEN 'page_view' THEN INTERVAL 15 MINUTE "
    "WHEN 'purchase' THEN INTERVAL 60 MINUTE ELSE INTERVAL 30 MINUTE END"
)

TUMBLING = f"""
tumbling AS (
  SELECT {floor_to('ts', 60)} AS window_start,
         {floor_to('ts', 60)} + INTERVAL 1 MINUTE AS window_end,
         event_type, count(*) AS event_count
  FROM base GROUP BY 1, 2, 3
)
"""

# The digest-driven generator: four numbers of 32 bits from one MD5.
GENERATED = """
WITH bits AS (
  SELECT ts, md5('42:' || event_id) AS b, md5('42:' || event_id || ':id') AS u FROM events
),
words AS (
  SELECT ts, u,
         CAST('0x' || substr(b, 1, 8) AS BIGINT) AS w0,
         CAST('0x' || substr(b, 9, 8) AS BIGINT) AS w1,
         CAST('0x' || substr(b, 17, 8) AS BIGINT) AS w2,
         CAST('0x' || substr(b, 25, 8) AS BIGINT) AS w3
  FROM bits
),
typed AS (
  SELECT *, ['page_view', 'click', 'purchase', 'session_start', 'session_end', 'error']
            [w0 % 6 + 1] AS event_type
  FROM words
)
"""

STRATEGIES = f"""
purchases AS (SELECT * FROM base WHERE event_type = 'purchase'),
{TUMBLING}, {SLIDING}, {sessions_sql('user_id', PLAIN_GAP, 'purchases')},
strategies AS (
  SELECT window_start, window_end, event_type, CAST(NULL AS VARCHAR) AS user_id, event_count
  FROM tumbling WHERE event_type IN ('page_view', 'error')
  UNION ALL
  SELECT window_start, window_end, event_type, NULL, event_count
  FROM sliding WHERE event_type = 'click'
  UNION ALL
  SELECT window_start, window_end, 'purchase', user_id, event_count FROM sessions
)
"""

ORACLE: dict[str, str] = {
    "src_envelopes": """
        SELECT count(*) AS messages, count(event_type) AS typed,
               min(ts) AS first_published, max(ts) AS last_published
        FROM events
    """,
    "parse_events": """
        SELECT CAST(event_id AS VARCHAR) AS message_id,
               CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id,
               CASE event_type WHEN 'view' THEN 'page_view' ELSE event_type END AS event_type,
               'user_' || user_id AS user_id
        FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0
    """,
    "dead_letters": REJECTS + """
        SELECT ts AS publish_time, reason,
               CASE reason WHEN 'malformed' THEN 'Message body is not one JSON document'
                           WHEN 'missing_required' THEN 'Missing required fields: event_id'
                           WHEN 'unknown_event_type' THEN 'Unknown event_type'
                           ELSE 'Empty or non-scalar event_id' END AS error, raw
        FROM rejects
    """,
    "dead_letter_summary": REJECTS + """
        SELECT reason, CAST(ts AS DATE) AS day, count(*) AS letter_count
        FROM rejects GROUP BY 1, 2
    """,
    "dead_letter_redrive": """
        SELECT CASE WHEN event_id % 97 = 0 THEN 'malformed'
                    WHEN event_type = 'signup' THEN 'unknown_event_type'
                    WHEN event_id % 89 = 0 THEN 'accepted'
                    ELSE 'bad_event_id' END AS outcome, count(*) AS message_count
        FROM events
        WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_type = 'signup'
        GROUP BY 1
    """,
    "validate_events": BASE + "SELECT event_id, event_type FROM base",
    "reject_summary": REJECTS + """
        SELECT reason AS reject_reason, count(*) AS reject_count FROM rejects GROUP BY 1
    """,
    "enrich_events": BASE + f"""
        SELECT event_id, event_type, user_id,
               CASE WHEN event_type = 'purchase' THEN value END AS amount_usd,
               CASE WHEN event_type = 'error' THEN k END AS error_code,
               CAST(NULL AS VARCHAR) AS core_in_payload, {PAYLOAD} AS payload,
               ts AS processed_at, d AS ingest_date, '1.0.0' AS pipeline_version
        FROM base
    """,
    "schema_conformance": BASE + """
        SELECT count(*) AS row_count,
               count(*) FILTER (event_id IS NULL) AS null_event_id,
               count(*) FILTER (event_type IS NULL) AS null_event_type,
               count(*) FILTER (ts IS NULL) AS null_processed_at,
               count(*) FILTER (d IS NULL) AS null_ingest_date,
               CAST(0 AS BIGINT) AS null_pipeline_version
        FROM base
    """,
    "q1_hourly_volume": BASE + """
        SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS event_count
        FROM base WHERE d >= DATE '2024-01-30' - INTERVAL 1 DAY
        GROUP BY 1, 2 ORDER BY 1 DESC, 3 DESC
    """,
    "q2_daily_active_users": BASE + """
        SELECT d AS ingest_date, count(DISTINCT user_id) AS daily_active_users
        FROM base WHERE d >= DATE '2024-01-30' - INTERVAL 7 DAY AND user_id IS NOT NULL
        GROUP BY 1 ORDER BY 1 DESC
    """,
    "q3_purchase_revenue": BASE + """
        SELECT d AS ingest_date, count(*) AS purchase_count,
               CAST(round(sum(CAST(value AS DECIMAL(28, 10))), 2) AS DOUBLE) AS revenue_usd
        FROM base WHERE d >= DATE '2024-01-30' - INTERVAL 30 DAY AND event_type = 'purchase'
        GROUP BY 1 ORDER BY 1 DESC
    """,
    "q4_ingest_health": BASE + """
        SELECT d AS ingest_date, '1.0.0' AS pipeline_version, count(*) AS total_events
        FROM base WHERE d >= DATE '2024-01-30' - INTERVAL 3 DAY
        GROUP BY 1, 2 ORDER BY 1 DESC
    """,
    "q5_top_error_codes": BASE + """
        SELECT k AS error_code, count(*) AS occurrences
        FROM base WHERE event_type = 'error' AND d = DATE '2024-01-30'
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
    "q6_type_counts_today": BASE + """
        SELECT event_type, count(*) AS events FROM base WHERE d = DATE '2024-01-30'
        GROUP BY 1 ORDER BY 2 DESC
    """,
    "q7_quality_check": BASE + """
        SELECT count(*) > 0 AS ok FROM base
        WHERE d = DATE '2024-01-30' AND event_id IS NOT NULL AND event_type IS NOT NULL
    """,
    "dq_report": BASE + """
        SELECT count(*) AS row_count,
               count(*) FILTER (event_id IS NULL) AS null_event_ids,
               count(*) FILTER (event_type IS NULL) AS null_event_types,
               count(*) > 0 AND count(*) FILTER (event_id IS NULL OR event_type IS NULL) = 0
                 AS passed
        FROM base WHERE d = DATE '2024-01-30'
    """,
    "partition_ready": BASE + """
        SELECT count(*) > 0 AS ready FROM base WHERE d = DATE '2024-01-30'
    """,
    "missing_days": BASE + """
        SELECT CAST(day AS DATE) AS ingest_date, count(base.event_id) AS total_events,
               count(base.event_id) = 0 AS is_missing
        FROM generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY) AS days(day)
        LEFT JOIN base ON base.d = CAST(days.day AS DATE)
        GROUP BY 1 ORDER BY 1 DESC
    """,
    "tumbling_assign": BASE + f"""
        SELECT event_id, {floor_to('ts', 60)} AS window_start,
               {floor_to('ts', 60)} + INTERVAL 1 MINUTE AS window_end
        FROM base
    """,
    "tumbling_counts": BASE + f", {TUMBLING} SELECT * FROM tumbling",
    "sliding_counts": BASE + f", {SLIDING} SELECT * FROM sliding",
    "session_counts": BASE + f", {sessions_sql('user_id', PLAIN_GAP)} SELECT * FROM sessions",
    "session_counts_by_type": BASE
    + f", {sessions_sql('user_id', TYPE_GAP)} SELECT * FROM sessions",
    "window_strategies": BASE + f", {STRATEGIES} SELECT * FROM strategies",
    "dedup_events": BASE + "SELECT event_id, event_type, ts AS processed_at FROM base",
    "json_value_extract": """
        SELECT event_id, json_extract_string(props, '$.k') AS k,
               CAST(NULL AS VARCHAR) AS whole, CAST(NULL AS VARCHAR) AS absent
        FROM events
    """,
    "hour_trunc": "SELECT event_id, date_trunc('hour', ts) AS hour FROM events",
    "sink_events_raw": BASE + f"""
        SELECT event_id, event_type, user_id, {PAYLOAD} AS payload, ts AS processed_at, d AS ingest_date,
               '1.0.0' AS pipeline_version
        FROM base
    """,
    "compacted_days": BASE + f"""
        SELECT event_id, event_type, user_id, {PAYLOAD} AS payload, ts AS processed_at,
               d AS ingest_date, '1.0.0' AS pipeline_version
        FROM base
    """,
    "sink_batch_rerun": BASE + """
        SELECT 'moved events' AS part, CAST(d + INTERVAL 1 DAY AS DATE) AS ingest_date,
               count(*) AS row_count
        FROM base GROUP BY 2
        UNION ALL
        SELECT 'moved letters', CAST(ts AS DATE), count(*) FROM events
        WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_type = 'signup'
        GROUP BY 2
        UNION ALL
        SELECT 'refused letters', CAST(ts AS DATE), count(*) FROM events GROUP BY 2
    """,
    "sink_dead_letters": REJECTS + """
        SELECT reason, CAST(ts AS DATE) AS day, count(*) AS letter_count
        FROM rejects GROUP BY 1, 2
    """,
    "partition_pruned_count": BASE + """
        SELECT d AS ingest_date, event_type, count(*) AS event_count
        FROM base WHERE d BETWEEN DATE '2024-01-27' AND DATE '2024-01-30' GROUP BY 1, 2
    """,
    "schema_evolution_read": BASE + """
        , kept AS (
          SELECT d, CASE WHEN event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-20'
                         THEN value END AS amount_usd
          FROM base
        )
        SELECT d AS ingest_date, count(*) AS event_count, count(amount_usd) AS amounts,
               count(*) - count(amount_usd) AS null_amounts
        FROM kept GROUP BY 1
    """,
    "gen_events": GENERATED + f"""
        SELECT substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-4' || substr(u, 14, 3) || '-'
                 || translate(substr(u, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
                 || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS event_id,
               event_type, 'user_' || (w1 % 9000 + 1000) AS user_id, ts AS event_time,
               {STAMP} AS timestamp,
               CASE WHEN event_type = 'page_view'
                    THEN ['/home', '/products', '/cart', '/checkout', '/account'][w2 % 5 + 1]
               END AS page,
               CASE WHEN event_type = 'page_view' THEN 'https://google.com' END AS referrer,
               CASE WHEN event_type = 'purchase' THEN (w2 % 49001 + 1000) / 100 END AS amount_usd,
               CASE WHEN event_type = 'purchase' THEN 'prod_' || (w3 % 900 + 100) END AS product_id,
               CASE WHEN event_type = 'error' THEN ['404', '500', '403'][w2 % 3 + 1] END
                 AS error_code
        FROM typed
    """,
    "gen_envelopes": GENERATED + """
        SELECT event_type, 'accepted' AS outcome, count(*) AS message_count
        FROM typed GROUP BY 1
    """,
    # Streams run to their end give all windows, the open ones among them.
    "stream_tumbling_counts": BASE + f", {TUMBLING} SELECT * FROM tumbling",
    "stream_sliding_counts": BASE + f", {SLIDING} SELECT * FROM sliding",
    "stream_session_counts": BASE
    + f", {sessions_sql('user_id', PLAIN_GAP)} SELECT * FROM sessions",
    "stream_session_counts_by_type": BASE
    + f", {sessions_sql('user_id', TYPE_GAP)} SELECT * FROM sessions",
    "stream_window_strategies": BASE + f", {STRATEGIES} SELECT * FROM strategies",
    # The stream alone: windows that end by an hour before the last event.
    "stream_strategies_silent_type": BASE + f""", {STRATEGIES}
        SELECT * FROM strategies
        WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM base)
    """,
    "stream_dedup_late": BASE + "SELECT event_id, event_type, user_id FROM base",
    "stream_dedup_events": BASE + "SELECT event_id, event_type, user_id FROM base",
    # The held-back tenth counts only where its window was still open.
    "late_data": BASE + """
        , marked AS (
          SELECT date_trunc('hour', ts) AS window_start, event_type,
                 CAST(event_id AS BIGINT) % 10 = 3 AS held_back, ts
          FROM base
        ),
        mark AS (
          SELECT max(ts) FILTER (NOT held_back) - INTERVAL 2 DAY AS closed,
                 max(ts) - INTERVAL 2 DAY AS final FROM marked
        ),
        counted AS (
          SELECT window_start, event_type,
                 count(*) FILTER (NOT held_back OR window_start + INTERVAL 1 HOUR > closed)
                   AS event_count, count(*) AS rows
          FROM marked, mark WHERE window_start + INTERVAL 1 HOUR <= final
          GROUP BY 1, 2
        )
        SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type,
               event_count, rows - event_count AS late_count,
               CASE WHEN rows > event_count THEN 'behind_watermark' END AS reason
        FROM counted
    """,
    "table_read_during_rewrite": BASE + """
      SELECT 'before' AS reader, d AS ingest_date, count(*) AS row_count FROM base GROUP BY d
      UNION ALL
      SELECT 'after', CAST(d + CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS DATE), count(*)
      FROM base GROUP BY 2
    """,
    "table_user_lookup": BASE + """
      SELECT event_id, event_type, user_id, ts AS processed_at, d AS ingest_date FROM base
      WHERE event_type IN ('click', 'purchase')
        AND user_id IN (SELECT 'user_' || n FROM range(1, 13) AS r(n))
    """,
    "schema_versions": BASE + """
      SELECT d AS ingest_date, count(*) AS event_count,
             count(CASE WHEN event_type = 'error' AND CAST(event_id AS BIGINT) % 3 > 0 THEN 1 END) AS codes,
             CAST(sum(CASE WHEN event_type <> 'error' THEN NULL
                           WHEN CAST(event_id AS BIGINT) % 3 = 1 THEN CAST(k AS BIGINT)
                           WHEN CAST(event_id AS BIGINT) % 3 = 2 THEN CAST(k AS BIGINT) + 1099511627776 END) AS BIGINT) AS code_sum,
             count(CASE WHEN event_type = 'purchase' AND CAST(event_id AS BIGINT) % 3 = 2 THEN 1 END) AS amounts
      FROM base GROUP BY d
    """,
    "exact_json": """
      SELECT '1' || lpad(event_id::VARCHAR, 44, '0') AS event_id,
             CASE event_type WHEN 'view' THEN 'page_view' ELSE event_type END AS event_type,
             CASE WHEN event_id % 2 = 0 THEN '7' || lpad(event_id::VARCHAR, 44, '0')
                  ELSE 'user_' || user_id END AS user_id,
             '{"beyond":[-' || event_id || '.50e400,0.' || lpad(event_id::VARCHAR, 44, '0')
             || '],"text":"\\ud800 \\\\ud800 \\ud83d' || event_id || '"}' AS payload,
             ts AS processed_at
      FROM events WHERE event_type <> 'signup'
    """,
    "stream_late_rows": BASE + """
        , marked AS (
          SELECT event_id, event_type, ts, date_trunc('hour', ts) AS window_start,
                 CAST(event_id AS BIGINT) % 10 = 3 AS held_back
          FROM base
        ),
        mark AS (SELECT max(ts) FILTER (NOT held_back) - INTERVAL 2 DAY AS closed FROM marked),
        counted AS (SELECT *, count(*) OVER (PARTITION BY event_type, window_start) AS event_count FROM marked)
        SELECT event_id, event_type, ts AS publish_time, window_start, event_count
        FROM counted, mark WHERE held_back AND window_start + INTERVAL 1 HOUR <= closed
    """,
    "stream_sliding_panes": BASE + f", {SLIDING} SELECT * FROM sliding",
    "dead_letter_redrive_twice": REJECTS + """
        , letters AS (
          SELECT ts, any_value(CASE WHEN event_id % 97 = 0 THEN 'malformed'
                                    WHEN event_type = 'signup' THEN 'unknown_event_type'
                                    WHEN event_id % 89 = 0 THEN 'accepted'
                                    ELSE 'bad_event_id' END) AS outcome
          FROM rejects GROUP BY ts, raw, reason
        )
        SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 ELSE 2 END AS attempt, outcome, count(*) AS row_count
        FROM letters GROUP BY 1, 2
        UNION ALL
        SELECT 0, 'in the table', count(*) FROM letters WHERE outcome = 'accepted'
    """,
}
# The same results, however they come about.
for _name, _same in (("q1_rollup", "q1_hourly_volume"), ("q4_rollup", "q4_ingest_health"),
                     ("q5_rollup", "q5_top_error_codes"), ("q2_incremental", "q2_daily_active_users"),
                     ("sink_dedup_across_runs", "sink_events_raw")):
    ORACLE[_name] = ORACLE[_same]
