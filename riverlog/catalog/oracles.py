"""The same results in DuckDB SQL, read from the tables and never from JSON."""

from __future__ import annotations

_LOGS = """logs AS (
  SELECT event_id, ts, epoch_us(ts) AS ts_us, user_id, event_type, value, props,
         CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info'
              WHEN 'signup' THEN 'info' WHEN 'purchase' THEN 'warn'
              WHEN 'error' THEN 'error' END AS level,
         concat(event_type, ' by ', user_id) AS message,
         concat('svc', user_id % 5) AS source
  FROM events)"""

# A timestamp as RFC 3339 text without trailing zeros, less the zone.
_STAMP = "regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '')"

_NOW_US = "1704067200000000"

_SHORT_LINE = (
    "concat('{\"ts\":\"', " + _STAMP.format(ts="ts") + ", 'Z\",\"severity\":\"', level, "
    "'\",\"msg\":\"event ', event_id, '\",\"event_id\":', event_id, ',\"user_id\":', user_id, '}')"
)

# The dirty lines after parsing: kinds 0-3 are malformed, 4 has no keys at all.
_DIRTY = (
    _LOGS
    + f""", dirty AS (
  SELECT event_id, source, event_id % 20 AS kind,
         CASE WHEN event_id % 20 IN (4, 5) THEN {_NOW_US} ELSE ts_us END AS ts_us,
         CASE WHEN event_id % 20 IN (4, 6) THEN '' ELSE level END AS level,
         CASE WHEN event_id % 20 = 4 THEN '' ELSE message END AS message,
         CASE WHEN event_id % 20 <> 4 THEN user_id END AS user_id
  FROM logs)"""
)

_TWELVE_HOURS = "43200000000"

_DEDUP = (
    _LOGS
    + f""", marked AS (
  SELECT *, concat_ws(' ', user_id, event_type) AS k,
         lag(ts_us) OVER (PARTITION BY user_id, event_type ORDER BY ts_us, event_id) AS before
  FROM logs), heads AS (
  SELECT *, (before IS NULL OR ts_us - before >= {_TWELVE_HOURS})::INT AS head FROM marked)"""
)

_RATE = (
    _LOGS
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_us, event_id) AS i FROM logs
), slack AS (
  SELECT *, max(ts_us - i * 1000000000) OVER (
      PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM ranked
), shaped AS (
  SELECT event_id, source, ts_us,
         greatest(ts_us, (i - 1) * 1000000000 + s)::BIGINT AS release_at FROM slack)"""
)


def _keep(key: str, seed: str, rate: str) -> str:
    return f"('0x' || substr(md5(concat({key}, '{seed}')), 1, 8))::BIGINT / 4294967296.0 < {rate}"


_POLLS = """polls AS (
  SELECT o_custkey AS path, o_orderdate AS poll_ts, o_orderkey AS poll_id,
         CASE WHEN o_orderstatus <> 'F' THEN 'available' ELSE 'missing' END AS state,
         o_orderkey % 3 AS inode, floor(o_totalprice)::BIGINT AS size
  FROM orders)"""

_MARKS = (
    _LOGS
    + """, marks AS (
  SELECT source, arg_max(ts, rank) AS mark FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY value, event_id) AS rank FROM logs)
  GROUP BY source)"""
)

ORACLES: dict[str, str] = {
    "level_counts": f"""WITH {_LOGS}
SELECT upper(level) AS level, source, count(*) AS entries, max(ts_us) AS last_us
FROM logs WHERE level IN ('info', 'warn', 'error') GROUP BY 1, 2""",
    "scan_lines": f"""WITH {_LOGS} SELECT 'events' AS source, {_SHORT_LINE} AS line FROM logs""",
    "scan_positions": f"""WITH {_LOGS}, lines AS (SELECT strlen({_SHORT_LINE}) + 1 AS size FROM logs)
SELECT count(*) AS lines, sum(size)::BIGINT AS bytes, sum(size)::BIGINT AS bytes_by_position FROM lines""",
    "tail_lines": f"""WITH {_LOGS} SELECT 'events' AS source, event_id, level, ts_us FROM logs""",
    "tail_rotation": f"""WITH {_LOGS}
SELECT 'app' AS source, event_id, level, 1::BIGINT AS times FROM logs""",
    "union_sources": f"""WITH {_LOGS}
SELECT 'app' AS source, count(*) AS lines, sum(strlen({_SHORT_LINE}))::BIGINT AS bytes, 'gone' AS skipped
FROM logs
UNION ALL
SELECT 'shop', count(*), sum(strlen(o_orderkey::VARCHAR))::BIGINT, 'gone' FROM orders""",
    "parse_entries": f"""WITH {_LOGS}
SELECT event_id, ts_us, level, message, source, user_id, event_type, value, props FROM logs""",
    "parse_dirty": f"""WITH {_DIRTY}
SELECT event_id, ts_us, level, message, user_id FROM dirty WHERE kind NOT IN (0, 1, 2, 3)""",
    "malformed_lines": f"""WITH {_LOGS}
SELECT event_id, source,
       CASE event_id % 20 WHEN 0 THEN 'empty line' WHEN 3 THEN 'not an object' ELSE 'invalid JSON' END AS reason
FROM logs WHERE event_id % 20 IN (0, 1, 2, 3)""",
    "raw_passthrough": f"""WITH {_DIRTY}, lines AS (
  SELECT event_id, concat('{{"ts":"', {_STAMP.format(ts="ts")}, 'Z","severity":"', level, '","msg":"', message,
         '","user_id":', user_id, ',"event_type":"', event_type, '","value":,"props":', to_json(props), '}}') AS line
  FROM logs)
SELECT event_id,
       CASE WHEN kind <= 3 THEN '' ELSE level END AS level,
       CASE kind WHEN 0 THEN '' WHEN 1 THEN 'plain ' || event_id WHEN 2 THEN line || ' x'
            WHEN 3 THEN '[' || line || ']' ELSE message END AS text,
       kind <= 3 AS is_line,
       (CASE WHEN kind <= 4 THEN 0 ELSE 4 END)::BIGINT AS n_fields
FROM dirty JOIN lines USING (event_id)""",
    "entry_json": f"""WITH {_LOGS}
SELECT {_STAMP.format(ts="ts")} || 'Z' AS timestamp, level, message, source,
       user_id::VARCHAR AS user_id, props, 'event_type,props,user_id,value' AS field_names,
       true AS no_raw FROM logs""",
    "filter_fields": f"""WITH {_LOGS}
SELECT event_id, level, user_id FROM logs
WHERE level IN ('error', 'warn') AND event_type IN ('purchase', 'view')""",
    "min_level": f"""WITH {_LOGS} SELECT event_id, level FROM logs WHERE level IN ('warn', 'error')""",
    "sample_hash": f"""SELECT event_id FROM events WHERE {_keep("event_id", "7", "0.1")}""",
    "sample_rand_bounds": "SELECT true AS within_bounds, true AS each_once, 0::BIGINT AS strange, 0::BIGINT AS different",
    "sample_stats": f"""SELECT count(*) FILTER (WHERE {_keep("event_id", "7", "0.25")}) AS kept,
       count(*) FILTER (WHERE NOT ({_keep("event_id", "7", "0.25")})) AS dropped FROM events""",
    "schema_valid": f"""WITH {_DIRTY}
SELECT event_id, level FROM dirty WHERE kind NOT IN (0, 1, 2, 3, 4, 6)""",
    "schema_violations": f"""WITH {_DIRTY}
SELECT event_id,
       CASE kind WHEN 4 THEN 'required field user_id is missing'
                 WHEN 6 THEN 'required field level is missing'
                 ELSE 'field props must be a number, got string' END AS violation
FROM dirty WHERE kind > 3""",
    "dedup_window": f"""WITH {_DEDUP} SELECT event_id, message FROM heads WHERE head = 1""",
    "dedup_bursts": f"""WITH {_DEDUP}, bursts AS (
  SELECT *, sum(head) OVER (PARTITION BY k ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS burst
  FROM heads)
SELECT sha256(k) AS key_hash, min(ts_us) AS first_at, max(ts_us) AS last_at, count(*) AS occurrences
FROM bursts GROUP BY k, burst""",
    "dedup_live_size": f"""WITH {_LOGS}, last AS (
  SELECT max(ts_us) AS t FROM logs GROUP BY user_id, event_type)
SELECT count(*) AS live_lines FROM last WHERE t >= (SELECT max(ts_us) FROM logs) - {_TWELVE_HOURS}""",
    "add_field": """SELECT event_id, 'prod' AS env, 'set' AS event_type, 5::BIGINT AS n_fields FROM events""",
    "remove_field": """SELECT event_id, NULL::VARCHAR AS props, 3::BIGINT AS n_fields FROM events""",
    "normalise_level": f"""WITH {_LOGS} SELECT event_id, upper(level) AS level FROM logs""",
    "mask_field": """SELECT event_id, '***' AS user_id, 4::BIGINT AS n_fields FROM events""",
    "transform_chain": f"""WITH {_LOGS}
SELECT event_id, upper(level) AS level, 'hidden' AS env, 4::BIGINT AS n_fields FROM logs""",
    "redact_fields": """SELECT doc_id, '[REDACTED]' AS origin, lang FROM documents""",
    "redact_pattern": """SELECT doc_id,
       CASE WHEN contains(text, '@') THEN '***' ELSE text END AS message,
       CASE WHEN starts_with(lang, 'e') THEN '[REDACTED]' ELSE lang END AS lang, n_chars
FROM documents""",
    "rename_fields": f"""WITH {_LOGS}
SELECT event_id, '' AS level, props AS source, event_type AS user_id, user_id::VARCHAR AS event_type,
       level AS severity, NULL::VARCHAR AS props FROM logs""",
    "truncate_bytes": """WITH bytes AS (SELECT doc_id, text, lang, hex(encode(text)) AS h FROM documents)
SELECT doc_id,
       CASE WHEN strlen(text) <= 40 THEN h
            WHEN substr(h, 75, 1) IN ('8', '9', 'A', 'B')
            THEN regexp_replace(substr(h, 1, 74), '[C-F].([89AB].){0,2}$', '') || 'EFBFBD2E2E2E'
            ELSE substr(h, 1, 74) || '2E2E2E' END AS message_hex,
       lang
FROM bytes""",
    "timestamp_text": f"""SELECT event_id, {_STAMP.format(ts="ts")} || 'Z' AS utc,
       {_STAMP.format(ts="timezone('America/New_York', timezone('UTC', ts))")} || '-05:00' AS new_york,
       {_STAMP.format(ts="ts + INTERVAL 330 MINUTE")} || '+05:30' AS kolkata
FROM events""",
    "envelope_seq": """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq,
       'events.log' AS envelope_source FROM events""",
    "multiline_coalesce": """WITH turns AS (
  SELECT *, CASE WHEN role = 'user' THEN text ELSE chr(9) || text END AS line,
         sum((NOT starts_with(CASE WHEN role = 'user' THEN text ELSE chr(9) || text END, chr(9)))::INT) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g
  FROM conversations)
SELECT conv_id, min(turn) AS turn, string_agg(line, chr(10) ORDER BY turn) AS message,
       arg_min(role, turn) AS role
FROM turns GROUP BY conv_id, g""",
    "batch_by_size": f"""WITH {_LOGS}
SELECT event_id, source,
       (row_number() OVER (PARTITION BY source ORDER BY ts_us, event_id) - 1) // 25 + 1 AS batch_id
FROM logs""",
    "batch_size_or_time": """WITH RECURSIVE ranked AS (
  SELECT event_id, user_id, epoch_us(ts) AS a,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), fold AS (
  SELECT user_id, event_id, i, a + 129600000000 AS deadline, 1 AS held, 1::BIGINT AS batch_id,
         1::BIGINT AS open_id
  FROM ranked WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i,
         CASE WHEN h = 4 THEN a + 129600000000 ELSE d END,
         CASE WHEN h = 4 THEN 0 ELSE h END,
         b,
         CASE WHEN h = 4 THEN b + 1 ELSE b END
  FROM (
    SELECT r.user_id, r.event_id, r.i, r.a,
           CASE WHEN r.a >= f.deadline
                THEN f.deadline + ((r.a - f.deadline) // 129600000000 + 1) * 129600000000
                ELSE f.deadline END AS d,
           CASE WHEN r.a >= f.deadline THEN 1 ELSE f.held + 1 END AS h,
           CASE WHEN r.a >= f.deadline AND f.held > 0 THEN f.open_id + 1 ELSE f.open_id END AS b
    FROM fold f JOIN ranked r ON r.user_id = f.user_id AND r.i = f.i + 1)
)
SELECT event_id, user_id, batch_id FROM fold""",
    "keep_latest": """WITH ranked AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r,
         count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, least(n, 5) - r + 1 AS buffer_pos FROM ranked WHERE r <= 5""",
    "keep_latest_daily": f"""WITH {_LOGS}, ranked AS (
  SELECT event_id, source,
         row_number() OVER (PARTITION BY source, ts::DATE ORDER BY ts DESC, event_id DESC) AS r,
         count(*) OVER (PARTITION BY source, ts::DATE) AS n FROM logs)
SELECT event_id, source, least(n, 10) - r + 1 AS buffer_pos FROM ranked WHERE r <= 10""",
    "buffer_flush_stream": f"""WITH {_LOGS}, ranked AS (
  SELECT event_id, ts_us, level, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC) AS r
  FROM logs WHERE level = 'warn')
SELECT event_id, ts_us, level FROM ranked WHERE r <= 10""",
    "rate_shape": f"""WITH {_RATE}
SELECT event_id, source, release_at, release_at - ts_us AS delay FROM shaped""",
    "rate_stats": f"""WITH {_RATE}
SELECT source, count(*) AS entries, count(*) FILTER (WHERE release_at = ts_us) AS immediate,
       count(*) FILTER (WHERE release_at > ts_us) AS delayed, 0::BIGINT AS never,
       max(release_at - ts_us) AS max_delay, sum(release_at - ts_us)::BIGINT AS total_delay
FROM shaped GROUP BY source""",
    "route_entries": """SELECT event_id, CASE event_type WHEN 'error' THEN 'alerts' ELSE 'money' END AS route
FROM events WHERE event_type IN ('error', 'purchase')""",
    "route_counts": """SELECT CASE event_type WHEN 'error' THEN 'alerts' WHEN 'purchase' THEN 'money'
       ELSE 'rest' END AS route, count(*) AS entries FROM events GROUP BY 1""",
    "file_sink_roundtrip": f"""WITH {_LOGS}
SELECT ts_us, level, message, source AS origin, user_id, value FROM logs""",
    "fan_out": """SELECT s AS source, (SELECT count(*) FROM events) AS lines, 'disk full' AS errors
FROM (VALUES ('a'), ('b')) AS t(s)""",
    "http_delivery": f"""WITH {_LOGS}
SELECT level, count(*) AS entries, sum(user_id)::BIGINT AS users, max(message) AS last_message,
       (SELECT count(*) FROM events) AS delivered, 0::BIGINT AS failed
FROM logs GROUP BY level""",
    "dead_letters": f"""WITH {_LOGS}
SELECT CASE level WHEN 'error' THEN 'alerts' ELSE 'delivered' END AS sink,
       CASE level WHEN 'error' THEN 3::BIGINT END AS attempts, level, message, user_id, value
FROM logs""",
    "one_pass_delivery": f"""WITH {_LOGS}, sent AS (
  SELECT 'all' AS sink, level AS folder, * FROM logs
  UNION ALL SELECT 'sample', '', * FROM logs
    WHERE ('0x' || substr(md5(concat(event_id, '7')), 1, 8))::BIGINT / 4294967296.0 < 0.25
  UNION ALL SELECT 'alerts', '', * FROM logs WHERE level = 'error'
  UNION ALL SELECT 'money', source, * FROM logs WHERE level <> 'error' AND event_type IN ('purchase', 'error'))
SELECT sink, folder, count(*) AS entries, sum(user_id)::BIGINT AS users, min(message) AS first_message
FROM sent GROUP BY sink, folder""",
    "job_resume": f"""WITH {_LOGS}
SELECT event_id, 1::BIGINT AS deliveries, level FROM logs""",
    "delivery_watermark": f"""WITH {_MARKS}
SELECT source, strftime(mark, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS watermark FROM marks""",
    "incremental_resume": f"""WITH {_LOGS}, placed AS (
  SELECT event_id, source, event_id % 100 AS tick FROM logs), marks AS (
  SELECT source, max((tick, event_id)) AS mark FROM placed
  WHERE source <> 'svc0' AND (tick < 60 OR (tick = 60 AND event_id < 500)) GROUP BY source)
SELECT event_id, p.source FROM placed p LEFT JOIN marks m ON m.source = p.source
WHERE m.mark IS NULL OR (p.tick, p.event_id) > m.mark""",
    "spec_job": f"""WITH {_LOGS}, newest AS (
  SELECT event_id FROM logs WHERE level = 'warn' ORDER BY ts DESC LIMIT 20)
SELECT 'errors' AS source, level, concat('event ', event_id) AS message FROM logs WHERE level = 'error'
UNION ALL
SELECT 'newest', level, concat('event ', event_id) FROM logs WHERE event_id IN (SELECT event_id FROM newest)
UNION ALL
SELECT 'sampled', level, concat('event ', event_id) FROM logs
WHERE level NOT IN ('error', 'warn') AND {_keep("concat('event ', event_id)", "3", "0.5")}""",
    "pipeline_counters": f"""WITH {_DIRTY}, lines AS (
  SELECT source, kind > 3 AS ok,
         (kind > 3 AND level IN ('info', 'warn', 'error'))::BIGINT AS w,
         (kind > 3 AND level = 'error')::BIGINT AS e FROM dirty)
SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS lines_read,
       count(*) FILTER (WHERE ok) AS lines_parsed, count(*) FILTER (WHERE NOT ok) AS parse_errors,
       sum(w)::BIGINT AS sink_writes, sum(e)::BIGINT AS sink_errors,
       count(*) FILTER (WHERE w = 0) AS lines_dropped
FROM lines GROUP BY ROLLUP (source)""",
    "live_counters": f"""WITH {_DIRTY}, counted AS (
  SELECT count(*) AS lines_read, count(*) FILTER (WHERE kind > 3) AS lines_parsed,
         count(*) FILTER (WHERE kind <= 3) AS parse_errors,
         count(*) FILTER (WHERE kind > 3 AND level IN ('info', 'warn', 'error')) AS sink_writes,
         count(*) FILTER (WHERE kind > 3 AND level = 'error') AS sink_errors,
         count(*) - count(*) FILTER (WHERE kind > 3 AND level IN ('info', 'warn', 'error')) AS lines_dropped
  FROM dirty)
SELECT s AS source, counted.* FROM counted, (VALUES ('app'), ('*')) AS t(s)""",
    "health_report": f"""WITH {_LOGS}, ages AS (
  SELECT source, (SELECT max(ts_us) FROM logs) - max(ts_us) AS age FROM logs GROUP BY source)
SELECT bool_and(age <= 600000000) AS healthy,
       string_agg(CASE WHEN age <= 600000000 THEN concat(source, ' true')
                       ELSE concat(source, ' false silent for ', age // 1000000, ' s') END,
                  '; ' ORDER BY source) AS components
FROM ages""",
    "state_transitions": f"""WITH {_POLLS}, seen AS (
  SELECT *, lag(state) OVER (PARTITION BY path ORDER BY poll_ts, poll_id) AS before FROM polls)
SELECT path, poll_id, state FROM seen WHERE before IS NULL OR before <> state""",
    "rotation_events": f"""WITH {_POLLS}, seen AS (
  SELECT *, lag(inode) OVER w AS inode_before, lag(size) OVER w AS size_before FROM polls
  WINDOW w AS (PARTITION BY path ORDER BY poll_ts, poll_id))
SELECT path, poll_id, CASE WHEN inode <> inode_before THEN 'inode_changed' ELSE 'truncated' END AS reason
FROM seen WHERE inode_before IS NOT NULL AND (inode <> inode_before OR size < size_before)""",
}
