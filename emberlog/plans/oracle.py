"""The registered queries as SQL for another engine, over the same tables."""

from __future__ import annotations

from emberlog.plans.params import (ARCHIVE_DAYS, AS_OF, BURST, COUNT_END, COUNT_START, DAY,
                                   DENSE_BURST, REPEAT_THRESHOLD, REPEAT_WINDOW, RETENTION_DAYS,
                                   STATUS_AS_OF)

ORACLE_SQL: dict[str, str] = {}

LOGS = """logs AS (
  SELECT event_id AS id, concat('svc-', CAST(user_id % 10 AS VARCHAR)) AS source,
         concat(event_type, ' event while handling request: ', props) AS content,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG'
                         WHEN 'signup' THEN 'trace' ELSE 'INFO' END AS log_level,
         ts AS created_at
  FROM events)"""

DOC_LOGS = """doc_logs AS (
  SELECT doc_id AS id, source, text AS content,
         CASE WHEN doc_id % 20 = 0 THEN 'ERROR' WHEN doc_id % 20 <= 3 THEN 'WARN'
              WHEN doc_id % 20 <= 15 THEN 'INFO' ELSE 'DEBUG' END AS log_level,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id % 43200) AS created_at
  FROM documents)"""

GAPPY = LOGS + """, gappy AS (
  SELECT id, CASE WHEN source = 'svc-3' THEN CASE WHEN id % 2 = 0 THEN '  ' ELSE concat(' ', chr(9), chr(10)) END
              WHEN source <> 'svc-7' THEN source END AS source, content,
         CASE WHEN log_level = 'trace' THEN '' WHEN log_level <> 'DEBUG' THEN log_level END AS "logLevel",
         CASE WHEN log_level <> 'WARN' THEN created_at END AS timestamp
  FROM logs)"""

NORMAL = GAPPY + f""", normal AS (
  SELECT id, CASE WHEN source IS NULL OR regexp_full_match(source, '[\\x00-\\x20]*') THEN 'unknown' ELSE source END AS source, content,
         CASE WHEN "logLevel" IS NULL OR regexp_full_match("logLevel", '[\\x00-\\x20]*') THEN 'INFO' ELSE "logLevel" END AS "logLevel",
         coalesce(timestamp, TIMESTAMP '{AS_OF}') AS timestamp
  FROM gappy)"""

LINES = LOGS + """, lines AS (
  SELECT concat(strftime(created_at, '%Y-%m-%d %H:%M:%S.%g'), ' [main] ', log_level, ' ', source, ' - ', content)
         AS value
  FROM logs)"""

GOOD = LOGS + """, good AS (SELECT * FROM logs WHERE source <> 'svc-4')"""

HOURLY = """SELECT CAST(created_at AS DATE) AS log_date, CAST(hour(created_at) AS INTEGER) AS hour,
  source, log_level, count(*) AS "count" FROM {rows} GROUP BY 1, 2, 3, 4"""

STATS = LOGS + f", stats AS ({HOURLY.format(rows='logs')})"

# Words run on over marks that join two letters or two digits. A private-use character is put behind
# every such mark; two passes reach the marks that share a neighbour.
LETTERS, DIGITS = r"\p{L}\p{Nl}\p{M}", r"\p{Nd}"
LETTER_MARKS, DIGIT_MARKS = r":.''\x{b7}\x{2018}\x{2019}\x{2024}\x{2027}", r".,;''\x{2018}\x{2019}\x{2024}\x{2044}"
JOINED = "lower(content)"
for run, marks in ((LETTERS, LETTER_MARKS), (DIGITS, DIGIT_MARKS)):
    for _ in range(2):
        JOINED = rf"regexp_replace({JOINED}, '([{run}])([{marks}])([{run}])', '\1\2' || chr(57344) || '\3', 'g')"

TOKENS = DOC_LOGS + rf""", joined AS (SELECT id, {JOINED} AS body FROM doc_logs),
found AS (SELECT id, unnest(regexp_extract_all(body,
  '(?:[{LETTERS}{DIGITS}_]|[{LETTER_MARKS};,\x{{2044}}]\x{{E000}})+')) AS term FROM joined),
words AS (SELECT id, replace(term, chr(57344), '') AS term FROM found WHERE ltrim(term, '_') <> '')"""

LEVEL_OF_LINE = """CASE WHEN contains({c}, 'ERROR') THEN 'ERROR' WHEN contains({c}, 'WARN') THEN 'WARN'
  WHEN contains({c}, 'DEBUG') THEN 'DEBUG' ELSE 'INFO' END"""

KNOWN = "CASE WHEN upper({c}) IN ('ERROR', 'WARN', 'INFO', 'DEBUG') THEN upper({c}) ELSE 'INFO' END"

RANK = """CASE upper({c}) WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3 WHEN 'INFO' THEN 2 WHEN 'DEBUG' THEN 1
  ELSE 0 END"""

LEVEL_COUNTS = """count(*) FILTER (log_level = 'ERROR') AS error, count(*) FILTER (log_level = 'WARN') AS warn,
  count(*) FILTER (log_level = 'INFO') AS info, count(*) FILTER (log_level = 'DEBUG') AS debug"""

LEVEL_SUMS = ", ".join(
    f"""CAST(coalesce(sum("count") FILTER (upper(log_level) = '{level}'), 0) AS BIGINT) AS {level.lower()}"""
    for level in ("ERROR", "WARN", "INFO", "DEBUG"))

IN_RANGE = f"created_at BETWEEN TIMESTAMP '{COUNT_START}' AND TIMESTAMP '{COUNT_END}'"
IN_DAYS = f"log_date BETWEEN CAST(TIMESTAMP '{COUNT_START}' AS DATE) AND CAST(TIMESTAMP '{COUNT_END}' AS DATE)"

UTF16 = r"""CAST(length({c}) + length(regexp_replace({c}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS INTEGER)"""

BASE64_GZIP = r"""(regexp_matches({c}, '\AH4[stuv][A-Za-z0-9+/]*={{0,2}}\z')
  AND CASE WHEN suffix({c}, '=') THEN length({c}) % 4 = 0 ELSE length({c}) % 4 <> 1 END)"""


def rate(part: str, whole: str) -> str:
    return (f"CASE WHEN {whole} > 0 THEN floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 * 100"
            f" + 0.5) / 100.0 ELSE 0.0::DOUBLE END")


def status(error_rate: str, response: str) -> str:
    return (f"CASE WHEN {error_rate} > 15.0 OR {response} > 500 THEN 'DEGRADED'"
            f" WHEN {error_rate} > 5.0 OR {response} > 200 THEN 'WARNING' ELSE 'UP' END")


def burst(scope: str, window_seconds: int, threshold: int, cooldown_seconds: int) -> str:
    """CTEs up to ``fired``: a walk over the errors of each scope, one at a time."""
    window, cooldown = window_seconds * 1_000_000, cooldown_seconds * 1_000_000
    fires = (f"e.us - w.anchor <= {window} AND w.n + 1 = {threshold}"
             f" AND (w.alerted IS NULL OR e.us - w.alerted > {cooldown})")
    return f"""WITH RECURSIVE {LOGS}, e AS (
      SELECT {scope} AS scope, id, epoch_us(created_at) AS us,
             row_number() OVER (PARTITION BY {scope} ORDER BY created_at, id) AS rn
      FROM logs WHERE upper(log_level) = 'ERROR'),
    walk AS (
      SELECT scope, id, us, rn, us AS anchor, 1 AS n, CAST(NULL AS BIGINT) AS alerted, FALSE AS fired
      FROM e WHERE rn = 1
      UNION ALL
      SELECT e.scope, e.id, e.us, e.rn,
             CASE WHEN e.us - w.anchor > {window} THEN e.us ELSE w.anchor END,
             CASE WHEN e.us - w.anchor > {window} THEN 1 ELSE w.n + 1 END,
             CASE WHEN {fires} THEN e.us ELSE w.alerted END, {fires}
      FROM walk w JOIN e ON e.scope = w.scope AND e.rn = w.rn + 1),
    fired AS (SELECT w.scope, l.* FROM walk w JOIN logs l ON l.id = w.id WHERE w.fired)"""


BURST_ALL = burst("'all'", **BURST)

SIMILAR = f"""{LOGS}, similar_errors AS (
  SELECT id, source, content, created_at, log_level, substr(content, 1, 30) AS message_pattern,
         epoch_us(created_at) AS us
  FROM logs WHERE log_level = 'ERROR'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, message_pattern ORDER BY us, id) AS position,
         row_number() OVER (PARTITION BY source, message_pattern ORDER BY us, id)
         - count(*) OVER (PARTITION BY source, message_pattern ORDER BY us
                          RANGE BETWEEN UNBOUNDED PRECEDING AND {REPEAT_WINDOW * 1_000_000 + 1} PRECEDING)
         AS repeat_count
  FROM similar_errors),
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY source, message_pattern ORDER BY us, id) AS rn
  FROM numbered WHERE repeat_count >= {REPEAT_THRESHOLD})"""

REPEATS = f"""WITH RECURSIVE {SIMILAR}, walk AS (
  SELECT source, message_pattern, id, rn, us AS reported, TRUE AS fired FROM candidates WHERE rn = 1
  UNION ALL
  SELECT c.source, c.message_pattern, c.id, c.rn,
         CASE WHEN c.us - w.reported > {REPEAT_WINDOW * 500_000} THEN c.us ELSE w.reported END,
         c.us - w.reported > {REPEAT_WINDOW * 500_000}
  FROM walk w JOIN candidates c
    ON c.source = w.source AND c.message_pattern = w.message_pattern AND c.rn = w.rn + 1),
detected AS (SELECT c.* FROM candidates c JOIN walk w ON c.id = w.id WHERE w.fired)"""

REPEAT_TEXT = ("concat('Repeated error: source ''', source, ''' logged ', {count}, ' similar errors within ',"
               " {seconds}, ' seconds. Latest error: ', content)")


def put(name: str, sql: str) -> None:
    ORACLE_SQL[name] = sql.strip()


# --- sources ------------------------------------------------------------------------------------
put("read_log_files", f"WITH {LINES} SELECT value AS content, {LEVEL_OF_LINE.format(c='value')} AS log_level FROM lines")
put("tail_log_files", ORACLE_SQL["read_log_files"])
put("decode_events", f"""WITH {GOOD} SELECT source, content, log_level AS "logLevel", created_at AS timestamp FROM good""")
put("read_event_stream", ORACLE_SQL["decode_events"])
put("decode_rejects", f"""WITH {LOGS} SELECT '{{"source":"svc-4","conten' AS raw, 'malformed json' AS reason
  FROM logs WHERE source = 'svc-4'""")
put("scan_old_logs", f"""WITH {LOGS} SELECT * FROM logs
  WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL {ARCHIVE_DAYS} DAY""")
put("scan_day_logs", f"""WITH {LOGS} SELECT * FROM logs WHERE created_at >= TIMESTAMP '{DAY} 00:00:00'
  AND created_at < TIMESTAMP '{DAY} 00:00:00' + INTERVAL 1 DAY""")
put("find_by_id", f"WITH {LOGS} SELECT * FROM logs WHERE id = 42")
put("count_all", "SELECT count(*) AS total FROM events")
put("ingest_request", f"""WITH {LOGS} SELECT source, content, log_level AS "logLevel",
  TIMESTAMP '{AS_OF}' AS timestamp FROM logs""")

# --- sinks --------------------------------------------------------------------------------------
put("write_logs", f"""WITH {LOGS} SELECT *, FALSE AS compressed, 0 AS original_size, 0 AS compressed_size,
  CAST(created_at AS DATE) AS log_date FROM logs""")
put("publish_events", f"""WITH {LOGS} SELECT source AS "key", source, content, log_level AS "logLevel",
  created_at AS timestamp FROM logs""")
put("index_documents", f"""WITH {DOC_LOGS} SELECT CAST(id AS VARCHAR) AS id, source, content, log_level,
  CAST(date_trunc('second', created_at) AS TIMESTAMP) AS timestamp FROM doc_logs""")
put("index_terms", f"WITH {TOKENS} SELECT term, count(DISTINCT id) AS documents FROM words GROUP BY term")
put("index_grams", f"""WITH {TOKENS}, vocabulary AS (SELECT DISTINCT term FROM words),
  sized AS (SELECT term, unnest(range(2, 6)) AS n FROM vocabulary),
  cut AS (SELECT term, n, unnest(range(1, CAST(length(term) - n + 2 AS BIGINT))) AS i
          FROM sized WHERE length(term) >= n),
  grams AS (SELECT DISTINCT term, substr(term, i, n) AS gram FROM cut)
  SELECT gram, count(*) AS words FROM grams GROUP BY gram""")
put("write_archive", f"""WITH {LOGS} SELECT *, FALSE AS compressed, CAST(strlen(content) AS INTEGER) AS original_size,
  CAST(strlen(content) AS INTEGER) AS compressed_size, TIMESTAMP '{AS_OF}' AS archived_at FROM logs
  WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL {ARCHIVE_DAYS} DAY""")
put("write_statistics", f"WITH {STATS} SELECT * FROM stats")
put("emit_alerts", f"""{BURST_ALL} SELECT created_at AS alert_ts, 'error-burst' AS kind, 'ERROR' AS severity,
  'Error burst detected' AS subject, concat('{BURST["threshold"]} ERROR logs within {BURST["window_seconds"]}',
  ' seconds. Latest error: ', source, ' - ', content) AS message FROM fired""")
put("export_csv", f"""WITH {LOGS} SELECT CAST(id AS VARCHAR) AS "ID", strftime(created_at, '%Y-%m-%d %H:%M:%S')
  AS "Timestamp", source AS "Source", log_level AS "Level", content AS "Content" FROM logs""")

# --- projections --------------------------------------------------------------------------------
put("normalize_events", f"WITH {NORMAL} SELECT * FROM normal")
put("derive_level", f"WITH {LINES} SELECT value, {LEVEL_OF_LINE.format(c='value')} AS log_level FROM lines")
put("enrich_events", f"""WITH {GAPPY} SELECT id, source, content, "logLevel",
  coalesce(timestamp, TIMESTAMP '{AS_OF}') AS timestamp, {KNOWN.format(c='"logLevel"')} AS route,
  TIMESTAMP '{AS_OF}' AS processed_time FROM gappy""")
put("level_rank", f"WITH {LOGS} SELECT id, {RANK.format(c='log_level')} AS level_rank FROM logs")
put("original_size", f"""WITH {DOC_LOGS} SELECT id, CAST(coalesce(strlen(content), 0) AS INTEGER) AS original_size
  FROM doc_logs""")
put("utf16_size", f"WITH {DOC_LOGS} SELECT id, {UTF16.format(c='content')} AS utf16_units FROM doc_logs")
put("compress_eligible", f"""WITH {DOC_LOGS} SELECT id, {UTF16.format(c='content')} > 1024
  AND NOT {BASE64_GZIP.format(c='content')} AS eligible FROM doc_logs""")
put("detect_compressed", f"""WITH {DOC_LOGS}, bodies AS (
  SELECT id, 'plain' AS kind, content AS body FROM doc_logs
  UNION ALL SELECT id, 'base64', base64(encode(content)) FROM doc_logs
  UNION ALL SELECT id, 'gzip', base64(from_hex('1F8B') || encode(content)) FROM doc_logs
  UNION ALL SELECT id, 'broken', base64(from_hex('1F8B') || encode(content)) || '!' FROM doc_logs)
  SELECT id, kind, {BASE64_GZIP.format(c='body')} AS compressed FROM bodies""")
put("compress_logs", f"""WITH {DOC_LOGS} SELECT id, {UTF16.format(c='content')} > 1024
  AND NOT {BASE64_GZIP.format(c='content')} AS compressed, CAST(octet_length(encode(content)) AS INTEGER) AS original_size,
  true AS comes_back, true AS fits FROM doc_logs""")
put("compression_ratio", f"""WITH {DOC_LOGS} SELECT id, CAST(octet_length(encode(content)) AS INTEGER) AS original_size,
  true AS in_range FROM doc_logs""")
put("compression_report", f"""WITH {DOC_LOGS} SELECT source, log_level, count(*) AS total_logs,
  count(*) FILTER ({UTF16.format(c='content')} > 1024 AND NOT {BASE64_GZIP.format(c='content')}) AS compressed_logs,
  CAST(sum(octet_length(encode(content))) AS BIGINT) AS original_bytes, true AS never_larger
  FROM doc_logs GROUP BY ROLLUP (source, log_level)""")
put("decompress_logs", f"""WITH {DOC_LOGS} SELECT id, {UTF16.format(c='content')} > 1024
  AND NOT {BASE64_GZIP.format(c='content')} AS compressed, content FROM doc_logs""")
put("normalize_message", f"WITH {DOC_LOGS} SELECT id, coalesce(substr(content, 1, 30), '') AS message_pattern FROM doc_logs")
put("date_hour", f"""WITH {LOGS} SELECT id, CAST(created_at AS DATE) AS log_date,
  CAST(hour(created_at) AS INTEGER) AS hour FROM logs""")
put("to_local_time", f"WITH {LOGS} SELECT id, created_at + INTERVAL 9 HOUR AS local_time FROM logs")
put("error_rate", f"""WITH {LOGS} SELECT source,
  {rate("count(*) FILTER (log_level = 'ERROR')", "count(*)")} AS error_rate FROM logs GROUP BY source""")
put("hour_label", f"""WITH {LOGS} SELECT strftime(created_at, '%H:00') AS hour, count(*) AS total
  FROM logs GROUP BY 1""")
put("response_projection", f"""WITH {LOGS} SELECT CAST(id AS VARCHAR) AS id, source, content,
  log_level AS "logLevel", created_at AS timestamp FROM logs""")
put("system_status", f"""WITH rows AS (SELECT user_id,
  {rate("count(*) FILTER (event_type = 'error')", "count(*)")} AS error_rate,
  CAST(floor(max(value)) AS BIGINT) AS response_ms FROM events GROUP BY user_id)
  SELECT *, {status("error_rate", "response_ms")} AS status FROM rows""")
put("metric_level", f"WITH {LOGS} SELECT id, {KNOWN.format(c='log_level')} AS metric_level FROM logs")
put("second_precision", f"""WITH {LOGS} SELECT id, CAST(date_trunc('second', created_at) AS TIMESTAMP) AS timestamp
  FROM logs""")
put("analyze_tokens", f"WITH {TOKENS} SELECT term, count(*) AS occurrences FROM words GROUP BY term")
put("analyze_ngrams", f"""WITH {TOKENS}, uniq AS (SELECT DISTINCT id, term FROM words),
  sized AS (SELECT id, term, unnest(range(2, 6)) AS n FROM uniq),
  cut AS (SELECT id, term, n, unnest(range(1, CAST(length(term) - n + 2 AS BIGINT))) AS i
          FROM sized WHERE length(term) >= n),
  grams AS (SELECT DISTINCT id, substr(term, i, n) AS term FROM cut)
  SELECT term, count(*) AS documents FROM grams GROUP BY term""")
put("render_messages", f"""WITH {LOGS} SELECT id,
  concat('10 ERROR logs within 60 seconds. Latest error: ', source, ' - ', content) AS burst,
  {REPEAT_TEXT.format(count="3", seconds="300")} AS repeated,
  'Log pattern detected: Repeated error' AS subject FROM logs WHERE upper(log_level) = 'ERROR'""")
put("level_share", f"""WITH {LOGS}, known AS (SELECT log_level AS level, count(*) AS value FROM logs
  WHERE {IN_RANGE} AND log_level IN ('ERROR', 'WARN', 'INFO', 'DEBUG') GROUP BY 1)
  SELECT level, value, CAST(floor(CAST(value AS DOUBLE) / CAST(sum(value) OVER () AS DOUBLE) * 100.0 + 0.5)
  AS INTEGER) AS percent FROM known""")

# --- filters ------------------------------------------------------------------------------------
put("filter_events", f"""WITH {LOGS}, marked AS (SELECT id, CASE WHEN source = 'svc-9' THEN 'performance-test'
  ELSE source END AS source, content, log_level AS "logLevel", created_at AS timestamp FROM logs)
  SELECT * FROM marked WHERE source = 'performance-test'
  OR (source NOT IN ('svc-1', 'svc-2') AND {RANK.format(c='"logLevel"')} >= 3)""")
put("route_by_level", f"""WITH {LOGS} SELECT id, log_level AS "logLevel", {KNOWN.format(c='log_level')} AS route
  FROM logs""")
put("errors_only", f"""WITH {LOGS}, mixed AS (SELECT id, CASE WHEN source = 'svc-5' THEN lower(log_level)
  ELSE log_level END AS log_level FROM logs)
  SELECT id, log_level, log_level = 'ERROR' AS exact FROM mixed WHERE upper(log_level) = 'ERROR'""")
put("between_closed", f"WITH {LOGS} SELECT * FROM logs WHERE {IN_RANGE}")
put("source_contains", f"WITH {LOGS} SELECT id, source FROM logs WHERE contains(source, '-3')")
put("search_table", f"""WITH {LOGS} SELECT * FROM logs WHERE {IN_RANGE} AND log_level = 'ERROR'
  AND contains(lower(source), 'svc-1') AND contains(lower(content), 'k')
  AND (contains(lower(content), 'error') OR contains(lower(source), 'error'))""")
put("search_documents", f"""WITH {DOC_LOGS} SELECT id, source, log_level, created_at FROM doc_logs
  WHERE contains(lower(content), 'license') OR contains(lower(source), 'license')""")
SEARCH_COLUMNS = "CAST(id AS VARCHAR) AS id, source, content, log_level, created_at AS timestamp"
put("search_index_tokens", f"""WITH {TOKENS} SELECT {SEARCH_COLUMNS} FROM doc_logs
  WHERE contains(source, 'src1') AND id IN (SELECT id FROM words WHERE term IN ('license', 'token'))""")
put("search_index_ngrams", f"""WITH {TOKENS} SELECT {SEARCH_COLUMNS} FROM doc_logs
  WHERE log_level = 'INFO' AND id IN (SELECT id FROM words WHERE contains(term, 'zq'))""")
put("index_finders", f"""WITH {LOGS}, docs AS (SELECT CAST(id AS VARCHAR) AS id, source, content, log_level,
  date_trunc('second', created_at) AS timestamp FROM logs)
  SELECT 'level' AS finder, id FROM docs WHERE log_level = 'ERROR'
  UNION ALL SELECT 'source', id FROM docs WHERE contains(source, 'svc-2')
  UNION ALL SELECT 'content', id FROM docs WHERE contains(lower(content), 'click event')
  UNION ALL SELECT 'time', id FROM docs
            WHERE timestamp BETWEEN TIMESTAMP '{COUNT_START}' AND TIMESTAMP '{COUNT_END}'""")
put("search_with_fallback", f"""WITH {DOC_LOGS}, found AS (SELECT CAST(id AS VARCHAR) AS id, created_at AS timestamp
  FROM doc_logs WHERE log_level = 'ERROR' AND contains(source, 'src')
  AND created_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 09:00:00')
  SELECT engine, id, timestamp FROM found, (VALUES ('index'), ('table')) AS e(engine)""")
put("time_range_preset", f"WITH {LOGS} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS preset, count(*) AS total, count(*) FILTER (log_level = 'ERROR') AS error FROM logs
    WHERE created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY AND TIMESTAMP '{AS_OF}'"""
    for name, days in (("24h", 1), ("7d", 7), ("30d", 30))))

# --- aggregations -------------------------------------------------------------------------------


def raw_counts(extra: str = "") -> str:
    return f"""SELECT {LEVEL_COUNTS}, count(*) AS total,
      {rate("count(*) FILTER (log_level = 'ERROR')", "count(*)")} AS error_rate
      FROM logs WHERE {IN_RANGE} {extra}"""


put("log_counts", f"WITH {LOGS} {raw_counts()}")
put("log_counts_source", f"WITH {LOGS} {raw_counts("AND contains(source, 'svc-3')")}")
put("log_counts_rollup", f"""WITH {STATS}, summed AS (SELECT {LEVEL_SUMS},
  CAST(coalesce(sum("count"), 0) AS BIGINT) AS total FROM stats WHERE {IN_DAYS} AND contains(source, 'svc'))
  SELECT *, {rate("error", "total")} AS error_rate FROM summed""")
HOURS = f"hours AS (SELECT unnest(range(0, 24)) AS h)"
HOUR_ROWS = """SELECT concat(lpad(CAST(h AS VARCHAR), 2, '0'), ':00') AS hour,
  count(*) FILTER (log_level = 'ERROR') AS error, count(*) FILTER (log_level = 'WARN') AS warn,
  count(*) FILTER (log_level = 'INFO') AS info, count(*) FILTER (log_level = 'DEBUG') AS debug,
  count(*) FILTER (log_level IN ('ERROR', 'WARN', 'INFO', 'DEBUG')) AS total
  FROM hours LEFT JOIN {rows} ON {condition} GROUP BY h"""
DAY_START = f"TIMESTAMP '{DAY} 00:00:00'"
put("hourly_stats", f"""WITH {LOGS}, {HOURS} {HOUR_ROWS.format(rows="logs", condition=f"created_at >= {DAY_START}"
  f" + INTERVAL 1 HOUR * h AND created_at < {DAY_START} + INTERVAL 1 HOUR * (h + 1)")}""")
put("hourly_stats_closed", f"""WITH {LOGS}, cut AS (SELECT log_level, date_trunc('hour', created_at) AS created_at
  FROM logs), {HOURS} {HOUR_ROWS.format(rows="cut", condition=f"created_at BETWEEN {DAY_START} + INTERVAL 1 HOUR * h"
  f" AND {DAY_START} + INTERVAL 1 HOUR * (h + 1)")}""")
put("hourly_stats_rollup", f"""WITH {STATS}, {HOURS} SELECT concat(lpad(CAST(h AS VARCHAR), 2, '0'), ':00') AS hour,
  {LEVEL_SUMS}, CAST(coalesce(sum("count"), 0) AS BIGINT) AS total
  FROM hours LEFT JOIN stats ON stats.hour = h AND log_date = DATE '{DAY}' GROUP BY h""")
put("source_stats", f"""WITH {LOGS} SELECT source, count(*) AS "count" FROM logs WHERE {IN_RANGE} GROUP BY source""")
put("source_stats_rollup", f"""WITH {STATS} SELECT source, CAST(sum("count") AS BIGINT) AS "count" FROM stats
  WHERE {IN_DAYS} GROUP BY source""")
put("level_stats_rollup", f"""WITH {STATS} SELECT log_level, CAST(sum("count") AS BIGINT) AS "count" FROM stats
  WHERE {IN_DAYS} AND contains(source, 'svc-1') GROUP BY log_level""")


def trends(rows: str, first: str, condition: str) -> str:
    return f"""days AS (SELECT CAST(d AS DATE) AS log_date
      FROM (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{COUNT_END}', INTERVAL 1 DAY)) AS d)),
    daily AS (SELECT days.log_date, count(created_at) AS total_logs,
                     count(*) FILTER (log_level = 'ERROR') AS error_logs
              FROM days LEFT JOIN {rows} ON {condition} GROUP BY 1)"""


HALF_OPEN_DAY = "created_at >= days.log_date AND created_at < days.log_date + INTERVAL 1 DAY"
CLOSED_DAY = "created_at BETWEEN days.log_date AND days.log_date + INTERVAL 1 DAY"
put("error_trends", f"""WITH {LOGS}, {trends("logs", "2023-12-28 00:00:00", HALF_OPEN_DAY)}
  SELECT *, {rate("error_logs", "total_logs")} AS error_rate FROM daily""")
put("error_trends_closed", f"""WITH {LOGS}, cut AS (SELECT log_level, date_trunc('day', created_at) AS created_at
  FROM logs), {trends("cut", COUNT_START, CLOSED_DAY)}
  SELECT *, {rate("error_logs", "total_logs")} AS error_rate FROM daily""")
put("hourly_rollup", f"WITH {STATS} SELECT * FROM stats")
put("increment_statistics", f"""WITH {GAPPY}, kept AS (SELECT source, "logLevel" AS log_level, timestamp AS created_at
  FROM gappy WHERE source IS NOT NULL AND "logLevel" IS NOT NULL AND timestamp IS NOT NULL)
  {HOURLY.format(rows="kept")}""")
put("upsert_statistics", f"""WITH {STATS} SELECT log_date, hour, source, log_level,
  CASE WHEN log_level = 'ERROR' THEN 2 * "count" ELSE "count" END AS "count" FROM stats""")
put("upsert_stored_statistics", ORACLE_SQL["upsert_statistics"])
put("rebuild_daily_statistics", f"""WITH {STATS} SELECT log_date, hour, source, log_level,
  CASE WHEN log_date = DATE '{DAY}' THEN "count" ELSE 2 * "count" END AS "count" FROM stats""")
put("reconcile_statistics", f"""WITH {STATS}, drifted AS (SELECT log_date, hour, source,
  CASE WHEN log_level = 'trace' THEN 'TRACE' ELSE log_level END AS log_level,
  CASE WHEN log_level = 'ERROR' THEN 2 * "count" ELSE "count" END AS rollup_count
  FROM stats WHERE log_level <> 'WARN')
  SELECT coalesce(d.log_date, s.log_date) AS log_date, coalesce(d.hour, s.hour) AS hour,
         coalesce(d.source, s.source) AS source, coalesce(d.log_level, s.log_level) AS log_level,
         d.rollup_count, s."count" AS raw_count,
         CASE WHEN d.rollup_count IS NULL THEN 'missing' WHEN s."count" IS NULL THEN 'extra'
              WHEN d.rollup_count <> s."count" THEN 'diff' ELSE 'match' END AS status
  FROM drifted d FULL OUTER JOIN stats s ON d.log_date = s.log_date AND d.hour = s.hour
    AND d.source = s.source AND d.log_level = s.log_level""")

put("reconcile_stored", f"""WITH {LOGS}, counted AS (SELECT CAST(created_at AS DATE) AS log_date,
    CAST(hour(created_at) AS INTEGER) AS hour, source, log_level, count(*) AS raw_count,
    count(*) FILTER (NOT (id % 3 = 1 AND log_level = 'ERROR' AND CAST(created_at AS DATE) = DATE '{DAY}')) AS kept
  FROM logs GROUP BY 1, 2, 3, 4)
  SELECT log_date, hour, source, log_level, CASE WHEN kept > 0 THEN kept END AS rollup_count, raw_count,
         CASE WHEN kept = 0 THEN 'missing' ELSE 'diff' END AS status
  FROM counted WHERE kept <> raw_count""")


def unpivot(panel: str, key: str, rows: str, *metrics: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{panel}' AS panel, {key} AS "key", '{m}' AS metric, CAST("{m}" AS DOUBLE) AS value FROM {rows}"""
        for m in metrics)


put("dashboard_stats", f"""WITH {LOGS}, {HOURS},
  totals AS ({raw_counts()}),
  hourly AS ({HOUR_ROWS.format(rows="logs", condition=f"created_at >= {DAY_START} + INTERVAL 1 HOUR * h"
             f" AND created_at < {DAY_START} + INTERVAL 1 HOUR * (h + 1)")}),
  by_source AS (SELECT source, count(*) AS "count" FROM logs WHERE {IN_RANGE} GROUP BY source),
  {trends("logs", "2024-01-03 00:00:00", HALF_OPEN_DAY)},
  trend AS (SELECT *, {rate("error_logs", "total_logs")} AS error_rate FROM daily),
  span AS (SELECT count(*) AS processed, count(*) FILTER (log_level = 'ERROR') AS errors FROM logs
    WHERE created_at >= date_trunc('minute', TIMESTAMP '{STATUS_AS_OF}') - INTERVAL 60 MINUTE
      AND created_at < date_trunc('minute', TIMESTAMP '{STATUS_AS_OF}')),
  state AS (SELECT CAST(floor(processed / 60) AS BIGINT) AS processed_rate, {rate("errors", "processed")} AS error_rate,
    CAST(0 AS BIGINT) AS avg_response_time FROM span),
  newest AS (SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS place, id FROM logs
    WHERE log_level = 'ERROR' ORDER BY 1 LIMIT 5)
  {unpivot("log_counts", "'all'", "totals", "error", "warn", "info", "debug", "total", "error_rate")}
  UNION ALL {unpivot("hourly_stats", "hour", "hourly", "error", "warn", "info", "debug", "total")}
  UNION ALL {unpivot("source_stats", "source", "by_source", "count")}
  UNION ALL {unpivot("error_trends", "CAST(log_date AS VARCHAR)", "trend", "total_logs", "error_logs", "error_rate")}
  UNION ALL {unpivot("system_status", "'all'", "state", "processed_rate", "error_rate", "avg_response_time")}
  UNION ALL {unpivot("recent_errors", "CAST(place AS VARCHAR)", "newest", "id")}""")
put("dashboard_status", f"""WITH {LOGS}, span AS (SELECT count(*) AS processed,
  count(*) FILTER (log_level = 'ERROR') AS errors FROM logs
  WHERE created_at >= date_trunc('minute', TIMESTAMP '{STATUS_AS_OF}') - INTERVAL 60 MINUTE
    AND created_at < date_trunc('minute', TIMESTAMP '{STATUS_AS_OF}')),
  rated AS (SELECT date_trunc('minute', TIMESTAMP '{STATUS_AS_OF}') - INTERVAL 1 MINUTE AS minute,
  CAST(floor(processed / 60) AS BIGINT) AS processed_rate, {rate("errors", "processed")} AS error_rate,
  CAST(0 AS BIGINT) AS avg_response_time FROM span)
  SELECT *, {status("error_rate", "avg_response_time")} AS status FROM rated""")
put("level_counters", f"""WITH {LOGS} SELECT {KNOWN.format(c='log_level')} AS level, count(*) AS processed FROM logs
  GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM logs""")
MINUTES = """minutes AS (SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS processed,
  count(*) FILTER (event_type = 'error') AS errors,
  CAST(floor(sum(floor(value)) / count(value)) AS BIGINT) AS avg_response_ms FROM events GROUP BY 1)"""
put("minute_metrics", f"WITH {MINUTES} SELECT * FROM minutes")


def rolled(keys: str, source: str, span: int, partition: str) -> str:
    frame = f"OVER ({partition} ORDER BY minute ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"
    return f"""rolled AS (SELECT {keys}, CAST(floor(sum(processed) {frame} / {span}) AS BIGINT) AS processed_rate,
      {rate(f"sum(errors) {frame}", f"sum(processed) {frame}")} AS error_rate,
      CAST(coalesce(floor(sum(CASE WHEN avg_response_ms > 0 THEN avg_response_ms END) {frame}
        / nullif(count(CASE WHEN avg_response_ms > 0 THEN 1 END) {frame}, 0)), 0) AS BIGINT) AS avg_response_time
      FROM {source})
    SELECT *, {status("error_rate", "avg_response_time")} AS status FROM rolled"""


put("rolling_metrics", f"""WITH {MINUTES}, spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00',
  TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS minute),
  filled AS (SELECT spine.minute, coalesce(processed, 0) AS processed, coalesce(errors, 0) AS errors,
             coalesce(avg_response_ms, 0) AS avg_response_ms
             FROM spine LEFT JOIN minutes ON spine.minute = minutes.minute),
  {rolled("minute", "filled", 5, "")}""")
put("rolling_metrics_by_service", f"""WITH {LOGS}, spine AS (SELECT unnest(generate_series({DAY_START},
  {DAY_START} + INTERVAL 1439 MINUTE, INTERVAL 1 MINUTE)) AS minute),
  grid AS (SELECT service, minute FROM (SELECT DISTINCT source AS service FROM logs), spine),
  minutes AS (SELECT source AS service, date_trunc('minute', created_at) AS minute, count(*) AS processed,
              count(*) FILTER (log_level = 'ERROR') AS errors FROM logs GROUP BY 1, 2),
  filled AS (SELECT grid.service, grid.minute, coalesce(processed, 0) AS processed, coalesce(errors, 0) AS errors,
             0 AS avg_response_ms FROM grid LEFT JOIN minutes
             ON grid.service = minutes.service AND grid.minute = minutes.minute),
  {rolled("service, minute", "filled", 60, "PARTITION BY service")}""")
put("current_metrics", f"""WITH {LOGS} SELECT count(*) AS processed_rate,
  {rate("count(*) FILTER (log_level = 'ERROR')", "count(*)")} AS error_rate, CAST(0 AS BIGINT) AS avg_response_time
  FROM logs WHERE created_at BETWEEN date_trunc('minute', TIMESTAMP '{STATUS_AS_OF}') AND TIMESTAMP '{STATUS_AS_OF}'""")
put("trailing_minute_metrics", f"""WITH {LOGS}, buckets AS (SELECT CAST(unnest(range(0, 600)) AS INTEGER) AS bucket)
  SELECT bucket, count(created_at) AS processed, count(*) FILTER (log_level = 'ERROR') AS errors
  FROM buckets LEFT JOIN logs ON created_at BETWEEN TIMESTAMP '{STATUS_AS_OF}' - INTERVAL 1 MINUTE * (bucket + 1)
    AND TIMESTAMP '{STATUS_AS_OF}' - INTERVAL 1 MINUTE * bucket GROUP BY bucket""")
put("source_level_stats", f"""WITH {STATS} SELECT source, {LEVEL_SUMS}, CAST(sum("count") AS BIGINT) AS total
  FROM stats WHERE {IN_DAYS} GROUP BY source""")
put("distinct_sources", f"WITH {LOGS} SELECT DISTINCT source FROM logs")
put("page_totals", f"""WITH {LOGS} SELECT count(*) AS total_elements, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages
  FROM logs WHERE log_level = 'WARN'""")
put("latency_summary", f"""SELECT event_type AS label, count(*) AS samples, round(avg(value), 6) AS average,
  min(value) AS minimum, max(value) AS maximum, {rate("count(*) FILTER (value > 100)", "count(*)")} AS error_percent,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0), 9) AS throughput,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
  FROM events GROUP BY event_type""")
put("latency_summary_nulls", """WITH rows AS (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS label,
    CASE WHEN event_type <> 'signup' THEN value END AS latency, ts FROM events)
  SELECT label, count(*) AS samples, min(latency) AS minimum, max(latency) AS maximum,
  round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.99), 6) AS p99
  FROM rows GROUP BY label""")
put("latency_summary_sketch", """SELECT event_type AS label, count(*) AS samples, min(value) AS minimum,
  max(value) AS maximum, true AS p50_close, true AS p99_close FROM events GROUP BY event_type""")
put("rows_affected", "SELECT count(*) AS stored, count(*) AS reported FROM events")

# --- windows ------------------------------------------------------------------------------------
put("repeated_error_candidates", f"""WITH {SIMILAR} SELECT id, source, message_pattern, created_at, repeat_count
  FROM candidates""")
SAMPLES = LOGS + """, minutes AS (SELECT log_level, source, date_trunc('minute', created_at) AS ts, count(*) AS n
  FROM logs GROUP BY 1, 2, 3),
samples AS (SELECT log_level, source, ts, CAST(sum(n) OVER (PARTITION BY log_level, source ORDER BY ts) AS BIGINT)
  AS value FROM minutes)"""


def increase(seconds: int) -> str:
    return f"""closing AS (SELECT log_level, source, epoch_us(ts) // {seconds * 1_000_000} AS bucket,
        max_by(value, ts) AS closing FROM samples GROUP BY 1, 2, 3),
      grown AS (SELECT *, lag(closing) OVER series AS closing_before, lag(bucket) OVER series AS bucket_before
                FROM closing WINDOW series AS (PARTITION BY log_level, source ORDER BY bucket)),
      rated AS (SELECT log_level, source, make_timestamp(CAST(bucket * {seconds * 1_000_000} AS BIGINT)) AS window_start,
                CASE WHEN closing < closing_before THEN closing ELSE closing - closing_before END * 60.0::DOUBLE
                  / ((bucket - bucket_before) * {seconds}.0::DOUBLE) AS rate,
                closing - closing_before AS delta
                FROM grown WHERE closing_before IS NOT NULL)"""


put("counter_rate", f"""WITH {SAMPLES}, {increase(3600)} SELECT log_level, window_start, round(sum(rate), 9) AS rate
  FROM rated GROUP BY 1, 2""")
put("counter_delta", f"""WITH {SAMPLES}, {increase(300)} SELECT log_level, source, window_start,
  round(sum(rate), 9) AS rate FROM rated GROUP BY 1, 2, 3""")
put("gauge_delta", f"""WITH {LOGS}, minutes AS (SELECT log_level, source, date_trunc('minute', created_at) AS ts,
  count(*) AS value FROM logs GROUP BY 1, 2, 3), samples AS (SELECT * FROM minutes), {increase(3600)}
  SELECT log_level, source, window_start, CAST(delta AS BIGINT) AS delta FROM rated""")
put("consumer_lag", f"""WITH {SAMPLES}, latest AS (SELECT log_level, source, max_by(value, ts) AS latest
  FROM samples GROUP BY 1, 2) SELECT log_level, CAST(sum(latest) AS BIGINT) AS lag FROM latest GROUP BY 1""")
put("running_count", f"""WITH {LOGS} SELECT id, source, log_level,
  row_number() OVER (PARTITION BY source, log_level ORDER BY created_at, id) AS running_count FROM logs""")

# --- sort, limit, paging ------------------------------------------------------------------------
put("recent_errors", f"""WITH {LOGS} SELECT * FROM logs WHERE log_level = 'ERROR'
  ORDER BY created_at DESC, id DESC LIMIT 5""")
put("recent_store_errors", f"""WITH {DOC_LOGS} SELECT id, source, content, created_at FROM doc_logs
  WHERE log_level = 'ERROR' ORDER BY created_at DESC, id DESC LIMIT 5""")
put("page_logs", f"WITH {LOGS} SELECT * FROM logs ORDER BY created_at, id LIMIT 20 OFFSET 60")
put("page_after", f"""WITH {LOGS} SELECT * FROM logs WHERE source < 'svc-5' OR (source = 'svc-5' AND id < 5000)
  ORDER BY source DESC, id DESC LIMIT 20""")
put("replay_after_compaction", f"""WITH {LOGS} SELECT CAST(created_at AS DATE) AS log_date, log_level,
  count(*) AS logs, count(*) AS ids FROM logs GROUP BY 1, 2""")
put("two_streams_one_store", f"""WITH {LOGS} SELECT source, log_level, count(*) AS logs,
  CAST(count(*) AS BIGINT) AS counted FROM logs GROUP BY 1, 2""")
put("equal_events_kept", f"""WITH {LOGS} SELECT source, 3 * count(*) AS rows, 2 * count(*) AS ids FROM logs GROUP BY 1""")
put("page_after_nulls", f"""WITH {GAPPY}, pages AS (
    (SELECT 'desc' AS direction, id, source FROM gappy WHERE source IS NULL AND id < 5000 ORDER BY id DESC LIMIT 20)
    UNION ALL (SELECT 'desc edge', id, source FROM gappy WHERE source < 'svc-0' OR source IS NULL
      OR (source = 'svc-0' AND id < 0) ORDER BY source DESC NULLS LAST, id DESC LIMIT 20)
    UNION ALL (SELECT 'asc', id, source FROM gappy WHERE source IS NOT NULL OR id > 5000
      ORDER BY source NULLS FIRST, id LIMIT 20)) SELECT * FROM pages""")
put("top_sources", f"""WITH {STATS} SELECT source, CAST(sum("count") AS BIGINT) AS "count" FROM stats
  WHERE {IN_DAYS} GROUP BY source ORDER BY 2 DESC, 1 LIMIT 10""")
put("related_logs", f"""{REPEATS} SELECT d.id AS trigger_id, CAST(d.position - n.position AS INTEGER) AS position, n.id
  FROM detected d JOIN numbered n ON n.source = d.source AND n.message_pattern = d.message_pattern
    AND n.position > d.position - least(10, d.repeat_count) AND n.position <= d.position""")

# --- sets and tables ----------------------------------------------------------------------------
put("append_sources", f"""WITH {LINES} SELECT source, content, log_level AS "logLevel", created_at AS timestamp FROM logs
  UNION ALL SELECT 'app.log', value, {LEVEL_OF_LINE.format(c='value')}, NULL FROM lines""")
put("log_history", f"""WITH {DOC_LOGS} SELECT id, source, content, log_level FROM doc_logs
  WHERE created_at < TIMESTAMP '2024-01-01 12:00:00' OR created_at >= TIMESTAMP '2024-01-01 06:00:00'""")
put("dedup_events", f"""WITH {LOGS} SELECT DISTINCT source, content, log_level AS "logLevel", created_at AS timestamp
  FROM logs""")
put("expire_logs", f"""WITH {LOGS} SELECT * FROM logs
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {RETENTION_DAYS} DAY""")
CUTOFF = f"TIMESTAMP '2024-01-31 13:30:00' - INTERVAL {RETENTION_DAYS} DAY"
put("expire_stored_logs", f"""WITH {LOGS} SELECT id, created_at,
  (SELECT count(*) FROM logs WHERE created_at < {CUTOFF}) AS removed FROM logs WHERE created_at >= {CUTOFF}""")
put("archive_logs", f"""WITH {DOC_LOGS} SELECT *, TIMESTAMP '2024-01-01 12:00:00' AS archived_at FROM doc_logs
  WHERE created_at < TIMESTAMP '2024-01-01 12:00:00'""")
put("archive_compress", f"""WITH {DOC_LOGS} SELECT id, CAST(strlen(content) AS INTEGER) AS original_size,
  {UTF16.format(c='content')} > 1024 AS eligible, TRUE AS never_larger FROM doc_logs""")

# --- streams and detectors ----------------------------------------------------------------------
put("ingest_events", f"""WITH {NORMAL} SELECT source, content, "logLevel", timestamp FROM normal
  WHERE source <> 'svc-1' AND {RANK.format(c='"logLevel"')} >= 3""")
STORED = """FALSE AS compressed, CAST(strlen(content) AS INTEGER) AS original_size,
  CAST(strlen(content) AS INTEGER) AS compressed_size"""
put("consume_events", f"WITH {GOOD} SELECT source, content, log_level, created_at, {STORED} FROM good")
put("consume_statistics", f"WITH {GOOD} {HOURLY.format(rows='good')}")
put("create_log", f"""WITH {GAPPY} SELECT source, content, "logLevel" AS log_level,
  coalesce(timestamp, TIMESTAMP '{AS_OF}') AS created_at, {STORED} FROM gappy""")
put("error_burst", f"{BURST_ALL} SELECT * FROM fired")
put("error_burst_dense", f"{burst("'all'", **DENSE_BURST)} SELECT * FROM fired")
put("error_burst_by_source", f"{burst('source', 7200, 3, 14400)} SELECT * FROM fired")
put("tumbling_burst", f"""WITH {LOGS}, spans AS (SELECT source AS scope,
  time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') AS window_start FROM logs WHERE log_level = 'ERROR')
  SELECT scope, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS errors FROM spans
  GROUP BY 1, 2 HAVING count(*) >= 4""")
put("sliding_burst", f"""WITH {LOGS}, spans AS (SELECT source AS scope,
  date_trunc('hour', created_at) - INTERVAL 1 HOUR * unnest(range(0, 6)) AS window_start
  FROM logs WHERE log_level = 'ERROR')
  SELECT scope, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS errors FROM spans
  GROUP BY 1, 2 HAVING count(*) >= 4""")
DETECTED_TEXT = REPEAT_TEXT.format(count="repeat_count", seconds=str(REPEAT_WINDOW))
put("repeated_error", f"""{REPEATS} SELECT 'repeated-error' AS pattern_id, 'WARNING' AS severity,
  {DETECTED_TEXT} AS message, created_at AS detected_at, id AS trigger_id,
  CAST(least(10, repeat_count) AS INTEGER) AS related, source, message_pattern, repeat_count FROM detected""")
put("pattern_alerts", f"""{REPEATS} SELECT created_at AS alert_ts, 'repeated-error' AS kind, 'WARNING' AS severity,
  'Log pattern detected: Repeated error' AS subject, {DETECTED_TEXT} AS message FROM detected""")
put("streaming_rollup", f"""WITH {STATS} SELECT * FROM stats
  WHERE log_date + INTERVAL 1 HOUR * (hour + 1) <= (SELECT max(created_at) FROM logs)""")
put("streaming_minute_metrics", f"""WITH {LOGS}, minutes AS (SELECT CAST(date_trunc('minute', created_at) AS TIMESTAMP)
  AS minute, count(*) AS processed, count(*) FILTER (log_level = 'ERROR') AS errors FROM logs GROUP BY 1)
  SELECT * FROM minutes WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(created_at) FROM logs)""")
put("streaming_error_burst", ORACLE_SQL["error_burst"])
put("streaming_repeated_error", ORACLE_SQL["repeated_error"])
put("streaming_error_burst_out_of_order", ORACLE_SQL["error_burst"])
put("streaming_repeated_error_out_of_order", ORACLE_SQL["repeated_error"])
put("streaming_level_counters", f"""WITH {LOGS} SELECT {KNOWN.format(c='log_level')} AS level, count(*) AS processed
  FROM logs GROUP BY 1""")
put("search_stored", ORACLE_SQL["search_index_tokens"])
put("search_partly_indexed", ORACLE_SQL["search_index_tokens"])
FOUND = f"""WITH {TOKENS} SELECT {SEARCH_COLUMNS} FROM doc_logs
  WHERE id IN (SELECT id FROM words WHERE term IN ('license', 'token'))"""
put("search_one_day", f"""{FOUND} AND created_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 02:59:59'""")
put("search_damaged_index", FOUND)
put("expired_not_found", f"{FOUND} AND created_at >= TIMESTAMP '2024-01-01 01:30:00'")
