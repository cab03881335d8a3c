"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from tablevault.plans.fixtures import ALL_TABLES

_JOBS = """
base AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) AS n,
    'db' || CAST(user_id % 5 AS VARCHAR) AS db,
    'db' || CAST(user_id % 5 AS VARCHAR) || '_' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS jid,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS st
  FROM events
),
jobs AS (
  SELECT jid AS id, event_id,
    CASE WHEN event_id % 10 = 9 THEN 'mysql' ELSE 'postgresql' END AS db_type,
    db AS db_name,
    CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' ELSE 'differential' END AS backup_type,
    st AS status,
    CASE WHEN st = 'success' THEN '/backups/' || db || '/' || jid || CASE WHEN event_id % 4 <> 0 THEN '.gz' ELSE '.sql' END END AS file_path,
    CASE WHEN st = 'success' THEN n * 10486 END AS file_size,
    CASE WHEN st = 'success' AND event_id % 4 <> 0 THEN n * 10486 END AS compressed_size,
    CASE WHEN st = 'success' THEN n * 31415 END AS raw_size,
    CASE WHEN st = 'success' THEN CASE WHEN event_id % 4 <> 0 THEN 'gzip' ELSE 'none' END END AS compression_type,
    CASE WHEN st = 'success' THEN sha256(jid) END AS checksum,
    ts AS started_at,
    CASE WHEN st <> 'running' THEN ts + to_milliseconds(n * 10) END AS completed_at,
    CASE WHEN st <> 'running' THEN n * 10 END AS duration_ms,
    CASE WHEN st <> 'running' THEN n * 10 / 1000.0::DOUBLE END AS duration,
    CASE WHEN st = 'failed' THEN 'pg_dump failed: ' || props END AS error
  FROM base
),
job_logs AS (
  SELECT event_id AS id, id AS backup_job_id, completed_at AS "timestamp",
    CASE WHEN status = 'success' THEN 'info' ELSE 'error' END AS level,
    CASE WHEN status = 'success' THEN 'Backup completed successfully' ELSE 'Backup failed' END AS message,
    duration, file_size, error
  FROM jobs WHERE status <> 'running'
)"""

_LOGS = """
logs AS (
  SELECT event_id,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
    CASE event_id % 4 WHEN 0 THEN 'pg_dump: NOTICE: ' || event_type WHEN 1 THEN '' ELSE 'pg_dump: ' || event_type END AS message,
    ts AS "timestamp",
    CASE WHEN event_id % 2 = 0 THEN 'postgres-backup' END AS module,
    CASE WHEN event_id % 5 = 0 THEN '{"host":"h","password":"p\\"' || CAST(event_id AS VARCHAR) || '"}' ELSE props END AS details,
    props
  FROM events
)"""

_ORDER_STATES = """
archive AS (
  SELECT -1 - o_orderkey AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderstatus = 'F'
),
dearer AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority
  FROM orders
),
s1 AS (
  SELECT * FROM dearer WHERE o_orderdate < TIMESTAMP '2001-01-01' UNION ALL SELECT * FROM archive
),
s0 AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority
  FROM dearer WHERE o_orderdate < TIMESTAMP '2000-01-01'
  UNION ALL SELECT * FROM archive WHERE o_orderpriority <> '5-LOW'
)"""

_LINE_STATES = """
k1 AS (
  SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01'
  UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R'
)"""

_SIZE_TEXT = """CASE WHEN {s} > 0 THEN CAST(({s} * 100 + 524288) // 1048576 // 100 AS VARCHAR) || '.' ||
      lpad(CAST(({s} * 100 + 524288) // 1048576 % 100 AS VARCHAR), 2, '0') END"""
_SECONDS_TEXT = """CASE WHEN duration_ms <> 0 THEN CAST((duration_ms + 5) // 10 // 100 AS VARCHAR) || '.' ||
      lpad(CAST((duration_ms + 5) // 10 % 100 AS VARCHAR), 2, '0') END"""


def _size(column: str) -> str:
    return _SIZE_TEXT.format(s=column)


def _delta(state: str) -> str:
    return f"""WITH {_ORDER_STATES},
    up AS (SELECT * FROM orders EXCEPT SELECT * FROM {state})
    SELECT 'U' AS op, * FROM up
    UNION ALL
    SELECT 'D', o_orderkey, NULL, NULL, NULL, NULL, NULL FROM {state}
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"""


_COUNTED = ["customer", "events", "lineitem", "orders"]


def oracle_sql() -> dict[str, str]:
    digest_text = " || ".join(
        f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-1:')"
        for c in (
            "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
            "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)", "CAST(epoch_us(o_orderdate) AS VARCHAR)", "o_orderpriority",
        )
    )
    iso = "strftime(ts, '%Y-%m-%dT%H-%M-%S-') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"
    chains = f"""WITH {_JOBS},
    counted AS (
      SELECT id, db_name, backup_type, started_at,
        sum(CASE WHEN backup_type = 'full' THEN 1 ELSE 0 END) OVER w AS grp,
        sum(CASE WHEN backup_type <> 'incremental' THEN 1 ELSE 0 END) OVER w AS seg,
        sum(CASE WHEN backup_type = 'incremental' THEN 1 ELSE 0 END) OVER w AS inc
      FROM jobs WHERE status = 'success'
      WINDOW w AS (PARTITION BY db_name ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)
    ),"""
    return {
        "full_backup_restore_orders": "SELECT * FROM orders",
        "full_backup_restore_zstd_events": "SELECT * FROM events",
        "full_backup_plain_documents": "SELECT * FROM documents",
        "backup_arrays_embeddings": """
            SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
              CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""",
        "selected_tables_restore_customer": "SELECT * FROM customer",
        "chunked_backup_elsewhere_events": "SELECT * FROM events",
        "backup_job_and_log": """
            SELECT 'postgresql' AS db_type, 'shop' AS db_name, 'full' AS backup_type, 'success' AS status,
              'gzip' AS compression_type, '1.0' AS backup_version, 0 AS retry_count, 'info' AS log_level,
              'Backup completed successfully' AS log_message, count(*) AS tables, CAST(sum(n) AS BIGINT) AS total_rows
            FROM (""" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in ALL_TABLES) + ")",
        "delta_totals_orders": f"""WITH {_ORDER_STATES},
            up1 AS (SELECT * FROM s1 EXCEPT SELECT * FROM s0), up2 AS (SELECT * FROM orders EXCEPT SELECT * FROM s0)
            SELECT 'full' AS backup_type, count(*) AS upserts, CAST(0 AS BIGINT) AS deletes, count(*) AS state_rows FROM s0
            UNION ALL SELECT 'incremental', (SELECT count(*) FROM up1),
              (SELECT count(*) FROM s0 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s1)), (SELECT count(*) FROM s1)
            UNION ALL SELECT 'differential', (SELECT count(*) FROM up2),
              (SELECT count(*) FROM s0 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)), (SELECT count(*) FROM orders)""",
        "manifest_row_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _COUNTED
        ),
        "manifest_selection": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("labels", "nation", "part", "supplier")
        ),
        "table_digest_orders": f"""
            WITH h AS (SELECT sha256({digest_text}) AS x FROM orders)
            SELECT count(*) AS row_count,
              CAST(sum(CAST('0x' || substr(x, 1, 15) AS BIGINT)) AS VARCHAR) AS digest1,
              CAST(sum(CAST('0x' || substr(x, 16, 15) AS BIGINT)) AS VARCHAR) AS digest2
            FROM h""",
        "sealed_digest_orders": f"""
            WITH rows AS (SELECT {digest_text} AS t FROM orders),
            hashed AS (SELECT b, sha256('a key:' || b || ':' || t) AS x FROM rows, range(64) AS r(b)),
            lanes AS (SELECT 16 * b + i AS lane, CAST(sum(CAST('0x' || substr(x, 4 * i + 1, 4) AS BIGINT)) % 65536 AS BIGINT) AS value
              FROM hashed, range(16) AS s(i) GROUP BY ALL)
            SELECT (SELECT count(*) FROM orders) AS row_count, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY lane)) AS digest FROM lanes""",
        "verify_after_changes": """
            SELECT 'orders' AS table_name, count(*) AS recorded_rows, count(*) AS found_rows, true AS content_ok, 'ok' AS file_states FROM orders
            UNION ALL SELECT 'supplier', count(*), 2 * count(*), false, 'extra,ok' FROM supplier
            UNION ALL SELECT 'customer', count(*), count(*), false, 'extra,missing' FROM customer
            UNION ALL SELECT 'region', count(*), count(*), false, 'changed' FROM region
            UNION ALL SELECT 'part', count(*), count(*), true, 'changed' FROM part
            UNION ALL SELECT 'nation', count(*), 0, false, 'missing' FROM nation""",
        "stored_artifacts": "SELECT 'orders' AS table_name, count(*) AS row_total, true AS lengths_ok FROM orders",
        "artifact_files": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_total, true AS all_ok, true AS bytes_ok FROM {t}" for t in ALL_TABLES
        ),
        "database_size": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_total, true AS bytes_ok FROM {t}" for t in ALL_TABLES),
        "failed_job_and_log": """
            SELECT 'shop' AS db_name, 'failed' AS status, 'error' AS log_level, 'Backup failed' AS log_message,
              CAST(NULL AS BIGINT) AS total_rows, true AS secret_hidden
            UNION ALL SELECT 'shop', 'success', 'info', 'Backup completed successfully',
              (SELECT CAST(sum(n) AS BIGINT) FROM (""" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in ALL_TABLES) + """)), NULL""",
        "status_with_logs": f"""WITH {_ORDER_STATES}
            SELECT 'success' AS status, 'incremental' AS backup_type, 0 AS pos, 'info' AS level,
              'Backup completed successfully' AS message, count(*) AS state_rows FROM s1""",
        "highwater_late_restore_events": "SELECT * FROM events",
        "highwater_late_delta_events": """
            WITH behind AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20'),
                 was AS (SELECT event_id, CASE WHEN event_id % 499 = 2 THEN value + 1 ELSE value END AS value FROM behind WHERE event_id % 499 <> 1
                         UNION ALL SELECT -1 - event_id, value FROM behind WHERE event_id % 499 = 3),
                 net AS (SELECT event_id, value, sum(n) AS copies, sum(b) AS copies_before FROM
                         (SELECT event_id, value, 1 AS n, 0 AS b FROM behind UNION ALL SELECT event_id, value, 0, 1 FROM was) GROUP BY ALL)
            SELECT event_id, value, false AS past_mark, copies::BIGINT AS copies, copies_before::BIGINT AS copies_before FROM net WHERE copies <> copies_before
            UNION ALL SELECT event_id, value, true, 1::BIGINT, NULL::BIGINT FROM events WHERE ts >= TIMESTAMP '2024-01-20'""",
        "highwater_null_marks": "SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN ts END AS ts) FROM events",
        "chain_restore_overlapping_runs": "SELECT * FROM orders",
        "list_backups": f"""WITH {_JOBS},
            page AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS position FROM jobs WHERE status = 'success')
            SELECT CAST(position AS BIGINT) AS position, substr(id, 1, 16) AS short_id,
              strftime(started_at, '%Y-%m-%d %H:%M:%S') AS date, backup_type, status, db_type || '/' || db_name AS database,
              coalesce({_size('file_size')}, 'N/A') AS size_mb, {_SECONDS_TEXT} AS duration_s,
              file_path AS path, substr(error, 1, 100) AS error
            FROM page WHERE position <= 20""",
        "list_failed_full": f"""WITH {_JOBS},
            page AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS position FROM jobs
              WHERE status = 'failed' AND db_name = 'db1' AND backup_type = 'full')
            SELECT CAST(position AS BIGINT) AS position, substr(id, 1, 16) AS short_id,
              strftime(started_at, '%Y-%m-%d %H:%M:%S') AS date, backup_type, status, db_type || '/' || db_name AS database,
              coalesce({_size('file_size')}, 'N/A') AS size_mb, {_SECONDS_TEXT} AS duration_s,
              file_path AS path, substr(error, 1, 100) AS error
            FROM page WHERE position <= 20""",
        "list_recent_50": f"""WITH {_JOBS}
            SELECT id, db_type, db_name, backup_type, status, file_size, started_at FROM jobs
            WHERE db_type = 'postgresql' AND db_name = 'db1' AND status = 'success'
            ORDER BY started_at DESC, id DESC LIMIT 50""",
        "count_by_status": f"""WITH {_JOBS}
            SELECT status, count(*) AS backups FROM jobs GROUP BY status""",
        "current_job_state": f"""WITH {_JOBS}
            SELECT id, db_type, db_name, backup_type, status, file_path, file_size, compressed_size, raw_size,
              compression_type, checksum, started_at, completed_at, duration, error FROM jobs""",
        "job_status_with_logs": f"""WITH {_JOBS}
            SELECT j.id, j.status, j.backup_type, l.id AS log_id, l."timestamp" AS log_timestamp,
              l.level AS log_level, l.message AS log_message
            FROM jobs j LEFT JOIN job_logs l ON l.backup_job_id = j.id""",
        "orphan_logs": f"""WITH {_JOBS}
            SELECT l.id, l.backup_job_id, l.level, l.message FROM job_logs l
            WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = l.backup_job_id AND j.status <> 'failed')""",
        "stale_jobs": f"""WITH {_JOBS}
            SELECT id, db_name, started_at FROM jobs
            WHERE status = 'running' AND started_at < TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR""",
        "job_summary": f"""WITH {_JOBS},
            done AS (SELECT *, 1000 * (raw_size - compressed_size) AS saved FROM jobs WHERE status = 'success')
            SELECT id, db_type || '/' || db_name AS database, backup_type,
              CASE WHEN compression_type <> 'none' THEN 'Yes' ELSE 'No' END AS compressed,
              regexp_extract(file_path, '[^/]*$') AS file, regexp_replace(file_path, '/[^/]*$', '') AS location,
              {_size('file_size')} AS size_mb,
              CASE WHEN raw_size > 0 AND saved IS NOT NULL THEN CASE WHEN saved < 0 THEN '-' ELSE '' END
                || CAST((abs(saved) * 2 + raw_size) // (2 * raw_size) // 10 AS VARCHAR) || '.'
                || CAST((abs(saved) * 2 + raw_size) // (2 * raw_size) % 10 AS VARCHAR) END AS ratio_percent,
              {_SECONDS_TEXT} AS duration_s, substr(checksum, 1, 16) AS checksum16
            FROM done""",
        "artifact_names": f"""
            SELECT event_id, {iso} AS stamp,
              'db' || CAST(user_id % 5 AS VARCHAR) || '_' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS job_id,
              CASE WHEN event_type = 'view' THEN 'nightly' ELSE 'db' || CAST(user_id % 5 AS VARCHAR) || '_' || {iso} END
                || '.' || CASE WHEN value > 50 THEN 'gz' ELSE 'sql' END AS file_name,
              '/backups/' || CASE WHEN event_type = 'view' THEN 'nightly' ELSE 'db' || CAST(user_id % 5 AS VARCHAR) || '_' || {iso} END
                || '.' || CASE WHEN value > 50 THEN 'gz' ELSE 'sql' END AS file_path,
              CASE WHEN event_type = 'click' OR user_id = 0 THEN 5432 ELSE user_id END AS port
            FROM events""",
        "elapsed_seconds": f"""WITH {_JOBS}
            SELECT id, CAST(epoch_us(completed_at) // 1000 - epoch_us(started_at) // 1000 AS DOUBLE) / 1000.0::DOUBLE AS seconds
            FROM jobs WHERE status <> 'running'""",
        "log_metadata_json": f"""WITH {_JOBS}
            SELECT id AS log_id, duration, file_size, error, file_size IS NULL AS size_absent, error IS NULL AS error_absent
            FROM job_logs""",
        "log_threshold": f"""WITH {_LOGS}
            SELECT event_id, level, message, 'catalog' AS module FROM logs WHERE level IN ('error', 'warn', 'info')""",
        "log_errors": f"""WITH {_LOGS} SELECT event_id, level, message, module FROM logs WHERE level = 'error'""",
        "log_warnings": f"""WITH {_LOGS}
            SELECT event_id, message FROM logs WHERE length(message) > 0 AND NOT contains(message, 'NOTICE')""",
        "log_render": f"""WITH {_LOGS}
            SELECT event_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' ' || level || ': ' ||
              CASE WHEN length(module) > 0 THEN '[' || module || '] ' ELSE '' END || message || chr(10) || details AS line
            FROM logs""",
        "log_redact": f"""WITH {_LOGS}
            SELECT event_id, regexp_replace(details, '("password"\\s*:\\s*)"(\\\\.|[^"\\\\])*"', '\\1"***"', 'g') AS details FROM logs""",
        "parse_sizes": """
            SELECT p_partkey,
              CASE p_brand WHEN 'Brand#1' THEN p_size * 1024::BIGINT WHEN 'Brand#2' THEN p_size * 1048576::BIGINT
                WHEN 'Brand#3' THEN p_size * 1073741824::BIGINT WHEN 'Brand#4' THEN CAST(p_size AS BIGINT) END AS size_bytes
            FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#1' WHEN p_partkey % 5 = 1 THEN 'Brand#2'
                WHEN p_partkey % 5 = 2 THEN 'Brand#3' WHEN p_partkey % 5 = 3 THEN 'Brand#4' ELSE 'none' END AS p_brand FROM part)""",
        "parse_ints": """
            SELECT event_id, CASE event_type WHEN 'view' THEN CAST(user_id AS INTEGER) WHEN 'click' THEN CAST(-user_id AS INTEGER)
              WHEN 'error' THEN CAST(user_id AS INTEGER) END AS parsed FROM events""",
        "db_type_alias": """
            SELECT event_id, CASE event_type WHEN 'view' THEN 'postgresql' WHEN 'click' THEN 'mysql' WHEN 'error' THEN 'postgresql'
              WHEN 'signup' THEN 'sqlite' END AS canonical FROM events""",
        "split_names": """
            SELECT c_custkey, c_name || '|' || c_mktsegment AS names, c_name AS first_part FROM customer""",
        "drop_absent_settings": """
            SELECT p_partkey, CASE WHEN p_size > 25 THEN 'brand,name,size' ELSE 'brand,name' END AS kept FROM part""",
        "incremental_delta_orders": _delta("s1"),
        "differential_delta_orders": _delta("s0"),
        "chain_restore_incremental": "SELECT * FROM orders",
        "chain_restore_differential": "SELECT * FROM orders",
        "chain_restore_mixed": "SELECT * FROM orders",
        "chain_restore_earlier_state": f"WITH {_ORDER_STATES} SELECT * FROM s1",
        "keyless_delta_lineitem": f"""WITH {_LINE_STATES},
            added AS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM k1),
            removed AS (SELECT * FROM k1 EXCEPT ALL SELECT * FROM lineitem)
            SELECT *, count(*) AS copies FROM added GROUP BY ALL
            UNION ALL SELECT *, -count(*) FROM removed GROUP BY ALL""",
        "keyless_chain_restore_lineitem": "SELECT * FROM lineitem",
        "small_change_delta_lineitem": """
            WITH l AS (SELECT * FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09)
            SELECT *, count(*) AS copies FROM l WHERE l_returnflag = 'R' GROUP BY ALL
            UNION ALL SELECT *, -count(*) FROM l WHERE l_returnflag = 'N' GROUP BY ALL""",
        "dedup_full_restore_orders": "SELECT *, true AS unwritten FROM orders",
        "sweep_after_expiry": """
            SELECT 'kept' AS run, count(*) AS restored, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, true AS exact FROM orders
            UNION ALL SELECT 'between', count(*), CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT), true
            FROM orders WHERE o_orderpriority = '1-URGENT'""",
        "highwater_delta_events": """
            SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')""",
        "highwater_chain_restore_events": "SELECT * FROM events",
        "backup_chains": f"""{chains}
            marked AS (
              SELECT *, max(CASE WHEN backup_type = 'full' THEN seg END) OVER w AS full_seg,
                max(CASE WHEN backup_type <> 'incremental' THEN inc END) OVER w AS head_inc
              FROM counted WINDOW w AS (PARTITION BY db_name ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)
            )
            SELECT id, db_name, backup_type, started_at, CAST(grp AS BIGINT) AS grp, CAST(seg AS BIGINT) AS seg,
              CAST(CASE WHEN grp = 0 THEN NULL WHEN backup_type = 'full' THEN 1 WHEN backup_type = 'differential' THEN 2
                ELSE 1 + CASE WHEN seg > full_seg THEN 1 ELSE 0 END + inc - head_inc END AS BIGINT) AS chain_length
            FROM marked""",
        "restore_chain_latest": f"""{chains}
            target AS (
              SELECT db_name, grp AS t_grp, seg AS t_seg, backup_type AS t_type, id AS t_id FROM counted
              QUALIFY row_number() OVER (PARTITION BY db_name ORDER BY started_at DESC, id DESC) = 1
            )
            SELECT c.db_name, t_id AS target_id, c.id, c.backup_type, c.started_at FROM counted c JOIN target USING (db_name)
            WHERE grp = t_grp AND (c.backup_type = 'full' OR (t_type <> 'full' AND id = t_id) OR (t_type = 'incremental' AND seg = t_seg))""",
        "base_selection": f"""WITH {_JOBS}
            SELECT id, db_name, backup_type, started_at FROM jobs
            WHERE status = 'success' AND db_name = 'db2' AND backup_type = 'full' AND started_at < TIMESTAMP '2024-01-20'
            ORDER BY started_at DESC, id DESC LIMIT 1""",
        "retention_expired": f"""{chains}
            flagged AS (SELECT *, started_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AS kept FROM counted),
            needed AS (
              SELECT *, bool_or(kept) OVER (PARTITION BY db_name, grp) AS grp_kept,
                bool_or(kept AND backup_type = 'incremental') OVER (PARTITION BY db_name, seg) AS seg_kept
              FROM flagged
            )
            SELECT id, db_name, backup_type, started_at FROM needed
            WHERE NOT kept AND NOT CASE WHEN backup_type = 'full' THEN grp_kept AND grp > 0 ELSE seg_kept AND seg > 0 END""",
        "size_cap_violations": f"""WITH {_JOBS}
            SELECT id, db_name, file_size FROM jobs WHERE status = 'success' AND file_size > 100 * 1048576""",
        "log_stream_ingest": f"""WITH {_LOGS} SELECT event_id, level, message, "timestamp", module, props FROM logs""",
        "log_growing_file_ingest": f"""WITH {_LOGS} SELECT event_id, level, message, "timestamp", module FROM logs""",
        "log_stream_errors": f"""WITH {_LOGS} SELECT event_id, level, message, "timestamp" FROM logs WHERE level = 'error'""",
    }
