"""The same results in plain SQL over the test tables."""

from __future__ import annotations

from tidemark.operators.detections import OBJECT_NAMES
from tidemark.operators.orders import CATEGORIES, CUSTOMER_WEIGHTS
from tidemark.registry.inputs import LONG_VALUE

_PARTS = "strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day"
_HOUR = "strftime(ts, '%H') AS hour"
_KEYS = f"{_PARTS}, {_HOUR}"
_INT_KEYS = "year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour"
_RAW = (
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props, "
    f"{_KEYS} FROM events"
)
_ID = "CAST(event_id AS VARCHAR)"
_HEAD = f"""'{{"event_id":' || {_ID} || ',"event_type":"' || event_type || '","value":'"""
_PLAIN = f"({_HEAD} || CAST(value AS VARCHAR) || '}}')"
_GOOD = f"""CASE WHEN event_id % 11 = 4 THEN '{{"event_type":"first","value":0.5,' || substr({_PLAIN}, 2) ELSE {_PLAIN} END"""
_LINES = f"""SELECT event_id, event_type, value, event_id % 7 AS kind,
  CASE event_id % 7 WHEN 3 THEN {_HEAD} || '"oops"}}' WHEN 5 THEN 'event ' || {_ID}
  WHEN 2 THEN ({_GOOD}) || ({_GOOD}) WHEN 6 THEN ({_GOOD}) || ' tail' ELSE ({_GOOD}) END AS line FROM events"""
_ROUTED = f"""SELECT CASE WHEN kind IN (0, 1, 4) THEN event_id END AS event_id,
  CASE WHEN kind IN (0, 1, 4) THEN event_type END AS event_type,
  CASE WHEN kind IN (0, 1, 4) THEN value END AS value,
  CASE WHEN kind NOT IN (0, 1, 4) THEN line END AS failed_text FROM ({_LINES})"""
_READABLE = "(SELECT * FROM orders WHERE o_orderkey % 17 > 2)"
_CHANGES = f"""SELECT o_orderkey, 'N' AS new_status, o_totalprice AS new_total, CAST(NULL AS VARCHAR) AS old_status
  FROM {_READABLE} WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'O', o_totalprice, NULL FROM {_READABLE} WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'N' FROM {_READABLE} WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_orderkey, NULL, NULL, o_orderstatus FROM {_READABLE} WHERE o_orderstatus NOT IN ('O', 'F')"""
_NOTICES = """SELECT doc_id,
  CASE WHEN kind IN (0, 1, 5) THEN NULL WHEN kind = 4 THEN ''
    ELSE source || '/' || CAST(doc_id AS VARCHAR) || suffix END AS key,
  CASE WHEN kind NOT IN (0, 1) THEN 'docs-' || lang END AS bucket,
  CASE WHEN kind NOT IN (0, 1, 3) THEN 'arn:docs-' || lang END AS arn
  FROM (SELECT *, doc_id % 10 AS kind, '.txt' AS suffix FROM documents
        UNION ALL SELECT *, 2 AS kind, '.meta' AS suffix FROM documents WHERE doc_id % 10 = 2)"""
_SCORES = """SELECT vec_id, CAST(label * 8 + i % 8 AS DOUBLE) AS class,
  abs(CAST(embedding[i + 1] AS DOUBLE)) AS score
  FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS i FROM embeddings)"""
_BEST = f"SELECT vec_id, class, max(score) AS score FROM ({_SCORES}) WHERE score > 0.15 GROUP BY vec_id, class"
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(OBJECT_NAMES))

_DRIFT = """SELECT strftime(ts, '%Y-%m-%d') AS day, unnest(['id', 'mixed', 'real', 'none', 'more']) AS field,
  unnest(CASE WHEN day(ts) % 2 = 1 THEN ['BIGINT', 'BIGINT', 'BIGINT', 'VOID']
    ELSE ['BIGINT', 'STRING', 'DOUBLE', 'VOID', 'OBJECT'] END) AS type FROM events"""
_DRIFT = f"SELECT * FROM ({_DRIFT}) WHERE type IS NOT NULL"
_UPLOADED_NAME = f"""CASE WHEN c_custkey % 1000 = 7 THEN repeat(',"', {LONG_VALUE}) WHEN c_custkey % 5 = 0 THEN c_name || 'x'
  WHEN c_custkey % 5 = 1 THEN c_name || ', open' WHEN c_custkey % 5 = 2 THEN c_name || '"y"' ELSE c_name END"""


def _draw(seed: int, number: int) -> str:
    digits = f"substr(sha256(CAST(o_orderkey AS VARCHAR) || '-{seed}'), {1 + 10 * number}, 10)"
    return f"(CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) + 0.5) / 1099511627776.0"


def _weighted(u: str, weights: dict[str, int]) -> str:
    upper, cases = 0, []
    for name, weight in weights.items():
        upper += weight
        cases.append(f"WHEN {u} * {sum(weights.values())}.0 < {upper} THEN '{name}'")
    return f"CASE {' '.join(cases)} END"


def _by_category(field: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {getattr(c, field)!r}" for n, c in CATEGORIES.items())
    return f"CASE category {cases} END"


def _orders(seed: int) -> str:
    draws = ", ".join(f"{_draw(seed, i)} AS u{i}" for i in range(6))
    category = _weighted("u0", {n: c.weight for n, c in CATEGORIES.items()})
    return f"""WITH d AS (SELECT o_orderkey, o_orderdate, {draws} FROM orders),
  c AS (SELECT *, {category} AS category FROM d)
  SELECT o_orderkey, CASE WHEN u1 > 0.05 THEN {_weighted("u2", CUSTOMER_WEIGHTS)} END AS customer_id,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date,
    {_by_category("sku_prefix")} || '-' ||
      CAST((1 + CAST(round(-ln(u3) / {_by_category("sku_rate")}) AS BIGINT)) * 9973 AS VARCHAR) AS sku,
    round({_by_category("price_mean")} + {_by_category("price_std")} * sqrt(-2.0 * ln(u4)) * cos(2.0 * pi() * u5), 4)
      AS price
  FROM c"""


ORACLE: dict[str, str] = {
    "scan_partitioned_json": _RAW,
    "scan_inferred_json": """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, 'k' AS fields
      FROM events GROUP BY ALL""",
    "scan_ragged_csv": f"""WITH c AS (SELECT c_custkey AS k, {_UPLOADED_NAME} AS name FROM customer)
      SELECT CAST(k AS VARCHAR) AS c_custkey, CASE WHEN k % 7 <> 1 THEN name END AS c_name,
      CASE WHEN k % 7 = 1 THEN CAST(k AS VARCHAR) WHEN k % 7 = 0 AND k % 5 <> 1 THEN concat(k, '|', name, '|more')
      END AS all_values FROM c""",
    "scan_headed_documents": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source,
      CAST(n_chars AS VARCHAR) AS n_chars, 'doc_id,text,lang,source,n_chars' AS headers FROM documents""",
    "scan_csv_header": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source,
      CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "decode_typed_attributes": """SELECT s_suppkey,
      CASE WHEN s_nationkey <> 0 THEN CAST(s_suppkey * 3 AS DOUBLE) END AS lat,
      CASE WHEN s_nationkey NOT IN (0, 1) THEN s_acctbal END AS lng FROM supplier""",
    "scan_change_images": f"""SELECT *, CAST(NULL AS VARCHAR) AS failed_text FROM ({_CHANGES})
      UNION ALL SELECT o_orderkey, NULL, NULL, NULL, CASE o_orderkey % 17 WHEN 0 THEN 'not json ' ||
        CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '{{"Records":null}}' ELSE '{{"Records":[]}} tail' END
      FROM orders WHERE o_orderkey % 17 <= 2""",
    "stream_source": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props
      FROM events""",
    "write_partitioned_parquet": f"SELECT *, {_KEYS} FROM events",
    "stream_to_parquet": _RAW,
    "stream_raw_backup": f"SELECT line AS value FROM ({_LINES})",
    "route_malformed": _ROUTED,
    "land_stream": _ROUTED,
    "write_json_events": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
    "register_external_table": f"""SELECT {_KEYS}, event_type, count(*) AS records, max(value) AS max_value
      FROM events GROUP BY ALL""",
    "apply_mapping": """SELECT c_custkey AS customer_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
      c_acctbal AS balance, TRY_CAST(c_mktsegment AS INTEGER) AS segment_number FROM customer""",
    "resolve_choice": """SELECT event_id,
      CASE WHEN event_type <> 'error' AND event_id % 7 <> 0 AND event_id % 3 = 2 THEN user_id END AS p_bigint,
      CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 7 = 0 THEN '12345678901234567891.2500'
        WHEN event_id % 3 = 0 THEN CAST(CAST(value AS DECIMAL(38, 4)) AS VARCHAR) END AS p_decimal,
      CASE WHEN event_type <> 'error' AND event_id % 7 <> 0 AND event_id % 3 = 1 THEN event_type END AS p_string
      FROM events""",
    "drop_null_fields": "SELECT * FROM part",
    "flatten_columns": "SELECT vec_id, "
    + ", ".join(f"embedding[{i + 1}] AS embedding_{i}" for i in range(64))
    + ", label FROM embeddings",
    "flatten_map_columns": """SELECT o_orderkey,
      CASE o_orderstatus WHEN 'F' THEN o_totalprice END AS m_is_F_total,
      CASE o_orderstatus WHEN 'O' THEN o_totalprice END AS m_is_O_total,
      CASE o_orderstatus WHEN 'P' THEN o_totalprice END AS m_is_P_total,
      CAST(o_custkey AS DOUBLE) AS m_key_total FROM orders""",
    "flatten_paths": """WITH e AS (SELECT * FROM events WHERE event_id % 50 > 1)
      SELECT event_id, 'p.k' AS path, json_extract_string(props, '$.k') AS value FROM e
      UNION ALL SELECT event_id, 't.0', event_type FROM e
      UNION ALL SELECT event_id, 't.1', NULL FROM e
      UNION ALL SELECT event_id, NULL, repeat('[', 200) FROM events WHERE event_id % 50 = 0
      UNION ALL SELECT event_id, rtrim(repeat('0.', 30), '.'), '1' FROM events WHERE event_id % 50 = 1""",
    "row_to_event": """SELECT 'extracted' AS status, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS headers,
      concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) AS data,
      concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) AS fields FROM customer""",
    "decode_payload": f"""SELECT vec_id, 'fragment-' || CAST(vec_id AS VARCHAR) AS fragment,
      'frame-' || CAST(vec_id AS VARCHAR) AS frame, 'camera' AS stream_name,
      count(*) AS n_predictions, max(score) AS top_score, sum(class) AS sum_class, round(sum(score), 6) AS sum_score
      FROM ({_SCORES}) WHERE vec_id % 11 > 2 GROUP BY vec_id
      UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM embeddings WHERE vec_id % 11 <= 2""",
    "unreadable_detections": """SELECT vec_id, CASE vec_id % 11 WHEN 0 THEN '%%%' WHEN 1 THEN 'a' ELSE '//4=' END
      AS payload FROM embeddings WHERE vec_id % 11 <= 2""",
    "partition_values_from_path": f"SELECT event_id, {_KEYS}, strftime(ts, '%Y/%m/%d/%H') AS parts FROM events",
    "time_partition_columns": f"SELECT event_id, ts, {_KEYS} FROM events",
    "normalise_partition_keys": """WITH e AS (SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d,
        hour(ts) AS h, event_id % 13 = 0 AS wide FROM events),
      n AS (SELECT event_id, wide, CASE WHEN wide THEN 10 * y + 1 ELSE y END AS year,
        CASE WHEN wide THEN 10 * m + 1 ELSE m END AS month, CASE WHEN wide THEN 10 * d + 1 ELSE d END AS day,
        CASE WHEN wide THEN 10 * h + 1 ELSE h END AS hour FROM e)
      SELECT event_id, year, month, day, hour, CAST(year AS VARCHAR) AS year_text,
        CASE WHEN month < 10 THEN '0' ELSE '' END || CAST(month AS VARCHAR) AS month_text,
        CASE WHEN day < 10 THEN '0' ELSE '' END || CAST(day AS VARCHAR) AS day_text,
        CASE WHEN hour < 10 THEN '0' ELSE '' END || CAST(hour AS VARCHAR) AS hour_text FROM n""",
    "require_fields": f"""SELECT *, CASE WHEN key IS NOT NULL AND bucket IS NOT NULL AND arn IS NOT NULL
      THEN 'kept' ELSE 'rejected' END AS outcome, CASE doc_id % 10 WHEN 0 THEN '{{}}'
        WHEN 1 THEN '{{"Message":"{{\\"Records\\":[]}}"}}'
        WHEN 3 THEN '{{"Message":"{{\\"Records\\":[{{\\"s3\\":{{\\"object\\":{{\\"key\\":\\"' || key ||
          '\\"}},\\"bucket\\":{{\\"name\\":\\"' || bucket || '\\"}}}}}}]}}"}}'
        WHEN 5 THEN '{{"Message":"{{\\"Records\\":[{{\\"s3\\":{{\\"object\\":{{}},\\"bucket\\":{{\\"name\\":\\"' || bucket ||
          '\\",\\"arn\\":\\"' || arn || '\\"}}}}}}]}}"}}' END AS body FROM ({_NOTICES})""",
    "split_images": f"""SELECT o_orderkey, 'new' AS kind, new_status AS status FROM ({_CHANGES})
      WHERE new_status IS NOT NULL
      UNION ALL SELECT o_orderkey, 'old', old_status FROM ({_CHANGES}) WHERE old_status IS NOT NULL""",
    "score_threshold": f"SELECT * FROM ({_SCORES}) WHERE score > 0.15",
    "partition_filter": f"SELECT * FROM ({_RAW}) WHERE day = '05'",
    "clean_orders": """SELECT o_orderkey, o_custkey AS customer_id, o_totalprice FROM orders
      WHERE o_orderkey % 20 <> 0 AND o_custkey IS NOT NULL""",
    "unnest_notifications": _NOTICES,
    "explode_predictions": _SCORES,
    "partition_grid": """WITH y AS (SELECT event_type, min(year(ts)) AS lo, max(year(ts)) AS hi FROM events GROUP BY 1),
      a AS (SELECT event_type, unnest(range(lo, hi + 1)) AS year FROM y),
      b AS (SELECT *, unnest(range(1, 13)) AS month FROM a),
      c AS (SELECT *, unnest(range(1, 32)) AS day FROM b),
      d AS (SELECT *, unnest(range(0, 24)) AS hour FROM c)
      SELECT event_type, year, month, day, hour, 'sensors/year=' || CAST(year AS VARCHAR) || '/month=' ||
        CAST(month AS VARCHAR) || '/day=' || CAST(day AS VARCHAR) || '/hour=' || CAST(hour AS VARCHAR) AS location
      FROM d""",
    "synthetic_orders": _orders(1),
    "order_stream": _orders(2),
    "label_lookup": f"""SELECT vec_id, label * 9 - 1 AS class, name AS class_name FROM embeddings
      LEFT JOIN (VALUES {_NAMES}) AS n(number, name) ON label * 9 - 1 = number""",
    "partition_gaps": f"""WITH a AS (SELECT DISTINCT event_type, {_INT_KEYS} FROM events),
      m AS (SELECT event_type, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY 1),
      h AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM m)
      SELECT event_type, {_INT_KEYS} FROM h EXCEPT SELECT event_type, year, month, day, hour FROM a""",
    "stale_partitions": """WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, max(o_orderdate) AS newest_source
        FROM orders GROUP BY 1),
      l AS (SELECT *, CASE month(newest_source) % 3 WHEN 1 THEN newest_source - INTERVAL 1 DAY
        WHEN 2 THEN newest_source + INTERVAL 1 DAY END AS last_load FROM s)
      SELECT month, newest_source, last_load FROM l WHERE last_load IS NULL OR last_load < newest_source""",
    "revenue_by_state": """SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue,
      count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY n_name""",
    "best_score_per_class": _BEST,
    "best_scores_in_record": _BEST,
    "distinct_partitions": f"SELECT DISTINCT {_KEYS} FROM events",
    "batch_record_count": "SELECT strftime(ts, '%Y-%m-%d %H') AS batch, count(*) AS records FROM events GROUP BY 1",
    "table_profile": """WITH t AS (SELECT octet_length(encode(translate(text, chr(13) || chr(10), '  '))) AS n FROM documents)
      SELECT CAST(4 AS BIGINT) AS objects, count(*) AS records, CAST(sum(n + 1) AS BIGINT) AS total_bytes, CAST(sum(n) AS BIGINT) AS record_bytes,
        round(sum(n + 1) / count(*), 6) AS average FROM t""",
    "per_minute_sums": """SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS records,
      CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY ALL""",
    "per_minute_lag": """WITH e AS (SELECT event_type, ts, ts + to_milliseconds((event_id * 37) % 5000) AS arrived FROM events)
      SELECT date_trunc('minute', arrived) AS minute, event_type, max(lag) AS max_lag_ms,
        round(avg(lag), 6) AS avg_lag_ms
      FROM (SELECT *, epoch_ms(arrived) - epoch_ms(ts) AS lag FROM e) GROUP BY 1, 2""",
    "top_sku": """SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY l_partkey
      ORDER BY sold DESC, l_partkey LIMIT 10""",
    "stream_top": """SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY l_partkey
      ORDER BY sold DESC, l_partkey LIMIT 10""",
    "m_of_n_alarm": """WITH p AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS period, event_type, avg(value) AS average
        FROM events GROUP BY 1, 2),
      b AS (SELECT *, CAST(sum(CAST(average > 60 AS INTEGER)) OVER (PARTITION BY event_type ORDER BY period
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS breaches FROM p)
      SELECT period, event_type, round(average, 6) AS average, breaches, breaches >= 2 AS alarm FROM b""",
    "try_records": """SELECT o_orderkey, CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey END AS customer,
      CASE WHEN o_orderkey % 20 = 0 THEN 3 WHEN o_orderkey % 20 = 1 THEN greatest(2, 1 + o_custkey % 3)
        ELSE 1 + o_custkey % 3 END AS tries,
      CASE WHEN o_orderkey % 20 = 0 THEN 'dead' ELSE 'done' END AS state,
      CASE WHEN o_orderkey % 20 = 0 THEN 'no customer' END AS cause FROM orders""",
    "run_scripts": """SELECT event_type, count(*) AS records, CAST(3 AS BIGINT) AS run_1, CAST(0 AS BIGINT) AS run_2
      FROM events GROUP BY event_type""",
    "field_types": f"SELECT day, field, type, count(*) AS records FROM ({_DRIFT}) GROUP BY ALL",
    "schema_drift": f"""WITH t AS (SELECT DISTINCT day, field, type FROM ({_DRIFT})),
      d AS (SELECT count(DISTINCT day) AS partitions FROM t)
      SELECT field, CASE field WHEN 'real' THEN 'DOUBLE' WHEN 'mixed' THEN 'STRING' ELSE min(type) END AS merged,
        partitions, count(*) AS holding, count(DISTINCT type) AS kinds FROM t, d GROUP BY field, partitions
      HAVING count(*) < partitions OR count(DISTINCT type) > 1""",
    "stream_alarm": """WITH p AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS period, event_type, avg(value) AS average
        FROM events GROUP BY 1, 2),
      b AS (SELECT *, CAST(sum(CAST(average > 60 AS INTEGER)) OVER (PARTITION BY event_type ORDER BY period
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS breaches FROM p)
      SELECT period, event_type, round(average, 6) AS average, breaches, breaches >= 2 AS alarm FROM b
      WHERE period + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
    "stream_since": f"""SELECT * FROM ({_RAW}) WHERE strptime(ts, '%Y-%m-%d %H:%M:%S') >=
      (SELECT date_trunc('hour', max(ts) - INTERVAL 36 HOURS) FROM events)""",
    "land_sized": _RAW,
    "distinct_notices": f"""SELECT DISTINCT doc_id, key, bucket, arn FROM ({_NOTICES})
      WHERE key <> '' AND bucket IS NOT NULL AND arn IS NOT NULL""",
    "curated_events": """SELECT event_type, day(ts) AS day, count(*) AS records,
      min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_datetime, max(value) AS max_value, false AS has_note
      FROM events GROUP BY 1, 2""",
    "refreshed_tables": """SELECT 'tidemark_' || event_type AS name, count(*) AS records FROM events
      WHERE event_type IN ('click', 'error') GROUP BY event_type""",
    "ingested_uploads": f"""SELECT 'extracted' AS status, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'c_custkey,c_name'
        WHEN 'BUILDING' THEN 'c_mktsegment,c_nationkey,c_custkey'
        ELSE 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' END AS headers,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN concat_ws(',', c_custkey, {_UPLOADED_NAME})
        WHEN 'BUILDING' THEN concat_ws(',', c_mktsegment, c_nationkey, c_custkey)
        ELSE concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) END AS data
      FROM customer WHERE lower(c_mktsegment) <> 'machinery'
      UNION ALL SELECT 'rejected', 'absent.csv', NULL FROM (SELECT unnest([1, 2]))""",
    "detections_report": f"""SELECT vec_id, 'camera' AS stream_name, class, name AS class_name, score FROM ({_BEST})
      LEFT JOIN (VALUES {_NAMES}) AS n(number, name) ON class = number WHERE vec_id % 11 > 2""",
}
