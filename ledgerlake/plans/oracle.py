"""SQL twins of the registered queries, computed from the given tables without JSON.

The expected values follow from the formulas that derive the inputs (see
``plans.derived``), so nothing here parses a payload.
"""

TS = "'%Y-%m-%d %H:%M:%S.%f'"
ISO = "'%Y-%m-%dT%H:%M:%S.%f'"


def ts(expr: str, name: str) -> str:
    return f"strftime({expr}, {TS}) AS {name}"


def listed(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(",")]


_BOOKING_PAYLOAD = f"""
CASE WHEN defect = 'malformed' THEN '{{"event_id":' ELSE '{{' || concat_ws(',',
  CASE WHEN defect IS DISTINCT FROM 'no_id' THEN '"event_id":"b-' || m || '"' END,
  '"event_type":"' || event_type || '"',
  '"event_time":"' || CASE WHEN defect = 'time' THEN 'not-a-time' ELSE strftime(event_time, {ISO}) END || '"',
  '"ingest_time":"' || strftime(event_time, {ISO}) || '"',
  '"schema_version":' || CASE WHEN defect = 'version' THEN 2 ELSE 1 END,
  '"booking_id":' || booking_id,
  '"shop_id":' || shop_id,
  CASE WHEN defect = 'customer' THEN '"customer_id":"abc"' ELSE '"customer_id":' || customer_id END,
  '"service_id":' || service_id,
  '"staff_id":' || staff_id,
  '"booked_price_krw":' || booked_price_krw,
  '"old_start_at":"' || strftime(old_start_at, {ISO}) || '"',
  '"start_at":"' || strftime(start_at, {ISO}) || '"',
  '"cancelled_at":"' || strftime(cancelled_at, {ISO}) || '"',
  '"status":"' || status || '"') || '}}' END
"""

BOOKINGS = f"""
WITH base AS (
  SELECT event_id AS m, user_id, event_type AS src, ts, value,
    CASE WHEN event_id % 101 = 0 THEN 'malformed' WHEN event_id % 103 = 0 THEN 'no_id'
         WHEN event_id % 107 = 0 THEN 'version' WHEN event_id % 109 = 0 THEN 'booking'
         WHEN event_id % 113 = 0 THEN 'time' WHEN event_id % 127 = 0 THEN 'customer'
         WHEN event_type = 'signup' AND event_id % 131 = 0 THEN 'price'
         WHEN event_id % 137 = 0 THEN 'status' END AS defect
  FROM events
), shaped AS (
  SELECT m, defect, 'b-' || m AS event_id, date_trunc('hour', ts) AS event_time,
    CASE src WHEN 'signup' THEN 'booking_created' WHEN 'view' THEN 'booking_rescheduled'
      WHEN 'error' THEN 'booking_cancelled' WHEN 'click' THEN 'checked_in'
      WHEN 'purchase' THEN 'no_show_marked' END AS event_type,
    CASE WHEN defect = 'booking' THEN 0 ELSE user_id + 1 END AS booking_id,
    user_id % 10 + 1 AS shop_id,
    CASE WHEN src = 'signup' AND defect IS DISTINCT FROM 'customer' THEN user_id % 7 + 1 END AS customer_id,
    CASE WHEN src = 'signup' THEN m % 5 + 1 END AS service_id,
    CASE WHEN src = 'signup' THEN m % 4 + 1 END AS staff_id,
    CASE WHEN defect = 'price' THEN -1 WHEN src = 'signup' THEN CAST(floor(value) AS BIGINT) * 100 END AS booked_price_krw,
    CASE WHEN src = 'signup' THEN ts + INTERVAL 1 DAY WHEN src = 'view' THEN ts + INTERVAL 2 DAY END AS start_at,
    CASE WHEN src = 'view' THEN ts + INTERVAL 12 HOUR END AS old_start_at,
    CASE WHEN src = 'error' THEN ts END AS cancelled_at,
    CASE WHEN defect IS DISTINCT FROM 'status' THEN CASE src WHEN 'signup' THEN 'scheduled'
      WHEN 'view' THEN 'rescheduled' WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'checked_in'
      WHEN 'purchase' THEN 'no_show' END END AS status,
    user_id % 3 AS kafka_partition, date_trunc('day', ts) + INTERVAL 1 DAY AS ingested,
    CASE defect WHEN 'malformed' THEN 'malformed_json' WHEN 'no_id' THEN 'missing_event_id'
      WHEN 'version' THEN 'unsupported_schema_version' WHEN 'booking' THEN 'invalid_required_id'
      WHEN 'time' THEN 'invalid_required_time' END AS envelope_error
  FROM base
), logical AS (
  SELECT *, {_BOOKING_PAYLOAD} AS payload,
    CASE WHEN defect = 'customer' THEN 'invalid_booking_type'
      WHEN defect = 'price' THEN 'invalid_booking_created_fields'
      WHEN defect = 'status' THEN CASE event_type
        WHEN 'booking_created' THEN 'invalid_booking_created_fields'
        WHEN 'booking_rescheduled' THEN 'invalid_booking_rescheduled_fields'
        WHEN 'booking_cancelled' THEN 'invalid_booking_cancelled_fields'
        WHEN 'checked_in' THEN 'invalid_checked_in_fields'
        ELSE 'invalid_no_show_fields' END END AS booking_error
  FROM shaped
), records AS (
  SELECT *, m * 2 AS kafka_offset, ingested AS bronze_ingested_at, 0 AS redelivered FROM logical
  UNION ALL
  SELECT *, m * 2 + 1, ingested + INTERVAL 1 DAY, 1 FROM logical WHERE m % 50 = 0
), parsed AS (
  SELECT * FROM logical WHERE envelope_error IS NULL
), clean AS (
  SELECT * FROM parsed WHERE booking_error IS NULL
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY event_time DESC NULLS LAST,
    ingested DESC NULLS LAST, kafka_partition, m) AS r FROM clean) WHERE r = 1
), creation AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY event_time NULLS FIRST,
    ingested NULLS FIRST, kafka_partition, m) AS r FROM clean WHERE event_type = 'booking_created') WHERE r = 1
), starts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY event_time DESC NULLS LAST,
    ingested DESC NULLS LAST, kafka_partition, m) AS r FROM clean WHERE start_at IS NOT NULL) WHERE r = 1
), now AS (
  SELECT s.booking_id, s.shop_id, s.status, t.start_at, s.cancelled_at, c.customer_id, c.service_id,
    c.staff_id, c.booked_price_krw, c.booking_id IS NULL AS is_orphan, s.event_id AS status_event_id,
    s.event_type AS status_event_type, s.event_time AS status_event_time, c.event_time AS created_event_time
  FROM latest s LEFT JOIN creation c ON c.booking_id = s.booking_id LEFT JOIN starts t ON t.booking_id = s.booking_id
), rejects AS (
  SELECT 'events_clean' AS validation_stage, envelope_error AS validation_error,
    CASE WHEN defect IN ('malformed', 'no_id') THEN NULL ELSE event_id END AS event_id,
    CASE WHEN defect = 'malformed' THEN NULL ELSE event_type END AS event_type,
    payload, kafka_partition, kafka_offset, bronze_ingested_at
  FROM records WHERE envelope_error IS NOT NULL
  UNION ALL
  SELECT 'booking_events_clean', booking_error, event_id, event_type, payload, kafka_partition, m * 2, ingested
  FROM parsed WHERE booking_error IS NOT NULL
), dq AS (
  SELECT *, coalesce('event:' || event_id,
      'kafka:booking.events.v1:' || kafka_partition || ':' || kafka_offset) AS dq_key FROM rejects
), shops AS (
  SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN opened_on + 15 END AS closed_on FROM (
    SELECT s_suppkey + 1 AS shop_id, s_suppkey, s_name AS shop_name, 'r' || (s_nationkey % 5) AS region,
      s_suppkey % 11 <> 0 AS is_active,
      CASE WHEN s_suppkey % 7 <> 3 THEN DATE '2024-01-01' + CAST(s_suppkey % 10 AS INTEGER) END AS opened_on
    FROM supplier)
), calendar AS (
  SELECT shop_id, shop_name, CAST(unnest(generate_series(opened_on, least(closed_on, DATE '2024-01-30'), INTERVAL 1 DAY)) AS DATE) AS report_date
  FROM shops WHERE opened_on < DATE '2024-01-31'
), daily AS (
  SELECT shop_id, CAST(event_time AS DATE) AS report_date,
    count(*) FILTER (WHERE event_type = 'booking_created') AS created_count,
    count(*) FILTER (WHERE event_type = 'booking_cancelled') AS cancelled_count
  FROM clean WHERE event_type IN ('booking_created', 'booking_cancelled') GROUP BY 1, 2
)
"""

_COMPLETED_STATUS = "CASE WHEN collected = request THEN 'paid' ELSE 'unpaid' END"

PAYMENTS = f"""
WITH lines AS (
  SELECT l_orderkey AS okey, CAST(floor(l_extendedprice) AS BIGINT) AS amount, l_returnflag = 'R' AS returned,
    l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem
), numbered AS (
  SELECT okey, amount, returned, row_number() OVER w AS k, sum(amount) OVER w AS collected,
    count(*) FILTER (WHERE returned) OVER w AS j,
    coalesce(sum(amount) FILTER (WHERE returned) OVER w, 0) AS refunded,
    sum(amount) OVER (PARTITION BY okey) AS request
  FROM lines WINDOW w AS (PARTITION BY okey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), moves AS (
  SELECT okey, 'requested' AS kind, 0 AS n, CAST(NULL AS BIGINT) AS amount, 0 AS payout, 0 AS refund, request FROM numbered WHERE k = 1
  UNION ALL
  SELECT okey, 'completed', k, amount, collected, 0, request FROM numbered
  UNION ALL
  SELECT okey, 'refunded', j, amount, request, refunded, request FROM numbered WHERE returned
), base AS (
  SELECT m.okey, kind, n, request, CAST(payout AS BIGINT) AS payout, CAST(refund AS BIGINT) AS refund,
    CAST(payout - refund AS BIGINT) AS paid, amount, o_custkey, okey * 1000 + n + CASE WHEN kind = 'refunded' THEN 500 ELSE 0 END AS row_id,
    o_orderdate + to_hours(CAST(n + CASE WHEN kind = 'refunded' THEN 500 ELSE 0 END AS INTEGER)) AS event_time,
    CASE WHEN kind = 'completed' AND n = 1 THEN
      CASE WHEN okey % 97 = 0 THEN 'amount' WHEN okey % 101 = 0 THEN 'payment' WHEN okey % 103 = 0 THEN 'payout'
        WHEN okey % 107 = 0 THEN 'weird' WHEN okey % 109 = 0 THEN 'repayment' WHEN okey % 113 = 0 THEN 'refund_type'
        WHEN okey % 127 = 0 THEN 'status' END END AS defect
  FROM moves m JOIN orders ON o_orderkey = m.okey
), events_p AS (
  SELECT okey, kind, n, defect, row_id, event_time,
    'p-' || okey || '-' || CASE WHEN kind = 'refunded' THEN 'r' ELSE '' END || n AS event_id,
    'payment_' || kind AS event_type,
    CASE WHEN defect = 'payment' THEN NULL ELSE okey + 1 END AS payment_id,
    CASE WHEN kind <> 'requested' THEN row_id END AS payment_transaction_id,
    o_custkey + 1 AS booking_id, o_custkey % 10 + 1 AS shop_id,
    CAST(request AS BIGINT) AS request_amount_krw,
    CASE kind WHEN 'completed' THEN 'payment' WHEN 'refunded' THEN 'refund' END AS transaction_type,
    CAST(CASE WHEN defect = 'amount' THEN request + 1 WHEN kind <> 'requested' THEN amount END AS BIGINT) AS amount_krw,
    CASE WHEN defect = 'payout' THEN payout + 1 ELSE payout END AS payout_amount_krw,
    refund AS refund_amount_krw, paid AS paid_amount_krw,
    CAST(CASE WHEN kind = 'refunded' THEN 0 ELSE request - paid END AS BIGINT) AS unpaid_amount_krw,
    CASE WHEN defect = 'weird' THEN 'weird' WHEN defect = 'status' THEN NULL
      WHEN kind = 'refunded' THEN CASE WHEN paid > 0 THEN 'partially_refunded' ELSE 'refunded' END
      WHEN paid = request THEN 'paid' ELSE 'unpaid' END AS payment_status,
    CASE WHEN defect = 'repayment' THEN NULL ELSE false END AS needs_repayment,
    CASE WHEN defect = 'refund_type' THEN 'full' WHEN kind = 'refunded' THEN CASE WHEN paid > 0 THEN 'partial' ELSE 'full' END END AS refund_type,
    CASE defect WHEN 'amount' THEN 'invalid_payment_transaction_fields' WHEN 'payment' THEN 'invalid_payment_type'
      WHEN 'payout' THEN 'inconsistent_payment_amounts' WHEN 'weird' THEN 'inconsistent_payment_status'
      WHEN 'repayment' THEN 'invalid_payment_summary' WHEN 'refund_type' THEN 'invalid_payment_completed_fields' END AS payment_error,
    date_trunc('day', event_time) + INTERVAL 1 DAY AS ingested, okey % 3 AS kafka_partition, 20000000 + row_id AS kafka_offset
  FROM base
), clean AS (
  SELECT * FROM events_p WHERE payment_error IS NULL
), tx AS (
  SELECT *, CASE WHEN defect = 'payment' THEN 'invalid_payment_type'
    WHEN defect = 'amount' THEN 'payment_amount_exceeds_request'
    WHEN kind = 'completed' AND (payment_status IS NULL OR payment_status <> 'paid' OR refund_type IS NOT NULL)
      THEN 'invalid_payment_completed_fields' END AS tx_error
  FROM events_p WHERE kind <> 'requested'
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY event_time DESC NULLS LAST,
    ingested DESC NULLS LAST, kafka_partition, kafka_offset) AS r FROM clean) WHERE r = 1
), request AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY event_time, ingested,
    kafka_partition, kafka_offset) AS r FROM clean WHERE kind = 'requested') WHERE r = 1
), now AS (
  SELECT s.payment_id, s.booking_id, s.shop_id, s.request_amount_krw, s.payout_amount_krw, s.refund_amount_krw,
    s.paid_amount_krw, s.unpaid_amount_krw, s.payment_status, s.needs_repayment,
    s.payment_transaction_id AS latest_transaction_id, s.transaction_type AS latest_transaction_type,
    s.amount_krw AS latest_transaction_amount_krw, c.payment_id IS NULL AS is_orphan,
    s.event_id AS state_event_id, s.event_type AS state_event_type, s.event_time AS state_event_time,
    c.event_time AS requested_event_time
  FROM latest s LEFT JOIN request c ON c.payment_id = s.payment_id
), ledger AS (
  SELECT payment_id, coalesce(sum(amount_krw) FILTER (WHERE transaction_type = 'payment'), 0) AS ledger_payout,
    coalesce(sum(amount_krw) FILTER (WHERE transaction_type = 'refund'), 0) AS ledger_refund
  FROM clean WHERE payment_transaction_id IS NOT NULL GROUP BY 1
), replay AS (
  SELECT *, sum(CASE WHEN transaction_type = 'payment' THEN amount_krw ELSE 0 END) OVER w AS rp,
    sum(CASE WHEN transaction_type = 'refund' THEN amount_krw ELSE 0 END) OVER w AS rr
  FROM clean WINDOW w AS (PARTITION BY payment_id ORDER BY event_time, ingested, kafka_partition, kafka_offset
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""

# both domains in one statement, for queries that cross them
BOTH = (
    BOOKINGS.rstrip()
    + ", "
    + PAYMENTS.strip()
    .removeprefix("WITH ")
    .replace("clean AS (", "clean_p AS (", 1)
    .replace("FROM clean ", "FROM clean_p ")
    .replace("FROM clean)", "FROM clean_p)")
    .replace("latest AS (", "latest_p AS (", 1)
    .replace("FROM latest ", "FROM latest_p ")
    .replace("base AS (", "base_p AS (", 1)
    .replace("FROM base\n", "FROM base_p\n")
    .replace("now AS (", "now_p AS (", 1)
    + "\n"
)

_ENVELOPE = f"""event_id, event_type, 1 AS schema_version, {ts('event_time', 'event_time')},
  {ts('event_time', 'ingest_time')}, booking_id, shop_id"""
_BOOKING_LINEAGE = f"""payload, CAST(shop_id AS VARCHAR) AS kafka_key, 'booking.events.v1' AS kafka_topic,
  kafka_partition, m * 2 AS kafka_offset, {ts('ingested', 'kafka_timestamp')}, {ts('ingested', 'bronze_ingested_at')}"""
_EVENTS_CLEAN = f"{BOOKINGS} SELECT {_ENVELOPE}, {_BOOKING_LINEAGE} FROM parsed"

_BOOKINGS_NOW = f"""{BOOKINGS} SELECT booking_id, shop_id, status, {ts('start_at', 'start_at')},
  {ts('cancelled_at', 'cancelled_at')}, customer_id, service_id, staff_id, booked_price_krw, is_orphan,
  status_event_id, status_event_type, {ts('status_event_time', 'status_event_time')},
  {ts('created_event_time', 'created_event_time')} FROM now"""

_PAYMENTS_NOW = f"""{PAYMENTS} SELECT payment_id, booking_id, shop_id, request_amount_krw, payout_amount_krw,
  refund_amount_krw, paid_amount_krw, unpaid_amount_krw, payment_status, needs_repayment, latest_transaction_id,
  latest_transaction_type, latest_transaction_amount_krw, is_orphan, state_event_id, state_event_type,
  {ts('state_event_time', 'state_event_time')}, {ts('requested_event_time', 'requested_event_time')} FROM now"""


def _payment_payload() -> str:
    plain = listed("booking_id, shop_id")
    amounts = listed(
        "payment_transaction_id, request_amount_krw, amount_krw, payout_amount_krw, "
        "refund_amount_krw, paid_amount_krw, unpaid_amount_krw"
    )
    number = lambda c: f"""'"{c}":' || {c}"""
    text = lambda c: f"""'"{c}":"' || {c} || '"'"""
    at = f"""strftime(event_time, {ISO}) || '"'"""
    members = [
        text("event_id"),
        text("event_type"),
        f"""'"event_time":"' || {at}""",
        f"""'"ingest_time":"' || {at}""",
        "'\"schema_version\":1'",
        *map(number, plain),
        """CASE WHEN payment_id IS NULL THEN '"payment_id":"x"' ELSE '"payment_id":' || payment_id END""",
        *map(number, amounts),
        text("payment_status"),
        """CASE WHEN needs_repayment IS NOT NULL THEN '"needs_repayment":false' END""",
        text("refund_type"),
    ]
    return "'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"


_PAYMENT_LINEAGE = f"""{_payment_payload()} AS payload, CAST(shop_id AS VARCHAR) AS kafka_key,
  'booking.events.v1' AS kafka_topic, kafka_partition, kafka_offset,
  {ts('ingested', 'kafka_timestamp')}, {ts('ingested', 'bronze_ingested_at')}"""

_STRICT = "CASE WHEN defect = 'status' THEN 'inconsistent_payment_status' ELSE payment_error END"

_DQ_COLUMNS = f"""dq_key, event_id, event_type, validation_stage, validation_error, payload,
  'booking.events.v1' AS kafka_topic, kafka_partition, kafka_offset,
  {ts('bronze_ingested_at', 'kafka_timestamp')}, {ts('bronze_ingested_at', 'bronze_ingested_at')}"""
_RUN_1, _RUN_2 = "2024-02-01 00:00:00.000000", "2024-02-02 00:00:00.000000"
_SEEN = f"'{_RUN_1}' AS first_detected_at, '{_RUN_1}' AS last_detected_at"


def _top_dq(where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dq_key ORDER BY
      bronze_ingested_at DESC NULLS LAST, kafka_partition DESC NULLS LAST, kafka_offset DESC NULLS LAST) AS r
      FROM dq WHERE {where}) WHERE r = 1"""


_RUN_REPORT_EVENTS = """SELECT 'events_clean' AS stage, (SELECT count(*) FROM records) AS input_rows,
  (SELECT count(*) FROM records WHERE envelope_error IS NOT NULL) AS rejected_rows,
  (SELECT count(*) FROM records WHERE envelope_error IS NULL) - (SELECT count(*) FROM parsed) AS duplicate_rows,
  (SELECT count(*) FROM parsed) AS stored_rows, 0 AS orphan_rows, 0 AS violations"""

_LEDGER = """now JOIN (SELECT payment_id AS pid, ledger_payout, ledger_refund, ledger_payout - ledger_refund AS ledger_paid
  FROM ledger UNION ALL SELECT payment_id, 0, 0, 0 FROM now WHERE payment_id NOT IN (SELECT payment_id FROM ledger)) ON pid = payment_id"""

ORACLES = {
    "bronze_bookings": f"""{BOOKINGS} SELECT payload, payload AS kafka_value, CAST(shop_id AS VARCHAR) AS kafka_key,
      'booking.events.v1' AS kafka_topic, kafka_partition, kafka_offset, {ts('bronze_ingested_at', 'kafka_timestamp')},
      0 AS kafka_timestamp_type, {ts('bronze_ingested_at', 'bronze_ingested_at')} FROM records""",
    "bronze_rows_count_by_partition": f"""{BOOKINGS} SELECT 'booking.events.v1' AS kafka_topic, kafka_partition,
      count(*) AS n FROM records GROUP BY 2""",
    "bronze_event_type_counts": f"""{BOOKINGS} SELECT CASE WHEN defect = 'malformed' THEN NULL ELSE event_type END AS event_type,
      count(*) AS n FROM records GROUP BY 1""",
    "bronze_shops": f"""{BOOKINGS} SELECT shop_id AS id, shop_name, region, is_active, CAST(opened_on AS VARCHAR) AS opened_on,
      CAST(closed_on AS VARCHAR) AS closed_on, '2024-01-01 00:00:00.000000' AS created_at,
      '2024-01-01 00:00:00.000000' AS updated_at, '2024-01-31 00:00:00.000000' AS bronze_ingested_at FROM shops""",
    "envelope_errors": f"{BOOKINGS} SELECT envelope_error AS validation_error, count(*) AS n FROM records GROUP BY 1",
    "events_clean": _EVENTS_CLEAN,
    "events_clean_ranked": _EVENTS_CLEAN,
    "payment_events_envelope": f"{PAYMENTS} SELECT event_type, count(*) AS n FROM events_p GROUP BY 1",
    "duplicate_positions": f"""{BOOKINGS} SELECT 'booking.events.v1' AS kafka_topic, kafka_partition, kafka_offset, 2 AS n
      FROM records WHERE redelivered = 1""",
    "payload_conflicts": f"""{BOOKINGS} SELECT event_id FROM records
      WHERE redelivered = 1 AND m % 7 = 0 AND envelope_error IS NULL""",
    "delivery_audit": f"""{BOOKINGS} SELECT deliveries, false AS payload_conflict, count(*) AS n FROM (
      SELECT event_id, count(*) AS deliveries FROM records WHERE envelope_error IS NULL GROUP BY 1) GROUP BY 1""",
    "settled_events": f"""{BOOKINGS} SELECT false AS rejected, event_id, CAST(NULL AS VARCHAR) AS validation_error,
        kafka_partition, m * 2 AS kafka_offset, CASE WHEN m % 50 = 0 THEN 2 ELSE 1 END AS deliveries,
        false AS payload_conflict FROM parsed
      UNION ALL SELECT true, event_id, validation_error, kafka_partition, kafka_offset,
        (SELECT count(*) FROM dq d WHERE d.dq_key = t.dq_key AND d.validation_stage = 'events_clean'), NULL
        FROM ({_top_dq("validation_stage = 'events_clean'")}) t""",
    "booking_errors": f"""{BOOKINGS} SELECT event_type, booking_error AS validation_error, count(*) AS n
      FROM parsed GROUP BY 1, 2""",
    "booking_events_clean": f"""{BOOKINGS} SELECT {_ENVELOPE}, customer_id, service_id, staff_id,
      {ts('start_at', 'start_at')}, {ts('old_start_at', 'old_start_at')}, {ts('cancelled_at', 'cancelled_at')},
      booked_price_krw, status, {_BOOKING_LINEAGE} FROM clean""",
    "booking_type_counts": f"{BOOKINGS} SELECT event_type, status, count(*) AS n FROM clean GROUP BY 1, 2",
    "bookings_current": _BOOKINGS_NOW,
    "bookings_current_join_twin": _BOOKINGS_NOW,
    "bookings_status_counts": f"{BOOKINGS} SELECT status, count(*) AS n FROM now GROUP BY 1",
    "booking_orphans": f"""{BOOKINGS}, kept AS (
        SELECT * FROM clean WHERE NOT (event_type = 'booking_created' AND booking_id % 2 = 1)
      ), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY event_time DESC,
          ingested DESC, kafka_partition, m) AS r FROM kept) WHERE r = 1
      ), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY event_time DESC,
          ingested DESC, kafka_partition, m) AS r FROM kept WHERE start_at IS NOT NULL) WHERE r = 1)
      SELECT s.booking_id, s.status, {ts('t.start_at', 'start_at')}, CAST(NULL AS BIGINT) AS customer_id
      FROM s LEFT JOIN t ON t.booking_id = s.booking_id
      WHERE s.booking_id NOT IN (SELECT booking_id FROM kept WHERE event_type = 'booking_created')""",
    "booking_transition_violations": f"""{BOOKINGS}, traced AS (
        SELECT *, lag(status) OVER (PARTITION BY booking_id ORDER BY event_time, ingested, kafka_partition, m) AS previous_status
        FROM clean)
      SELECT booking_id, event_id, event_type, {ts('event_time', 'event_time')}, previous_status, status FROM traced
      WHERE NOT coalesce((previous_status IS NULL AND status = 'scheduled')
        OR (previous_status = 'scheduled' AND status <> 'scheduled')
        OR (previous_status = 'rescheduled' AND status = 'checked_in'), false)""",
    "payment_errors": f"""{PAYMENTS} SELECT event_type, payment_error AS validation_error, count(*) AS n
      FROM events_p GROUP BY 1, 2""",
    "payment_reject_reasons": f"""{PAYMENTS} SELECT payment_error AS validation_error, count(*) AS n FROM events_p
      WHERE payment_error IS NOT NULL GROUP BY 1""",
    "payment_orphans": f"""{PAYMENTS} SELECT count(DISTINCT payment_id) AS keys,
      count(DISTINCT payment_id) FILTER (WHERE payment_id % 2 = 0) AS orphans FROM clean
      WHERE NOT (kind = 'requested' AND payment_id % 2 = 0)""",
    "payment_errors_strict": f"{PAYMENTS} SELECT event_type, {_STRICT} AS validation_error, count(*) AS n FROM events_p GROUP BY 1, 2",
    "payment_events_clean": f"""{PAYMENTS} SELECT {_ENVELOPE}, payment_id, payment_transaction_id, request_amount_krw,
      transaction_type, amount_krw, payout_amount_krw, refund_amount_krw, paid_amount_krw, unpaid_amount_krw,
      payment_status, needs_repayment, refund_type, {_PAYMENT_LINEAGE} FROM clean""",
    "payment_null_status_accepted": f"""{PAYMENTS} SELECT event_id, payment_id, amount_krw FROM events_p
      WHERE defect = 'status'""",
    "payment_tx_duplicates": f"""{PAYMENTS} SELECT payment_transaction_id // 100 AS payment_transaction_id, count(*) AS n
      FROM clean WHERE payment_transaction_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "payment_request_disagreement": f"""{PAYMENTS} SELECT booking_id, min(request_amount_krw) AS low,
      max(request_amount_krw) AS high FROM clean GROUP BY 1 HAVING count(DISTINCT request_amount_krw) > 1""",
    "payments_current": _PAYMENTS_NOW,
    "payments_current_join_twin": _PAYMENTS_NOW,
    "payment_status_counts": f"{PAYMENTS} SELECT payment_status, is_orphan, count(*) AS n FROM now GROUP BY 1, 2",
    "payment_transaction_errors": f"""{PAYMENTS} SELECT event_type, tx_error AS validation_error, count(*) AS n
      FROM tx GROUP BY 1, 2""",
    "payment_transactions_legacy": f"""{PAYMENTS} SELECT payment_transaction_id, payment_id, booking_id, shop_id,
      request_amount_krw, transaction_type, amount_krw, payment_status, refund_type, event_id, event_type,
      1 AS schema_version, {ts('event_time', 'occurred_at')}, {ts('event_time', 'ingest_time')},
      {_PAYMENT_LINEAGE} FROM tx WHERE tx_error IS NULL""",
    "payment_transactions_view": f"""{PAYMENTS} SELECT payment_transaction_id, payment_id, transaction_type, amount_krw,
      {ts('event_time', 'event_time')} FROM clean WHERE payment_transaction_id IS NOT NULL""",
    "ledger_reconciliation": f"""{PAYMENTS} SELECT payment_id, payout_amount_krw, refund_amount_krw, paid_amount_krw,
      CAST(ledger_payout AS BIGINT) AS ledger_payout, CAST(ledger_refund AS BIGINT) AS ledger_refund,
      CAST(ledger_paid AS BIGINT) AS ledger_paid FROM {_LEDGER}
      WHERE payout_amount_krw <> paid_amount_krw + refund_amount_krw OR payout_amount_krw <> ledger_payout
        OR refund_amount_krw <> ledger_refund OR paid_amount_krw <> ledger_paid""",
    "ledger_replay": f"""{PAYMENTS} SELECT payment_id, event_id, {ts('event_time', 'event_time')},
      CAST(rp AS BIGINT) AS replayed_payout, CAST(rr AS BIGINT) AS replayed_refund, CAST(rp - rr AS BIGINT) AS replayed_paid,
      CAST(u AS BIGINT) AS replayed_unpaid, st AS replayed_status,
      rp = payout_amount_krw AND rr = refund_amount_krw AND rp - rr = paid_amount_krw AND u = unpaid_amount_krw
        AND st IS NOT DISTINCT FROM payment_status AS agrees
      FROM (SELECT *, CASE WHEN rp - rr = request_amount_krw THEN 'paid' WHEN rr = 0 THEN 'unpaid'
          WHEN rp = rr THEN 'refunded' ELSE 'partially_refunded' END AS st,
        CASE WHEN rp - rr <> request_amount_krw AND rr = 0 THEN request_amount_krw - rp + rr ELSE 0 END AS u FROM replay)""",
    "summary_violations": f"""{PAYMENTS} SELECT event_id, payment_id,
      CASE defect WHEN 'payout' THEN 'net_amount_matches_movements' ELSE 'status_matches_amounts' END AS violation
      FROM events_p WHERE defect IN ('payout', 'weird')""",
    "dq_rows": f"{BOOKINGS} SELECT {_DQ_COLUMNS}, 1 AS source_snapshot_id, {_SEEN} FROM dq",
    "dq_latest_per_key": f"{BOOKINGS} SELECT {_DQ_COLUMNS}, 1 AS source_snapshot_id, {_SEEN} FROM ({_top_dq()})",
    "dq_by_stage": f"{BOOKINGS} SELECT validation_stage, validation_error, count(*) AS n FROM dq GROUP BY 1, 2",
    "dq_merge_first_run": f"{BOOKINGS} SELECT {_DQ_COLUMNS}, 1 AS source_snapshot_id, {_SEEN} FROM ({_top_dq()})",
    "dq_merge_rerun": f"""{BOOKINGS}, old AS ({_top_dq('kafka_partition <= 1')}), new AS ({_top_dq('kafka_partition >= 1')})
      SELECT {_DQ_COLUMNS}, 2 AS source_snapshot_id, CASE WHEN dq_key IN (SELECT dq_key FROM old) THEN '{_RUN_1}'
        ELSE '{_RUN_2}' END AS first_detected_at, '{_RUN_2}' AS last_detected_at FROM new
      UNION ALL SELECT {_DQ_COLUMNS}, 1, '{_RUN_1}', '{_RUN_1}' FROM old WHERE dq_key NOT IN (SELECT dq_key FROM new)""",
    "dim_shops": f"""{BOOKINGS} SELECT shop_id, shop_name, region, is_active, '2024-01-01 00:00:00.000000' AS created_at,
      '2024-01-01 00:00:00.000000' AS updated_at, CAST(opened_on AS VARCHAR) AS opened_on,
      CAST(closed_on AS VARCHAR) AS closed_on, '2024-01-31 00:00:00.000000' AS bronze_ingested_at FROM shops""",
    "shop_date_violations": f"""{BOOKINGS} SELECT shop_id, CAST(opened_on AS VARCHAR) AS opened_on,
      CAST(opened_on - 10 AS VARCHAR) AS closed_on FROM shops WHERE shop_id % 2 = 0 AND opened_on IS NOT NULL""",
    "shop_calendar": f"{BOOKINGS} SELECT shop_id, shop_name, CAST(report_date AS VARCHAR) AS report_date FROM calendar",
    "shop_daily_booking_metrics": f"""{BOOKINGS} SELECT c.shop_id, c.shop_name, CAST(c.report_date AS VARCHAR) AS report_date,
      coalesce(created_count, 0) AS created_count, coalesce(cancelled_count, 0) AS cancelled_count
      FROM calendar c LEFT JOIN daily d ON d.shop_id = c.shop_id AND d.report_date = c.report_date""",
    "id_missing": f"{BOOKINGS} SELECT event_id FROM logical WHERE defect IN ('malformed', 'no_id')",
    "id_unexpected": f"""{BOOKINGS} SELECT event_id FROM logical WHERE coalesce(defect, '') NOT IN ('malformed', 'no_id')
      AND (envelope_error IS NOT NULL OR booking_error IS NOT NULL)""",
    "id_diff": f"""{BOOKINGS} SELECT event_id, 'missing' AS difference FROM logical
      WHERE m % 3 = 1 AND (envelope_error IS NOT NULL OR booking_error IS NOT NULL)
      UNION ALL SELECT event_id, 'unexpected' FROM clean WHERE m % 3 <> 1""",
    "topic_bronze_diff": f"""{BOOKINGS} SELECT 'topic_only' AS difference, kafka_partition, kafka_offset, payload
      FROM records WHERE redelivered = 1
      UNION ALL SELECT 'bronze_only', kafka_partition, kafka_offset, payload FROM records
      WHERE redelivered = 0 AND kafka_partition = 0""",
    "bronze_vs_topic": f"""{BOOKINGS} SELECT count(*) AS topic_rows,
      count(*) FILTER (WHERE redelivered = 0) + count(*) FILTER (WHERE redelivered = 0 AND kafka_partition = 0) AS bronze_rows,
      count(*) FILTER (WHERE redelivered = 1) AS missing,
      count(*) FILTER (WHERE redelivered = 0 AND kafka_partition = 0) AS extra,
      count(*) FILTER (WHERE redelivered = 0 AND kafka_partition = 0) AS duplicate_positions FROM records""",
    "bronze_reconciliation": f"""{BOOKINGS} SELECT count(*) AS topic_rows,
      count(*) FILTER (WHERE redelivered = 0) + count(*) FILTER (WHERE redelivered = 0 AND kafka_partition = 0) AS bronze_rows,
      count(*) FILTER (WHERE redelivered = 1) AS missing,
      count(*) FILTER (WHERE redelivered = 0 AND kafka_partition = 0) AS extra,
      count(*) FILTER (WHERE redelivered = 0 AND kafka_partition = 0) AS duplicate_positions,
      count(*) FILTER (WHERE redelivered = 0 AND defect IN ('malformed', 'no_id')) AS ids_missing,
      max(CASE WHEN defect IN ('malformed', 'no_id') THEN 1 ELSE 0 END) AS ids_unexpected FROM records""",
    "bronze_verified_kinds": f"""{BOOKINGS} SELECT CASE WHEN defect = 'malformed' THEN NULL ELSE event_type END AS event_type,
      count(*) AS n FROM records GROUP BY 1""",
    "ids_not_in_outbox": f"""{BOOKINGS} SELECT DISTINCT CAST(NULL AS VARCHAR) AS event_id FROM logical
      WHERE defect IN ('malformed', 'no_id')""",
    "id_list_missing": f"{BOOKINGS} SELECT event_id FROM logical WHERE defect IN ('malformed', 'no_id')",
    "model_diff": f"{BOOKINGS} SELECT '' AS difference, booking_id, status FROM now WHERE booking_id IS NULL",
    "strictness_diff": f"""{PAYMENTS} SELECT 'default_only' AS difference, event_id, payment_id, payment_status
      FROM events_p WHERE defect = 'status'""",
    "fk_violations": f"""{BOTH} SELECT booking_id, count(*) AS child_rows FROM now_p
      WHERE booking_id NOT IN (SELECT booking_id FROM now) GROUP BY 1""",
    "bookable_slots": """WITH s AS (SELECT s_suppkey + 1 AS shop_id FROM supplier WHERE s_suppkey % 11 <> 0
      ), v AS (SELECT p_partkey % 97 + 1 AS shop_id, min(p_partkey + 1) AS service_id,
          arg_min(CAST(floor(p_retailprice) AS BIGINT), p_partkey) AS list_price_krw
        FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1
      ), t AS (SELECT c_custkey % 89 + 1 AS shop_id, min(c_custkey + 1) AS staff_id
        FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1)
      SELECT shop_id, service_id, staff_id, list_price_krw FROM s JOIN v USING (shop_id) JOIN t USING (shop_id)""",
    "paid_payments_with_booking": f"""{BOTH} SELECT p.payment_id, p.booking_id, b.shop_id, b.status AS booking_status,
      p.paid_amount_krw FROM now_p p JOIN now b ON b.booking_id = p.booking_id WHERE p.payment_status = 'paid'""",
    "not_null_violations": f"{BOOKINGS} SELECT event_id, event_type FROM parsed WHERE status IS NULL",
    "unique_violations": f"""{BOOKINGS} SELECT event_id, 2 AS n FROM logical
      WHERE m % 50 = 0 AND coalesce(defect, '') NOT IN ('malformed', 'no_id')""",
    "accepted_values_violations": f"""{PAYMENTS} SELECT payment_status, count(*) AS n FROM events_p
      WHERE defect = 'weird' GROUP BY 1""",
    "contract_violations": f"""{BOOKINGS} SELECT event_id, event_type FROM parsed
      WHERE defect IN ('price', 'status') OR (defect = 'customer' AND event_type = 'booking_created')""",
    "test_suite_report": f"""{BOOKINGS}
      SELECT 'not_null(event_id, event_type, event_time, booking_id, shop_id, status)' AS test,
        count(*) FILTER (WHERE status IS NULL) AS violations FROM parsed
      UNION ALL SELECT 'booking_contract', count(*) FROM parsed
        WHERE defect IN ('price', 'status') OR (defect = 'customer' AND event_type = 'booking_created')
      UNION ALL SELECT 'unique(event_id)', count(*) - count(DISTINCT event_id) FROM parsed
      UNION ALL SELECT 'accepted_values(event_type)', count(*) FILTER (WHERE event_type IS NULL) FROM parsed
      UNION ALL SELECT 'unique(booking_id, event_type)', count(*) FROM (
        SELECT booking_id, event_type FROM parsed GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT 'one service per booking', count(*) FROM (
        SELECT booking_id FROM parsed GROUP BY ALL HAVING count(DISTINCT service_id) > 1)""",
    "key_coverage": f"""{BOOKINGS} SELECT booking_id, 1 AS in_source,
      count(*) FILTER (WHERE event_type = 'booking_created') AS in_output FROM clean GROUP BY 1
      HAVING count(*) FILTER (WHERE event_type = 'booking_created') <> 1""",
    "expected_type_counts": f"""{BOOKINGS} SELECT event_type, 100 AS expected, count(*) AS actual FROM clean GROUP BY 1
      HAVING count(*) <> 100""",
    "row_constraint_violations": f"""{BOTH} SELECT 'services' AS relation, 'duration_positive' AS violation, count(*) AS n
        FROM part WHERE p_partkey % 4 = 0
      UNION ALL SELECT 'bookings', 'price_nonnegative', count(*) FROM parsed WHERE defect = 'price' HAVING count(*) > 0
      UNION ALL SELECT 'outbox', 'schema_version_positive', count(*) FROM events WHERE event_id % 3 = 0""",
    "one_payment_per_booking": f"{PAYMENTS} SELECT booking_id, count(*) AS n FROM now GROUP BY 1 HAVING count(*) > 1",
    "outbox_records": f"""{BOOKINGS} SELECT CAST(shop_id AS VARCHAR) AS key, payload AS value, 'booking.events.v1' AS topic,
      'id' AS header, event_id AS header_value FROM logical""",
    "lost_outbox_records": f"""{BOOKINGS} SELECT CAST(shop_id AS VARCHAR) AS key, payload AS value FROM logical
      WHERE defect IN ('malformed', 'no_id')""",
    "stream_bronze_count": f"""{BOOKINGS} SELECT CAST(CAST(bronze_ingested_at AS DATE) AS VARCHAR) AS ingest_date,
      kafka_partition, count(*) AS n FROM records GROUP BY 1, 2""",
    "stream_bronze_rows": f"""{BOOKINGS} SELECT payload, CAST(shop_id AS VARCHAR) AS kafka_key, kafka_partition,
      kafka_offset, {ts('bronze_ingested_at', 'bronze_ingested_at')} FROM records""",
    "stream_resume": f"""{BOOKINGS} SELECT run, (SELECT count(*) FROM records) AS n FROM (VALUES (1), (2)) AS v(run)""",
    "booking_domain_run": f"""{BOOKINGS} {_RUN_REPORT_EVENTS}
      UNION ALL SELECT 'booking_events_clean', (SELECT count(*) FROM parsed), (SELECT count(*) FROM parsed
        WHERE booking_error IS NOT NULL), 0, (SELECT count(*) FROM clean), 0, 0
      UNION ALL SELECT 'bookings_current', (SELECT count(*) FROM clean), 0, 0, (SELECT count(*) FROM now),
        (SELECT count(*) FROM now WHERE is_orphan), 0
      UNION ALL SELECT 'bronze_shops', count(*), 0, 0, count(*), 0, 0 FROM shops
      UNION ALL SELECT 'dim_shops', count(*), 0, 0, count(*), 0, count(*) FILTER (WHERE closed_on < opened_on) FROM shops
      UNION ALL SELECT 'shop_daily_booking_metrics', (SELECT count(*) FROM clean), 0, 0, (SELECT count(*) FROM calendar), 0, 0""",
    "booking_chain_run": f"""{BOOKINGS} {_RUN_REPORT_EVENTS}
      UNION ALL SELECT 'booking_chain', (SELECT count(*) FROM parsed), (SELECT count(*) FROM parsed
        WHERE booking_error IS NOT NULL), 0, (SELECT count(*) FROM clean), 0, 0""",
    "selected_run": f"""{BOOKINGS} SELECT 'events_clean' AS stage, 'done' AS status, (SELECT count(*) FROM records) AS input_rows,
        (SELECT count(*) FROM parsed) AS stored_rows
      UNION ALL SELECT 'booking_events_clean', 'done', (SELECT count(*) FROM parsed), (SELECT count(*) FROM clean)
      UNION ALL SELECT 'bookings_current', 'done', (SELECT count(*) FROM clean), (SELECT count(*) FROM now)
      UNION ALL SELECT 'dim_shops', 'refused', NULL, NULL
      UNION ALL SELECT 'shop_daily_booking_metrics', 'skipped', NULL, NULL""",
    "bronze_as_of_batch": f"""{BOOKINGS} SELECT 0 AS ingest_batch, CAST(CAST(bronze_ingested_at AS DATE) AS VARCHAR) AS ingest_date,
      kafka_partition, count(*) AS n FROM records WHERE kafka_partition = 0 GROUP BY 2, 3""",
    "stream_progress": f"{BOOKINGS} SELECT kafka_partition AS batch_id, count(*) AS input_rows FROM records GROUP BY 1",
    "recovered_bronze": f"""{BOOKINGS}, lost AS (
        SELECT count(*) AS n FROM logical WHERE m % 10 = 3 AND coalesce(defect, '') NOT IN ('malformed', 'no_id')
      ), kept AS (SELECT count(*) AS n FROM records WHERE m % 10 <> 3)
      SELECT run, 'stored' AS figure, kept.n + CASE WHEN run > 0 THEN lost.n ELSE 0 END AS n FROM range(3) AS v(run), lost, kept
      UNION ALL SELECT run, 'missing', CASE WHEN run > 0 THEN 0 ELSE lost.n END FROM range(3) AS v(run), lost
      UNION ALL SELECT run, 'repeated_positions', 0 FROM range(3) AS v(run)""",
    "bronze_files": f"""{BOOKINGS} SELECT CAST(CAST(bronze_ingested_at AS DATE) AS VARCHAR) AS ingest_date, count(*) AS rows,
        true AS has_files, true AS sized FROM records GROUP BY 1""",
    "created_table_columns": f"""{BOOKINGS} SELECT name, type, name = 'ingest_date' AS is_partition, (SELECT count(*) FROM records) AS filled
      FROM (VALUES ('payload', 'string'), ('kafka_value', 'binary'), ('kafka_key', 'binary'), ('kafka_topic', 'string'),
        ('kafka_partition', 'int'), ('kafka_offset', 'bigint'), ('kafka_timestamp', 'timestamp'),
        ('kafka_timestamp_type', 'int'), ('bronze_ingested_at', 'timestamp'), ('ingest_date', 'date')) AS v(name, type)""",
    "appended_rows": f"""{BOOKINGS} SELECT CAST(CAST(bronze_ingested_at AS DATE) AS VARCHAR) AS ingest_date,
      kafka_partition, 2 * count(*) AS n FROM records GROUP BY 1, 2""",
    "offset_gaps": """
      WITH topic AS (
        SELECT CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS p,
          CASE WHEN event_id % 4 = 3 THEN event_id // 4 ELSE event_id // 4 * 3 + event_id % 4 END AS o FROM events
      ), known AS (
        SELECT p, o FROM topic WHERE NOT ((o // 40) % 9 = 0 OR o % 97 = 5)
        UNION ALL SELECT p, min(o) - 1 FROM topic GROUP BY p
        UNION ALL SELECT p, max(o) + 1 FROM topic GROUP BY p
      ), pairs AS (SELECT p, o, lag(o) OVER (PARTITION BY p ORDER BY o) AS b FROM known)
      SELECT 'booking.events.v1' AS kafka_topic, p AS kafka_partition, b + 1 AS first_missing, o - 1 AS last_missing,
        o - b - 1 AS missing FROM pairs WHERE o - b > 1""",
    "booking_domain_dq": f"{BOOKINGS} SELECT {_DQ_COLUMNS}, {_SEEN} FROM ({_top_dq()})",
    "payment_domain_run": f"""{PAYMENTS} SELECT 'events_clean' AS stage, count(*) AS input_rows, 0 AS rejected_rows,
        0 AS duplicate_rows, count(*) AS stored_rows, 0 AS orphan_rows, 0 AS violations FROM events_p
      UNION ALL SELECT 'payment_events_clean', (SELECT count(*) FROM events_p), (SELECT count(*) FROM events_p
        WHERE payment_error IS NOT NULL), 0, (SELECT count(*) FROM clean), 0, 0
      UNION ALL SELECT 'payments_current', (SELECT count(*) FROM clean), 0, 0, (SELECT count(*) FROM now),
        (SELECT count(*) FROM now WHERE is_orphan), 0""",
}
ORACLES["stream_fanout_rows"] = ORACLES["stream_bronze_rows"]
ORACLES["dq_merge_incremental"] = ORACLES["dq_merge_rerun"]
ORACLES["first_bookable_slot"] = (
    f"SELECT * FROM ({ORACLES['bookable_slots']}) ORDER BY shop_id, service_id, staff_id LIMIT 1"
)
