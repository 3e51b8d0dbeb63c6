"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

# Fixed value: Python's white space as an explicit class.
_SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _clean(column: str) -> str:
    return f"trim(regexp_replace({column}, '[{_SPACE}]+', ' ', 'g'))"


_FEED = """
feed AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS mail_id,
         CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS action,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS event_version,
         ts AS occurred_at,
         CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch_id
  FROM events)"""

_WINNERS = (
    _FEED
    + """,
winners AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY epoch_id, mail_id ORDER BY event_version DESC, occurred_at DESC, event_id DESC) AS rn
    FROM feed) WHERE rn = 1)"""
)

_ADDRESS = "'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$'"

# the nations' numbers are those of ``queries.SPOILED``
_SOURCE = f"""
src AS (
  SELECT CASE WHEN d.lang = 'de' THEN 'de-' ELSE '' END || d.doc_id AS mail_id,
    CASE WHEN c.c_nationkey = 0 AND c.c_acctbal > 0 THEN '' ELSE CAST(d.doc_id AS VARCHAR) END AS own_id,
    CASE c.c_nationkey WHEN 1 THEN ' ' WHEN 10 THEN '<i> </i>' WHEN 12 THEN '<b>' || d.source || ' ' || d.lang || '</b>'
      ELSE d.source || ' ' || d.lang END AS title,
    CASE c.c_nationkey WHEN 10 THEN '' ELSE d.source || ' ' || d.lang END AS clean_title,
    CASE c.c_nationkey WHEN 2 THEN chr(10) WHEN 11 THEN '<p></p>' ELSE d.text END AS body,
    CASE WHEN c.c_nationkey = 3 THEN '' ELSE 'c' || CAST(c.c_custkey AS VARCHAR)
      || CASE WHEN l.toxic = 1 THEN '.at.' ELSE '@' END || lower(c.c_mktsegment) || '.example' END AS sender,
    c.c_name AS sender_name,
    CASE c.c_nationkey WHEN 4 THEN NULL WHEN 5 THEN 'r' || d.doc_id || ' at corp'
      ELSE 'r' || d.doc_id || '@corp.example' END AS receiver,
    CASE WHEN c.c_nationkey = 6 THEN CASE WHEN c.c_acctbal > 0 THEN 'nobody' ELSE 'cc@corp.example' END END AS cc,
    CASE WHEN c.c_nationkey = 7 AND c.c_acctbal > 0 THEN 'yesterday' END AS bad_moment,
    coalesce(c.c_nationkey = 8, FALSE) AS bad_read, coalesce(c.c_nationkey = 9, FALSE) AS bad_attachment,
    CASE WHEN l.toxic IS NULL AND d.lang = 'fr' THEN 'fetch failed: timeout'
         WHEN l.toxic IS NULL AND d.lang = 'es' THEN 'supply response error: gone' END AS lookup_error
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN customer c ON c.c_custkey = d.doc_id),
ruled AS (
  SELECT *, CASE
      WHEN own_id = '' THEN 'mail_id is required'
      WHEN NOT regexp_matches(coalesce(title, ''), '[^{_SPACE}]') THEN 'title is required'
      WHEN NOT regexp_matches(coalesce(body, ''), '[^{_SPACE}]') THEN 'body is required'
      WHEN coalesce(sender, '') = '' THEN 'sender is required'
      WHEN NOT regexp_matches(sender, {_ADDRESS}) THEN 'invalid sender email: ' || sender
      WHEN receiver IS NULL THEN 'receiver is required'
      WHEN NOT regexp_matches(receiver, {_ADDRESS}) THEN 'invalid receiver email: ' || receiver
      WHEN NOT regexp_matches(cc, {_ADDRESS}) THEN 'invalid cc email: ' || cc
      WHEN bad_moment IS NOT NULL THEN 'invalid sent_at datetime: ' || bad_moment
      WHEN bad_read THEN 'read_yn must be boolean'
      WHEN bad_attachment THEN 'has_attachment must be boolean'
    END AS rule_error,
    CASE WHEN body = '<p></p>' THEN 'body is empty after refinement'
         WHEN title = '<i> </i>' THEN 'title is empty after refinement' END AS clean_error,
    coalesce(lookup_error, rule_error, clean_error) AS fault
  FROM src)"""

_DAMAGED = """
raw AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS uid, event_type, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
read AS (
  SELECT event_id, k,
    CASE WHEN k IN (0, 1, 2, 7) THEN 'invalid event payload json'
         WHEN k IN (3, 4) THEN 'event mail_id is missing' END AS parse_error,
    CASE WHEN k IN (0, 1, 2, 3, 4, 7) THEN NULL ELSE uid END AS mail_id,
    CASE WHEN k IN (0, 1, 2, 3, 4, 7) THEN NULL WHEN k = 6 THEN 'DELETE' WHEN k IN (5, 8) THEN 'UPSERT'
         WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS action,
    CASE WHEN k IN (0, 1, 2, 3, 4, 7) THEN NULL WHEN k = 5 THEN 4 WHEN k = 6 THEN 0 WHEN k = 8 THEN 3
         ELSE k END AS event_version,
    CASE WHEN k IN (1, 0, 2, 4, 5, 6, 7, 8) THEN NULL ELSE ts END AS occurred_at
  FROM raw)"""

_BATCH = f"""{_DAMAGED},{_SOURCE},
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY event_version DESC,
      occurred_at DESC NULLS LAST, event_id DESC) AS rn
    FROM read WHERE parse_error IS NULL) WHERE rn = 1),
judged AS (
  SELECT b.mail_id, b.action, b.event_version, r.title, r.body, r.sender, r.receiver,
    CASE WHEN b.action = 'DELETE' THEN NULL
         WHEN r.mail_id IS NULL THEN 'supply response error: not found' ELSE r.fault END AS err,
    r.clean_title, r.cc, r.lookup_error, b.k, CAST(c.c_nationkey + 80 AS BIGINT) AS stored
  FROM best b LEFT JOIN ruled r ON b.mail_id = r.mail_id
  LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = b.mail_id),
settled AS (
  SELECT *, CASE WHEN err IS NOT NULL THEN 'quarantined'
                 WHEN action = 'DELETE' THEN 'deleted'
                 WHEN event_version < stored THEN 'stale' ELSE 'accepted' END AS outcome
  FROM judged)"""

_FOLD = f"""{_WINNERS},{_SOURCE},
history AS (
  SELECT w.* FROM winners w
  WHERE w.action = 'DELETE' OR w.mail_id IN (SELECT mail_id FROM ruled WHERE fault IS NULL)),
grouped AS (
  SELECT *, sum(CASE WHEN action = 'DELETE' THEN 1 ELSE 0 END)
              OVER (PARTITION BY mail_id ORDER BY epoch_id) AS grp FROM history),
met AS (
  SELECT *, max(CASE WHEN action = 'UPSERT' THEN event_version END) OVER (
      PARTITION BY mail_id, grp ORDER BY epoch_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_version,
    max(grp) OVER (PARTITION BY mail_id) AS last_grp
  FROM grouped)"""

# the same history in three epochs: the days of the month in thirds
_THIRDS = _FOLD.replace(
    "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))", "(day(ts) - 1) // 11"
)

_STALE = f"""WITH {_FOLD}
SELECT epoch_id, mail_id, event_version, current_version,
       'stale event dropped: incoming_version=' || CAST(event_version AS VARCHAR)
         || ', current_version=' || CAST(current_version AS VARCHAR) AS validation_error
FROM met WHERE action = 'UPSERT' AND event_version < current_version"""

_LETTERS = """
letters AS (
  SELECT CAST(user_id AS VARCHAR) AS uid, k, CAST(CASE WHEN k >= 90 THEN 0 ELSE k // 20 END AS INTEGER) AS retry_count,
         err, CASE WHEN err IS NULL OR err = 'title is required' THEN 'permanent'
                   WHEN (CASE WHEN k >= 90 THEN 0 ELSE k // 20 END) + 1 > 3 THEN 'exhausted'
                   ELSE 'redriven' END AS outcome
  FROM (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               CASE event_type WHEN 'click' THEN 'fetch failed: timeout' WHEN 'view' THEN 'FETCH FAILED reset'
                 WHEN 'signup' THEN 'supply response error: not found'
                 WHEN 'purchase' THEN 'title is required' END AS err
        FROM events))"""

_GOLD = f"""{_SOURCE},
gold AS (
  SELECT s.mail_id, s.title, s.body, coalesce(c.c_acctbal > 5000, FALSE) AS read_yn,
         coalesce(CASE WHEN c.c_acctbal > 0 THEN CAST(c.c_nationkey AS BIGINT) END, 0) AS event_version,
         strftime(TIMESTAMP '1970-01-01' + to_seconds(c.c_nationkey * 100000), '%Y-%m-%dT%H:%M:%S') || '+00:00'
           AS source_updated_at
  FROM src s LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = s.mail_id)"""

_SERVED = """SELECT mail_id, title, md5(body) AS body_md5, '' AS sender_enc, read_yn, FALSE AS has_attachment,
       event_version, source_updated_at, CAST(NULL AS VARCHAR) AS occurred_at, 'local.gold.mail' AS source
FROM gold"""

_RECEIPTS = """
receipts AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS mail_id, event_type AS consumer,
         CASE WHEN event_type <> 'error' THEN value / 100 END AS delay, ts AS received_at
  FROM events)"""

_ACCESS = """
grants AS (
  SELECT DISTINCT p.c_name AS api_key, n.n_nationkey AS route
  FROM customer p JOIN nation n ON p.c_mktsegment =
    CASE n.n_regionkey WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END),
requests AS (
  SELECT CASE WHEN c_acctbal > 0 THEN c_name END AS api_key, c_nationkey AS route, c_custkey AS request_id
  FROM customer)"""

_ORDERS = """
stored AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01'),
incoming AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')"""

_MICROS = "'%Y-%m-%d %H:%M:%S.%f'"

_TOKENS = r"(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<[^>]*>|[^<]+|<"


def _decoded(text: str) -> str:
    """The references that pages hold, in one pass."""
    for ref, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{ref}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


_PAGE_TEXT = f"""array_to_string(list_transform(regexp_extract_all(html, '{_TOKENS}'), lambda t: CASE
  WHEN starts_with(t, '<script>') THEN t[9:-10] WHEN starts_with(t, '<style>') THEN t[8:-9]
  WHEN starts_with(t, '<') THEN '' ELSE {_decoded("t")} END), '')"""

SQL = {
    "refine_pages": f"""WITH texts AS (SELECT page_id, url, {_PAGE_TEXT} AS t FROM pages)
SELECT page_id, url, {_clean(_decoded("t"))} AS plain FROM texts""",
    "mime_docs": f"SELECT doc_id, md5({_clean('text')}) AS text_md5 FROM documents",
    "deep_mime_docs": rf"""SELECT doc_id, md5({_clean("greeting || ' ' || regexp_replace(text, '[^\x00-\x7F]', '', 'g')")}) AS text_md5
FROM (SELECT *, CASE lang WHEN 'en' THEN '안녕하세요' WHEN 'fr' THEN 'こんにちは' WHEN 'es' THEN '日本' ELSE 'Привет' END AS greeting
      FROM documents)""",
    "tagged_docs": f"""SELECT doc_id, md5({_clean("text || ' if (a < b) { } <©'")}) AS text_md5 FROM documents""",
    "parse_events": f"""WITH {_DAMAGED}
SELECT event_id, mail_id, action, event_version, strftime(occurred_at, {_MICROS}) AS occurred_at, parse_error
FROM (SELECT * REPLACE (CASE WHEN parse_error = 'event mail_id is missing' AND k3 THEN ts ELSE occurred_at END
        AS occurred_at) FROM (SELECT r.*, raw.ts, raw.k = 3 AS k3 FROM read r JOIN raw USING (event_id)))""",
    "parse_moments": f"""SELECT event_id, strftime(CASE event_type WHEN 'click' THEN date_trunc('second', ts)
  WHEN 'view' THEN ts - INTERVAL 9 HOUR WHEN 'signup' THEN date_trunc('day', ts)
  WHEN 'purchase' THEN date_trunc('hour', ts) + INTERVAL 570 MINUTE END, {_MICROS}) AS read_at FROM events""",
    "latest_per_key": f"""WITH {_WINNERS}
SELECT epoch_id, mail_id, action, event_version, event_id, strftime(occurred_at, {_MICROS}) AS occurred_at
FROM winners""",
    "delete_ids": f"WITH {_FEED} SELECT DISTINCT mail_id FROM feed WHERE action = 'DELETE' ORDER BY mail_id",
    "enrich_claim_check": f"""WITH {_FEED},{_SOURCE},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mail_id
  ORDER BY event_version DESC, occurred_at DESC, event_id DESC) AS rn FROM feed) WHERE rn = 1 AND action = 'UPSERT')
SELECT l.mail_id, l.event_version, s.title, md5(s.body) AS body_md5, s.sender,
       CASE WHEN s.mail_id IS NULL THEN 'supply response error: not found' ELSE s.lookup_error END AS lookup_error
FROM last l LEFT JOIN src s ON l.mail_id = s.mail_id""",
    "validate_reasons": f"WITH {_SOURCE} SELECT mail_id, rule_error FROM ruled",
    "whitespace_docs": f"SELECT doc_id, md5({_clean('text')}) AS text_md5 FROM documents",
    "refine_docs": f"""SELECT doc_id, CAST(length({_clean('text')}) AS INTEGER) AS chars,
       md5({_clean('text')}) AS text_md5 FROM documents""",
    "protect_roundtrip": """SELECT c_custkey, lower(c_mktsegment) || '@x.example' AS sender, c_name AS sender_name,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS cc, c_acctbal < 0 AS cc_blank FROM customer""",
    "stale_events": _STALE,
    "stale_events_in_runs": _STALE,
    "gold_state": f"""WITH {_FOLD},
final AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY event_version DESC, epoch_id DESC) AS rn
    FROM met WHERE action = 'UPSERT' AND grp = last_grp) WHERE rn = 1)
SELECT f.mail_id, r.clean_title AS title, {_clean('r.body')} AS body, r.sender, coalesce(r.sender_name, '') AS sender_name,
       r.receiver, coalesce(r.cc, '') AS cc, FALSE AS read_yn, f.event_version, strftime(f.occurred_at, {_MICROS}) AS occurred_at
FROM final f JOIN ruled r ON f.mail_id = r.mail_id""",
    "lake_gold": f"""WITH {_THIRDS},
final AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY event_version DESC, epoch_id DESC) AS rn
    FROM met WHERE action = 'UPSERT' AND grp = last_grp) WHERE rn = 1)
SELECT f.mail_id, r.clean_title AS title, md5({_clean('r.body')}) AS body_md5, r.sender, r.receiver, f.event_version,
       strftime(f.occurred_at, {_MICROS}) AS occurred_at
FROM final f JOIN ruled r ON f.mail_id = r.mail_id""",
    "lake_quarantine": f"""WITH {_THIRDS}
SELECT w.epoch_id, w.mail_id, CASE WHEN r.mail_id IS NULL THEN 'supply response error: not found' ELSE r.fault END
  AS validation_error
FROM winners w LEFT JOIN ruled r ON w.mail_id = r.mail_id
WHERE w.action = 'UPSERT' AND (r.mail_id IS NULL OR r.fault IS NOT NULL)
UNION ALL SELECT epoch_id, mail_id, 'stale event dropped: incoming_version=' || CAST(event_version AS VARCHAR)
  || ', current_version=' || CAST(current_version AS VARCHAR)
FROM met WHERE action = 'UPSERT' AND event_version < current_version""",
    "upsert_merge": f"""WITH {_ORDERS}
SELECT * FROM stored WHERE o_custkey NOT IN (SELECT o_custkey FROM incoming) UNION ALL SELECT * FROM incoming""",
    "delete_apply": f"""WITH {_ORDERS}
SELECT * FROM stored WHERE o_custkey NOT IN (SELECT o_custkey FROM incoming WHERE o_orderstatus = 'F')""",
    "quarantine_union": f"""WITH {_BATCH}
SELECT NULL AS mail_id, 'UPSERT' AS action, FALSE AS without_payload,
       CASE WHEN k IN (0, 3, 7) THEN CAST(k AS VARCHAR) END AS payload_version, NULL AS record_title, parse_error AS validation_error
FROM read WHERE parse_error IS NOT NULL
UNION ALL
SELECT mail_id, 'UPSERT', outcome = 'stale',
       CASE WHEN outcome = 'stale' THEN NULL WHEN k = 5 THEN ' 4 ' WHEN k = 8 THEN '3.7' ELSE CAST(event_version AS VARCHAR) END,
       CASE WHEN outcome <> 'stale' AND lookup_error IS NULL THEN title END,
       CASE WHEN outcome = 'stale' THEN 'stale event dropped: incoming_version=' || CAST(event_version AS VARCHAR)
         || ', current_version=' || CAST(stored AS VARCHAR) ELSE err END
FROM settled WHERE outcome IN ('quarantined', 'stale')""",
    "ready_notices": f"""WITH {_BATCH}
SELECT mail_id, 'ready' AS status FROM settled WHERE outcome = 'accepted'
UNION ALL SELECT mail_id, 'deleted' FROM settled WHERE outcome = 'deleted'""",
    "accepted_rows": f"""WITH {_BATCH}
SELECT mail_id, clean_title AS title, md5({_clean('body')}) AS body_md5, sender, receiver, cc IS NULL AS cc_blank, event_version
FROM settled WHERE outcome = 'accepted'""",
    "batch_metrics": f"""WITH {_BATCH}
SELECT count(*) AS events, count(*) FILTER (outcome = 'accepted') AS accepted,
       count(*) FILTER (outcome = 'deleted') AS deleted,
       count(*) FILTER (outcome IN ('quarantined', 'stale'))
         + (SELECT count(*) FROM read WHERE parse_error IS NOT NULL) AS quarantined
FROM settled""",
    "epoch_counts": f"""WITH {_WINNERS}
SELECT epoch_id, count(*) AS events, count(*) FILTER (action = 'DELETE') AS deleted FROM winners GROUP BY epoch_id""",
    "dlq_outcomes": f"""WITH {_LETTERS}
SELECT outcome, retry_count, count(*) AS letters FROM letters GROUP BY outcome, retry_count""",
    "redriven_events": f"""WITH {_LETTERS}
SELECT uid AS mail_key, uid AS mail_id, CASE WHEN k >= 90 THEN 'UPSERT' END AS action,
       retry_count + 1 AS retry_count, count(*) AS messages
FROM letters WHERE outcome = 'redriven' GROUP BY ALL""",
    "parked_letters": f"""WITH {_LETTERS}
SELECT outcome, err AS validation_error, count(*) AS letters, count(DISTINCT uid) AS mails
FROM letters WHERE outcome <> 'redriven' GROUP BY outcome, err""",
    "serve_view": f"WITH {_GOLD} {_SERVED}",
    "serve_lookup": f"WITH {_GOLD} {_SERVED} WHERE mail_id = '1' ORDER BY event_version DESC LIMIT 1",
    "fanout_topics": """SELECT t.topic, e.event_id, CAST(e.user_id AS VARCHAR) AS mail_id FROM events e
CROSS JOIN (VALUES ('search-events'), ('mobile-events'), ('graph-events')) t(topic)""",
    "subscriber_records": f"""WITH {_FEED},{_SOURCE}
SELECT f.mail_id, f.pulls, s.title,
       CASE WHEN s.mail_id IS NULL THEN 'supply response error: not found' ELSE s.lookup_error END AS lookup_error
FROM (SELECT mail_id, count(*) AS pulls FROM feed GROUP BY mail_id) f LEFT JOIN src s ON f.mail_id = s.mail_id""",
    "ready_with_gold": f"""WITH {_GOLD}
SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS mail_id, 'ready' AS status, g.title,
       CASE WHEN g.mail_id IS NULL THEN 'mail_id not found: ' || CAST(e.user_id AS VARCHAR) END AS error
FROM events e LEFT JOIN gold g ON g.mail_id = CAST(e.user_id AS VARCHAR)""",
    "consumer_receipts": f"""WITH {_RECEIPTS}
SELECT mail_id, consumer, count(*) AS receipts, count(*) FILTER (delay >= 0.5) AS slow_receipts,
       max(delay) AS max_delay FROM receipts WHERE delay IS NOT NULL GROUP BY mail_id, consumer""",
    "slow_receipts": f"""WITH {_RECEIPTS}
SELECT event_id, mail_id, consumer, delay >= 0.5 AS is_slow FROM receipts WHERE delay IS NOT NULL""",
    "received_counts": f"WITH {_RECEIPTS} SELECT consumer, count(*) AS received_count FROM receipts GROUP BY consumer",
    "last_n_per_consumer": f"""WITH {_RECEIPTS}
SELECT consumer, event_id, mail_id, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY consumer ORDER BY received_at DESC, event_id DESC) AS position
  FROM receipts) WHERE position <= 50""",
    "latest_mail_groups": f"""WITH {_RECEIPTS}
SELECT mail_id, strftime(first_seen, {_MICROS}) AS first_seen, receipts FROM (
  SELECT mail_id, min(received_at) AS first_seen, count(*) AS receipts FROM receipts
  WHERE delay IS NOT NULL GROUP BY mail_id ORDER BY 2 DESC, 1 DESC LIMIT 10)""",
    "ready_as_of": f"""WITH {_FEED},
log AS (
  SELECT mail_id, epoch_id, max(event_version) FILTER (event_type = 'purchase') AS event_version
  FROM feed JOIN events USING (event_id) WHERE event_type IN ('purchase', 'error') GROUP BY mail_id, epoch_id)
SELECT f.event_id, f.mail_id, f.epoch_id, l.event_version,
       CASE WHEN l.event_version IS NULL THEN 'mail_id not found: ' || f.mail_id END AS error
FROM (SELECT * FROM feed JOIN events USING (event_id) WHERE event_type = 'view') f
ASOF LEFT JOIN log l ON f.mail_id = l.mail_id AND f.epoch_id >= l.epoch_id""",
    "peak_concurrency": """WITH ends AS (
  SELECT event_type, ts AS moment, 1 AS d FROM events
  UNION ALL SELECT event_type, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), -1 FROM events),
runs AS (SELECT event_type, d, sum(d) OVER (PARTITION BY event_type ORDER BY moment, d
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM ends)
SELECT event_type, CAST(count(*) FILTER (d = 1) AS BIGINT) AS total_requests,
       CAST(max(active) AS BIGINT) AS peak_active FROM runs GROUP BY event_type""",
    "kpi_summary": """SELECT n.n_name AS service,
       CASE WHEN count(c.c_custkey) = 0 THEN 'down' ELSE 'running' END AS status, count(c.c_custkey) AS received_count
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name
UNION ALL SELECT n_name || ' agency', 'down', 0 FROM nation""",
    "log_union": f"""WITH {_RECEIPTS}
SELECT consumer, strftime(received_at, '%Y-%m-%d') AS day, count(*) AS lines FROM receipts GROUP BY ALL""",
    "entitlement": f"""WITH {_ACCESS}
SELECT request_id, route FROM requests r
WHERE EXISTS (SELECT 1 FROM grants g WHERE g.api_key = r.api_key AND g.route = r.route)""",
    "entitlement_refused": f"""WITH {_ACCESS}
SELECT request_id, route FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.api_key = r.api_key AND g.route = r.route)""",
    "list_records": f"WITH {_SOURCE} SELECT mail_id AS lookup_id, title, md5(body) AS body_md5 FROM src",
}
