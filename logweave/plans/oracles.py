"""The same queries in SQL for DuckDB, written from the semantics and not from the Spark code."""

from __future__ import annotations

LOG = """
k_events AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
log AS (
  SELECT user_id % 8 AS source_id,
         'binlog-' || lpad(CAST(event_id // 1000 AS VARCHAR), 10, '0') || '.log' AS log_file,
         event_id AS log_pos, ts AS event_ts,
         CASE event_type WHEN 'signup' THEN 'QUERY' WHEN 'error' THEN 'QUERY' WHEN 'view' THEN 'TABLE_MAP'
                         WHEN 'click' THEN 'ROWS' WHEN 'purchase' THEN 'XID' ELSE 'OTHER' END AS kind,
         CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 1 THEN 'BeGin' ELSE 'begin' END
                         WHEN 'error' THEN 'ALTER' END AS query,
         'DB' || (k % 3) AS schema_name, 'T' || (k % 5) AS table_name,
         20 + length(props) + CAST(floor(value) AS BIGINT) % 50 AS size, props AS raw
  FROM k_events)"""

ORDERS = """
lines AS (SELECT l_orderkey, l_linenumber, count(*) * 60 + sum(CAST(trunc(l_quantity) AS BIGINT)) AS size
          FROM lineitem GROUP BY ALL),
steps AS (SELECT * FROM (VALUES (0, 'QUERY', 60), (1, 'TABLE_MAP', 50), (15, 'XID', 31)) AS s(step, kind, size)),
order_events AS (
  SELECT o.*, step, kind, size FROM orders o, steps
  UNION ALL
  SELECT o.*, l_linenumber + 1, 'ROWS', l.size FROM orders o JOIN lines l ON o_orderkey = l_orderkey),
order_log AS (
  SELECT o_custkey % 16 AS source_id, 'binlog-' || year(o_orderdate) || '.log' AS log_file,
         o_orderkey * 16 + step AS log_pos, o_orderdate AS event_ts, kind,
         CASE WHEN step = 0 THEN 'BEGIN' END AS query, 'shop' AS schema_name,
         'orders_' || lower(o_orderstatus) AS table_name, CAST(size AS BIGINT) AS size, '' AS raw
  FROM order_events)"""


def routed(log: str, table_rule: str, schemas: str) -> str:
    return f"""
flagged AS (
  SELECT *, coalesce(sum(CAST(kind = 'XID' AS INT)) OVER (PARTITION BY source_id ORDER BY log_file, log_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch,
         coalesce({table_rule}, false) AS ok, coalesce(upper(query) = 'BEGIN', false) AS begins
  FROM {log}),
stated AS (
  SELECT *, coalesce(bool_or((kind = 'QUERY' AND begins) OR (kind = 'TABLE_MAP' AND ok)) OVER before, false) AS in_tx,
         coalesce(last_value(CASE WHEN kind = 'TABLE_MAP' THEN ok END IGNORE NULLS) OVER before, false) AS keep
  FROM flagged
  WINDOW before AS (PARTITION BY source_id, epoch ORDER BY log_file, log_pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
routed AS (
  SELECT *, CASE kind
    WHEN 'QUERY' THEN CASE WHEN begins OR in_tx THEN 'tx' WHEN lower(schema_name) IN ({schemas}) THEN 'standalone' ELSE 'drop' END
    WHEN 'TABLE_MAP' THEN CASE WHEN ok THEN 'tx' ELSE 'drop' END
    WHEN 'XID' THEN 'commit'
    ELSE CASE WHEN NOT in_tx THEN 'standalone' WHEN keep THEN 'tx' ELSE 'drop' END END AS action
  FROM stated)"""


TABLE_RULE = "(lower(schema_name) IN ('db0', 'db1') AND regexp_matches(lower(table_name), 't[012]'))"
ROUTED = LOG + "," + routed("log", TABLE_RULE, "'db0', 'db1'")
ORDERS_ROUTED = ORDERS + "," + routed(
    "order_log", "(lower(schema_name) = 'shop' AND regexp_matches(lower(table_name), 'orders_[fo]'))", "'shop'"
)

TRANSACTIONS = """
grouped AS (
  SELECT source_id, epoch, count(*) AS n_events, CAST(sum(size) AS BIGINT) AS bytes,
         arg_min(log_file, log_file || lpad(CAST(log_pos AS VARCHAR), 20, '0')) AS first_file,
         arg_min(log_pos, log_file || lpad(CAST(log_pos AS VARCHAR), 20, '0')) AS first_pos,
         arg_max(log_file, log_file || lpad(CAST(log_pos AS VARCHAR), 20, '0')) AS last_file,
         arg_max(log_pos, log_file || lpad(CAST(log_pos AS VARCHAR), 20, '0')) AS last_pos,
         bool_or(action = 'commit') AS committed
  FROM routed WHERE action IN ('tx', 'commit') GROUP BY source_id, epoch),
transactions AS (SELECT * EXCLUDE (committed) FROM grouped WHERE committed AND n_events >= 3)"""


def records(max_size: int) -> str:
    """Transactions folded event by event (recursion), then everything that goes out as a record."""
    return f"""
tx AS (SELECT *, row_number() OVER (PARTITION BY source_id, epoch ORDER BY log_file, log_pos) AS rn
       FROM routed WHERE action IN ('tx', 'commit')),
fold AS (
  SELECT source_id, epoch, rn, size AS held, CAST(0 AS BIGINT) AS part,
         kind IN ('ROWS', 'OTHER') AND size > {max_size} AS is_cut
  FROM tx WHERE rn = 1
  UNION ALL
  SELECT t.source_id, t.epoch, t.rn, CASE WHEN f.is_cut THEN t.size ELSE f.held + t.size END,
         f.part + CAST(f.is_cut AS BIGINT),
         t.kind IN ('ROWS', 'OTHER') AND (CASE WHEN f.is_cut THEN t.size ELSE f.held + t.size END) > {max_size}
  FROM fold f JOIN tx t ON t.source_id = f.source_id AND t.epoch = f.epoch AND t.rn = f.rn + 1),
parts AS (SELECT t.*, f.part, f.is_cut FROM tx t JOIN fold f USING (source_id, epoch, rn)),
tx_records AS (
  SELECT source_id, epoch, part, count(*) AS n_events, CAST(sum(size) AS BIGINT) AS bytes,
         arg_min(log_pos, rn) AS first_pos, arg_max(log_file, rn) AS log_file, arg_max(log_pos, rn) AS log_pos,
         arg_max(event_ts, rn) AS event_ts, bool_or(action = 'commit') AS committed, bool_or(is_cut) AS cut,
         string_agg(raw, '|' ORDER BY rn) AS payload
  FROM parts GROUP BY source_id, epoch, part),
records AS (
  SELECT * EXCLUDE (cut) FROM tx_records WHERE cut OR (committed AND (part > 0 OR n_events >= 3))
  UNION ALL
  SELECT source_id, epoch, -1, 1, size, log_pos, log_file, log_pos, event_ts, false, raw FROM routed WHERE action = 'standalone')"""


RECORDS = ROUTED + "," + records(120)


def numbered(start: int, source: str = "records") -> str:
    return f"""
slots AS (
  SELECT *, max(epoch_us(event_ts) // 60000000) OVER (PARTITION BY source_id ORDER BY log_file, log_pos) AS slot
  FROM {source}),
numbered AS (
  SELECT *, ({start} - 1 + row_number() OVER (ORDER BY slot, source_id, log_file, log_pos) - 1) % 1000000000000 + 1 AS seqid
  FROM slots)"""


def topic(variant: str, start: int = 1) -> str:
    keep = {"gap": "event_id % 997 <> 13", "late_gap": "event_id % 6007 <> 6006"}.get(variant, "true")
    again = (
        f"UNION ALL SELECT event_id, ts, props, (event_id * 48271) % 2147483647 + 2147483647 FROM events WHERE {keep} AND event_id % 101 = 7"
        if variant in ("dups", "late_gap", "whole")
        else ""
    )
    junk = "false" if variant in ("late_gap", "whole") else "event_id % 211 = 210"
    return f"""
arrived AS (
  SELECT event_id, ts, props, (event_id * 48271) % 2147483647 AS arrival FROM events WHERE {keep} {again}),
topic AS (
  SELECT 'k' || event_id AS key, CAST(event_id % 3 AS INT) AS partition, arrival, ts, props, {junk} AS junk,
         CASE WHEN NOT ({junk}) THEN ({start} - 1 + event_id) % 1000000000000 + 1 END AS seqid,
         row_number() OVER (PARTITION BY event_id % 3 ORDER BY arrival) - 1 AS "offset"
  FROM arrived)"""


def winners(start: int) -> str:
    """One copy per id that is at most half a cycle ahead, and the first id that is missing."""
    return f"""
ahead AS (
  SELECT *, (seqid - {start} + 1000000000000) % 1000000000000 AS d FROM topic
  WHERE seqid IS NOT NULL AND (seqid - {start} + 1000000000000) % 1000000000000 <= 500000000000),
winners AS (SELECT * FROM ahead QUALIFY row_number() OVER (PARTITION BY d ORDER BY partition, "offset") = 1),
expected AS (
  SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM winners WHERE d = 0) THEN 0
              ELSE (SELECT min(w.d) + 1 FROM winners w WHERE NOT EXISTS (SELECT 1 FROM winners n WHERE n.d = w.d + 1)) END AS d)"""


# the hash in 64-bit arithmetic: whole words first, then up to three bytes from the start of the key
def murmur2(key: str) -> str:
    m32 = "4294967295"
    word = f"(ord({key}[4*i+1])::UBIGINT | (ord({key}[4*i+2])::UBIGINT << 8) | (ord({key}[4*i+3])::UBIGINT << 16) | (ord({key}[4*i+4])::UBIGINT << 24))"
    words = f"list_transform(range(0, length({key}) // 4), lambda i: {word})"
    mul = f"(w * 1540483477::UBIGINT) & {m32}"
    mixed = f"list_transform(list_transform({words}, lambda w: {mul}), lambda w: (xor(w, w >> 24) * 1540483477::UBIGINT) & {m32})"
    body = f"list_reduce(list_prepend(xor(2538058380::UBIGINT, length({key})::UBIGINT), {mixed}), lambda h, w: xor((h * 1540483477::UBIGINT) & {m32}, w))"
    return body


def partition_of(key: str, source: str, n: int, columns: str) -> str:
    m32 = "4294967295"
    return f"""
hash_body AS (SELECT {columns}, {key} AS hash_key, {murmur2(key)} AS h0, length({key}) % 4 AS tail FROM {source}),
hash_tail AS (
  SELECT *, xor(xor(xor(h0,
      CASE WHEN tail >= 3 THEN ord(hash_key[3])::UBIGINT << 16 ELSE 0 END),
      CASE WHEN tail >= 2 THEN ord(hash_key[2])::UBIGINT << 8 ELSE 0 END),
      CASE WHEN tail >= 1 THEN ord(hash_key[1])::UBIGINT ELSE 0 END) AS h1 FROM hash_body),
hash_mixed AS (SELECT *, CASE WHEN tail > 0 THEN (h1 * 1540483477::UBIGINT) & {m32} ELSE h1 END AS h2 FROM hash_tail),
hash_last AS (SELECT *, (xor(h2, h2 >> 13) * 1540483477::UBIGINT) & {m32} AS h3 FROM hash_mixed),
placed AS (SELECT {columns}, CASE WHEN hash_key IS NULL THEN 0 ELSE CAST((xor(h3, h3 >> 15) & 2147483647) % {n} AS INT) END AS partition FROM hash_last)"""


FRAMES = LOG + """,
frames AS (
  SELECT log_pos // 1000 AS segment_id, log_pos + 1 AS seqid, event_ts, size, raw,
         CAST(120 + sum(size) OVER (PARTITION BY log_pos // 1000 ORDER BY log_pos) AS BIGINT) AS log_pos,
         log_pos % 503 = 499 AS damaged
  FROM log)"""

# bitwise CRC-32 of a text, byte by byte
CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(raw) + 1), lambda i: ord(raw[i])::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1::UBIGINT, 2, 3, 4, 5, 6, 7, 8]),
      lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""

PACKS = """
messages AS (
  SELECT 'k' || event_id AS key, props AS value, CAST(event_id % 3 AS INT) AS partition, event_id // 3 AS "offset",
         max(epoch_us(ts) // 1000000 // 86400) OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS tick
  FROM events),
ticked AS (SELECT *, length(value) AS bytes, row_number() OVER (PARTITION BY partition, tick ORDER BY "offset") AS rn FROM messages),
fold AS (
  SELECT partition, tick, rn, bytes AS held, 1 AS n, CAST(0 AS BIGINT) AS part, bytes > 80 OR 1 > 10 AS is_cut
  FROM ticked WHERE rn = 1
  UNION ALL
  SELECT t.partition, t.tick, t.rn, CASE WHEN f.is_cut THEN t.bytes ELSE f.held + t.bytes END,
         CASE WHEN f.is_cut THEN 1 ELSE f.n + 1 END, f.part + CAST(f.is_cut AS BIGINT),
         (CASE WHEN f.is_cut THEN t.bytes ELSE f.held + t.bytes END) > 80 OR (CASE WHEN f.is_cut THEN 1 ELSE f.n + 1 END) > 10
  FROM fold f JOIN ticked t ON t.partition = f.partition AND t.tick = f.tick AND t.rn = f.rn + 1),
packed AS (
  SELECT t.*, f.part, row_number() OVER (PARTITION BY t.partition, t.tick, f.part ORDER BY t.rn) - 1 AS idx
  FROM ticked t JOIN fold f USING (partition, tick, rn))"""

SEGMENTS = RECORDS + "," + numbered(1) + """,
seg_fold AS (
  SELECT seqid, 120 + bytes AS held, CAST(0 AS BIGINT) AS segment_id, committed AND 120 + bytes > 4000 AS is_cut
  FROM numbered WHERE seqid = 1
  UNION ALL
  SELECT n.seqid, CASE WHEN f.is_cut THEN 120 ELSE f.held END + n.bytes, f.segment_id + CAST(f.is_cut AS BIGINT),
         n.committed AND CASE WHEN f.is_cut THEN 120 ELSE f.held END + n.bytes > 4000
  FROM seg_fold f JOIN numbered n ON n.seqid = f.seqid + 1)"""


def throughput(source: str, ts: str, seconds: int, scope: str = "") -> str:
    by = f"{scope}, " if scope else ""
    using = f"({by}slot)"
    over = f"PARTITION BY {scope} ORDER BY slot" if scope else "ORDER BY slot"
    return f"""
counted AS (SELECT {by}epoch_us({ts}) // 1000000 // {seconds} AS slot, count(*) AS n FROM {source} GROUP BY ALL),
bounds AS (SELECT {by}min(slot) AS lo, max(slot) AS hi FROM counted {'GROUP BY ' + scope if scope else ''}),
slots AS (SELECT {by}unnest(generate_series(lo, hi)) AS slot FROM bounds)
SELECT {by}slot * {seconds} AS interval_start, coalesce(n, 0) AS events,
       CAST(sum(coalesce(n, 0)) OVER ({over}) AS BIGINT) AS total, coalesce(n, 0) // {seconds} AS avg_per_second
FROM slots LEFT JOIN counted USING {using}"""


BOTH_TOPICS = f"""
both_topics AS (
  SELECT * FROM (WITH {topic("dups")} SELECT 'changes' AS topic, partition, "offset", arrival, key, seqid, junk FROM topic)
  UNION ALL SELECT * FROM (WITH {topic("gap")} SELECT 'audit' AS topic, partition, "offset", arrival, key, seqid, junk FROM topic))"""


ORACLES: dict[str, str] = {
    "parse_rules": """
WITH rules AS (SELECT DISTINCT 'DB' || (k % 7) || '@t[' || (k % 5) || ']' AS rule
               FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))
SELECT lower(split_part(rule, '@', 1)) AS schema_name,
       string_agg(split_part(rule, '@', 2), ',' ORDER BY split_part(rule, '@', 2)) AS table_regexes
FROM rules GROUP BY 1""",
    "filter_schema": f"""
WITH {LOG} SELECT source_id, log_pos, schema_name, size FROM log
WHERE kind = 'QUERY' AND lower(schema_name) IN ('db0', 'db1')""",
    "filter_tables": f"""
WITH {LOG} SELECT source_id, log_pos, schema_name, table_name FROM log WHERE kind = 'TABLE_MAP' AND {TABLE_RULE}""",
    "is_begin": f"WITH {LOG} SELECT log_pos, coalesce(upper(query) = 'BEGIN', false) AS begins FROM log",
    "carry_table_decision": f"WITH {ROUTED} SELECT source_id, log_pos, kind, epoch, keep, in_tx FROM routed",
    "route_kinds": f"WITH {ROUTED} SELECT source_id, log_pos, kind, action FROM routed",
    "override_topic": "SELECT event_id, event_type AS kept, 'archive' AS replaced FROM events",
    "drop_bad_envelopes": f"""
WITH {topic("dups")} SELECT partition, "offset", key, coalesce(seqid, 0) AS seqid, CASE WHEN junk THEN 0 ELSE 1 END AS events,
  CASE WHEN junk THEN 'dead' ELSE 'good' END AS output FROM topic""",
    "segments_matching": f"""
WITH {LOG}, names AS (
  SELECT CASE kind WHEN 'OTHER' THEN log_file || '.tmp' WHEN 'XID' THEN 'old-' || log_file ELSE log_file END AS name FROM log)
SELECT name, CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) AS segment_number, count(*) AS n
FROM names WHERE regexp_matches(name, '^binlog-[0-9]+.log$') GROUP BY ALL""",
    "newest_and_oldest_unpadded": "SELECT 'binlog-' || max(event_id % 7 + 7) || '.log' AS newest, 'binlog-' || min(event_id % 7 + 7) || '.log' AS oldest FROM events",
    "newest_and_oldest_segment": f"WITH {LOG} SELECT max(log_file) AS newest, min(log_file) AS oldest FROM log",
    "assemble_transactions": f"WITH {ROUTED}, {TRANSACTIONS} SELECT * FROM transactions",
    "drop_empty_transactions": f"""
WITH {ROUTED}, {TRANSACTIONS},
c AS (SELECT source_id, count(*) AS commits FROM log WHERE kind = 'XID' GROUP BY 1),
s AS (SELECT source_id, count(*) AS sent, min(n_events) AS smallest FROM transactions GROUP BY 1)
SELECT source_id, commits, sent, smallest FROM c LEFT JOIN s USING (source_id)""",
    "split_transactions": f"WITH RECURSIVE {RECORDS} SELECT source_id, epoch, log_pos, part, is_cut FROM parts",
    "standalone_records": f"WITH {ROUTED} SELECT source_id, log_pos, kind, size FROM routed WHERE action = 'standalone'",
    "record_headers": f"""
WITH RECURSIVE {RECORDS} SELECT source_id, epoch, CAST(part AS BIGINT) AS part, n_events, bytes, first_pos, log_file, log_pos, committed
FROM records""",
    "build_records": f"""
WITH RECURSIVE {RECORDS} SELECT source_id, log_pos, n_events, length(replace(payload, '|', '')) AS payload_bytes, payload
FROM records""",
    "order_log_transactions": f"WITH {ORDERS_ROUTED}, {TRANSACTIONS} SELECT * FROM transactions",
    "order_log_records": f"""
WITH RECURSIVE {ORDERS_ROUTED}, {records(400)}
SELECT source_id, CAST(part AS BIGINT) AS part, n_events, bytes, first_pos, log_pos, committed FROM records""",
    "last_position": f"""
WITH RECURSIVE {RECORDS} SELECT source_id, max(log_file) AS log_file, max(log_pos) AS log_pos FROM records GROUP BY 1""",
    "read_changelog": f"""
WITH {LOG}, saved AS (SELECT source_id, max(log_pos) AS p FROM log
  WHERE event_ts < TIMESTAMP '2024-01-15 00:00:00' AND source_id < 6 GROUP BY 1)
SELECT source_id, log_file, log_pos, kind FROM log LEFT JOIN saved USING (source_id) WHERE p IS NULL OR log_pos > p""",
    "read_from_offsets": f"""
WITH {topic("dups")}, saved AS (SELECT partition, max("offset") // 2 AS p FROM topic WHERE partition < 2 GROUP BY 1)
SELECT partition, "offset", key, coalesce(seqid, 0) AS seqid FROM topic LEFT JOIN saved USING (partition) WHERE "offset" >= coalesce(p, 0)""",
    "partition_stream": f"""WITH {topic("dups")} SELECT partition, "offset", key FROM topic""",
    "order_within_source": f"WITH {LOG} SELECT source_id, log_file, log_pos, kind FROM log",
    "assign_seqid": f"""
WITH RECURSIVE {RECORDS}, {numbered(10**12 - 999)} SELECT source_id, log_file, log_pos, n_events, seqid FROM numbered""",
    "fan_in": f"""
WITH {LOG}, {ORDERS}, both_logs AS (
  SELECT source_id, log_file, log_pos, event_ts FROM log
  UNION ALL SELECT source_id + 8, log_file, log_pos, event_ts FROM order_log),
{numbered(1, "both_logs")} SELECT source_id, log_file, log_pos, seqid FROM numbered""",
    "publish_records": f"""
WITH RECURSIVE {RECORDS}, {numbered(10**12 - 999)},
keyed AS (
  SELECT md5(source_id || '|' || log_file || '|' || log_pos) AS key, seqid,
         '{{"seqid":' || seqid || ',"data":[' || list_aggregate(list_transform(string_split(payload, '|'),
           lambda x: '"' || to_base64(encode(x)) || '"'), 'string_agg', ',') || ']}}' AS value
  FROM numbered),
{partition_of("key", "keyed", 3, "key, seqid, value")}
SELECT 'changes' AS topic, key, value, partition, seqid FROM placed""",
    "resequence": f"""
WITH {topic("late_gap")}, {winners(501)}
SELECT seqid, w.d, partition, "offset", key FROM winners w, expected e WHERE w.d < e.d""",
    "resequence_wrapped": f"""
WITH {topic("late_gap", 10**12 - 4999)}, {winners(10**12 - 4999)}
SELECT seqid, w.d, partition, "offset", key FROM winners w, expected e WHERE w.d < e.d""",
    "resequence_whole": f"""
WITH {topic("whole")}, {winners(1)}
SELECT seqid, d, partition, "offset", key FROM winners""",
    "resequence_whole_wrapped": f"""
WITH {topic("whole", 10**12 - 4999)}, {winners(10**12 - 4999)}
SELECT seqid, d, partition, "offset", key FROM winners""",
    "resequence_delivered_again": f"""
WITH {topic("whole")}, {winners(1)}
SELECT seqid, d, partition, "offset", key FROM winners""",
    "pending_status_delivered_again": f"""
WITH {topic("dups")}, {winners(501)},
told AS (
  SELECT t.partition, t."offset", 1 + CAST(t.arrival % 101 = 3 AS INT) + CAST(t.arrival % 7 = 3 AS INT) AS n, CASE WHEN t.seqid IS NULL THEN 'invalid' WHEN w.d IS NULL THEN 'duplicate'
         WHEN w.d < e.d THEN 'released' WHEN w.d < e.d + 50 THEN 'pending' ELSE 'blocked' END AS status
  FROM topic t CROSS JOIN expected e LEFT JOIN winners w ON w.partition = t.partition AND w."offset" = t."offset"),
rows AS (
  SELECT partition, "offset", status, CASE WHEN status IN ('invalid', 'duplicate') THEN n ELSE 1 END AS n FROM told
  UNION ALL SELECT partition, "offset", 'duplicate', n - 1 FROM told WHERE status NOT IN ('invalid', 'duplicate') AND n > 1)
SELECT partition, "offset", status, CAST(sum(n) AS BIGINT) AS deliveries FROM rows GROUP BY ALL""",
    "last_offsets_two_topics": f"""
WITH {BOTH_TOPICS} SELECT topic, partition, arg_max("offset", arrival) AS "offset", arg_max(seqid, arrival) AS seqid
FROM both_topics WHERE NOT junk GROUP BY ALL""",
    "contiguous_watermark_two_topics": f"""
WITH {BOTH_TOPICS}, good AS (SELECT DISTINCT topic, partition, "offset" AS o FROM both_topics WHERE NOT junk),
started AS (SELECT topic, partition FROM good WHERE o = 0)
SELECT g.topic, g.partition, min(g.o) AS watermark FROM good g JOIN started USING (topic, partition)
WHERE NOT EXISTS (SELECT 1 FROM good n WHERE n.topic = g.topic AND n.partition = g.partition AND n.o = g.o + 1) GROUP BY ALL""",
    "read_from_offsets_two_topics": f"""
WITH {BOTH_TOPICS}, saved AS (
  SELECT topic, partition, max("offset") // 2 AS p FROM both_topics WHERE partition < 2 AND topic = 'changes' GROUP BY ALL)
SELECT topic, partition, "offset", key, coalesce(seqid, 0) AS seqid FROM both_topics LEFT JOIN saved USING (topic, partition)
WHERE "offset" >= coalesce(p, 0)""",
    "resequence_two_topics": f"""
WITH {BOTH_TOPICS}, firsts AS (
  SELECT seqid, seqid - 1 AS d, topic, partition, "offset", key,
         row_number() OVER (PARTITION BY seqid ORDER BY partition, "offset", topic) AS copy FROM both_topics WHERE NOT junk),
ids AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS place FROM firsts WHERE copy = 1)
SELECT seqid, d, topic, partition, "offset", key FROM ids WHERE d = place""",
    "drop_stale": f"""WITH {topic("dups")}, {winners(501)} SELECT seqid, partition, "offset", key FROM winners""",
    "pending_status": f"""
WITH {topic("dups")}, {winners(501)}
SELECT t.partition, t."offset", coalesce(t.seqid, 0) AS seqid,
  CASE WHEN t.seqid IS NULL THEN 'invalid' WHEN w.d IS NULL THEN 'duplicate' WHEN w.d < e.d THEN 'released'
       WHEN w.d < e.d + 50 THEN 'pending' ELSE 'blocked' END AS status
FROM topic t CROSS JOIN expected e LEFT JOIN winners w ON w.partition = t.partition AND w."offset" = t."offset" """,
    "gap_report": f"""
WITH {topic("gap")}, ids AS (SELECT DISTINCT seqid FROM topic WHERE seqid IS NOT NULL),
chained AS (SELECT seqid, coalesce(lag(seqid) OVER (ORDER BY seqid), 0) AS previous FROM ids)
SELECT previous + 1 AS first_missing, seqid - 1 AS last_missing, seqid - previous - 1 AS missing
FROM chained WHERE seqid - previous > 1""",
    "last_offsets": f"""
WITH {topic("dups")} SELECT partition, arg_max("offset", arrival) AS "offset", arg_max(seqid, arrival) AS seqid
FROM topic WHERE NOT junk GROUP BY 1""",
    "offset_book": f"""
WITH {topic("dups")}, p AS (SELECT partition, arg_max("offset", arrival) AS o FROM topic WHERE NOT junk GROUP BY 1)
SELECT (SELECT string_agg(partition || ':' || o, ',' ORDER BY partition) FROM p) AS offsets,
       (SELECT arg_max(seqid, arrival) FROM topic WHERE NOT junk) AS seqid""",
    "contiguous_watermark": f"""
WITH {topic("gap")}, good AS (SELECT DISTINCT partition, "offset" AS o FROM topic WHERE NOT junk),
started AS (SELECT partition FROM good WHERE o = 0)
SELECT g.partition, min(g.o) AS watermark FROM good g JOIN started USING (partition)
WHERE NOT EXISTS (SELECT 1 FROM good n WHERE n.partition = g.partition AND n.o = g.o + 1) GROUP BY 1""",
    "route_messages": f"""
WITH keyed AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type || '-' || user_id END AS key FROM events),
{partition_of("key", "keyed", 6, "event_id, key")} SELECT event_id, key, partition FROM placed""",
    "partition_balance": f"""
WITH keyed AS (SELECT 'k' || event_id AS key, length(props) AS bytes FROM events),
{partition_of("key", "keyed", 6, "key, bytes")}
SELECT partition, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes,
       CAST(sum(bytes) AS DOUBLE) / (SELECT sum(bytes) FROM placed) AS share FROM placed GROUP BY 1""",
    "write_topic_rows": f"""
WITH {LOG}, keyed AS (SELECT log_pos, md5(source_id || '|' || log_file || '|' || log_pos) AS key, raw FROM log),
{partition_of("key", "keyed", 6, "log_pos, key, raw")}
SELECT log_pos, 'changes' AS topic, key, raw AS value, partition FROM placed""",
    "write_topic_key_lists": f"""
WITH keyed AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) - 1 AS INT) AS idx,
         event_type || '-' || event_id AS key, props AS value FROM events),
{partition_of("key", "keyed", 6, "user_id, idx, key, value")}
SELECT user_id, idx, 'changes' AS topic, key, value, partition FROM placed""",
    "pack_messages": f"""
WITH RECURSIVE {PACKS}
SELECT 'changes' AS topic, partition, tick, part, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes,
       min("offset") AS first_offset, max("offset") AS last_offset,
       '{{"topic":"changes","data":[' || string_agg('{{"key":"' || key || '","value":"' || to_base64(encode(value)) || '"}}', ',' ORDER BY idx) || ']}}' AS pack
FROM packed GROUP BY partition, tick, part""",
    "pack_messages_two_topics": f"""
WITH RECURSIVE {PACKS}
SELECT topic, partition, tick, part, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes,
       min("offset") AS first_offset, max("offset") AS last_offset,
       '{{"topic":"' || topic || '","data":[' || string_agg('{{"key":"' || key || '","value":"' || to_base64(encode(value)) || '"}}', ',' ORDER BY idx) || ']}}' AS pack
FROM packed, (VALUES ('left'), ('right')) AS t(topic) GROUP BY topic, partition, tick, part""",
    "unpack": f"WITH RECURSIVE {PACKS} SELECT 'archive' AS topic, CAST(idx AS INT) AS idx, key, value FROM packed",
    "log_rows": "SELECT 'key: k' || event_id || ', value:' || props AS line FROM events",
    "republish": f"""
WITH keyed AS (SELECT 'k' || event_id AS key, props AS value FROM events),
{partition_of("key", "keyed", 6, "key, value")} SELECT 'archive' AS topic, key, value, partition FROM placed""",
    "segment_log": f"""
WITH RECURSIVE {SEGMENTS} SELECT seqid, bytes, committed, segment_id FROM numbered JOIN seg_fold USING (seqid)""",
    "segment_log_wrapped": f"""
WITH RECURSIVE {SEGMENTS}
SELECT (10**12 - 999 - 1 + seqid - 1)::BIGINT % 1000000000000 + 1 AS seqid, bytes, committed, segment_id
FROM numbered JOIN seg_fold USING (seqid)""",
    "rewrite_positions": f"""
WITH {FRAMES} SELECT segment_id, seqid, size, log_pos, CAST(xor({CRC}, 4294967295::UBIGINT) AS BIGINT) AS crc FROM frames""",
    "verify_segments": f"""
WITH {FRAMES} SELECT segment_id, coalesce(min(CASE WHEN damaged THEN log_pos - size END), max(log_pos)) AS valid_end,
  CASE WHEN bool_or(damaged) THEN 'checksum' ELSE 'eof' END AS stop_reason FROM frames GROUP BY 1""",
    "check_on_read": f"""
WITH {FRAMES} SELECT segment_id, seqid, log_pos, CASE WHEN damaged THEN 'damaged' ELSE 'intact' END AS state,
  CAST(length(raw) AS INT) AS frame_bytes FROM frames""",
    "segment_manifest": f"""
WITH {FRAMES}, m AS (
  SELECT segment_id, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes, min(seqid) AS first_seqid, max(seqid) AS last_seqid,
         min(epoch_us(event_ts)) // 1000000 AS first_ts, max(epoch_us(event_ts)) // 1000000 AS last_ts FROM frames GROUP BY 1),
chained AS (SELECT *, lead(segment_id) OVER (ORDER BY segment_id) AS next_segment FROM m)
SELECT * REPLACE (coalesce(next_segment, -1) AS next_segment), 120 + bytes + coalesce(31 + length('binlog-' || next_segment || '.log'), 0) AS file_bytes FROM chained""",
    "write_segments_table": f"""
WITH {FRAMES} SELECT segment_id, seqid, size, log_pos,
  CAST(xor({CRC}, 4294967295::UBIGINT) AS BIGINT) + CAST(damaged AS INT) AS crc FROM frames""",
    "read_segments_pruned": f"""
WITH {FRAMES} SELECT segment_id, seqid, size, log_pos,
  CAST(xor({CRC}, 4294967295::UBIGINT) AS BIGINT) + CAST(damaged AS INT) AS crc FROM frames WHERE segment_id >= 1""",
    "scan_segments": f"""
WITH {FRAMES} SELECT segment_id, log_pos, seqid FROM frames
WHERE segment_id > 2 OR (segment_id = 2 AND log_pos - size >= 5000)""",
    "replay_from": f"""
WITH {FRAMES} SELECT segment_id, log_pos, raw AS frame FROM frames
WHERE NOT damaged AND (segment_id > 2 OR (segment_id = 2 AND log_pos - size >= 5000))""",
    "throughput": f"WITH {LOG}, {throughput('log', 'event_ts', 3600, 'source_id')}",
    "throughput_orders": f"WITH {throughput('lineitem', 'l_shipdate', 86400)}",
    "freshness": f"""
WITH {LOG}, f AS (SELECT source_id, arg_max(epoch_us(event_ts), log_pos) // 1000000 AS last_event FROM log GROUP BY 1)
SELECT source_id, last_event, strftime(make_timestamp(last_event * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_event_text,
       1706659200 - last_event AS lag_seconds FROM f""",
    "concurrency_gauge": """
SELECT event_id, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS connected
FROM events""",
    "tier_by_age": f"""
WITH {LOG}, f AS (SELECT log_file, max(epoch_us(event_ts)) // 1000000 AS modified FROM log GROUP BY 1),
n AS (SELECT max(modified) AS now FROM f)
SELECT log_file, modified, CASE WHEN (now - modified) // 86400 > 3 THEN 'expired'
  WHEN (now - modified) // 86400 > 1 THEN 'compressed' ELSE 'hot' END AS tier FROM f, n""",
    "apply_latest": f"""
WITH {LOG}, latest AS (
  SELECT source_id, schema_name, table_name, log_file, log_pos, kind, size FROM log
  QUALIFY row_number() OVER (PARTITION BY source_id, schema_name, table_name ORDER BY log_file DESC, log_pos DESC) = 1)
SELECT * FROM latest WHERE kind <> 'XID'""",
    "stream_records": f"""
WITH RECURSIVE {RECORDS}, {numbered(1)}
SELECT source_id, log_file, log_pos, n_events, bytes, committed, seqid, payload FROM numbered""",
    "stream_watermark": """
WITH done AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'changes' ELSE 'audit' END AS topic, CAST(event_id // 2 % 3 AS INT) AS partition, event_id // 6 AS o
              FROM events WHERE event_id % 211 <> 210),
started AS (SELECT topic, partition FROM done WHERE o = 0)
SELECT d.topic, d.partition, min(d.o) AS watermark FROM done d JOIN started USING (topic, partition)
WHERE NOT EXISTS (SELECT 1 FROM done n WHERE n.topic = d.topic AND n.partition = d.partition AND n.o = d.o + 1) GROUP BY ALL""",
    "stream_records_in_batches": f"""
WITH RECURSIVE {RECORDS} SELECT source_id, epoch, CAST(part AS BIGINT) AS part, log_file, log_pos, n_events, bytes, committed, payload FROM records""",
    "stream_segments": f"""
WITH RECURSIVE {LOG},
released AS (SELECT log_pos AS d, log_pos + 1 AS seqid, length(raw) AS size, kind = 'XID' AS committed, raw FROM log WHERE log_pos < 6006),
seg_fold AS (
  SELECT d, 120 + size AS log_pos, CAST(0 AS BIGINT) AS segment_id, committed AND 120 + size > 4000 AS is_cut FROM released WHERE d = 0
  UNION ALL
  SELECT r.d, CASE WHEN f.is_cut THEN 120 ELSE f.log_pos END + r.size, f.segment_id + CAST(f.is_cut AS BIGINT),
         r.committed AND CASE WHEN f.is_cut THEN 120 ELSE f.log_pos END + r.size > 4000
  FROM seg_fold f JOIN released r ON r.d = f.d + 1)
SELECT segment_id, seqid, size, log_pos, CAST(xor({CRC}, 4294967295::UBIGINT) AS BIGINT) AS crc, raw AS frame
FROM released JOIN seg_fold USING (d)""",
    "stream_segments_whole": f"""
WITH RECURSIVE {LOG},
whole AS (SELECT log_pos AS d, log_pos + 1 AS seqid, length(raw) AS size, kind = 'XID' AS committed, raw,
                 CAST(sum(length(raw)) OVER (ORDER BY log_pos) AS BIGINT) AS upto FROM log),
ends AS (SELECT d, upto FROM whole WHERE committed),
next_cut AS (SELECT s.upto AS before, e.d, e.upto FROM (SELECT 0 AS upto UNION ALL SELECT upto FROM ends) s ASOF JOIN ends e ON s.upto + 3880 < e.upto),
cuts AS (SELECT d, upto FROM next_cut WHERE before = 0 UNION ALL SELECT n.d, n.upto FROM cuts c JOIN next_cut n ON n.before = c.upto),
numbered AS (SELECT d, upto, row_number() OVER (ORDER BY d) AS segment_id FROM cuts)
SELECT coalesce(segment_id, 0) AS segment_id, seqid, size, 120 + w.upto - coalesce(n.upto, 0) AS log_pos,
       CAST(xor({CRC}, 4294967295::UBIGINT) AS BIGINT) AS crc, raw AS frame
FROM whole w ASOF LEFT JOIN numbered n ON w.d > n.d""",
    "stream_far_ahead": """
WITH bounds AS (SELECT min(event_id) AS low, max(event_id) + 1 - min(event_id) AS n FROM events),
starts AS (SELECT low AS p0, low + n // 6 AS p1, low + n * 2 // 6 AS p2 FROM bounds),
placed AS (SELECT event_id, CASE WHEN event_id < p1 THEN 3 WHEN event_id < p2 THEN 4 ELSE 5 END AS batch,
                  CASE WHEN event_id < p1 THEN p0 WHEN event_id < p2 THEN p1 ELSE p2 END AS first_id FROM events, starts)
SELECT batch::BIGINT AS batch, event_id + 1 AS seqid, event_id - first_id AS d, 'k' || event_id AS key FROM placed""",
    "stream_relay": f"""
WITH keyed AS (SELECT 'k' || event_id AS key, props AS value FROM events),
{partition_of("key", "keyed", 6, "key, value")} SELECT 'changes' AS topic, key, value, partition FROM placed""",
}
ORACLES["stream_log_rows"] = ORACLES["log_rows"]
ORACLES["stream_files_to_table"] = "SELECT 'archive' AS topic, 'k' || event_id AS key, props AS value FROM events"
ORACLES["stream_segments_in_batches"] = ORACLES["stream_segments"]
ORACLES["stream_segments_whole_in_batches"] = ORACLES["stream_segments_whole"]
ORACLES["stream_tail_segments"] = f"""
SELECT segment_id, seqid, size, log_pos, frame FROM ({ORACLES["stream_segments_whole"]})
WHERE segment_id > 1 OR (segment_id = 1 AND log_pos - size >= 1500)"""
ORACLES["stream_segments_repaired"] = ORACLES["stream_segments_whole"]
ORACLES["stream_apply_latest"] = ORACLES["apply_latest"]
ORACLES["stream_records_two_collectors"] = f"""
WITH RECURSIVE {RECORDS}
SELECT source_id, log_file, log_pos, n_events, bytes, committed, count(*) OVER () AS ids, CAST(1 AS BIGINT) AS first_id, count(*) OVER () AS last_id FROM records"""
ORACLES["age_log_files"] = f"""
WITH aged AS ({ORACLES["tier_by_age"]}), {LOG}
SELECT log_file, tier, log_pos, source_id FROM log JOIN aged USING (log_file) WHERE tier <> 'expired'"""

# the databases Db0 .. Db6 but Db1, each with the tables that the events draw
RULE_ROWS = """
rule_rows AS (
  SELECT 'db' || (k % 7) AS database, string_agg(DISTINCT CAST(k % 4 AS VARCHAR), '') AS digits
  FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) WHERE k % 7 <> 1 GROUP BY 1)"""
BY_ROWS = """EXISTS (SELECT 1 FROM rule_rows r WHERE r.database = lower(schema_name) AND regexp_matches(lower(table_name), 't[' || r.digits || ']'))"""
ORACLES["filter_schema_by_rule_rows"] = f"""
WITH {LOG}, {RULE_ROWS} SELECT source_id, log_pos, schema_name, size FROM log
WHERE kind = 'QUERY' AND lower(schema_name) IN (SELECT database FROM rule_rows)"""
ORACLES["filter_tables_by_rule_rows"] = f"""
WITH {LOG}, {RULE_ROWS} SELECT source_id, log_pos, schema_name, table_name FROM log WHERE kind = 'TABLE_MAP' AND {BY_ROWS}"""
ORACLES["route_kinds_by_rule_rows"] = f"""
WITH {LOG}, {RULE_ROWS}, {routed("log", BY_ROWS, "SELECT database FROM rule_rows")} SELECT source_id, log_pos, kind, action FROM routed"""
ORACLES["stream_figures"] = """
WITH b AS (SELECT min(event_id) AS lo, max(event_id) + 1 - min(event_id) AS n FROM events),
batches AS (SELECT i, (SELECT count(*) FROM events, b WHERE event_id >= lo + n * i // 3 AND event_id < lo + n * (i + 1) // 3) AS events,
                   (SELECT max(epoch_us(ts)) // 1000000 FROM events, b WHERE event_id < lo + n * (i + 1) // 3) AS last_event
            FROM range(3) r(i)),
totals AS (SELECT *, CAST(sum(events) OVER (ORDER BY i) AS BIGINT) AS total FROM batches)
SELECT 2 * i + idle AS report, CASE idle WHEN 0 THEN events ELSE 0 END AS events, total,
       CASE idle WHEN 0 THEN events // 50 ELSE 0 END AS avg_per_second, last_event, 1706659200 - last_event AS lag_seconds
FROM totals, range(2) s(idle)"""
