"""Routing, transactions and records against an event-by-event walk through random logs."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import rules, transactions

RULES = rules.parse_rules(["Shop@^o", "shop@item", "crm@user"])
SCHEMA = (
    "source_id bigint, log_file string, log_pos bigint, event_ts timestamp_ntz, kind string, schema_name string, "
    "table_name string, query string, size bigint, raw binary"
)


def random_log(rng, sources, events):
    rows = []
    for s in range(sources):
        for pos in range(events):
            kind = rng.choices(["QUERY", "TABLE_MAP", "ROWS", "XID", "ROTATE", "FORMAT", "OTHER"], [4, 4, 8, 2 + s, 1, 1, 1])[0]
            rows.append(
                (s, f"binlog-{pos // 40:03d}.log", pos % 40, None, kind, rng.choice(["SHOP", "crm", "misc", None]),
                 rng.choice(["Orders", "line_ITEM", "users", "log", None]), rng.choice(["begin", "BEGIN", " BEGIN", "ALTER", None]),
                 rng.randint(1, 60), f"{s}:{pos}".encode())
            )
    return rows


def walk(rows, max_size):
    """{(source, last raw): [raw, ...]} of every record that goes out."""
    out, open_tx = {}, None  # open_tx: events, bytes, whether a part already went out
    keep, source = False, None
    for s, _, _, _, kind, schema, table, query, size, raw in rows:
        if s != source:
            source, open_tx, keep = s, None, False
        configured = {"shop": ("o",), "crm": ("user",)}.get((schema or "").lower())
        emit = None
        if kind == "TABLE_MAP":
            name = (table or "").lower()
            keep = bool(configured) and (
                ("item" in name or name.startswith("o")) if schema.lower() == "shop" else "user" in name
            )
        wanted = {
            "QUERY": open_tx is not None or (query or "").upper() == "BEGIN",
            "TABLE_MAP": keep,
            "XID": True,
            "ROTATE": False,
            "FORMAT": False,
        }.get(kind, open_tx is not None and keep)
        if wanted:
            open_tx = open_tx or {"events": [], "bytes": 0, "sent": False}
            open_tx["events"].append(raw)
            open_tx["bytes"] += size
            if kind == "XID":
                if open_tx["sent"] or len(open_tx["events"]) > 2:
                    emit = open_tx["events"]
                open_tx = None
                keep = False
            elif kind in ("ROWS", "OTHER") and open_tx["bytes"] > max_size:
                emit = open_tx["events"]
                open_tx = {"events": [], "bytes": 0, "sent": True}
        elif open_tx is None and (kind in ("ROWS", "OTHER") or (kind == "QUERY" and configured)):
            emit = [raw]
        if emit:
            out[(s, emit[-1])] = emit
    return out


@pytest.mark.parametrize("seed,span", [(1, 7), (2, 1000)])
def test_records_match_walk(spark, seed, span):
    rows = random_log(random.Random(seed), sources=4, events=300)
    want = walk(rows, 90)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    log = spark.createDataFrame(shuffled, SCHEMA)
    records = transactions.build_records(log, RULES, 90, span=span).collect()
    got = {(r.source_id, bytes(r.data[-1])): [bytes(b) for b in r.data] for r in records}
    assert got == want and len(records) == len(want)
    for r in records:
        assert r.n_events == len(r.data)


def test_whole_source_in_one_transaction(spark):
    """No commit for a long time: the blocks stay small, parts still go out."""
    rows = [(0, "binlog-0.log", 0, None, "QUERY", None, None, "BEGIN", 10, b"b"), (0, "binlog-0.log", 1, None, "TABLE_MAP", "crm", "users", None, 10, b"t")]
    rows += [(0, "binlog-0.log", p, None, "ROWS", None, None, None, 10, b"%d" % p) for p in range(2, 1000)]
    headers = transactions.record_headers(spark.createDataFrame(rows, SCHEMA), RULES, 95, span=64)
    got = headers.orderBy("log_pos").select("part", "n_events", "first_pos", "log_pos").collect()
    assert [tuple(r) for r in got] == [(i, 10, 10 * i, 10 * i + 9) for i in range(100)]


def test_rules():
    assert rules.parse_rules(["Db@a", "db@b", "x@"]) == {"db": ["a", "b"], "x": [""]}
    for bad in ("db", "db@a@b", ""):
        with pytest.raises(ValueError):
            rules.parse_rules([bad])


def test_malformed_rule_rows_fail(spark):
    good = spark.createDataFrame([("A@x",), ("a@y",)], "rule string")
    assert rules.parse_rule_rows(good).first().table_regexes == ["x", "y"]
    with pytest.raises(Exception, match="malformed rule"):
        rules.parse_rule_rows(spark.createDataFrame([("a@b@c",)], "rule string")).collect()


def test_predicates(spark):
    df = spark.createDataFrame([("begin",), ("BEGIN",), ("begin ",), (None,), ("begın",)], "query string")
    assert [r[0] for r in df.select(rules.is_begin(F.col("query"))).collect()] == [True, True, False, False, True]
    names = spark.createDataFrame([("SHOP", "my_Items"), ("shop", "to"), ("crm", None), (None, "user"), ("other", "o")], "s string, t string")
    got = names.select(rules.table_matches(RULES, F.col("s"), F.col("t")), rules.schema_matches(RULES, F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, True), (False, False), (False, False)]
