"""Tables that live on: aged parts, latest state under a stream, the shared counter, rules kept as rows."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.operators import lifecycle, rules
from logweave.plans import fixtures as fx
from logweave.sinks.tiers import AgedTable
from logweave.streaming.collector import collect_stream
from logweave.streaming.figures import LiveFigures
from logweave.streaming.latest import LatestTable
from logweave.streaming.ledger import IdLedger
from logweave.streaming.state import BatchStore
from test_streaming import in_files, run

DAY = 86400


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_parts_age_once(spark, tmp_path):
    table = AgedTable(str(tmp_path), "day")
    rows = spark.range(50).select("id", F.concat(F.lit("d"), F.col("id") % 5).alias("day"), (F.col("id") % 5 * DAY).alias("seconds"))
    table.add(rows, F.col("seconds"))
    kept = lambda: sorted((r.id, r.day) for r in table.read(spark).select("id", "day").collect())
    everything = kept()
    assert len(everything) == 50
    assert table.age(spark, 3 * DAY) == {"d0": "compressed", "d1": "compressed"} and kept() == everything
    gzipped = [f for f in files_below(tmp_path / "rows") if f.endswith(".gz.parquet")]
    assert {f.split("day=")[1][:2] for f in gzipped} == {"d0", "d1"}
    table.age(spark, 3 * DAY)  # clears what the run before has left, and no more
    before = files_below(tmp_path)
    assert table.age(spark, 3 * DAY) == {} and files_below(tmp_path) == before
    untouched = {f: t for f, t in before.items() if "day=d1" in f or "day=d3" in f or "day=d4" in f}
    assert table.age(spark, 4 * DAY) == {"d0": "expired", "d2": "compressed"}
    assert untouched.items() <= files_below(tmp_path).items()
    assert kept() == [r for r in everything if r[1] != "d0"]
    table.add(rows.where("day = 'd1'"), F.lit(4 * DAY))  # a part that was compressed is written to again
    assert table.tiers(spark) == {"d1": "hot", "d2": "compressed", "d3": "hot", "d4": "hot"}
    assert kept() == sorted([r for r in everything if r[1] != "d0"] + [r for r in everything if r[1] == "d1"])
    table.age(spark, 100 * DAY)
    with pytest.raises(ValueError):
        table.read(spark)


def test_part_names_must_fit_a_path(spark, tmp_path):
    with pytest.raises(Exception, match="not fit for a path"):
        AgedTable(str(tmp_path), "day").add(spark.sql("SELECT 1 AS id, 'a/b' AS day"), F.lit(0))


def test_latest_table_equals_batch(spark, tmp_path):
    """Late rows, rows given twice, deletions that come before what they delete, replayed batches."""
    schema, random_ = "k int, at bigint, v string, gone boolean", random.Random(5)
    rows = [(random_.choice([None, *range(8)]), at, f"v{at}", random_.random() < 0.3) for at in range(120)]
    random_.shuffle(rows)
    table = LatestTable(str(tmp_path), ("k",), ("at",), buckets=3, compact_every=2)
    for nr in range(9):
        given = rows[: (nr + 1) * 12]
        new = spark.createDataFrame(given[-12:] + given[:1], schema)
        for _ in range(2 if nr % 4 == 3 else 1):
            table.apply(new, nr, F.col("gone"))
        if nr % 2:
            wanted = lifecycle.apply_latest(spark.createDataFrame(given, schema), ["k"], ["at"], F.col("gone"))
            found = table.read(spark, new.schema)
            assert found.columns == new.columns
            assert {tuple(r) for r in found.collect()} == {tuple(r) for r in wanted.select(found.columns).collect()}
    held = {f.split("batch=")[1].split("/")[0] for f in files_below(tmp_path / "changes") if "batch=" in f}
    assert min(map(int, held)) >= 4  # what bases hold is gone


def test_ledger(spark, tmp_path):
    ledger = IdLedger(str(tmp_path), start=10**12 - 4)
    assert ledger.claim(spark, "a", 0, 0) == 10**12 - 4
    assert ledger.claim(spark, "a", 0, 3) == 10**12 - 4
    assert ledger.claim(spark, "b", 0, 10) == 10**12 - 1
    assert ledger.claim(spark, "a", 0, 3) == 10**12 - 4  # replayed
    assert ledger.claim(spark, "a", 1, 1) == 9  # behind the end of the cycle
    with pytest.raises(ValueError):
        ledger.claim(spark, "a", 1, 2)
    with pytest.raises(ValueError):
        ledger.claim(spark, "a", 0, 3)


def test_claims_at_once_never_overlap(spark, tmp_path):
    ledger, got = IdLedger(str(tmp_path)), []

    def claims(owner):
        for batch in range(8):
            got.append((ledger.claim(spark, owner, batch, batch + 1), batch + 1))

    threads = [threading.Thread(target=claims, args=(name,)) for name in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = sorted(i for first, count in got for i in range(first, first + count))
    assert ids == list(range(1, 3 * 36 + 1))


def test_two_collectors_one_killed_and_restarted(spark, tmp_path):
    log, ledger, tries = fx.change_log(spark, SF_SMALL), IdLedger(str(tmp_path / "ledger")), []
    wanted = rules.parse_rules(fx.RULES)
    stores = [BatchStore(str(tmp_path / f"store{i}")) for i in range(2)]
    for i in range(2):
        in_files(log.where(F.col("source_id") % 2 == i), str(tmp_path / f"log{i}"), "log_pos", 2)

    def failing_once(records, batch_id):
        tries.append(batch_id)
        if len(tries) == 1:
            raise RuntimeError("killed with its ids claimed")

    def collector(i):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"log{i}"))
        return collect_stream(stream, wanted, fx.MAX_SIZE, stores[i], span=fx.SPAN, sink=failing_once if i else None, ledger=ledger, owner=f"c{i}")

    running = [collector(i).trigger(availableNow=True).start() for i in range(2)]
    with pytest.raises(Exception):
        running[1].awaitTermination()
    running[0].awaitTermination()
    run(collector(1))
    ids = sorted(r.seqid for store in stores for r in store.read(spark, "records").select("seqid").collect())
    assert ids == list(range(1, len(ids) + 1)) and len(ids) > 0 and tries == [0, 0, 1]


def test_rule_rows_equal_literal_rules(spark):
    """Twenty thousand databases as a table: the plan is that of one, and rows fare as with the few that matter spelled out."""
    log = fx.change_log(spark, SF_SMALL)
    many = spark.range(20000).select(F.concat(F.lit("dB"), F.col("id"), F.lit("@t"), F.col("id") % 5).alias("rule"))
    table = rules.parse_rule_rows(many.unionByName(spark.createDataFrame([("db1@^x|3$",)], "rule string")))
    literal = rules.parse_rules(["db0@t0", "db1@t1", "db1@^x|3$", "db2@t2"])
    for decide in (rules.filter_tables, rules.filter_schema, lambda df, r: rules.route_events(df, r, span=fx.SPAN)):
        by_rows, spelled = decide(log, table), decide(log, literal)
        assert by_rows.columns == spelled.columns
        assert sorted(map(str, by_rows.drop("raw").collect())) == sorted(map(str, spelled.drop("raw").collect()))
    assert sum(1 for r in rules.filter_tables(log, table).collect()) > 0
    odd = spark.createDataFrame([("TABLE_MAP", None, "t0"), ("TABLE_MAP", "DB0", None), ("TABLE_MAP", "DB0", "T0")], "kind string, schema_name string, table_name string")
    assert rules.filter_tables(odd, table).count() == rules.filter_tables(odd, literal).count() == 1


def test_figures_count_a_replayed_batch_once_and_report_idle_intervals(spark, tmp_path):
    reports = []
    figures = LiveFigures(10, reports.append, clock=lambda: 1000)
    figures.report()
    for batch, first, end in ((0, 0, 95), (0, 0, 95), (1, 95, 100), (2, 0, 0)):
        rows, seen = figures.observed(spark.range(first, end).select(F.timestamp_seconds("id").alias("event_ts")))
        rows.write.mode("overwrite").parquet(str(tmp_path / "rows"))
        figures.took(batch, seen)
        figures.report()
    assert [(r["events"], r["total"], r["avg_per_second"], r["last_event"], r["lag_seconds"]) for r in reports] == [
        (0, 0, 0, None, None), (95, 95, 9, 94, 906), (0, 95, 0, 94, 906), (5, 100, 0, 99, 901), (0, 100, 0, 99, 901),
    ]


def test_figures_report_by_a_timer():
    reports = []
    with LiveFigures(1, reports.append):
        time.sleep(2.5)
    assert [r["events"] for r in reports] == [0, 0]
