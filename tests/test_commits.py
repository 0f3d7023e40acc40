"""The commit log between two streams, the tailing reader, and messages that wait by ranges."""

import pytest
from pyspark.sql import functions as F

from logweave import files
from logweave.functions.envelope import encode_envelope
from logweave.operators.segments import rewrite_positions, verify_segments
from logweave.session import checkpoint_root
from logweave.streaming.commits import CommitLog, commit_writer
from logweave.streaming.replayer import repair_tail, resequence_stream
from logweave.streaming.shelf import Shelf
from logweave.streaming.state import BatchStore
from logweave.streaming.tail import commit_frames, position, tail_segments
from test_streaming import run


def numbers(spark, log):
    return sorted(r.id for r in log.read(spark).select("id").collect())


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "one.json")
    assert files.put_if_absent(spark, path, "first") and not files.put_if_absent(spark, path, "second")
    assert open(path).read() == "first" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["one.json"]


def test_only_committed_tries_are_read(spark, tmp_path):
    log = CommitLog(str(tmp_path))
    assert log.manifests(spark) == []
    with pytest.raises(ValueError):
        log.read(spark)
    spark.range(100, 110).write.parquet(f"{log.root}/rows/batch=0/try=lost")  # a driver that died before its commit
    log.commit(spark.range(3), 0)
    log.commit(spark.range(3), 0)
    log.commit(spark.range(3, 5), 1)
    assert numbers(spark, log) == [0, 1, 2, 3, 4]
    assert [m.batch for m in log.manifests(spark, 1)] == [1] and log.read(spark).columns == ["id", "batch"]


def test_replay_between_two_streams(spark, tmp_path):
    """The first stream fails after its commit, the second one after its write; nothing is lost and nothing comes twice."""
    source, sent, arrived = str(tmp_path / "in"), CommitLog(str(tmp_path / "sent")), CommitLog(str(tmp_path / "arrived"))
    store, tries = BatchStore(str(tmp_path / "reader")), []

    def failing_at(batch, write, name):
        def write_and_fail(df, batch_id):
            write(df, batch_id)
            tries.append((name, batch_id))
            if batch_id == batch and tries.count((name, batch_id)) == 1:
                raise RuntimeError("lost right after writing")

        return write_and_fail

    def first():
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
        return stream.writeStream.foreachBatch(failing_at(1, commit_writer(sent), "first")).option("checkpointLocation", str(tmp_path / "checkpoint"))

    def second():
        return sent.follow_rows(spark, store, failing_at(2, commit_writer(arrived), "second"), batches_per_trigger=1)

    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(source)
        for writer in (first, second):
            query = writer().trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                run(writer())
    assert tries.count(("first", 1)) == 2 and tries.count(("second", 2)) == 2
    assert numbers(spark, sent) == numbers(spark, arrived) == list(range(40))


def test_tail_follows_rotation_and_goes_on_from_its_place(spark, tmp_path):
    log, frames = CommitLog(str(tmp_path / "log")), []
    for segment in range(6):
        for i in range(10):
            frames.append((segment, len(frames), f"frame {segment} {i}".encode()))
    rows = spark.createDataFrame(frames, "segment_id bigint, seqid bigint, frame binary")
    placed = rewrite_positions(rows.withColumn("size", F.octet_length("frame").cast("bigint")), ["seqid"], F.lit(0))
    seen = []

    def reader(store, *start):
        return tail_segments(spark, log, store, lambda df, _: seen.append([r.seqid for r in df.collect()]), *start)

    one, two = BatchStore(str(tmp_path / "one")), BatchStore(str(tmp_path / "two"))
    for batch, upto in enumerate((7, 25, 25, 33)):  # batches end inside segments; one is empty
        before = (0, 7, 25, 25)[batch]
        commit_frames(log, placed.where(F.col("seqid").between(before, upto - 1)), batch)
        run(reader(one))
    assert [i for part in seen for i in part] == list(range(33)) and len(seen) == 3
    run(reader(one))
    assert len(seen) == 3
    at = position(spark, one, 3)
    assert at[0] == 3 and at == tuple(placed.where("seqid = 32").select("segment_id", "log_pos").first())
    commit_frames(log, placed.where("seqid >= 33"), 4)
    seen.clear()
    run(reader(two, *at))  # a new reader that is told the place: skips whole batches by their manifests
    assert seen == [list(range(33, 60))]
    seen.clear()
    run(reader(BatchStore(str(tmp_path / "three")), 2, 0))
    assert seen == [list(range(20, 60))]


def test_damage_stops_the_tail(spark, tmp_path):
    log = CommitLog(str(tmp_path / "log"))
    frames = spark.createDataFrame([(0, 121, 1, b"x", 1)], "segment_id bigint, log_pos bigint, size bigint, frame binary, crc bigint")
    commit_frames(log, frames, 0)
    with pytest.raises(Exception, match="checksum failed at 0:121"):
        query = tail_segments(spark, log, BatchStore(str(tmp_path / "tail")), lambda df, _: df.collect()).trigger(availableNow=True).start()
        query.awaitTermination()


def test_what_waits_far_behind_a_gap_is_not_touched(spark, tmp_path, monkeypatch):
    """Ids from 101 on wait in ranges; batches in front of the gap read none of them, until it is filled."""
    schema = "key string, value binary, topic string, partition int, offset bigint, committed boolean"

    def messages(ids):
        rows = [(f"k{i}", f'{{"seqid":{i},"data":["eA=="]}}'.encode(), "changes", i % 3, i, True) for i in ids]
        return spark.createDataFrame(rows, schema).coalesce(1)

    store, folder, reads = BatchStore(str(tmp_path / "store")), str(tmp_path / "topic"), []
    between = Shelf.between

    def counting(self, session, columns, first, last, at="at"):
        found = between(self, session, columns, first, last, at)
        reads.append((first, last, sorted({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}, key=int)))
        return found

    monkeypatch.setattr(Shelf, "between", counting)
    batches = [range(101, 181), range(1, 11), [*range(11, 21), 150], [*range(21, 95), 5], range(95, 101), range(181, 200)]
    for ids in batches:
        messages(ids).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run(resequence_stream(stream, store, span=20))
    assert reads == [
        (0, -1, []), (0, 9, ["0"]), (10, 19, ["0"]), (20, 93, ["1", "2", "3", "4"]),
        (94, 179, ["4", "5", "6", "7", "8"]), (180, 198, ["9"]),
    ]
    got = [(r.batch, r.seqid) for r in store.read(spark, "released").orderBy("batch", "d").collect()]
    assert [s for _, s in got] == list(range(1, 200))
    assert sum(b == 4 for b, _ in got) == 86
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "store" / "shelf").glob("bucket=*"))
    assert kept == [9]  # what was released is gone


def test_a_shelf_has_few_folders_however_much_a_batch_brings(spark, tmp_path):
    """Wide and narrow ranges side by side: all rows of a stretch are found, and what is past is removed."""
    shelf, schema = Shelf(str(tmp_path / "shelf"), 10), spark.range(1).withColumnRenamed("id", "at").schema
    for batch_id, (first, end) in enumerate([(5000, 9000), (0, 100), (100, 5000)]):
        shelf.add(spark.range(first, end).withColumnRenamed("id", "at"), batch_id)
    folders = [p for p in (tmp_path / "shelf").rglob("bucket=*")]
    assert len(folders) <= 3 * 64
    for first, last in ((0, 4), (95, 105), (4990, 5010), (0, 8999), (3, 2)):
        assert sorted(r.at for r in shelf.between(spark, schema, first, last).collect()) == list(range(first, last + 1))
    shelf.forget(spark, 5003)
    assert sorted(r.at for r in shelf.between(spark, schema, 5003, 8999).collect()) == list(range(5003, 9000))
    assert not shelf.between(spark, schema, 0, 4000).collect()


@pytest.mark.parametrize("harm", ["frame", "tail", "nothing"])
def test_a_damaged_last_segment_is_written_again_before_more_is_appended(spark, tmp_path, harm):
    """Damage at rest, then a restart: every id once, in the places it had; readers ahead of the damage go on."""
    path, store, log = str(tmp_path / "in"), BatchStore(str(tmp_path / "store")), CommitLog(str(tmp_path / "log"))
    reader, seen = BatchStore(str(tmp_path / "reader")), []

    def replay(first, end):
        new = spark.range(first, end, numPartitions=1).select(
            F.lit("k").alias("key"),
            encode_envelope(F.col("id") + 1, F.array(F.lit("some bytes").cast("binary"), F.col("id").cast("string").cast("binary"))).cast("binary").alias("value"),
            F.lit(0).alias("partition"), F.col("id").alias("offset"), (F.col("id") % 5 == 4).alias("committed"),
        )
        new.write.mode("append").parquet(path)
        stream = spark.readStream.schema(new.schema).parquet(path)
        run(resequence_stream(stream, store, segment_limit=300, log=log))

    def read():
        run(tail_segments(spark, log, reader, lambda df, batch_id: seen.extend(r.seqid for r in df.collect())))

    replay(0, 37)
    replay(37, 60)
    read()
    intact = sorted(tuple(r) for r in log.read(spark).drop("batch").collect())
    last = log.manifests(spark)[-1]
    rows = log.rows(spark, [last]).drop("batch")
    if harm == "frame":
        worst = F.when(F.col("segment_id") == last.facts["segment"], F.lit("?").cast("binary")).otherwise(F.col("frame"))
        log.replace(rows.withColumn("frame", worst), last)
    if harm == "tail":
        log.replace(rows.where(F.col("segment_id") < last.facts["segment"]), last)
    before = len(log.manifests(spark))
    replay(60, 80)
    frames = log.read(spark).drop("batch")
    assert len(log.manifests(spark)) == before + 1
    assert set(intact) <= {tuple(r) for r in frames.collect()}
    assert sorted(r.seqid for r in frames.collect()) == sorted([*range(1, 81)] * 2)
    assert {r.stop_reason for r in verify_segments(frames).collect()} == {"eof"}
    assert repair_tail(spark, log, store, 300) == [] == repair_tail(spark, log, store, 300, from_segment=0)
    read()
    assert sorted(seen) == sorted([*range(1, 81)] * 2)


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, tmp_path, monkeypatch):
    assert files.shared_path(spark, str(tmp_path)) == f"file:{tmp_path}"
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    assert files.shared_path(spark, f"{checkpoint_root(spark)}/x").startswith("file:")
    assert files.shared_path(spark, "file:" + spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/x")
    with pytest.raises(ValueError, match="one machine"):
        files.shared_path(spark, str(tmp_path))
