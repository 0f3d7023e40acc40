"""Block-parallel cutting against the plain fold, with blocks far smaller than a pack and far larger."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.operators import greedy
from logweave.operators.greedy import greedy_pack


def fold(rows, max_size, max_count, base=0):
    """rows: (pos, run, size, eligible) in order -> {pos: (part, is_cut)}"""
    out, run, size, count, part = {}, None, 0, 0, 0
    for pos, r, s, ok in rows:
        if r != run:
            run, size, count, part = r, base, 0, 0
        size, count = size + s, count + 1
        cut = ok and ((max_size is not None and size > max_size) or (max_count is not None and count > max_count))
        out[pos] = (part, cut)
        if cut:
            size, count, part = base, 0, part + 1
    return out


@pytest.mark.parametrize("max_size,max_count,base", [(100, None, 0), (None, 5, 0), (60, 4, 0), (1000, 40, 0), (300, None, 120)])
def test_matches_fold(spark, monkeypatch, max_size, max_count, base):
    monkeypatch.setattr(greedy, "FAN_IN", 3)
    rng = random.Random(max_size or 7)
    data, expected = [], {}
    for scope in range(4):
        rows, run = [], 0
        uniform = scope == 1
        for pos in range(400):
            if scope != 0 and rng.random() < (0.2 if scope == 2 else 0.01):
                run += 1
            rows.append((pos, run, 10 if uniform else rng.randint(0, 40), scope != 3 or rng.random() < 0.3))
        data += [(scope, *r) for r in rows]
        expected[scope] = fold(rows, max_size, max_count, base)
    for span in (3, 17, 1000):
        df = spark.createDataFrame(pd.DataFrame(data, columns=["scope", "pos", "run", "size", "ok"]).sample(frac=1, random_state=1))
        df = df.withColumn("blk", F.floor(F.col("pos") / span).cast("bigint"))
        got = greedy_pack(
            df, ["scope"], ["blk"], ["pos"], "size", max_size, max_count, "ok", "run", base_size=base, levels={3: 3, 17: 2, 1000: 0}[span]
        ).toPandas()
        assert len(got) == len(data)
        for r in got.itertuples():
            assert (r.part, r.is_cut) == expected[r.scope][r.pos], (span, r)


def test_many_files_of_one_small_block(spark, monkeypatch):
    """Blocks are composed over the borders of files, and no Python call is made for a single block."""
    monkeypatch.setattr(greedy, "FAN_IN", 4)
    rng = random.Random(5)
    rows = [(pos, pos // 37, rng.randint(0, 40), rng.random() < 0.5) for pos in range(600)]
    expected = fold(rows, 150, None)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["pos", "run", "size", "ok"]).sample(frac=1, random_state=1))
    df = df.withColumns({"scope": F.lit(0), "file": F.format_string("f%05d", F.floor(F.col("pos") / 3)), "blk": F.lit(0).cast("bigint")})
    got = greedy_pack(df, ["scope"], ["file", "blk"], ["pos"], "size", 150, None, "ok", "run", levels=2)
    calls = [line for line in got._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMap" in line]
    assert calls and not any("file" in line.split("(")[0] for line in calls)
    found = got.toPandas()
    assert {r.pos: (r.part, r.is_cut) for r in found.itertuples()} == expected and len(found) == len(rows)


def test_groups_over_batches():
    rows = [("a", 1)] * 3 + [("b", 1)] * 5 + [("b", 2)] + [("c", 1)] * 4
    table = pa.table({"k": [r[0] for r in rows], "n": [r[1] for r in rows], "i": list(range(len(rows)))})
    for size in (1, 2, 3, 5, 100):
        groups = [
            t["i"].to_pylist()[a:z] for t, starts, ends in greedy._whole_groups(iter(table.to_batches(size)), ["k", "n"]) for a, z in zip(starts, ends)
        ]
        assert groups == [[0, 1, 2], [3, 4, 5, 6, 7], [8], [9, 10, 11, 12]]


def test_composed_blocks_stay_small():
    """Records of one size never meet at a cut: the worst case for the number of steps."""
    limit, per_block, size = 10_000, 40, 100
    blocks = []
    for _ in range(27):
        b = greedy._Block(np.zeros(per_block, np.int64), np.full(per_block, size), np.ones(per_block, bool), limit, greedy._NO_LIMIT)
        blocks.append(greedy._Steps(0, 0, 0, (int(b.cum[-1]), b.n, 0), b.steps()))
    tiers = [blocks]
    while len(tiers[-1]) > 1:
        groups = [tiers[-1][i : i + 3] for i in range(0, len(tiers[-1]), 3)]
        composed = [greedy._composed(g, limit, greedy._NO_LIMIT) for g in groups]
        tiers.append([greedy._Steps.read(pa.table(c))[0] for c in composed])
        assert max(len(x.steps["hi_cum"]) for x in tiers[-1]) <= limit // size + 1
    assert len(tiers) == 4
    for held in range(0, limit + 1, 700):
        want = (held, held // size, 0)
        for block in blocks:
            want = tuple(int(x[0]) for x in block.ends(*(np.array([v]) for v in want), limit, greedy._NO_LIMIT))
        got = tuple(int(x[0]) for x in tiers[-1][0].ends(*(np.array([v]) for v in (held, held // size, 0)), limit, greedy._NO_LIMIT))
        assert got == want


def test_key_hash_vectors():
    from logweave.functions.hashing import hash_keys

    # published vectors of the standard variant (Kafka's own client tests)
    known = {b"21": -973932308, b"foobar": -790332482, b"a-little-bit-long-string": -985981536, b"abc": 479470107}
    got = hash_keys(pa.array(list(known), pa.binary()), standard_tail=True).astype("int32").tolist()
    assert got == list(known.values())
    # keys of whole words do not depend on the tail rule; others read it from the start of the key
    plain = pa.array([b"", b"abcd", b"abc"], pa.binary())
    assert (hash_keys(plain) == hash_keys(plain, standard_tail=True)).all()
    assert hash_keys(pa.array([b"abcde"], pa.binary())) != hash_keys(pa.array([b"abcde"], pa.binary()), standard_tail=True)
