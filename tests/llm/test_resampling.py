import hashlib
import math
import re
import zlib
from collections import Counter

import edge
import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import resampling

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text, run):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent, least, run, buckets, seed=2024):
    def of(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text, run)[1]]

    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of(x))
        rows.append((d, len(of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(x, run)[0])))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [r[:4] + (i + 1,) for i, r in enumerate(able) if i < percent * len(able) // 100]
    rest = [r[:4] + (None,) for r in able[len(drawn) :]] + [r[:4] + (None,) for r in rows if r[4] < least]
    return Counter(drawn + rest)


@pytest.mark.parametrize("run, buckets, percent", [(1, 10_000, 30), (3, 97, 50), (2, 100_000, 100)])
def test_scores_and_draw_equal_the_plain_ones(spark, run, buckets, percent):
    docs = edge.frame(spark).repartition(3)
    target = spark.createDataFrame([("to be, or NOT to be",), (None,), ("word1 of1 word2 é",)], "text string")
    got = resampling.importance_scores(docs, target, percent=percent, least_words=4, run=run, buckets=buckets)
    want = plain([r[:2] for r in edge.rows()], [r[0] for r in target.collect()], percent, 4, run, buckets)
    assert Counter(map(tuple, got.drop("text_hash").collect())) == want
    drawn = resampling.drawn_documents(docs, target, percent=percent, least_words=4, run=run, buckets=buckets)
    assert drawn.columns == docs.columns and drawn.count() == sum(n for r, n in want.items() if r[4] is not None)


def test_no_rows_and_no_target(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.importance_scores(edge.empty(spark), none).count() == 0
    assert resampling.drawn_documents(edge.empty(spark), none).count() == 0
    got = resampling.importance_scores(edge.frame(spark), none, percent=50, least_words=1)
    assert got.count() == len(edge.rows()) and got.filter("rank = 1").count() == 1


@pytest.mark.parametrize("widest", [4, 256])
def test_crcs_of_segments(monkeypatch, widest):
    monkeypatch.setattr(resampling, "WIDEST", widest)
    random = np.random.default_rng(1)
    data = random.integers(0, 4, 3000, dtype=np.uint8)
    starts = random.integers(0, 2900, 500)
    ends = starts + random.integers(1, 30, 500)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.segment_crcs(data, starts, ends).tolist() == want
    assert resampling.segment_crcs(data, starts[:0], ends[:0]).tolist() == []


def test_a_text_longer_than_a_chunk():
    long = "Wort " * 1_000_000 + "x" * 70_000
    rows = list(resampling.text_buckets(pa.array(["a", long, None, "b c"]), 1, 1 << 20))
    assert [n for n, _ in rows] == [1, 1_000_001, 0, 2]
    assert rows[1][1][0] == zlib.crc32(b"wort") % (1 << 20) and rows[1][1][-1] == zlib.crc32(b"x" * 70_000) % (1 << 20)
