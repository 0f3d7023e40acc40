import tracemalloc

import edge
import numpy as np
import pyarrow as pa
import pytest
import reference
from test_dedup import family

from logweave.llm import tokengroups, words
from logweave.llm.shingles import sets_of


def edited(random, words, edits):
    words = words[:]
    for at in random.integers(0, len(words), edits):
        words[at] = f"e{random.integers(0, 10**9)}"
    return words


def families():
    """Copies of templates with few and many edits, fragments and extensions, and documents that share a passage."""
    random = np.random.default_rng(8)
    rows, number = [], 0
    for f in range(3):
        base = [f"t{f}_{i}" for i in range(150)]
        for k in range(90):
            words = edited(random, base, int(random.integers(0, 9)))
            if k % 5 == 0:
                words = words[: int(random.integers(60, 150))]
            elif k % 7 == 0:
                words += [f"x{f}_{k}_{i}" for i in range(int(random.integers(0, 60)))]
            rows.append((number, " ".join(words)))
            number += 1
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(int(random.integers(1, 60))))) for i in range(80)]
    rows += [(2000 + i, " ".join(f"s{(i // 2) % 9}_{k}" for k in range(i % 7))) for i in range(40)]
    return rows + [(3000 + d, t) for d, t in family()]


@pytest.mark.parametrize("group, percent, width", [(1, 80, 5), (4, 85, 3), (64, 80, 5)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, group, percent, width):
    monkeypatch.setattr(tokengroups, "QUERIES", 16)
    rows = families()
    want = reference.components_of(rows, width, percent)
    got = tokengroups.similarity_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), width, percent, group=group).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 20 < len({c for _, c in want.values()}) < len(rows)


def test_odd_rows(spark):
    got = tokengroups.similarity_join(edge.frame(spark), 3, 85).collect()
    assert len(got) == len(edge.rows())
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[None] == {None}
    assert {d: next(iter(c)) for d, c in of.items() if d} == {d: {4: 1, 5: 1, 7: 6, 9: 8, 12: 11}.get(d, d) for d in of if d}
    assert tokengroups.similarity_join(edge.empty(spark)).count() == 0


def test_a_group_finds_links_only_within_its_bound():
    random = np.random.default_rng(2)
    pool = np.sort(random.integers(0, 1 << 40, 60))
    arrays = [np.sort(random.choice(pool, int(n), replace=False)) for n in random.integers(1, 50, 20)]
    group = tokengroups.Group(list(range(20)), [len(a) for a in arrays], np.concatenate(arrays))
    for sid, query in enumerate(arrays):
        for percent in (50, 80):
            both = [len(np.intersect1d(query, a)) for a in arrays]
            want = [m for m, a in enumerate(arrays) if m != sid and 100 * both[m] >= percent * (len(a) + len(query) - both[m])]
            assert group.linked_to(query, sid, percent).tolist() == want
    assert all((group.holds[:, m].sum() == len(a)) for m, a in enumerate(arrays))
    assert [bin(b).count("1") for b in group.bits()] == group.holds.sum(axis=1).tolist()


def test_first_tokens_always_meet():
    for percent in (80, 85):
        for n in range(1, 400):
            look, due = tokengroups.covered_first(n, percent)
            least = -(-percent * n // 100)
            assert 1 <= due <= look <= n and look - due >= n - least - (n == look)


def test_sets_of_many_texts_take_little_memory(monkeypatch):
    """Six workers of an executor share its memory with the JVM: each one's arrays are those of one chunk."""
    monkeypatch.setattr(words, "_powers", {})
    texts = pa.array([" ".join(f"word{i}x{k}" for k in range(100)) for i in range(6000)])
    tracemalloc.start()
    try:
        assert sum(len(s) for s in sets_of(texts, 5)) == 6000 * 96
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
