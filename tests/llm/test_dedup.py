from collections import Counter

import edge
import hashlib
import numpy as np
import pytest
import reference

from logweave.llm import exact, lines, minmax, mixing, components


def test_components_of_random_graphs(spark):
    random = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in alone}


def family():
    """Near copies in a chain: neighbours are alike, the ends are not; and texts that share a passage only."""
    base = [f"w{i}" for i in range(120)]
    chain = []
    for i in range(60):
        base = base[:]
        base[(i * 17) % 120] = f"x{i}"
        chain.append((1000 + i, " ".join(base)))
    passage = " ".join(f"p{i}" for i in range(30))
    return chain + [(2000 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(25))) for i in range(40)]


@pytest.mark.parametrize("small", [1, 3, 64])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(minmax, "SMALL", small)
    rows = family()
    want = reference.components_of(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minmax.near_duplicates(docs, width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_on_odd_rows(spark):
    got = minmax.near_duplicates(edge.frame(spark), width=3, percent=85).collect()
    assert len(got) == len(edge.rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by_id[None] == {(None, True)}
    assert by_id[1] == by_id[1] and {next(iter(by_id[d]))[0] for d in (1, 4, 5)} == {1}
    assert by_id[2] == {(2, True)} and by_id[3] == {(3, True)} and by_id[13] == {(13, True)}
    assert by_id[7] == {(6, False)} and by_id[9] == {(8, False)} and by_id[12] == {(11, False)} and by_id[10] == {(10, True)}
    kept = minmax.without_near_duplicates(edge.frame(spark), width=3, percent=85)
    assert kept.columns == edge.frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 6, 8, 10, 11, 13, 14, 15, 16, None}
    assert minmax.near_duplicates(edge.empty(spark)).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    same = (minmax.signature(minmax.mix(a)) == minmax.signature(minmax.mix(b))).mean()
    assert abs(same - 900 / 1100) < 0.1
    assert minmax.band_rows(85) == 6 and minmax.band_rows(80) == 5


@pytest.mark.parametrize("hot", [1, 256])
def test_exact_groups_on_odd_rows(spark, hot):
    rows = edge.rows() + [(100 + i, "hot text", None, "a", 0, 0, 0, "", "", "") for i in range(50)]
    docs = spark.createDataFrame(rows, edge.SCHEMA).repartition(4)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    got = exact.exact_groups(docs, hot=hot).collect()
    largest = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    want = Counter((d, largest[t or ""], len(groups[t or ""]), digest[t or ""]) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    whole = exact.without_exact_copies(docs)
    assert whole.columns == docs.columns
    assert Counter(((r.text or ""), r.doc_id) for r in whole.collect()) == Counter((t, largest[t]) for t in groups)


def test_exact_groups_of_nothing(spark):
    assert exact.exact_groups(edge.empty(spark)).count() == 0
    assert exact.without_exact_copies(edge.empty(spark)).count() == 0


def filled(sizes, weights, most):
    """Targets by filling up by weight and stopping, again and again."""
    total, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = (total - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * share > most * sizes[i]}
        for i in open_:
            target[i] = weights[i] * share
        for i in over:
            target[i] = float(most * sizes[i])
        if not over:
            break
        open_ -= over
    return target


def test_mix_reaches_targets(spark):
    random = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), f"s{min(4, i % 7)}" if i % 11 else None) for i, n in enumerate(random.integers(0, 200, 1500))]
    rows += [(5000, "tiny", "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))
    size = {d: len(t.split()) for d, t, _ in rows}
    sources = sorted({s for *_, s in rows if s is not None}) + [None]
    sums = [sum(size[d] for d, _, s in rows if s == x) for x in sources]
    target = dict(zip(sources, filled(sums, [[5, 2, 1][i % 3] for i in range(len(sources))], 3)))
    of = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sums[sources.index(of[r.doc_id])]
        assert abs(r.target - target[of[r.doc_id]]) < 1e-6 * sum(sums) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[of[r.doc_id]] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 200 + 0.01 * t
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_odd_rows(spark):
    docs = edge.frame(spark)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(edge.rows())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(edge.empty(spark)).count() == 0 and mixing.mixed_documents(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [0, 50_000])
def test_lines_common_in_a_site_are_dropped(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    rows = [(i, f"nav {i % 2}\nbody {i}\n\nnav {i % 2}\nrare {i // 2}", "h" if i % 3 else None) for i in range(30)] + [(90, None, "h"), (91, "nav 1", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    pages, total = Counter(), Counter(s for *_, s in rows)
    for _, t, s in rows:
        pages.update({(s, x) for x in (t or "").split("\n") if x.strip()})
    gone = {k for k, n in pages.items() if n >= 3 and n > total[k[0]] * 0.2}
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(docs, ratio=0.2).collect()}
    for d, t, s in rows:
        parts = t.split("\n") if t is not None else []
        left = [x for x in parts if (s, x) not in gone]
        assert got[d] == (None if t is None else "\n".join(left), len(parts), len(parts) - len(left))
    assert any(n for _, _, n in got.values())


def test_lines_of_odd_rows(spark):
    out = lines.drop_boilerplate(edge.frame(spark), ratio=0.1)
    assert out.count() == len(edge.rows()) and lines.drop_boilerplate(edge.empty(spark)).count() == 0
