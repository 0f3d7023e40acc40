import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logweave.llm import radix, trie


def plain(rows, block=100, most=5):
    """(conv, turn, role, text) rows to the trie's rows, by listing every prefix."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        order = sorted(turns, key=lambda u: (u[0], u[1], hashlib.md5(f"{len(u[2])}:{u[2]}{u[3]}".encode()).digest()))
        convs[c] = [u[2:] for u in order]
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - int(np.fmod(c, block))
        whole[c] = tuple(convs.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out[(m[0], len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def talks():
    random = np.random.default_rng(12)
    rows = []
    for c in range(260):
        n = int(random.integers(1, 9))
        rows += [(c, i, ["user", "assistant"][i % 2], f"t{random.integers(0, 3)}é") for i in range(n)]
    long = [("user", f"long {i}") for i in range(70)]
    for c, cut in ((300, 70), (301, 70), (306, 45), (333, 66), (402, 70), (403, 70)):  # long ones that share more than a window
        rows += [(c, i, r, x if i < cut or c < 310 else x + "!") for i, (r, x) in enumerate(long)]
    rows += [(5000 + c, i, "system", f"same {i}") for c in range(0, 900, 10) for i in range(6)]  # copies
    rows += [(7, None, None, None), (7, None, "user", "first"), (8, 1, "user", "tie"), (8, 1, "assistant", "tie"), (8, 1, "assistant", "tie")]
    rows += [(None, 1, "user", "nobody"), (-5, 0, "user", "t1é"), (9007, 0, "user", ""), (9100, 0, None, None)]
    return rows


@pytest.mark.parametrize("window, chunk, most", [(2, 7, 5), (4, 64, 0), (32, 20_000, 5)])
def test_nodes_are_those_of_all_prefixes(spark, monkeypatch, window, chunk, most):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "LARGEST_WINDOW", 8 if window == 2 else 512)
    frame = spark.createDataFrame(talks(), "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = trie.conversation_trie(frame, most=most, window=window)
    assert got.columns == trie.COLUMNS
    want = plain(talks(), most=most)
    found = Counter(map(tuple, got.collect()))
    assert sum(found.values()) == sum(want.values())
    assert found == want


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, id string, pos string")
    assert trie.conversation_trie(frame).count() == 0


def test_radix_tree_keeps_keys_in_order_and_grows():
    random = np.random.default_rng(0)
    keys = {bytes(random.integers(0, 256, int(n), dtype=np.uint8)) for n in random.integers(1, 5, 3000)} | {b"", b"\x00", b"\xff" * 9} | {b"zz" + bytes((i,)) for i in range(0, 250, 8)}
    root = radix.Node()
    for i, key in enumerate(keys):
        radix.insert(root, key, i, more=i % 3 == 0)
    found, sizes = {}, set()
    for node, start, whole in radix.bottom_up(root):
        assert whole.endswith(node.path) and start <= len(whole)
        sizes.add(node.kids.size)
        for i in node.ends + node.goes:
            found[whole] = i
        bytes_in_order = [b for b, _ in node.kids.items()]
        assert bytes_in_order == sorted(bytes_in_order) and all(node.kids.find(b) is not None for b in bytes_in_order)
    assert found == {key: i for i, key in enumerate(keys)}
    assert sizes == {4, 16, 48, 256}
